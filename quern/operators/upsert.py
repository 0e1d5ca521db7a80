"""Messages delivered more than once, kept once.

Deliveries are upserted into storage that is bucketed by a hash of the identifier
and sorted by it within each bucket.  A batch of deliveries adds one sorted run, and
a ledger keeps the names of batches, so that a batch taken in again adds nothing.
Compaction reads the runs bucket by bucket, where equal identifiers meet and collapse
to one message; as the storage is bucketed, it moves no row between tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.session import settings
from quern.workdir import Manifest, fresh_dir, remove_dir

#: Messages that one bucket of the storage should hold.
BUCKET_ROWS = 5_000_000


def buckets_for(rows: int, least: int = 16) -> int:
    """How many buckets a store of so many messages should have."""
    return max(least, -(-rows // BUCKET_ROWS))


class MessageStore:
    """Messages by identifier, below ``path``.

    ``keys``: columns of the identifier, named in the storage; ``order``: columns that
    put deliveries in order, the first delivery being the least; ``fields``: what a
    message holds.  Of each field the value of the first delivery that has one is kept.
    ``buckets`` holds for a new store; one that exists keeps the number it was made with,
    and goes on from what it holds.

    Defined results: a delivery with a null in its identifier is left out (give such
    rows an identifier of their own first); nulls in ``order`` come last; deliveries that
    are equal in all columns count each and collapse like others; a batch of a name that
    was taken in before, also before a compaction or by another process, changes nothing;
    an empty batch adds nothing; other columns are never read.
    """

    def __init__(self, spark: SparkSession, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], buckets: int = 16, path: str | None = None):
        self.spark, self.keys, self.order, self.fields = spark, list(keys), list(order), list(fields)
        self.path = path or fresh_dir(spark, "messages")
        self.manifest = Manifest(spark, self.path)
        state = self.manifest.load()
        if state and (state["keys"], state["order"], state["fields"]) != (self.keys, self.order, self.fields):
            raise ValueError(f"{self.path} holds messages of other columns")
        self.state = state or {"keys": self.keys, "order": self.order, "fields": self.fields, "buckets": buckets, "schema": None, "runs": [], "batches": []}
        self.table = f"quern_messages_{uuid.uuid4().hex[:12]}"
        if state and state["schema"]:
            self._declare()

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    def _declare(self) -> None:
        """The storage under a name of this session; it lies below ``path`` whatever becomes of the name."""
        schema = StructType.fromJson(self.state["schema"])
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        keys = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"CREATE TABLE {self.table} ({cols}, run string) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (run) CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/runs'")
        if self.state["runs"]:
            self.spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def _add(self, rows: DataFrame) -> str:
        """Write rows as a run; each task has one bucket."""
        run = f"r{uuid.uuid4().hex[:12]}"
        rows.withColumn("run", F.lit(run)).write.insertInto(self.table)
        return run

    def _at(self) -> list[Column]:
        return [F.coalesce(F.col(o).cast("bigint"), F.lit(2**62)).alias(o) for o in self.order]

    def _combined(self) -> list[Column]:
        """The first delivery that has all fields, and of those that lack some the first with each field.

        Nearly all deliveries have all fields, so a row is hardly wider than a delivery.
        """
        whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in self.fields])
        first = F.min(F.when(whole, F.struct(F.struct(*self._at()).alias("at"), F.struct(*self.fields).alias("value")))).alias("whole")
        return [first, *[F.min(F.when(~whole & F.col(c).isNotNull(), F.struct(F.struct(*self._at()).alias("at"), F.col(c).alias("value")))).alias(f"only_{c}") for c in self.fields]]

    def _field(self, c: str) -> Column:
        """Of a field the value of the earlier of the two."""
        of_whole = F.when(F.col("whole").isNotNull(), F.struct(F.col("whole.at").alias("at"), F.col(f"whole.value.{c}").alias("value")))
        return F.array_min(F.array(of_whole, F.col(f"only_{c}")))["value"].alias(c)

    def upsert(self, deliveries: DataFrame, batch: str) -> None:
        """Add a batch of deliveries as one sorted run, unless it is in already.

        Deliveries of an identifier are combined before the shuffle, so an identifier
        that holds a third of all rows sends one row a task.  The shuffle has as many
        partitions as there are buckets and the same hash, so its tasks write their buckets.
        """
        if batch in self.state["batches"]:
            return
        rows = deliveries
        for c in self.keys:
            rows = rows.where(F.col(c).isNotNull())
        once = rows.groupBy(*self.keys).agg(*self._combined(), F.count("*").alias("deliveries"))
        if not self.state["schema"]:
            self.state["schema"] = once.schema.jsonValue()
            self._declare()
        with settings(self.spark, spark__sql__shuffle__partitions=str(self.buckets), spark__sql__adaptive__coalescePartitions__enabled="false"):
            run = self._add(once)
        self.state |= {"runs": [*self.state["runs"], run], "batches": [*self.state["batches"], batch]}
        self.manifest.save(self.state)

    def _runs(self) -> DataFrame:
        return self.spark.table(self.table).where(F.col("run").isin(self.state["runs"])).drop("run")

    def compact(self) -> DataFrame:
        """The messages, one for each identifier: the sorted runs of each bucket merged into one.

        A task reads its bucket of every run.  They are sorted, which its sort makes use of.
        """
        if len(self.state["runs"]) > 1:
            merged = self._runs().groupBy(*self.keys).agg(*[F.min(c).alias(c) for c in ("whole", *[f"only_{c}" for c in self.fields])], F.sum("deliveries").alias("deliveries"))
            old = self.state["runs"]
            # Small buckets are not worth a shuffle either.
            with settings(self.spark, spark__sql__sources__bucketing__autoBucketedScan__enabled="false"):
                self.state["runs"] = [self._add(merged)]
            self.manifest.save(self.state)
            for run in old:
                self.spark.sql(f"ALTER TABLE {self.table} DROP PARTITION (run = '{run}')")
                remove_dir(self.spark, f"{self.path}/runs/run={run}")
        return self.messages()

    def messages(self) -> DataFrame:
        """The compacted storage: keys, fields and the number of deliveries."""
        if not self.state["schema"]:
            raise ValueError("no batch has been taken in")
        if len(self.state["runs"]) > 1:
            return self.compact()
        return self._runs().select(*self.keys, *[self._field(c) for c in self.fields], F.col("deliveries").alias("n_deliveries"))
