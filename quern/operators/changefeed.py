"""A feed of inserts, updates and deletes applied to rebuild a table.

A keyed streaming aggregation holds, for each key, the payload of the newest
change, its sequence and whether it was a delete (a tombstone, so that a late
older change cannot bring the row back).  Only newer changes are accepted.  Each
micro-batch emits the keys it changed into a folder of its own version; writing
a batch again replaces that folder, so a repeated batch changes nothing.  Versions
are merged into one base now and then, so that a reader has few of them to look through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.session import settings
from quern.workdir import Manifest, folders, fresh_dir, remove_dir

#: Versions that are left beside the base.
VERSIONS = 8
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest_changes(changes: DataFrame, keys: Sequence[str], sequence: Sequence[str | Column], payload: Sequence[str], deleted: Column) -> DataFrame:
    """keys and ``state`` (payload, seq, gone): of each key the change with the greatest sequence.

    Works on streams and on tables.  Changes of a key are combined before the shuffle,
    so a key that holds a third of all rows sends one row a task.
    """
    seq = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(-(2**62))).cast("bigint").alias(f"s{i}") for i, c in enumerate(sequence)]
    rows = changes
    for c in keys:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.select(*keys, F.struct(F.struct(*seq).alias("seq"), F.coalesce(deleted, F.lit(False)).alias("gone"), F.struct(*payload).alias("payload")).alias("state"))
    return rows.groupBy(*keys).agg(F.max("state").alias("state"))


class ChangeFeed:
    """The state of a table under a feed of changes, below ``path``.

    ``keys``: columns that name a row; ``sequence``: columns that order changes (a null
    counts as earliest); ``payload``: columns to keep; ``deleted``: whether a change
    removes its row.

    Defined results: changes with a null key are left out; of several changes with the
    same sequence a delete wins, then the greater payload, so that the result never
    depends on the order of arrival; a repeated change changes nothing; deletes of rows
    that don't exist leave only a tombstone; an empty feed gives an empty table; other
    columns of the feed are never read.
    """

    def __init__(self, spark: SparkSession, keys: Sequence[str], sequence: Sequence[str | Column], payload: Sequence[str], deleted: Column, path: str | None = None):
        self.spark, self.keys, self.sequence, self.payload, self.deleted = spark, list(keys), list(sequence), list(payload), deleted
        self.path = path or fresh_dir(spark, "changefeed")
        self.manifest = Manifest(spark, self.path)
        #: upto: versions from which the base was made.
        self.state = self.manifest.load() or {"schema": None, "base": None, "upto": -1}

    def run(self, stream: DataFrame) -> None:
        """Apply all that the stream has now; a later call, also of another process, goes on where this one ended."""
        state = newest_changes(stream, self.keys, self.sequence, self.payload, self.deleted)
        if self.state["schema"] != state.schema.jsonValue():
            if self.state["schema"]:
                raise ValueError(f"{self.path} holds rows of other columns")
            self.state["schema"] = state.schema.jsonValue()
            self.manifest.save(self.state)

        def emit(batch: DataFrame, version: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.path}/out/version={version}")

        with settings(self.spark, spark__sql__streaming__stateStore__providerClass=_ROCKS, spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true"):
            q = state.writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(emit).option("checkpointLocation", f"{self.path}/checkpoint").start()
            q.awaitTermination()
        if len(self._versions()) > VERSIONS:
            self.compact()

    def _versions(self) -> list[int]:
        """Those that are not in the base."""
        have = [int(n.removeprefix("version=")) for n in folders(self.spark, f"{self.path}/out") if n.startswith("version=")]
        return sorted(v for v in have if v > self.state["upto"])

    def _newest(self) -> DataFrame:
        if not self.state["schema"]:
            raise ValueError("no changes have been applied")
        schema = StructType.fromJson(self.state["schema"])
        paths = [f"{self.path}/out/version={v}" for v in self._versions()] + ([self.state["base"]] if self.state["base"] else [])
        out = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return out.groupBy(*self.keys).agg(F.max("state").alias("state"))

    def compact(self) -> None:
        """Merge all versions into one base; tombstones stay, as an older change may still come."""
        have = self._versions()
        if not have:
            return
        base, old = f"{self.path}/base-{have[-1]}", self.state["base"]
        self._newest().write.mode("overwrite").parquet(base)
        self.state |= {"base": base, "upto": have[-1]}
        self.manifest.save(self.state)
        for path in [f"{self.path}/out/version={v}" for v in have] + ([old] if old else []):
            remove_dir(self.spark, path)

    def rows(self, tombstones: bool = False) -> DataFrame:
        """The current table: of each key its newest version, without deleted rows."""
        now = self._newest()
        if not tombstones:
            now = now.where(~F.col("state.gone"))
        return now.select(*self.keys, "state.payload.*", *([F.col("state.gone").alias("deleted")] if tombstones else []))


def file_stream(spark: SparkSession, path: str, batches: int = 3) -> DataFrame:
    """The files of a Parquet table as a stream, in about as many micro-batches."""
    table = spark.read.parquet(path)
    files = len(table.inputFiles())
    # As a pattern the path may be one file as well as a folder of them.
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{path[:-1]}[{path[-1]}]")
