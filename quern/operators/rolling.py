"""Rolling totals over trailing periods, kept as versioned daily state.

For each entity and day the state holds the day's amounts and, for each period,
the totals up to that day.  A batch of arrivals recomputes the days it touches and
then only the dates whose periods hold such a day: yesterday's totals, plus the
day's amounts, less those of the day that expires.

The state is cut into blocks of days.  A batch reads the blocks that its dates lie
in or reach back to, writes new versions of those it changes, and puts them into the
manifest together, so the work of a batch does not grow with the history behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.workdir import Manifest, fresh_dir, remove_dir

_DAY = 86_400_000
_AMOUNT = "decimal(38,8)"
#: Days of one block of the state.
BLOCK_DAYS = 32


class RollingDays:
    """Daily amounts and totals over the last ``periods`` days of each entity, below ``path``.

    ``keys``: the entity; ``ts``: time of an event in Unix milliseconds, UTC;
    ``version``: which of several events of an entity at one time counts, the greatest;
    ``values``: measures to total.  ``active``: a measure of which a value above 0 makes
    a day one with activity.  A state that exists below ``path`` goes on from what it holds.

    Defined results: events with a null key or time are left out; a null measure adds
    nothing and is not counted; days without events between an entity's first and last
    day have rows with totals of what is still in the period; equal events count once;
    events with the same version are told apart by their values, the greater counts; a
    batch of a name that was applied before changes nothing, and so does an empty one;
    other columns are never read.
    """

    def __init__(self, spark: SparkSession, keys: Sequence[str], ts: str, version: Sequence[str], values: Sequence[str], active: str, periods: Sequence[int] = (7, 30), path: str | None = None):
        self.spark, self.keys, self.ts, self.order, self.values, self.active, self.periods = spark, list(keys), ts, list(version), list(values), active, sorted(periods)
        self.path = path or fresh_dir(spark, "rolling")
        self.manifest = Manifest(spark, self.path)
        made = {"keys": self.keys, "version": self.order, "values": self.values, "active": active, "periods": self.periods}
        state = self.manifest.load()
        if state and state["made"] != made:
            raise ValueError(f"{self.path} holds totals of other columns")
        #: blocks: of each table the version that each block of days is in now.
        self.state = state or {"made": made, "batches": [], "at": 0, "blocks": {"events": {}, "days": {}, "spans": {}}, "schemas": {}}
        self.amounts = [f"{p}_{v}" for v in self.values for p in ("sum", "n")]
        self.totals = [f"{a}_{p}" for p in self.periods for a in self.amounts]

    def _folder(self, name: str, block: int | str, version: int) -> str:
        return f"{self.path}/{name}/version={version}/block={block}"

    def _read(self, name: str, blocks: Sequence[int] | None = None) -> DataFrame | None:
        """The newest version of these blocks of a table, or of all; None where there is none."""
        have = self.state["blocks"][name]
        wanted = [b for b in have if blocks is None or int(b) in blocks]
        if not wanted:
            return None
        return self.spark.read.schema(StructType.fromJson(self.state["schemas"][name])).parquet(*[self._folder(name, b, have[b]) for b in sorted(wanted)])

    def _write(self, df: DataFrame, name: str, version: int, block: Column) -> None:
        df.withColumn("block", block).write.mode("overwrite").partitionBy("block").parquet(f"{self.path}/{name}/version={version}")
        self.state["schemas"][name] = df.schema.jsonValue()

    def days(self) -> DataFrame:
        """Each entity's days with their amounts and totals."""
        got = self._read("days")
        return got if got is not None else self.spark.createDataFrame([], self._day_schema())

    def _day_schema(self) -> StructType:
        if "days" not in self.state["schemas"]:
            raise ValueError("no batch has been applied")
        return StructType.fromJson(self.state["schemas"]["days"])

    def apply(self, arrivals: DataFrame, batch: str) -> None:
        """One batch of events: new ones, late ones and corrections."""
        if batch in self.state["batches"]:
            return
        k, kd, far = self.keys, [*self.keys, "day"], max(self.periods)
        this, block = self.state["at"] + 1, F.floor(F.col("day") / BLOCK_DAYS).cast("int")
        rank = F.struct(*[F.coalesce(F.col(c).cast("bigint"), F.lit(-(2**62))).alias(c) for c in self.order], *[F.col(v).cast(_AMOUNT).alias(v) for v in self.values])
        rows = arrivals
        for c in [*k, self.ts]:
            rows = rows.where(F.col(c).isNotNull())
        rows = rows.select(*k, F.col(self.ts).cast("bigint").alias("t"), rank.alias("event"))
        rows = rows.groupBy(*k, "t").agg(F.max("event").alias("event")).withColumn("day", F.floor(F.col("t") / _DAY).cast("int"))
        staged = f"{self.path}/incoming/version={this}"
        rows.write.mode("overwrite").parquet(f"{staged}/events")
        rows = self.spark.read.schema(rows.schema).parquet(f"{staged}/events")

        spans = self._read("spans")
        rows.select(*kd).distinct().write.mode("overwrite").parquet(f"{staged}/touched")
        hit = self.spark.read.schema(rows.select(*kd).schema).parquet(f"{staged}/touched")
        own = hit.groupBy(*k).agg(F.min("day").alias("first"), F.max("day").alias("last"))
        affected = self._affected(hit, own, spans)
        affected.write.mode("overwrite").parquet(f"{staged}/affected")
        affected = self.spark.read.schema(affected.schema).parquet(f"{staged}/affected")
        # Blocks come to the driver: one number for each month of dates.
        touched = [r[0] for r in hit.select(block).distinct().collect()]
        changed = [r[0] for r in affected.select(block).distinct().collect()]
        needed = {b for c in changed for b in range((c * BLOCK_DAYS - far) // BLOCK_DAYS, c + 1)}

        events = rows
        if (before := self._read("events", touched)) is not None:
            events = rows.unionByName(before).groupBy(*kd, "t").agg(F.max("event").alias("event")).select(*rows.columns)
        self._write(events, "events", this, block)
        events = self.spark.read.schema(events.schema).parquet(*[self._folder("events", b, this) for b in touched]) if touched else rows
        daily = events.join(hit, kd, "left_semi").groupBy(*kd).agg(*[x for v in self.values for x in (F.coalesce(F.sum(f"event.{v}"), F.lit(0)).cast(_AMOUNT).alias(f"sum_{v}"), F.count(f"event.{v}").cast(_AMOUNT).alias(f"n_{v}"))], F.max(F.coalesce(F.col(f"event.{self.active}") > 0, F.lit(False))).alias("active"), F.count("*").alias("events"))
        days = self._roll(daily, affected, self._read("days", sorted(needed)))
        self._write(days.where(block.isin(changed)), "days", this, block)
        whole = own if spans is None else own.unionByName(spans).groupBy(*k).agg(F.min("first").alias("first"), F.max("last").alias("last"))
        self._write(whole, "spans", this, F.lit(0))
        self._commit(batch, this, {"events": touched, "days": changed, "spans": [0] if touched else []})
        remove_dir(self.spark, staged)

    def _commit(self, batch: str, this: int, blocks: dict[str, list[int]]) -> None:
        old = []
        for name, new in blocks.items():
            now = self.state["blocks"][name]
            old += [self._folder(name, b, now[str(b)]) for b in new if str(b) in now]
            now |= {str(b): this for b in new}
        self.state |= {"batches": [*self.state["batches"], batch], "at": this}
        self.manifest.save(self.state)
        for path in old:
            remove_dir(self.spark, path)

    def _affected(self, touched: DataFrame, own: DataFrame, spans: DataFrame | None) -> DataFrame:
        """keys, day: dates whose periods hold a touched day, and those that an entity's span gains."""
        k, far = self.keys, max(self.periods)
        if spans is None:
            return own.select(*k, F.explode(F.sequence("first", "last")).alias("day"))
        own = own.join(spans.withColumnsRenamed({"first": "was_first", "last": "was_last"}), k, "left")
        hit = touched.join(own.select(*k, F.greatest("last", "was_last").alias("end")), k).select(*k, F.explode(F.sequence(F.col("day"), F.least(F.col("day") + far - 1, F.col("end")))).alias("day"))
        none = F.array().cast("array<int>")
        gained = F.when(F.col("was_first").isNull(), F.sequence("first", "last")).otherwise(
            F.concat(F.when(F.col("first") < F.col("was_first"), F.sequence(F.col("first"), F.col("was_first") - 1)).otherwise(none), F.when(F.col("last") > F.col("was_last"), F.sequence(F.col("was_last") + 1, F.col("last"))).otherwise(none))
        )
        return hit.unionByName(own.select(*k, F.explode(gained).alias("day"))).distinct()

    def _roll(self, changed: DataFrame, affected: DataFrame, old: DataFrame | None) -> DataFrame:
        """The days of the blocks read, with new amounts and totals where they are affected.

        Rows of an entity are brought together once; it has one for each day of the blocks.
        """
        k, kd = self.keys, [*self.keys, "day"]
        facts = [*self.amounts, "active", "events"]
        rows = changed.select(*kd, F.struct(*facts).alias("new")).unionByName(affected.select(*kd, F.lit(True).alias("affected")), allowMissingColumns=True)
        if old is not None:
            rows = rows.unionByName(old.select(*kd, F.struct(*facts, *self.totals).alias("old")), allowMissingColumns=True)
        else:
            rows = rows.withColumn("old", F.lit(None).cast("struct<" + ",".join([*(f"{a}:{_AMOUNT}" for a in self.amounts), "active:boolean", "events:bigint", *(f"{t}:{_AMOUNT}" for t in self.totals)]) + ">"))
        rows = rows.repartition(*k).groupBy(*kd).agg(*[F.first(c, True).alias(c) for c in ("new", "old", "affected")])
        zero = {**{a: F.lit(0).cast(_AMOUNT) for a in self.amounts}, "active": F.lit(False), "events": F.lit(0).cast("bigint")}
        rows = rows.select(*kd, F.coalesce("affected", F.lit(False)).alias("affected"), "old", *[F.coalesce(f"new.{c}", f"old.{c}", z).alias(c) for c, z in zero.items()])
        expiring = {p: Window.partitionBy(*k).orderBy("day").rangeBetween(-p, -p) for p in self.periods}
        yesterday = Window.partitionBy(*k).orderBy("day").rangeBetween(-1, -1)
        rows = rows.withColumns({f"{a}_gone_{p}": F.sum(a).over(w) for p, w in expiring.items() for a in self.amounts} | {"before": F.first("old").over(yesterday)})
        # Affected dates in a row form a stretch: only its first date takes yesterday's
        # totals from the state, the others build on the date before.
        starts = F.col("affected") & ~F.coalesce(F.first("affected").over(yesterday), F.lit(False))
        rows = rows.withColumn("starts", starts)
        rows = rows.withColumn("stretch", F.sum(F.col("starts").cast("int")).over(Window.partitionBy(*k).orderBy("day")))
        run = Window.partitionBy(*k, "affected", "stretch").orderBy("day")

        def total(a: str, p: int) -> Column:
            seed = F.when(F.col("starts"), F.coalesce(F.col(f"before.{a}_{p}"), F.lit(0))).otherwise(0)
            now = F.sum((seed + F.col(a) - F.coalesce(F.col(f"{a}_gone_{p}"), F.lit(0))).cast(_AMOUNT)).over(run)
            return F.when(F.col("affected"), now).otherwise(F.col(f"old.{a}_{p}")).cast(_AMOUNT).alias(f"{a}_{p}")

        return rows.select(*kd, *facts, *[total(a, p) for p in self.periods for a in self.amounts])
