"""Running sums and ranks over a stream, however long: in shards, plus what comes before each shard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.shards import SHARD_ROWS, ShardPlan, plan_shards


def running_sums(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], sums: Mapping[str, Column], plan: ShardPlan | None = None) -> DataFrame:
    """df with a column for each of ``sums``: its sum over the stream's rows up to and with this one.

    ``ts`` (an integer) leads the order, ``order`` are the columns after it.  A shard's
    offset comes from one row for each shard, so no task sorts a whole stream.
    """
    keys = list(keys)
    plan = plan or plan_shards(df, keys, ts)
    rows = df.withColumn("_shard", plan.of(F.col(ts)))
    w = Window.partitionBy(*keys, "_shard").orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_x_{n}": x for n, x in sums.items()})
    inside = rows.withColumns({n: F.sum(f"_x_{n}").over(w) for n in sums})
    if plan.shards > 1:
        total = rows.groupBy(*keys, "_shard").agg(*[F.sum(f"_x_{n}").alias(f"_o_{n}") for n in sums])
        before = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
        total = total.select(*keys, "_shard", *[F.coalesce(F.sum(f"_o_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
        inside = inside.join(total, [*keys, "_shard"]).withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums})
    return inside.select(*df.columns, *sums)


def ranked(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], name: str = "n", plan: ShardPlan | None = None) -> DataFrame:
    """df with the place of each row in its stream, from 1."""
    return running_sums(df, keys, ts, order, {name: F.lit(1).cast("bigint")}, plan)


def islands(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], value: str, plan: ShardPlan | None = None) -> DataFrame:
    """Runs of neighbouring rows with the same value: keys, value, first, last (of ``ts``), length.

    Within shards first; then the first and last piece of each shard are put together
    where their values go on.  Nulls are equal to each other.
    """
    keys = list(keys)
    plan = plan or plan_shards(df, keys, ts)
    rows = df.select(*keys, F.col(ts).alias("_t"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(value).alias("_v")).withColumn("_shard", plan.of(F.col("_t")))
    w = Window.partitionBy(*keys, "_shard").orderBy("_t", *[f"_o{i}" for i in range(len(order))])
    rows = rows.withColumns({"_head": F.row_number().over(w) == 1, "_tail": F.lead("_t").over(w).isNull(), "_go": F.lag("_v").over(w).eqNullSafe(F.col("_v"))})
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_head") | ~F.col("_go"), 1).otherwise(0)).over(w))
    piece = rows.groupBy(*keys, "_shard", "_run").agg(F.max("_v").alias("_v"), F.min("_t").alias("first"), F.max("_t").alias("last"), F.count("*").alias("n"), F.max("_head").alias("_head"), F.max("_tail").alias("_tail"))
    piece = piece.withColumn("_part", F.when(F.col("_head") | F.col("_tail"), F.lit(None)).otherwise(F.col("_shard")))
    e = Window.partitionBy(*keys, "_part").orderBy("_shard", "_run")
    piece = piece.withColumn("_joins", F.col("_head") & (F.row_number().over(e) > 1) & F.lag("_v").over(e).eqNullSafe(F.col("_v")))
    piece = piece.withColumn("_whole", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(e))
    out = piece.groupBy(*keys, "_part", "_whole").agg(F.max("_v").alias(value), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("length"))
    return out.select(*keys, value, "first", "last", "length")


def in_blocks(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], before: int = 0, after: int = 0, plan: ShardPlan | None = None, rows: int = SHARD_ROWS) -> DataFrame:
    """df in blocks of ``rows`` rows of a stream, each with the ``before`` rows ahead of it and the ``after`` rows behind.

    Adds _rank (place in the stream, from 1), _block and _own (false for the rows of
    other blocks).  A window over keys and _block in order of _rank that looks back no
    more than ``before`` rows and ahead no more than ``after`` sees for own rows what one
    over the whole stream would; ``own_rows`` then drops the others.  Streams that fit
    one block are only ranked.
    """
    keys = list(keys)
    plan = plan or plan_shards(df, keys, ts, rows)
    if plan.shards == 1:
        return df.withColumns({"_rank": F.row_number().over(Window.partitionBy(*keys).orderBy(ts, *order)).cast("bigint"), "_block": F.lit(0).cast("bigint"), "_own": F.lit(True)})
    size = max(rows, before, after)
    out = ranked(df, keys, ts, order, "_rank", plan).withColumn("_home", F.floor((F.col("_rank") - 1) / size).cast("bigint"))
    place = F.pmod(F.col("_rank") - 1, F.lit(size))
    homes = F.array(F.col("_home"), F.when(place >= size - before, F.col("_home") + 1), F.when((place < after) & (F.col("_home") > 0), F.col("_home") - 1))
    out = out.withColumn("_block", F.explode(F.filter(homes, lambda x: x.isNotNull())))
    return out.withColumn("_own", F.col("_block") == F.col("_home")).drop("_home")


def own_rows(df: DataFrame) -> DataFrame:
    """What ``in_blocks`` was given, and the columns since."""
    return df.where("_own").drop("_rank", "_block", "_own")


def block_window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, "_block").orderBy("_rank")
