"""Implausible readings: physical bounds, frozen values and spikes.

Per source, a Hampel filter (distance from the rolling median, in units of the
median absolute deviation from it) finds values that leap away and come back; run
lengths find frozen values; bounds find impossible ones.

Two passes over the readings.  The first measures what is usual for a source: the
median absolute deviation from the rolling median, and the median step.  These are
exact medians over all records of the source, so that no verdict hangs on how the
source is cut.  The second judges.

Sources are split into time shards.  What is said of a record depends on the
``REACH`` records before and after it, so a shard settles all but its outermost
records.  Those go on, with as many beside them, to a round with wider shards,
until one shard holds what is left of a source.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.quantile import weighted_median
from quern.shards import SHARD_ROWS, plan_shards
from quern.workdir import fresh_dir

#: Records on each side that a verdict may depend on.
REACH = 24
#: Shards of one round that make one of the next.
WIDER = 1000
#: Records without a time are judged in groups of so many ids.
ID_BLOCK = 1_000_000
#: Values are held as whole multiples of this.
UNIT = 10**8


@dataclass(frozen=True)
class Rules:
    """half: records of the rolling window on each side of the middle one.
    deviations: distance from the rolling median, in scaled median absolute deviations, of a spike.
    steps: least distance of a spike in usual steps, for sources that hardly deviate.
    times: multiple of the usual value that is a spike, where levels have no meaning.
    stay: longest stretch of records, repeats aside, that counts as a spike.
    frozen: equal values in a row that count as frozen."""

    half: int = 4
    deviations: float = 24.0
    steps: float = 18.0
    times: float = 64.0
    stay: int = 2
    frozen: int = 20


#: What a median absolute deviation is multiplied by to equal the standard deviation of normal values.
NORMAL = 1.4826
#: Sources with fewer values, repeats aside, have no spikes.
LEAST = 3


def _frozen(v: np.ndarray, ok: np.ndarray, least: int) -> np.ndarray:
    n = len(v)
    new = np.ones(n, bool)
    new[1:] = (v[1:] != v[:-1]) | ~ok[1:] | ~ok[:-1]
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n))
    return np.repeat(length, length) >= least


def _rolling_median(v: np.ndarray, half: int) -> np.ndarray:
    """Median over half records before, the middle one and half after; fewer at the ends."""
    width = 2 * half + 1
    padded = np.concatenate([np.full(half, np.inf), v, np.full(half, np.inf)])
    win = np.sort(np.lib.stride_tricks.sliding_window_view(padded, width), axis=1)
    i = np.arange(len(v))
    count = np.minimum(i + half, len(v) - 1) - np.maximum(i - half, 0) + 1
    return (win[i, (count - 1) // 2] + win[i, count // 2]) / 2


def _brief(x: np.ndarray, far: np.ndarray, reach: float, stay: int) -> np.ndarray:
    """Of the far values, those whose own level lasts for no more than stay records."""
    level = np.cumsum(np.concatenate([[True], (np.abs(np.diff(x)) > reach) | (far[1:] != far[:-1])]))
    return far & (np.bincount(level)[level] <= stay)


def _once(v: np.ndarray, ok: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the values that count, which of these are kept, and for each the kept one it repeats.

    A repeat has the mark and the value of a record at most REACH places before it.
    """
    at = np.flatnonzero(ok)
    if not key.any():
        return at, np.arange(len(at)), np.arange(len(at))
    order = np.lexsort((at, v[at], key[at]))
    k, x, place = key[at][order], v[at][order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (k[1:] == 0) | (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (np.diff(place) > REACH)
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    kept = np.sort(order[new])
    of = np.empty(len(at), np.int64)
    of[order] = np.searchsorted(kept, first)
    return at, kept, of


def _spikes(v: np.ndarray, ok: np.ndarray, key: np.ndarray, level: bool, scale: float, rules: Rules) -> np.ndarray:
    """Whether each record leaps away and comes back; a repeat has the verdict of its first.

    scale: the distance of a spike, or the usual value where levels have no meaning; 0: no spikes.
    """
    out = np.zeros(len(v), bool)
    at, kept, of = _once(v, ok, key)
    if not len(at) or not scale > 0:
        return out
    x = v[at[kept]].astype(float)
    if level:
        reach, far = scale, np.abs(x - _rolling_median(x, rules.half)) > scale
    else:
        reach, far = (rules.times - 1) * scale, x > rules.times * scale
    out[at] = _brief(x, far, reach, rules.stay)[of]
    return out


_ROW = [("src", pa.int32()), *((f"k{i}", pa.string()) for i in range(2)), ("t", pa.int64()), ("id", pa.int64()), ("v0", pa.int64()), ("v1", pa.int64()), ("key", pa.int64()), ("shard", pa.int64()), ("done", pa.bool_())]
#: bad: bits of the values found wrong.
_JUDGED = pa.schema([*_ROW, ("bad", pa.int32())])
_JUDGED_DDL = "src int, k0 string, k1 string, t bigint, id bigint, v0 bigint, v1 bigint, key bigint, shard bigint, done boolean, bad int"
#: what: 2 * column for distances (doubled) or values, 2 * column + 1 for steps, -1 for a record that goes on, -2 for a shard (x).  x occurs n times.
_MEASURED = pa.schema([*_ROW, ("what", pa.int32()), ("x", pa.int64()), ("n", pa.int64())])
_MEASURED_DDL = _JUDGED_DDL.removesuffix("bad int") + "what int, x bigint, n bigint"


def _mine(n: int, done: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which of n records in order this round settles, and which the next one needs."""
    i = np.arange(n)
    if last:
        return ~done, np.zeros(n, bool)
    if n < 4 * REACH:
        return np.zeros(n, bool), np.ones(n, bool)
    return ~done & (i >= REACH) & (i < n - REACH), (i < 2 * REACH) | (i >= n - 2 * REACH)


def _column(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column's values and where there are any."""
    col = rows[name].combine_chunks()
    return col.fill_null(0).to_numpy(), col.is_valid().to_numpy(zero_copy_only=False)


def _measure(rows: pa.Table, rules: dict[int, Rules], levels: dict[int, tuple[bool, bool]], first: bool, last: bool) -> pa.Table:
    """One round of measuring over one shard: how often each distance, step and value occurs, and what goes on.

    A negative shard holds what has been counted.
    """
    src, shard = rows["src"][0].as_py(), rows["shard"][0].as_py()
    if shard < 0:
        return rows
    rows = rows.take(pa.array(np.lexsort((rows["id"].to_numpy(), rows["t"].to_numpy()))))
    n = rows.num_rows
    done, key = rows["done"].to_numpy(zero_copy_only=False).copy(), rows["key"].to_numpy()
    mine, keep = _mine(n, done, last)
    counts: list[tuple[int, np.ndarray, np.ndarray]] = [(-2, np.array([shard]), np.array([1]))] if first else []
    if mine.any():
        for c, level in enumerate(levels[src]):
            v, there = _column(rows, f"v{c}")
            at, kept, _ = _once(v, there & (v > 0), key)
            x, own = v[at[kept]], mine[at[kept]]
            if not level:
                counts.append((2 * c, *np.unique(x[own], return_counts=True)))
            elif len(x):
                twice = np.abs(2 * x - np.rint(2 * _rolling_median(x.astype(float), rules[src].half)).astype(np.int64))
                step = np.abs(np.diff(x, prepend=x[0]))
                counts += [(2 * c, *np.unique(twice[own], return_counts=True)), (2 * c + 1, *np.unique(step[own & (step > 0)], return_counts=True))]
    done |= mine
    goes = rows.set_column(8, "shard", pa.array(np.full(n, shard // WIDER))).set_column(9, "done", pa.array(done)).filter(pa.array(keep)).select([f.name for f in _MEASURED]).cast(_MEASURED)
    tables = [goes]
    for what, x, count in counts:
        m = len(x)
        same = {"src": src, "k0": rows["k0"][0].as_py(), "k1": rows["k1"][0].as_py(), "shard": -1 - shard, "done": True, "what": what}
        tables.append(pa.table([pa.array(x) if f.name == "x" else pa.array(count) if f.name == "n" else pa.nulls(m, f.type) if f.name not in same else pa.repeat(pa.scalar(same[f.name], f.type), m) for f in _MEASURED], schema=_MEASURED))
    return pa.concat_tables(tables)


def _judge(rows: pa.Table, scales: pa.Table, rules: dict[int, Rules], levels: dict[int, tuple[bool, bool]], last: bool) -> pa.Table:
    """One round of judging over one shard: sets bad where a verdict is possible, and keeps what the next round needs.

    A negative shard holds records that are settled, or have no time.
    """
    if not rows.num_rows:
        return _JUDGED.empty_table()
    src, shard = rows["src"][0].as_py(), rows["shard"][0].as_py()
    settled = shard < 0
    done = rows["done"].to_numpy(zero_copy_only=False)
    if settled and done.all():
        return rows
    if not settled:
        rows = rows.take(pa.array(np.lexsort((rows["id"].to_numpy(), rows["t"].to_numpy()))))
    n = rows.num_rows
    done, bad = rows["done"].to_numpy(zero_copy_only=False).copy(), rows["bad"].to_numpy().copy()
    mine, keep = (~done, np.zeros(n, bool)) if settled else _mine(n, done, last)
    if mine.any():
        key, r = rows["key"].to_numpy(), rules[src]
        for c, level in enumerate(levels[src]):
            v, there = _column(rows, f"v{c}")
            wrong = there & (v <= 0)
            if not settled:
                scale = scales[f"scale{c}"][0].as_py() if scales.num_rows else None
                wrong |= there & _frozen(v, there, r.frozen)
                wrong |= _spikes(v, there & (v > 0), key, level, scale or 0.0, r)
            bad[mine & wrong] |= 1 << c
    done |= mine
    # Found and not needed as a neighbour: put aside, in a group for each shard.
    aside = ~keep & (bad > 0)
    keep |= aside
    wide = np.where(aside, -1 - shard, shard // WIDER) if not settled else np.full(n, shard)
    out = rows.set_column(8, "shard", pa.array(wide)).set_column(9, "done", pa.array(done)).set_column(10, "bad", pa.array(bad))
    return out.filter(pa.array(keep)).select([f.name for f in _JUDGED]).cast(_JUDGED)


def _measure_round(rules: dict[int, Rules], levels: dict[int, tuple[bool, bool]], first: bool, last: bool):
    return lambda rows: _measure(rows, rules, levels, first, last)


def _judge_round(rules: dict[int, Rules], levels: dict[int, tuple[bool, bool]], last: bool):
    return lambda rows, scales: _judge(rows, scales, rules, levels, last)


@dataclass(frozen=True)
class Readings:
    """A table with two measured columns: its keys (two), time, id and values, whether
    each value moves in steps from level to level, and what marks a repeated record."""

    name: str
    table: DataFrame
    keys: tuple[str, str]
    ts: str
    id: str
    values: tuple[str, str]
    levels: tuple[bool, bool] = (True, True)
    repeat: Column | None = None
    rules: Rules = Rules()


def _units(c: str) -> Column:
    return (F.col(c).cast("decimal(18,8)") * UNIT).cast("bigint")


_GROUP = ("src", "k0", "k1", "shard")


def _one_shard(rows: DataFrame) -> DataFrame:
    """For the last round: what is left of a source in one shard."""
    return rows.withColumn("shard", F.when(F.col("shard") < 0, F.col("shard")).otherwise(F.lit(0).cast("bigint")))


def _scales(spark: SparkSession, rows: DataFrame, rounds: list[bool], rules: dict[int, Rules], levels: dict[int, tuple[bool, bool]]) -> DataFrame:
    """src, k0, k1, shard, scale0, scale1: of each source the distance of a spike, or the usual value; null without spikes.

    A written table of one row for each shard.
    """
    rows = rows.where("shard >= 0").withColumns({"what": F.lit(-1), "x": F.lit(None).cast("bigint"), "n": F.lit(None).cast("bigint")})
    for n, last in enumerate(rounds):
        rows = (_one_shard(rows) if last else rows).groupBy(*_GROUP).applyInArrow(_measure_round(rules, levels, n == 0, last), _MEASURED_DDL)
    at = fresh_dir(spark, "usual")
    counts = rows.where("what != -1").groupBy("src", "k0", "k1", "what", "x").agg(F.sum("n").alias("n"))
    counts.write.parquet(f"{at}/counts")
    counts = spark.read.schema(counts.schema).parquet(f"{at}/counts")
    usual = weighted_median(counts.where("what >= 0"), ["src", "k0", "k1", "what"], "x", "n")
    of = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    out = usual.groupBy("src", "k0", "k1").agg(*[x for c in range(2) for x in (of(2 * c, "median").alias(f"mid{c}"), of(2 * c, "n").alias(f"n{c}"), of(2 * c + 1, "median").alias(f"step{c}"))])
    for c in range(2):
        scale = F.lit(None).cast("double")
        for n, r in rules.items():
            reach = F.greatest(F.lit(r.deviations * NORMAL) * F.col(f"mid{c}") / 2, F.lit(r.steps) * F.col(f"step{c}"))
            scale = F.when(F.col("src") == n, reach if levels[n][c] else F.col(f"mid{c}")).otherwise(scale)
        out = out.withColumn(f"scale{c}", F.when(F.col(f"n{c}") >= LEAST, scale))
    shards = counts.where("what = -2").select("src", "k0", "k1", F.col("x").alias("shard"))
    out = shards.join(out.select("src", "k0", "k1", "scale0", "scale1"), ["src", "k0", "k1"])
    out.write.parquet(f"{at}/scales")
    return spark.read.schema(out.schema).parquet(f"{at}/scales")


def flag_outliers(spark: SparkSession, sources: Sequence[Readings], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rec_table, rec_id, field_name: one row for each bad value of the sources.

    A value is bad if it is 0 or below; if it is one of ``frozen`` or more equal
    values in a row; or if it is a spike for at most ``stay`` records, repeats aside:
    farther from the rolling median than ``deviations`` scaled median absolute deviations
    and than ``steps`` usual steps of its source (without levels: above ``times`` the
    source's usual value).  The median absolute deviation is that from the rolling
    median, the usual step the median step that is not 0, both over all records of the
    source above 0.

    Defined results: a missing value is never bad and ends a row of equal ones; a
    record with a null key or time can only be out of bounds; records at the same time
    go by id; a repeat (same ``repeat`` mark, same value, at most ``REACH`` records
    later) has the verdict of its first record; a source of fewer than ``LEAST`` values
    has no spikes; an empty table gives no rows; other columns are never read.  Values
    are compared exactly, as DECIMAL(18,8).
    """
    rows, plan = None, None
    rules = {n: s.rules for n, s in enumerate(sources)}
    levels = {n: s.levels for n, s in enumerate(sources)}
    for n, s in enumerate(sources):
        r = s.table.select(F.lit(n).alias("src"), *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(s.keys)], F.col(s.ts).cast("bigint").alias("t"), F.col(s.id).cast("bigint").alias("id"), *[_units(c).alias(f"v{i}") for i, c in enumerate(s.values)], (F.coalesce(F.xxhash64(s.repeat), F.lit(0)) if s.repeat is not None else F.lit(0)).cast("bigint").alias("key"))
        p = plan_shards(s.table, list(s.keys), s.ts, shard_rows)
        plan = p if plan is None or p.width < plan.width else plan
        rows = r if rows is None else rows.unionByName(r)
    known = F.col("t").isNotNull() & F.col("k0").isNotNull() & F.col("k1").isNotNull()
    # Times may be negative, shards must not be: they count from the earliest time possible.
    low = (-(2**62)) // plan.width
    rows = rows.withColumn("shard", F.when(known, plan.of(F.col("t")) - F.lit(low)).otherwise(-1 - F.floor(F.abs(F.col("id")) / ID_BLOCK))).withColumn("t", F.coalesce("t", F.lit(0).cast("bigint"))).withColumn("id", F.coalesce("id", F.lit(-1).cast("bigint")))
    rows = rows.withColumn("shard", F.col("shard").cast("bigint")).withColumn("done", F.lit(False))
    rounds, left = [], plan.shards + 2
    while left > 1:
        rounds.append(False)
        left = left // WIDER
    rounds.append(True)
    scales = _scales(spark, rows, rounds, rules, levels)
    rows = rows.withColumn("bad", F.lit(0))
    for last in rounds:
        rows, told = (_one_shard(rows), _one_shard(scales).distinct()) if last else (rows, scales)
        told = told.groupBy(*[F.col(c).alias(f"{c}_") for c in _GROUP])
        rows = rows.groupBy(*_GROUP).cogroup(told).applyInArrow(_judge_round(rules, levels, last), _JUDGED_DDL)
        scales = scales.withColumn("shard", F.floor(F.col("shard") / WIDER)).distinct()
    name = F.element_at(F.array(*[F.lit(s.name) for s in sources]), F.col("src") + 1)
    field = F.array(*[F.array(*[F.lit(c) for c in s.values]) for s in sources])[F.col("src")]
    hit = F.filter(F.array(F.when(F.col("bad").bitwiseAND(1) > 0, field[0]), F.when(F.col("bad").bitwiseAND(2) > 0, field[1])), lambda x: x.isNotNull())
    return rows.where(F.col("bad") > 0).select(name.alias("rec_table"), F.col("id").alias("rec_id"), F.explode(hit).alias("field_name"))
