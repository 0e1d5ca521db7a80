"""Irregular readings onto regular grids.

Grid points are made by time shard, readings are cut into the same shards (narrow
enough for the readings and for the points of the busiest source), and each shard is given the two readings before and after it, wherever they lie
("halo").  A vectorised binary search puts readings into cells; between readings
a shape-preserving monotone cubic (Fritsch and Carlson's condition, with the
weighted harmonic mean of the neighbouring slopes) gives values, except across
gaps longer than allowed, which stay marked.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.shards import SHARD_ROWS, ShardPlan, plan_shards

READING, FILLED, MISSING = "reading", "filled", "missing"
#: Readings of the halo on each side of a shard: what a cubic between two needs.
HALO = 2

_OUT = pa.schema([("job", pa.string()), ("k0", pa.string()), ("k1", pa.string()), ("g", pa.int64()), ("status", pa.string()), ("value", pa.float64()), ("smooth", pa.float64()), ("long_gap", pa.bool_())])
_DDL = "job string, k0 string, k1 string, g bigint, status string, value double, smooth double, long_gap boolean"


def _slopes(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Slope at each reading.  0 at turns; at the ends of a segment that of the one side there is."""
    n = len(x)
    m = np.zeros(n)
    if n < 2:
        return m
    h = np.diff(x)
    s = np.diff(y) / h
    left, right = np.zeros(n), np.zeros(n)
    left[1:], right[:-1] = s, s
    hl, hr = np.ones(n), np.ones(n)
    hl[1:], hr[:-1] = h, h
    has_l, has_r = np.zeros(n, bool), np.zeros(n, bool)
    has_l[1:], has_r[:-1] = ~apart, ~apart
    w1, w2 = 2 * hr + hl, hr + 2 * hl
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.where(left * right > 0, (w1 + w2) / (w1 / left + w2 / right), 0.0)
    return np.where(has_l & has_r, inner, np.where(has_l, left, np.where(has_r, right, 0.0)))


def monotone_cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray, max_gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Values at the points ``at``, NaN outside of a segment, and whether a point lies in a long gap."""
    i = np.searchsorted(x, at, side="right") - 1
    exact = (i >= 0) & (x[np.maximum(i, 0)] == at)
    inside = (i >= 0) & (i < len(x) - 1)
    j = np.clip(i, 0, max(0, len(x) - 2))
    if len(x) < 2:
        return np.where(exact, y[np.maximum(i, 0)], np.nan), np.zeros(len(at), bool)
    apart = np.diff(x) > max_gap
    m = _slopes(x, y, apart)
    h = x[j + 1] - x[j]
    u = (at - x[j]) / h
    w = (1 - u) * (1 - u)
    v = y[j] * (1 + 2 * u) * w + m[j] * h * u * w + y[j + 1] * u * u * (3 - 2 * u) + m[j + 1] * h * u * u * (u - 1)
    long_gap = inside & apart[j] & ~exact
    v = np.where(exact, y[np.maximum(i, 0)], np.where(inside & ~long_gap, v, np.nan))
    return v, long_gap


def _onto_grid(readings: pa.Table, points: pa.Table, max_gap: float) -> pa.Table:
    n = points.num_rows
    if not n:
        return _OUT.empty_table()
    t, y, ident = (readings[c].to_numpy() for c in ("t", "y", "id"))
    order = np.lexsort((ident, t))
    t, y = t[order], y[order]
    last = np.append(t[1:] != t[:-1], True) if len(t) else np.zeros(0, bool)  # of equal times, the highest id
    t, y = t[last], y[last]
    g, step, start, fill = (points[c].to_numpy(zero_copy_only=False) for c in ("g", "step", "start", "fill"))
    if not len(t):
        status, value, smooth, long_gap = np.full(n, MISSING, object), np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, bool)
    else:
        i = np.searchsorted(t, g, side="right") - 1
        at = np.where(i >= 0, t[np.maximum(i, 0)], np.iinfo(np.int64).min)
        fresh, earlier = at > np.maximum(g - step, start), at > start
        status = np.where(fresh, READING, np.where(fill & earlier, FILLED, MISSING)).astype(object)
        value = np.where(status != MISSING, y[np.maximum(i, 0)], np.nan)
        smooth, long_gap = monotone_cubic(t.astype(float), y, g.astype(float), max_gap)
    nan = lambda x: pa.array(x, mask=np.isnan(x))
    return pa.table([points["job"].combine_chunks(), points["k0"].combine_chunks(), points["k1"].combine_chunks(), pa.array(g), pa.array(status, pa.string()), nan(value), nan(smooth), pa.array(long_gap)], schema=_OUT)


def plan_grid(readings: DataFrame, jobs: DataFrame, rows: int) -> ShardPlan:
    """Width at which the busiest source has about ``rows`` readings a shard, and no more points of all its jobs.

    A slow source may have few readings and a grid of any number of points.
    """
    plan = plan_shards(readings, ["k0", "k1"], "t", rows, least=60_000)
    jobs = jobs.where(F.col("step").isNotNull() & (F.col("step") > 0) & (F.col("start") <= F.col("end")))
    per = jobs.groupBy("k0", "k1").agg(F.sum(1.0 / F.col("step")).alias("rate"), F.sum((F.col("end") - F.col("start")) / F.col("step")).alias("points"), F.min("start").alias("lo"), F.max("end").alias("hi"))
    got = per.agg(F.max("rate").alias("rate"), F.max("points").alias("points"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if not got["points"] or got["points"] <= rows:
        return plan
    width = min(plan.width, max(1, int(rows / got["rate"])))
    return ShardPlan(width, max(plan.shards * -(-plan.width // width), -(-(int(got["hi"]) - int(got["lo"]) + 1) // width)))


def _job_shards(jobs: DataFrame, plan: ShardPlan) -> DataFrame:
    """Each job once for each shard in which it has points, the a-th to the b-th."""
    first, end = F.col("start") + F.col("step"), F.col("end")
    jobs = jobs.where(F.col("step").isNotNull() & (F.col("step") > 0) & (first <= end))
    jobs = jobs.withColumn("shard", F.explode(F.sequence(plan.of(first), plan.of(end))))
    lo, hi = plan.first(F.col("shard")), plan.last(F.col("shard"))
    k0 = F.greatest(F.lit(1).cast("bigint"), F.ceil((lo - F.col("start")) / F.col("step"))).cast("bigint")
    k1 = F.floor((F.least(hi, end) - F.col("start")) / F.col("step")).cast("bigint")
    return jobs.withColumn("a", k0).withColumn("b", k1).where(F.col("a") <= F.col("b"))


def _grid_points(jobs: DataFrame) -> DataFrame:
    return jobs.select("job", "k0", "k1", "start", "step", "fill", "shard", F.explode(F.sequence("a", "b")).alias("k")).select("job", "k0", "k1", (F.col("start") + F.col("k") * F.col("step")).alias("g"), "step", "start", "fill", "shard")


def _halos(cut: DataFrame, wanted: DataFrame) -> DataFrame:
    """The HALO readings before and after each wanted shard of a stream, as rows of that shard.

    A shard's first and last readings are enough to know; there are at most 2 * HALO of
    them for each shard, so the windows over a whole stream stay small.
    """
    w = Window.partitionBy("k0", "k1", "shard").orderBy("t", "id")
    edge = cut.withColumn("n", F.row_number().over(w)).withColumn("ahead", F.lead("t", HALO).over(w)).where((F.col("n") <= HALO) | F.col("ahead").isNull())
    edge = edge.select("k0", "k1", "shard", F.struct("t", "id", "y").alias("r"))
    o = Window.partitionBy("k0", "k1").orderBy("r")
    edge = edge.withColumn("to", F.array(F.lag("r").over(o), F.col("r"))).withColumn("on", F.array(F.col("r"), F.lead("r").over(o))).withColumn("known", F.lit(True))
    asked = wanted.select("k0", "k1", "shard").distinct().withColumn("known", F.lit(False))
    both = edge.unionByName(asked, allowMissingColumns=True)
    # false sorts before true: a question stands before the readings of its own shard, in
    # either direction, and so meets only readings of other shards.
    past = Window.partitionBy("k0", "k1").orderBy("shard", "known", "r")
    ahead = Window.partitionBy("k0", "k1").orderBy(F.col("shard").desc(), "known", F.col("r").desc())
    both = both.withColumn("before", F.last("to", True).over(past)).withColumn("after", F.last("on", True).over(ahead)).where(~F.col("known"))
    none = F.array().cast(edge.schema["to"].dataType)
    halo = both.select("k0", "k1", "shard", F.explode(F.concat(F.coalesce("before", none), F.coalesce("after", none))).alias("h")).where(F.col("h").isNotNull())
    return halo.select("k0", "k1", "shard", "h.t", "h.id", "h.y")


def regular_grid(
    readings: DataFrame,
    keys: tuple[str, str],
    ts: str,
    id: str,
    value: str,
    jobs: DataFrame,
    max_gap: int,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row for each grid point of each job: job, the keys, grid_ts, status, value, smooth, long_gap.

    ``jobs`` has one row for each job and source: job, the keys under their names, and
    start, end, step (BIGINT, in the unit of ``ts``) and fill (BOOLEAN).  Grid points
    are start + k * step for k = 1, 2, ... up to end; a reading belongs to point g if
    its time lies in (g - step, g].  status: ``reading`` if there is one; else
    ``filled`` if fill is true and a reading lies before within the job (after start);
    else ``missing``.  value: the last reading up to g, null if missing.  smooth: the
    monotone cubic through the source's readings at g; null before the first, after the
    last, and in a gap longer than ``max_gap``, where long_gap is true.

    Defined results: readings with a null key, time or value do not count; of several at
    one time the highest id counts; jobs with a null key, a null or not positive step, or
    null times have no points; a null fill means true; a job named twice for a source has
    its points twice; sources without readings have only missing points; empty tables
    give no rows; other columns are never read.
    """
    cut = readings.select(F.col(keys[0]).cast("string").alias("k0"), F.col(keys[1]).cast("string").alias("k1"), F.col(ts).cast("bigint").alias("t"), F.coalesce(F.col(id).cast("bigint"), F.lit(-1)).alias("id"), F.col(value).cast("double").alias("y")).dropna()
    ask = jobs.select(F.col("job").cast("string").alias("job"), F.col(keys[0]).cast("string").alias("k0"), F.col(keys[1]).cast("string").alias("k1"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("step").cast("bigint").alias("step"), F.coalesce(F.col("fill"), F.lit(True)).alias("fill"))
    for c in ("k0", "k1", "start", "end"):
        ask = ask.where(F.col(c).isNotNull())
    plan = plan_grid(cut, ask, shard_rows)
    cut = cut.withColumn("shard", plan.of(F.col("t")))
    ask = _job_shards(ask, plan)
    points = _grid_points(ask)
    cut = cut.unionByName(_halos(cut, ask))

    def onto(r: pa.Table, p: pa.Table) -> pa.Table:
        return _onto_grid(r, p, float(max_gap))

    got = cut.groupBy("k0", "k1", "shard").cogroup(points.groupBy("k0", "k1", "shard")).applyInArrow(onto, _DDL)
    return got.select("job", F.col("k0").alias(keys[0]), F.col("k1").alias(keys[1]), F.col("g").alias("grid_ts"), "status", "value", "smooth", "long_gap")
