"""Records paired with the record nearest in time of the same entity.

Both tables are co-grouped by entity and time shard; the searched side is given
to every shard within the tolerance of its time, so that the margins of shards
overlap.  Inside a group a vectorised binary search finds both neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.shards import SHARD_ROWS, plan_shards

_OUT = pa.schema([("tag", pa.int32()), ("id", pa.int64()), ("found", pa.int64()), ("gap", pa.int64())])


def _pair(searched: pa.Table, probes: pa.Table) -> pa.Table:
    if not searched.num_rows or not probes.num_rows:
        return _OUT.empty_table()
    t, ref = searched["t"].to_numpy(), searched["ref"].to_numpy()
    order = np.lexsort((ref, t))
    t, ref = t[order], ref[order]
    at, tol = probes["t"].to_numpy(), probes["tol"].to_numpy()
    after = np.searchsorted(t, at, side="right")
    left = np.searchsorted(t, t[np.maximum(after - 1, 0)], side="left")  # of equal times, the lowest id
    right = np.minimum(after, len(t) - 1)
    far = np.iinfo(np.int64).max
    before = np.where(after > 0, at - t[left], far)
    behind = np.where(after < len(t), t[right] - at, far)
    best = np.where(before <= behind, left, right)
    gap = np.minimum(before, behind)
    ok = gap <= tol
    return pa.table([probes["tag"].combine_chunks().filter(pa.array(ok)), probes["id"].combine_chunks().filter(pa.array(ok)), pa.array(ref[best[ok]]), pa.array(gap[ok])], schema=_OUT)


def match_nearest(searched: DataFrame, probes: DataFrame, keys: Sequence[str], searched_ts: str, searched_id: str, probe_ts: str, probe_id: str, tolerance: str, tag: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """tag, id, found, gap: each probe with the id of the searched record nearest in time.

    ``tolerance`` is a column of ``probes``, the largest gap allowed; of two equally
    near records the earlier wins, of several at the same time that with the lowest
    id.  Times are integers in one unit; ``tag`` is an INT that tells apart probes of
    several tables.

    Defined results: probes or records with a null key, time, id or tolerance match
    nothing; a probe with nothing near enough has no row; every probe row counts by
    itself, repeated or not; empty tables give an empty result; other columns are
    never read, whatever their names.
    """
    keys = list(keys)
    k = [f"k{i}" for i in range(len(keys))]
    a = searched.select(*[F.col(c).alias(x) for c, x in zip(keys, k)], F.col(searched_ts).cast("bigint").alias("t"), F.col(searched_id).cast("bigint").alias("ref")).dropna()
    b = probes.select(*[F.col(c).alias(x) for c, x in zip(keys, k)], F.col(probe_ts).cast("bigint").alias("t"), F.col(tolerance).cast("bigint").alias("tol"), F.col(tag).cast("int").alias("tag"), F.col(probe_id).cast("bigint").alias("id")).dropna()
    margin = b.agg(F.max("tol")).first()[0] or 0
    plan = plan_shards(a, k, "t", shard_rows, least=max(1, margin))
    a = a.withColumn("shard", F.explode(F.array_distinct(F.array(plan.of(F.col("t") - margin), plan.of(F.col("t")), plan.of(F.col("t") + margin)))))
    b = b.withColumn("shard", plan.of(F.col("t")))
    schema = "tag int, id bigint, found bigint, gap bigint"
    return a.groupBy(*k, "shard").cogroup(b.groupBy(*k, "shard")).applyInArrow(_pair, schema)
