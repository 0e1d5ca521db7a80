"""Data preparation: outliers, grids, change feeds, message stores, rolling days."""

import random
from datetime import datetime, timezone
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators.changefeed import ChangeFeed, newest_changes
from quern.operators.outliers import Readings, Rules, flag_outliers
from quern.operators.quantile import weighted_median
from quern.operators.regrid import _job_shards, monotone_cubic, plan_grid, regular_grid
from quern.operators.rolling import RollingDays
from quern.operators.upsert import MessageStore

D = Decimal


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ---- outliers

READ = "sym string, ven string, t bigint, id bigint, a decimal(18,8), b decimal(18,8), shard int, k0 string, bad int"


def readings(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 7, "x", 9) for r in rows], READ)
    return Readings("r", df, ("sym", "ven"), "t", "id", ("a", "b"), **kw)


def wave(n, sym="S", start=0, seed=1):
    rng = random.Random(seed)
    p, out = 100.0, []
    for i in range(n):
        p += rng.choice([-0.02, -0.01, 0.01, 0.02])
        out.append([sym, "V", start + i * 1000, i + 1, D(str(round(p, 2))), D(str(round(5 + rng.random(), 2)))])
    return out


def found(spark, src, **kw):
    return {(r[0], r[1]) for r in rows_of(flag_outliers(spark, [src], **kw), "rec_id", "field_name")}


def test_bounds_spikes_and_frozen_values(spark):
    rows = wave(300)
    rows[50][4] = D("0")
    rows[60][5] = D("-1")
    rows[100][4] *= 2
    rows[150][4] += 5
    rows[151][4] += 5
    for i in range(200, 220):
        rows[i][5] = D("7.5")
    got = found(spark, readings(spark, [tuple(r) for r in rows]))
    assert got == {(51, "a"), (61, "b"), (101, "a"), (151, "a"), (152, "a")} | {(i, "b") for i in range(201, 221)}


def test_a_level_that_stays_is_no_spike_and_nineteen_equal_values_are_not_frozen(spark):
    rows = wave(200)
    for i in range(100, 200):
        rows[i][4] += 50
    for i in range(20, 39):
        rows[i][5] = D("7.5")
    rows[39][5] = None
    rows[40][5] = D("7.5")
    assert found(spark, readings(spark, [tuple(r) for r in rows])) == set()


def test_shards_change_nothing(spark):
    rows = wave(900) + wave(700, "T", seed=5)
    for i, r in enumerate(rows):
        r[3] = i + 1
    rng = random.Random(3)
    for i in rng.sample(range(len(rows)), 40):
        rows[i][4] *= D(str(rng.choice([2, 10, "0.1"])))
    for a in (95, 330, 640):
        for i in range(a, a + 45):
            rows[i][5] = D("9")
    src = readings(spark, [tuple(r) for r in rows])
    whole = found(spark, src, shard_rows=10**9)
    assert len(whole) > 150
    assert found(spark, src, shard_rows=120) == whole


def test_a_change_of_regime_is_judged_alike_in_shards_of_any_width(spark):
    """A source that moves a hundred times as far after a fifth of its records, with leaps that only one of the regimes would call usual."""
    rng = random.Random(9)
    p, rows = 1000.0, []
    for i in range(3000):
        p += rng.choice([-1, 1]) * (0.01 if i < 600 else 1.0)
        rows.append(["S", "V", i * 1000, i + 1, D(str(round(p, 2))), D("5.5") + i % 7])
    for i in (200, 400):
        rows[i][4] += D("0.9")
    for i in (1000, 2000, 2999 - 30):
        rows[i][4] += D("60")
    for i in (500, 1500, 2500):
        rows[i][5] = D("999")
    src = readings(spark, [tuple(r) for r in rows], levels=(True, False))
    one = found(spark, src, shard_rows=10**9)
    assert one == {(i + 1, "a") for i in (1000, 2000, 2969)} | {(i + 1, "b") for i in (500, 1500, 2500)}
    assert found(spark, src, shard_rows=500) == one and found(spark, src, shard_rows=150) == one


def test_repeats_across_shards_have_the_verdict_of_their_first(spark):
    rows = [[*r, f"m{r[3]}"] for r in wave(600)]
    for i in (120, 240, 360, 480):
        rows[i][4] *= 3
        rows[i + 1 : i + 1] = [[*rows[i][:2], rows[i][2] + n, 10_000 + 10 * i + n, *rows[i][4:]] for n in range(1, 5)]
    df = spark.createDataFrame([tuple(r) for r in rows], "sym string, ven string, t bigint, id bigint, a decimal(18,8), b decimal(18,8), mark string")
    src = Readings("r", df, ("sym", "ven"), "t", "id", ("a", "b"), repeat=F.col("mark"))
    one = found(spark, src, shard_rows=10**9)
    assert len(one) == 20 and {c for _, c in one} == {"a"}
    assert found(spark, src, shard_rows=120) == one


def test_median_of_weighted_values_is_exact(spark):
    rng = random.Random(12)
    rows = [(g, x, rng.randrange(1, 5)) for g in range(6) for x in rng.sample(range(10 ** (g + 2)), 5 * g + 1)]
    got = {r[0]: (r[1], r[2]) for r in weighted_median(spark.createDataFrame(rows, "g int, x bigint, c bigint"), ["g"], "x", "c").collect()}
    each = {g: [x for h, x, c in rows if h == g for _ in range(c)] for g in range(6)}
    assert got == {g: (len(v), float(np.median(v))) for g, v in each.items()}


def test_nulls_times_and_empty_tables(spark):
    rows = [("S", "V", None, 1, D(0), D(1), 0, "", 0), (None, "V", 5, 2, D(-3), D(1), 0, "", 0), ("S", "V", 7, 3, None, None, 0, "", 0), ("S", "V", 8, 4, D(100), D(1), 0, "", 0)]
    df = spark.createDataFrame(rows, READ)
    src = Readings("r", df, ("sym", "ven"), "t", "id", ("a", "b"))
    assert found(spark, src) == {(1, "a"), (2, "a")}
    assert found(spark, Readings("r", df.limit(0), ("sym", "ven"), "t", "id", ("a", "b"))) == set()


def test_sizes_by_usual_value_and_repeats(spark):
    rows = wave(200)
    rows[90][5] = D("900")
    again = [rows[90][:] for _ in range(3)]
    for n, r in enumerate(again):
        r[3] = 1000 + n
    src = readings(spark, [tuple(r) for r in rows + again], levels=(True, False), repeat=F.col("a").cast("string"))
    assert found(spark, src) == {(91, "b"), (1000, "b"), (1001, "b"), (1002, "b")}
    assert Rules().frozen == 20


# ---- grids

GRID = "sym string, ven string, t bigint, id bigint, y double, job string, status string"
JOB = "job string, sym string, ven string, start bigint, end bigint, step bigint, fill boolean"


def grid(spark, rows, jobs, **kw):
    r = spark.createDataFrame([(*x, "no", "no") for x in rows], GRID)
    return regular_grid(r, ("sym", "ven"), "t", "id", "y", spark.createDataFrame(jobs, JOB), kw.pop("max_gap", 10**9), **kw)


def test_grid_cells_are_closed_on_the_right(spark):
    rows = [("S", "V", 110, 1, 1.0), ("S", "V", 120, 2, 2.0), ("S", "V", 141, 3, 3.0)]
    jobs = [("f", "S", "V", 100, 160, 10, True), ("m", "S", "V", 100, 160, 10, False), ("none", "X", "V", 100, 120, 10, None), ("late", "S", "V", 120, 140, 10, True), ("no", "S", "V", 0, 50, None, True)]
    got = rows_of(grid(spark, rows, jobs), "job", "grid_ts", "status")
    assert [x for x in got if x[0] == "f"] == [("f", g, s) for g, s in ((110, "reading"), (120, "reading"), (130, "filled"), (140, "filled"), (150, "reading"), (160, "filled"))]
    assert [x[2] for x in got if x[0] == "m"] == ["reading", "reading", "missing", "missing", "reading", "missing"]
    assert [x for x in got if x[0] == "none"] == [("none", 110, "missing"), ("none", 120, "missing")]
    assert [x for x in got if x[0] == "late"] == [("late", 130, "missing"), ("late", 140, "missing")]  # a reading at the start is none of the window
    assert not [x for x in got if x[0] == "no"]


def test_grid_shards_exchange_halos(spark):
    rng = random.Random(2)
    rows = [(s, "V", rng.randrange(0, 40_000_000), i, rng.random()) for i, s in enumerate(rng.choices("ST", k=600))]
    rows += [("U", "V", 1_000_000, 900, 0.5), ("U", "V", 39_000_000, 901, 0.7)]
    jobs = [(f"{s}{n}", s, "V", n, 40_000_000, 500_000 + n, True) for s in "STU" for n in (0, 77)]
    one = rows_of(grid(spark, rows, jobs, shard_rows=10**9), "job", "grid_ts", "status", F.round("value", 9), F.round("smooth", 9), "long_gap")
    many = rows_of(grid(spark, rows, jobs, shard_rows=15), "job", "grid_ts", "status", F.round("value", 9), F.round("smooth", 9), "long_gap")
    assert one == many and len(one) > 400


def test_monotone_cubic_keeps_shape_and_marks_gaps():
    x, y = np.array([0.0, 1, 2, 3, 100, 101]), np.array([0.0, 0, 1, 1, 5, 6])
    at = np.linspace(0, 3, 61)
    v, gap = monotone_cubic(x, y, at, 10)
    assert (np.diff(v) >= -1e-12).all() and v.min() >= 0 and v.max() <= 1 and not gap.any()
    v, gap = monotone_cubic(x, y, np.array([-1.0, 50, 101, 102]), 10)
    assert np.isnan(v[[0, 1, 3]]).all() and v[2] == 6 and gap.tolist() == [False, True, False, False]


def test_a_fine_grid_over_a_slow_source_is_split(spark):
    year, day = 31_536_000_000, 86_400_000
    readings = spark.createDataFrame([("S", "V", n * 60 * day, 1.0) for n in range(6)], "k0 string, k1 string, t bigint, y double")
    jobs = spark.createDataFrame([(f"j{n}", "S", "V", 0, year, 1000, True) for n in range(2)], "job string, k0 string, k1 string, start bigint, end bigint, step bigint, fill boolean")
    plan = plan_grid(readings, jobs, 60_000)
    sizes = _job_shards(jobs, plan).groupBy("k0", "k1", "shard").agg(F.sum(F.col("b") - F.col("a") + 1).alias("points")).agg(F.max("points"), F.sum("points"), F.count("*")).first()
    assert sizes[0] <= 61_000 and sizes[1] == 2 * year // 1000 and sizes[2] > 1000
    rows = [("S", "V", n * 400_000, n, float(n * n)) for n in range(20)]
    ask = [("j", "S", "V", 0, 8_000_000, 1000, True), ("k", "S", "V", 500, 7_000_000, 3000, False)]
    cols = ["job", "grid_ts", "status", F.round("value", 9), F.round("smooth", 9), "long_gap"]
    one = rows_of(grid(spark, rows, ask, shard_rows=10**9), *cols)
    assert rows_of(grid(spark, rows, ask, shard_rows=500), *cols) == one and len(one) == 8000 + 2333


def test_grid_of_empty_tables(spark):
    assert grid(spark, [], [("j", "S", "V", 0, 20, 10, True)]).count() == 2
    assert grid(spark, [("S", "V", 1, 1, 1.0)], []).count() == 0


# ---- change feeds

CHANGE = "k string, t bigint, seq bigint, x int, op string, state string, extra int"


def test_change_feed_over_batches(spark, tmp_path):
    rng = random.Random(4)
    log, table = [], {}
    for i in range(400):
        k, op = rng.choice("abcdefgh"), rng.choice(["set", "set", "del"])
        log.append((k, i // 3, i, i, op, "s", 1))
        table[k] = None if op == "del" else i
    noisy = log + rng.sample(log, 150) + [(None, 5, 5, 5, "set", "s", 1)]
    rng.shuffle(noisy)
    for n in range(4):
        spark.createDataFrame(noisy[n::4], CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed = ChangeFeed(spark, ["k"], ["t", "seq"], ["x"], F.col("op") == "del", path=f"{tmp_path}/feed")
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    feed.run(stream)
    want = sorted((k, v) for k, v in table.items() if v is not None)
    assert rows_of(feed.rows(), "k", "x") == want
    assert feed.rows(tombstones=True).count() == len(table)
    spark.createDataFrame([("z", 0, 0, 7, "set", "s", 1), ("a", 0, -1, 8, "set", "s", 1)], CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed.run(spark.readStream.schema(CHANGE).parquet(f"{tmp_path}/in"))  # goes on; the older change of a is refused
    assert rows_of(feed.rows(), "k", "x") == sorted([*want, ("z", 7)])


def test_change_feed_opened_again_reads_and_compacts(spark, tmp_path):
    new = lambda: ChangeFeed(spark, ["k"], ["t", "seq"], ["x"], F.col("op") == "del", path=f"{tmp_path}/feed")
    with pytest.raises(ValueError):
        new().rows()
    changes = lambda rows: spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for n in range(3):
        changes([("a", n, 0, n, "set", "", 0), (f"b{n}", n, 0, n, "set", "", 0)])
    changes([("b1", 5, 0, 0, "del", "", 0)])
    new().run(stream())
    want = [("a", 2), ("b0", 0), ("b2", 2)]
    assert rows_of(new().rows(), "k", "x") == want
    new().compact()
    again = new()
    assert again._versions() == [] and rows_of(again.rows(), "k", "x") == want and again.rows(tombstones=True).count() == 4
    changes([("b1", 4, 0, 9, "set", "", 0), ("a", 9, 0, 7, "set", "", 0)])  # older than the tombstone; newer than a
    again.run(stream())
    assert rows_of(new().rows(), "k", "x") == [("a", 7), *want[1:]]


def test_change_ties_do_not_depend_on_order(spark):
    rows = [("a", 1, None, 1, "set", "", 0), ("a", 1, None, 2, "del", "", 0), ("b", None, 1, 1, "set", "", 0), ("b", 0, 0, 2, "set", "", 0)]
    df = spark.createDataFrame(rows, CHANGE)
    got = newest_changes(df, ["k"], ["t", "seq"], ["x"], F.col("op") == "del")
    assert rows_of(got, "k", "state.payload.x", "state.gone") == [("a", 2, True), ("b", 2, False)]


def test_empty_change_feed(spark, tmp_path):
    spark.createDataFrame([], CHANGE).write.parquet(f"{tmp_path}/in")
    feed = ChangeFeed(spark, ["k"], ["t"], ["x"], F.col("op") == "del", path=f"{tmp_path}/feed")
    feed.run(spark.readStream.schema(CHANGE).parquet(f"{tmp_path}/in"))
    assert feed.rows().count() == 0


# ---- messages

MSG = "k string, at bigint, id bigint, p int, q string, run string, bucket int"


def test_message_store_collapses_and_repeats_change_nothing(spark, tmp_path):
    rows = [("a", 1, 1, None, "x", "r", 1), ("a", 5, 2, 3, "y", "r", 1), ("b", 2, 3, 4, None, "r", 1), ("c", None, 4, 5, "z", "r", 1), (None, 1, 5, 6, "n", "r", 1), ("b", 2, 3, 4, None, "r", 1)]
    df = spark.createDataFrame(rows, MSG)
    store = MessageStore(spark, ["k"], ["at", "id"], ["p", "q"], buckets=3, path=f"{tmp_path}/m")
    want = [("a", 3, "x", 2), ("b", 4, None, 2), ("c", 5, "z", 1)]
    for _ in range(2):  # the same batch again adds nothing
        store.upsert(df, "one")
    assert rows_of(store.compact(), "k", "p", "q", "n_deliveries") == want
    store.upsert(spark.createDataFrame([("c", 0, 9, 1, None, "r", 1), ("d", 1, 10, 2, "w", "r", 1)], MSG), "two")
    assert rows_of(store.compact(), "k", "p", "q", "n_deliveries") == [*want[:2], ("c", 1, "z", 2), ("d", 2, "w", 1)]


def test_message_runs_do_not_matter(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("abcdefghij") if rng.random() < 0.7 else "hot", i, i, rng.choice([None, i]), rng.choice([None, str(i)]), "", 0) for i in range(500)]
    df = spark.createDataFrame(rows, MSG)
    got = []
    for n, width in enumerate((1000, 37)):
        store = MessageStore(spark, ["k"], ["at", "id"], ["p", "q"], path=f"{tmp_path}/{n}")
        for b in range(0, 500, width):
            store.upsert(df.where(F.col("at").between(b, b + width - 1)), f"from {b}")
        got.append(rows_of(store.compact(), "k", "p", "q", "n_deliveries"))
    assert got[0] == got[1]


def test_empty_message_batch(spark, tmp_path):
    store = MessageStore(spark, ["k"], ["at", "id"], ["p", "q"], path=f"{tmp_path}/m")
    store.upsert(spark.createDataFrame([], MSG), "one")
    assert store.compact().count() == 0


def test_message_store_opened_again_goes_on_and_knows_its_batches(spark, tmp_path):
    path = f"{tmp_path}/m"
    batches = {n: spark.createDataFrame([(k, n, i, i, str(n), "", 0) for i, k in enumerate(ks)], MSG) for n, ks in enumerate(("abc", "bcd", "cde"))}
    open_again = lambda buckets: MessageStore(spark, ["k"], ["at", "id"], ["p", "q"], buckets, path)
    store = open_again(3)
    store.upsert(batches[0], "0")
    store.upsert(batches[1], "1")
    want = [("a", "0", 1), ("b", "0", 2), ("c", "0", 2), ("d", "1", 1)]
    for compacted in (False, True):
        again = open_again(7)  # the number of buckets is that of the store
        assert again.buckets == 3
        for n in (0, 1):
            again.upsert(batches[n], str(n))
        if compacted:
            assert rows_of(again.compact(), "k", "q", "n_deliveries") == want
            again.upsert(batches[0], "0")
        assert rows_of(open_again(1).messages(), "k", "q", "n_deliveries") == want
    last = open_again(5)
    last.upsert(batches[2], "2")
    assert rows_of(last.compact(), "k", "q", "n_deliveries") == [("a", "0", 1), ("b", "0", 2), ("c", "0", 3), ("d", "1", 2), ("e", "2", 1)]
    with pytest.raises(ValueError):
        MessageStore(spark, ["k"], ["at"], ["p"], path=path)


def test_what_a_failed_batch_left_is_not_read(spark, tmp_path):
    store = MessageStore(spark, ["k"], ["at", "id"], ["p", "q"], 3, f"{tmp_path}/m")
    rows = spark.createDataFrame([("a", 1, 1, 1, "x", "", 0)], MSG)
    store.upsert(rows, "one")
    store._add(store._runs())  # written, but never put into the manifest
    again = MessageStore(spark, ["k"], ["at", "id"], ["p", "q"], 3, f"{tmp_path}/m")
    assert rows_of(again.messages(), "k", "n_deliveries") == [("a", 1)]


def test_compaction_moves_no_row(spark, tmp_path):
    store = MessageStore(spark, ["k"], ["at", "id"], ["p", "q"], 3, f"{tmp_path}/m")
    for n in range(2):
        store.upsert(spark.createDataFrame([(k, n, n, n, "x", "", 0) for k in "abcdef"], MSG), str(n))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = store._runs().groupBy("k").agg(F.min("whole"), F.sum("deliveries"))._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "Bucketed: true" in plan and "Exchange" not in plan


# ---- rolling days

BAR = "s string, t bigint, v bigint, id bigint, volume decimal(18,8), close decimal(18,8), day int, sum_volume int"
DAY = 86_400_000


def brute(rows, p):
    last = {}
    for s, t, v, i, vol, close in rows:
        if s is not None and t is not None and ((s, t) not in last or (v, i) > last[(s, t)][0]):
            last[(s, t)] = ((v, i), vol, close)
    out = {}
    for s in {k[0] for k in last}:
        days = [t // DAY for k, t in last if k == s]
        for d in range(min(days), max(days) + 1):
            own = [x for (k, t), x in last.items() if k == s and d - p < t // DAY <= d]
            out[(s, d)] = (sum((x[1] or 0 for x in own), D(0)), sum((x[2] or 0 for x in own), D(0)), sum(x[2] is not None for x in own), any((x[1] or 0) > 0 for (k, t), x in last.items() if k == s and t // DAY == d))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_rolling_days_in_batches(spark, tmp_path, batches):
    rng = random.Random(8)
    rows = []
    for i in range(260):
        s = rng.choice("ABC")
        t = rng.randrange(20) * 3 * DAY + rng.randrange(3) * 3_600_000 + (DAY if s == "C" else 0)
        rows.append((s, t, rng.randrange(1000), i, rng.choice([None, D(0), D(rng.randrange(50))]), rng.choice([None, D(rng.randrange(99))])))
    rows += [(None, 5, 1, 900, D(1), D(1)), ("A", None, 1, 901, D(1), D(1))]
    state = RollingDays(spark, ["s"], "t", ["v", "id"], ["volume", "close"], "volume", path=f"{tmp_path}/r")
    state.apply(spark.createDataFrame([], BAR), "nothing")
    assert state.days().count() == 0
    for n in range(batches):
        state.apply(spark.createDataFrame([(*r, 1, 1) for r in rows[n::batches]], BAR), str(n))
    state.apply(spark.createDataFrame([], BAR), "nothing again")
    for p in (7, 30):
        got = {(r[0], r[1]): (r[2], r[3], int(r[4]), r[5]) for r in state.days().select("s", "day", f"sum_volume_{p}", f"sum_close_{p}", f"n_close_{p}", "active").collect()}
        assert got == brute(rows, p)


def test_utc_days(spark, tmp_path):
    t = int(datetime(2013, 1, 7, 23, 55, tzinfo=timezone.utc).timestamp() * 1000)
    state = RollingDays(spark, ["s"], "t", ["v"], ["volume"], "volume", path=f"{tmp_path}/r")
    state.apply(spark.createDataFrame([("A", t, 1, 1, D(1), D(1), 0, 0), ("A", t + 300_000, 1, 1, D(1), D(1), 0, 0)], BAR), "one")
    assert [r[0] for r in state.days().select(F.date_from_unix_date("day").cast("string")).orderBy("day").collect()] == ["2013-01-07", "2013-01-08"]


def random_bars(seed, n, days):
    rng = random.Random(seed)
    return [(rng.choice("ABC"), rng.randrange(days) * DAY + rng.randrange(3) * 3_600_000, rng.randrange(1000), i, rng.choice([None, D(0), D(rng.randrange(50))]), D(rng.randrange(99))) for i in range(n)]


def totals(state, p=30):
    return {(r[0], r[1]): (r[2], r[3], int(r[4]), r[5]) for r in state.days().select("s", "day", f"sum_volume_{p}", f"sum_close_{p}", f"n_close_{p}", "active").collect()}


def test_rolling_days_opened_again_go_on_and_know_their_batches(spark, tmp_path):
    rows = random_bars(3, 120, 150)
    new = lambda: RollingDays(spark, ["s"], "t", ["v", "id"], ["volume", "close"], "volume", path=f"{tmp_path}/r")
    part = lambda a, b: spark.createDataFrame([(*r, 1, 1) for r in rows[a:b]], BAR)
    new().apply(part(0, 60), "one")
    new().apply(part(60, 100), "two")
    again = new()
    again.apply(part(0, 60), "one")
    assert totals(again) == brute(rows[:100], 30)
    again.apply(part(100, 120), "three")
    assert totals(new()) == brute(rows, 30)
    with pytest.raises(ValueError):
        RollingDays(spark, ["s"], "t", ["v"], ["volume"], "volume", path=f"{tmp_path}/r")


def test_a_batch_reads_and_writes_only_blocks_near_its_days(spark, tmp_path):
    rows = random_bars(4, 400, 800)
    state = RollingDays(spark, ["s"], "t", ["v", "id"], ["volume", "close"], "volume", path=f"{tmp_path}/r")
    state.apply(spark.createDataFrame([(*r, 1, 1) for r in rows], BAR), "history")
    late = [("A", 400 * DAY + 5, 2000, 5000, D(7), D(7)), ("B", 801 * DAY, 2000, 5001, D(1), D(2))]
    read, seen = state._read, []
    state._read = lambda name, blocks=None: (seen.append((name, blocks)), read(name, blocks))[1]
    state.apply(spark.createDataFrame([(*r, 1, 1) for r in late], BAR), "late")
    state._read = read
    assert {b for n, bs in seen if n == "days" for b in bs} <= {11, 12, 13, 23, 24, 25} and len(state.state["blocks"]["days"]) > 20
    assert sorted(int(b) for b, v in state.state["blocks"]["days"].items() if v == 2) in ([12, 13, 24, 25], [12, 13, 25])
    assert totals(state) == brute(rows + late, 30) and totals(state, 7) == brute(rows + late, 7)
