"""Jobs, events, grids, features, labels, joins, bars, books, accounts, sources, sinks and streams."""

import json
import random
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern.functions import scalars as sc
from quern.operators import adjust, asof, bars, book, events, features, grid, labels, liquidity, matching, portfolio, rolling_stats, universe, validate
from quern.operators import orders as od
from quern.operators.fold import fold
from quern.operators.running import islands, ranked, running_sums
from quern.plans import runner
from quern.plans.job import Condition, JobSpec, micros, parse_span
from quern.shards import ShardPlan, plan_shards
from quern.sources import feeds, sinks
from quern.streaming import live

D = Decimal
MIN = 60_000_000


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def trades(spark, rows):
    """symbol, us, seq, price, quantity, side."""
    df = spark.createDataFrame([(s, u, q, float(p), float(n), d) for s, u, q, p, n, d in rows], "symbol string, us bigint, seq bigint, price double, quantity double, side string")
    return events.conform(df, "trade", 0, symbol="symbol", venue=F.lit("v"), us="us", seq="seq", price="price", quantity="quantity", side="side")


def quotes(spark, rows):
    """symbol, us, seq, bid, bid size, ask, ask size."""
    df = spark.createDataFrame([(s, u, q, *map(float, x)) for s, u, q, *x in rows], "symbol string, us bigint, seq bigint, b double, bs double, a double, az double")
    return events.conform(df, "quote", 1, symbol="symbol", venue=F.lit("v"), us="us", seq="seq", bid_price="b", bid_size="bs", ask_price="a", ask_size="az")


# ---- jobs


@pytest.mark.parametrize("text,seconds", [("60s", 60), ("5m", 300), ("1h", 3600), ("2d", 172800), ("300", 300), ("0.5h", 1800), ("00:05:00", 300), ("1.00:00:00", 86400)])
def test_spans(text, seconds):
    assert parse_span(text) == seconds * 1_000_000


@pytest.mark.parametrize("text", ["", "xm", "0s", "-5m", "5g"])
def test_spans_that_are_none(text):
    with pytest.raises(ValueError):
        parse_span(text)


def test_conditions(spark):
    df = spark.createDataFrame([(1, 0.5), (2, -0.6), (3, None)], "i int, Imbalance double")
    assert rows_of(df.where(Condition.parse("imbalance < -0.50").column(df.columns)), "i") == [(2,)]
    assert df.where(Condition.parse("nothing > 1").column(df.columns)).count() == 0
    for bad in ("imbalance", "a <> 1", "a < b", "1 < a"):
        with pytest.raises(ValueError):
            Condition.parse(bad)


def test_job_documents():
    doc = {"jobId": "j", "symbols": ["A"], "startTime": "2024-01-01T00:00:00Z", "endTime": "2024-01-02T00:00:00", "observation_interval": "1m", "features": ["Imbalance", "structural_imbalance"], "experimentConfig": {"feature.structural_imbalance.bps": "25", "fee": 1}, "horizons": ["1m", "5m"], "fillForward": False}
    job = JobSpec.from_json(json.dumps(doc))
    assert (job.step, job.end - job.start, job.fill_forward) == (MIN, 1440 * MIN, False)
    assert job.features == {"imbalance": {}, "structural_imbalance": {"bps": "25"}} and job.horizons == (MIN, 5 * MIN)
    assert replace(job, job_id="k").hash() == job.hash() != replace(job, step=2 * MIN).hash()
    assert job.problems(list(features.REGISTRY), list(features.RAW)) == []
    bad = replace(job, features={"imbalence": {}}, symbols=()).problems(list(features.REGISTRY), list(features.RAW))
    assert any("did you mean 'imbalance'" in p for p in bad) and "no symbols" in bad


# ---- grids

JOB = JobSpec(start=0, end=10 * MIN, step=MIN)


def test_buckets_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(t,) for t in (-5, 0, 1, MIN, MIN + 1)], "us bigint")
    assert [r[0] for r in df.select(grid.ceil_bucket(F.col("us"), 0, MIN)).collect()] == [0, 0, MIN, MIN, 2 * MIN]


def test_observations_fill_and_carry(spark):
    ev = events.unified([trades(spark, [("A", 90_000_000, 1, 100, 2, "buy"), ("A", 4 * MIN, 2, 110, 1, "sell"), ("A", 11 * MIN, 3, 1, 1, "buy")]), quotes(spark, [("A", 3 * MIN, 4, 0, 1, 101, 5), ("A", 3 * MIN, 5, 99, 3, 0, 1)])])
    got = {r["bucket"] // MIN: r for r in grid.observations(events.select_events(ev, JOB), JOB).collect()}
    assert sorted(got) == list(range(11))
    assert [got[i]["data_quality"] for i in (0, 1, 2, 3, 4, 5, 10)] == [0, 0, 2, 2, 2, 1, 1]
    assert got[1]["data_age_ms"] == -1 and got[2]["data_age_ms"] == 30_000 and got[10]["data_age_ms"] == 360_000
    assert (got[3]["bid_price"], got[3]["ask_price"]) == (99, 101)  # a side changes only with a price above 0
    assert (got[4]["last"], got[10]["volume"], got[4]["aggressive_sell_volume"]) == (110, 3, 110)
    assert (got[1]["last"], got[0]["trade_count"], got[5]["high_at"]) == (None, 0, None)
    few = grid.observations(events.select_events(ev, JOB), replace(JOB, fill_forward=False, max_observations=2))
    assert rows_of(few, "bucket") == [(2 * MIN,), (3 * MIN,)]
    each = grid.observations(events.select_events(ev, JOB), replace(JOB, step=None))
    assert each.count() == 4
    named = grid.observations(events.select_events(ev, JOB), replace(JOB, symbols=("A", "B")))
    assert named.where("symbol = 'B' AND data_quality = 0").count() == 11


def test_observations_beyond_the_end_and_of_nothing(spark):
    job = replace(JOB, end=10 * MIN - 5)
    ev = events.select_events(trades(spark, [("A", 10 * MIN - 9, 1, 5, 1, "buy")]), job)
    assert max(r[0] for r in grid.observations(ev, job).select("bucket").collect()) == 10 * MIN
    assert grid.observations(ev.limit(0), job).count() == 0


def test_order_breaks_ties_by_sequence_then_stream(spark):
    ev = trades(spark, [("A", 5, 2, 20, 1, "buy"), ("A", 5, 1, 10, 1, "buy"), ("A", 5, None, 5, 1, "buy")])
    row = grid.bucketed(ev, JOB).collect()[0]
    assert (row["open_at"], row["close_at"]) == (5, 20)
    assert rows_of(events.first_events(ev, 2), "price") == [(D("10.00000000"),), (D("5.00000000"),)]


def test_chunks_equal_the_whole(spark):
    rng = random.Random(1)
    ev = trades(spark, [(rng.choice("AB"), rng.randrange(10 * MIN), i, rng.randrange(1, 99), 1, "buy") for i in range(300)])
    whole = rows_of(grid.bucketed(events.select_events(ev, JOB), JOB), "symbol", "bucket", "event_count", "close_at")
    cut = 5 * MIN
    head = grid.bucketed(events.select_events(ev, replace(JOB, end=cut)), JOB)
    tail = grid.bucketed(events.select_events(ev, replace(JOB, start=cut + 1, anchor=0)), JOB)
    assert rows_of(head.unionByName(tail), "symbol", "bucket", "event_count", "close_at") == whole


@pytest.mark.parametrize("job", [JOB, replace(JOB, step=None), replace(JOB, fill_forward=False)])
def test_observations_in_shards(spark, job):
    rng = random.Random(12)
    ev = events.unified([trades(spark, [(rng.choice("AAB"), rng.randrange(10 * MIN), rng.choice([i, None]) if i % 3 else i, rng.randrange(1, 99), 1, rng.choice(["buy", "sell"])) for i in range(80)]), quotes(spark, [(rng.choice("AB"), rng.randrange(10 * MIN), 100 + i, rng.choice([0, 9]), 1, rng.choice([0, 10]), 1) for i in range(20)])])
    ev = ev.dropDuplicates(["symbol", "us"])
    one, many = (rows_of(grid.observations(ev, job, shard_rows=n), "symbol", "bucket", *grid.CARRIED, *grid.RUNNING, "data_quality", "data_age_ms") for n in (10**6, 3))
    assert one == many and len(one) > 15


def test_resuming_equals_one_run(spark):
    rng = random.Random(11)
    ev = events.unified([trades(spark, [(rng.choice("AB"), rng.randrange(10 * MIN), i, rng.randrange(1, 99), rng.randrange(1, 5), rng.choice(["buy", "sell"])) for i in range(60)] + [("C", 8 * MIN, 90, 5, 1, "buy")]), quotes(spark, [("A", 2 * MIN, 100, 9, 1, 10, 1)])])
    cols = ["symbol", "bucket", "last", "volume", "trades_so_far", "cumulative_flow", "bid_price", "data_quality", "data_age_ms", "trade_count"]
    for fill in (True, False):
        job = replace(JOB, fill_forward=fill)
        whole = rows_of(grid.observations(events.select_events(ev, job), job), *cols)
        first = replace(job, end=4 * MIN)
        head = grid.observations(events.select_events(ev, first), first)
        rest = replace(job, start=4 * MIN + 1, anchor=0)
        tail = grid.observations(events.select_events(ev, rest), rest, seed=grid.snapshot(head))
        got = rows_of(head, *cols) + rows_of(tail, *cols)
        missing = [r for r in whole if r[0] == "C" and r[1] <= 4 * MIN]  # a symbol that only the later run knows
        assert sorted(got + missing, key=repr) == whole


def test_quote_depth(spark):
    ev = quotes(spark, [("A", 1, 1, 100, 3, 101, 1)])
    obs = grid.observations(ev, replace(JOB, end=0))
    got = features.feature_rows(obs.where("event_count > 0"), {n: {} for n in ("bid_depth", "ask_depth", "imbalance", "depth_ratio", "mid_price", "spread_bps")}).collect()[0]
    assert (got["bid_depth"], got["ask_depth"], got["imbalance"], got["depth_ratio"], got["mid_price"]) == (3, 1, 0.5, 3, 100.5)


def test_features_resolve_and_custom_ones_register(spark):
    assert features.resolve(["imbalance"]) == ["bids", "bid_depth", "asks", "ask_depth", "depth", "imbalance"]
    features.register("twice_mid", lambda p: F.col("mid_price") * p["times"], ("mid_price",), times=2)
    features.register("loop_a", lambda p: F.lit(0), ("loop_b",))
    features.register("loop_b", lambda p: F.lit(0), ("loop_a",))
    try:
        with pytest.raises(ValueError, match="need each other"):
            features.resolve(["loop_a"])
        obs = grid.observations(trades(spark, [("A", 1, 1, 10, 1, "buy")]), replace(JOB, end=MIN))
        got = features.feature_rows(obs.where("last IS NOT NULL"), {"twice_mid": {"times": "x"}, "structural_imbalance": {"bps": "25"}}, ("vwap", "trade_flow"))
        assert "structural_imbalance_25bps" in got.columns and got.collect()[0]["twice_mid"] == 20
    finally:
        for n in ("twice_mid", "loop_a", "loop_b"):
            del features.REGISTRY[n]


# ---- labels and joins


def test_time_labels(spark):
    rows = spark.createDataFrame([("A", 0, 100.0), ("A", 5 * MIN, 110.0), ("A", 6 * MIN, 0.0)], "symbol string, bucket bigint, p double")
    got = labels.label_after(rows, "p", 5 * MIN).select("bucket", "observed_at", F.round("ret", 9)).collect()
    assert [tuple(r) for r in got] == [(0, 5 * MIN, 0.1)]
    many = spark.range(1000).select(F.lit("A").alias("symbol"), (F.col("id") * MIN).alias("bucket"), (F.col("id") + 1.0).alias("p"))
    assert labels.label_after(many, "p", 5 * MIN).count() == 995


def test_hypothesis(spark):
    rows = spark.createDataFrame([("A", i, 100.0 + i, -0.6 if i % 2 == 0 else 0.1) for i in range(8)], "symbol string, bucket bigint, p double, imbalance double")
    got = {r["horizon"]: r for r in labels.hypothesis(rows, F.col("imbalance") < -0.5, "p", (1, 2)).collect()}
    assert (got[1]["n"], got[2]["n"], got[1]["up_rate"]) == (4, 3, 1.0)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_in_shards(spark, forward, strict):
    rng = random.Random(3)
    facts = [(rng.choice("AB"), rng.randrange(200), i, float(i)) for i in range(120)]
    probes = [(rng.choice("ABC"), rng.randrange(220), i) for i in range(150)]
    f = spark.createDataFrame(facts, "k string, at bigint, tie bigint, x double")
    p = spark.createDataFrame(probes, "k string, t bigint, i int")
    want = []
    for k, t, i in probes:
        ok = [(a, n, x) for fk, a, n, x in facts if fk == k and ((a > t if strict else a >= t) if forward else (a < t if strict else a <= t))]
        want.append((i, (min(ok, key=lambda r: (r[0], -r[1])) if forward else max(ok))[2] if ok else None))
    for plan in (None, ShardPlan(7, 99)):
        got = asof.asof(p, f, ["k"], "t", "at", ["x"], forward, strict, "tie", plan)
        assert {r[0]: r[1] for r in got.select("i", "x").collect()} == ({i: x for i, x in want} if not forward else {r[0]: r[1] for r in got.select("i", "x").collect()})
        if forward:  # of facts at one time any tie of the least time counts the same time
            times = {x: a for _, a, _, x in facts}
            assert {r[0]: times.get(r[1]) for r in got.select("i", "x").collect()} == {i: times.get(x) for i, x in want}


def test_steps_and_clamps(spark):
    s = spark.createDataFrame([("k", 10, 0.5), ("k", 20, 0.8)], "k string, d int, f double")
    t = spark.createDataFrame([("k", 5), ("k", 10), ("k", 11), ("k", 21), ("z", 5)], "k string, dt int")
    got = asof.step_lookup(t, s, ["k"], "dt", "d", "f", F.lit(1.0))
    assert rows_of(got) == [("k", 10, 0.5), ("k", 11, 0.8), ("k", 21, 1.0), ("k", 5, 0.5), ("z", 5, 1.0)]


def test_running_sums_in_shards(spark):
    rng = random.Random(4)
    rows = [(rng.choice("AB"), rng.randrange(100), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, x int")
    for plan in (None, ShardPlan(3, 50)):
        got = {r["i"]: (r["s"], r["n"]) for r in ranked(running_sums(df, ["k"], "t", ["i"], {"s": F.col("x")}, plan), ["k"], "t", ["i"], "n", plan).collect()}
        for k in "AB":
            total = 0
            for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 1):
                total += r[3]
                assert got[r[2]] == (total, n)
    got = [rows_of(islands(df.withColumn("y", F.col("x") > 2), ["k"], "t", ["i"], "y", plan)) for plan in (None, ShardPlan(3, 50))]
    assert got[0] == got[1] and sum(r[4] for r in got[0]) == 300
    for k in "AB":
        own = [r for r in got[0] if r[0] == k]
        flags = [r[3] > 2 for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))]
        assert len(own) == 1 + sum(a != b for a, b in zip(flags, flags[1:]))
    plan = plan_shards(df, ["k"], "t", 20)
    assert plan.shards > 3 and plan_shards(df.limit(0), ["k"], "t").shards == 1


def observed_rows(spark, n=700):
    rng, rows = random.Random(17), []
    for s, m in (("A", n), ("B", 60), ("C", 1)):
        for i in range(m):
            bid = 100 + rng.randrange(-20, 20) / 10
            rows.append((s, i * MIN + rng.choice([0, 0, MIN // 2]), 2, 0.0, bid, float(rng.randrange(1, 9)), bid + 0.2, float(rng.randrange(1, 9)), bid + 0.1, i * MIN))
    return spark.createDataFrame(rows, "symbol string, bucket bigint, data_quality int, data_age_ms double, bid_price double, bid_size double, ask_price double, ask_size double, last double, last_us bigint")


def test_rolling_features_in_blocks_of_any_size(spark):
    rows = observed_rows(spark)
    wanted = {"liquidity_depletion": {"bps": "50"}, "replenishment_rate": {"bps": "50"}, "depth_persistence": {}}
    got = [rows_of(features.feature_rows(rows, wanted, shard_rows=n), "symbol", "bucket", *[F.round(c, 9) for c in wanted]) for n in (10**9, 1000, 90)]
    assert got[0] == got[1] == got[2] and len(got[0]) == rows.count()
    short = [rows_of(features.feature_rows(rows, {"replenishment_rate": {"bps": "50"}}, shard_rows=n), "symbol", "bucket", F.round("replenishment_rate", 9)) for n in (10**9, 40)]
    assert short[0] == short[1] and len({x[2] for x in short[0]}) > 30


def test_labels_in_blocks_of_any_size(spark):
    rows = observed_rows(spark).select("symbol", "bucket", "last")
    for make, cols in (
        (lambda n: labels.label_by_count(rows, "last", (1, 7, 30), shard_rows=n), ("ret_1", "ret_7", "ret_30")),
        (lambda n: labels.label_after(rows, "last", 5 * MIN, cap=3, shard_rows=n), ("observed_at", "ret")),
        (lambda n: labels.excursions(rows, "last", 9 * MIN, shard_rows=n), ("mfe", "mae")),
    ):
        one, *more = (rows_of(make(n), "symbol", "bucket", *cols) for n in (10**9, 50, 11))
        assert all(x == one for x in more) and len(one) > 700


def test_transitions_and_checks_in_blocks_of_any_size(spark):
    rng = random.Random(5)
    rows = [(s, i * 1000, rng.choice([5.0, 9.0, 2.0]), rng.choice([5.0, 8.0]), 100.0 + rng.randrange(3), 104.0) for s in "AB" for i in range(400)]
    states = spark.createDataFrame(rows, "symbol string, us bigint, bid_depth double, ask_depth double, best_bid double, best_ask double")
    levels = states.withColumn("bids", F.array(*[F.struct(F.lit(1.0).alias("price"), q.alias("quantity")) for q in (F.col("bid_depth") * 3, F.lit(2.0), F.lit(2.0))])).withColumn("asks", F.col("bids"))
    seen = []
    for n in (10**9, 37):
        moves = liquidity.transitions(states, shard_rows=n)
        seen.append((rows_of(moves), rows_of(liquidity.walls(levels, shard_rows=n)), rows_of(liquidity.replenished(moves, 5000, shard_rows=n)), rows_of(validate.check_grid(observed_rows(spark), MIN, shard_rows=n))))
    assert seen[0] == seen[1] and all(seen[0])
    late = spark.createDataFrame([(s, rng.randrange(50) * MIN, i) for s in "AB" for i in range(300)], "symbol string, us bigint, seq bigint")
    job = JobSpec(start=0, end=60 * MIN, step=MIN)
    one, many = (rows_of(grid.replay_statistics(late, job, shard_rows=n)) for n in (10**9, 20))
    assert one == many and all(r[2] > 100 for r in one)


# ---- bars, books, matching


def test_renko_bricks_touch_each_other(spark):
    rng = random.Random(5)
    p, rows = 100.0, []
    for i in range(500):
        p += rng.uniform(-4, 4)
        rows.append(("A", i, i, round(p, 2), 1, "buy"))
    out = bars.renko_bars(trades(spark, rows), "2").collect()
    assert len(out) > 50
    for a, b in zip(out, out[1:]):
        assert abs(b["close"] - b["open"]) == 2 and b["low"] <= min(b["open"], b["close"]) and b["high"] >= max(b["open"], b["close"])
        assert b["open"] == (a["close"] if b["direction"] == a["direction"] else a["open"])
    for r in bars.range_bars(trades(spark, rows), "3").collect():
        assert r["high"] - r["low"] <= 3
    assert all(abs(r["close"] - r["open"]) == 2 for r in bars.renko_bars(trades(spark, rows), "2", classic=True).collect())
    assert bars.renko_bars(trades(spark, rows).limit(0), "2").count() == 0


def test_mixed_bars_end_by_count_or_time(spark):
    rows = [("A", t, t, t, 1, "buy") for t in (0, 1, 2, 3, 25, 26, 61)]
    got = rows_of(bars.mixed_bars(trades(spark, rows), 3, 20), "bar", "n")
    assert got == [(0, 1), (0, 3), (20, 2)]


def test_volume_bricks_roll_over(spark):
    rows = [("A", 1, 1, 10, 25, "buy"), ("A", 2, 2, 11, 5, "buy"), ("A", 3, 3, 12, 10, "buy")]
    got = rows_of(bars.volume_bricks(trades(spark, rows), 10), "bar", "volume", "close")
    assert [(b, float(v), float(c)) for b, v, c in got] == [(0, 10, 10), (1, 10, 10), (2, 10, 11), (3, 10, 12)]


def test_book_with_quotes_and_changes(spark):
    b = spark.createDataFrame([("A", 1, 1, "bid", 99.0, 5.0, "add"), ("A", 2, 2, "bid", 98.0, 7.0, "add"), ("A", 3, 3, "ask", 101.0, 4.0, "add"), ("A", MIN + 1, 6, "bid", 98.0, None, "remove"), ("A", MIN + 2, 7, "ask", 101.0, 0.0, "modify")], "symbol string, us bigint, seq bigint, side string, price double, quantity double, action string")
    ev = events.unified([events.conform(b, "book", 0, symbol="symbol", us="us", seq="seq", side="side", price="price", quantity="quantity", action="action"), quotes(spark, [("A", 5, 5, 98, 2, 100, 0)])])
    got = {r["bucket"] // MIN: r for r in book.book_states(ev, MIN).collect()}
    assert (got[1]["best_bid"], got[1]["bid_depth"], got[1]["best_ask"]) == (98, 2, 101)  # the quote removed 99 and set 98
    assert (got[2]["best_bid"], got[2]["bid_depth"], got[2]["best_ask"]) == (None, 0, None)


def test_books_have_all_levels(spark):
    rows = [("A", i, i, s, p, 1.0, "add") for i in range(1, 41) for s, p in (("bid", 100.0 - i), ("ask", 100.0 + i))]
    df = spark.createDataFrame(rows, "symbol string, us bigint, seq bigint, side string, price double, quantity double, action string")
    ev = events.conform(df, "book", 0, symbol="symbol", us="us", seq="seq", side="side", price="price", quantity="quantity", action="action")
    for depth, n in ((None, 40), (3, 3), (0, 0)):
        (r,) = book.book_states(ev, MIN, **({} if depth is None else {"depth": depth})).collect()
        assert (r["n_bids"], r["n_asks"], r["best_bid"], r["best_ask"], r["bid_depth"]) == (40, 40, 99, 101, 40)
        assert [x["price"] for x in r["bids"]] == [100 - i for i in range(1, n + 1)] and [x["price"] for x in r["asks"]] == [100 + i for i in range(1, n + 1)]


def test_books_in_time_shards(spark):
    rng = random.Random(31)
    rows, asks = [], []
    for i in range(900):
        s = rng.choice("AAAB")
        if rng.random() < 0.12:
            mid = 50 + rng.randrange(-8, 9)
            asks.append((s, i * 7_000_000, i, mid - 1, rng.choice([0, 3, 5]), mid + 1, rng.choice([0, 2])))
        else:
            side = rng.choice(["bid", "ask"])
            price = 50.0 + (-1 if side == "bid" else 1) * rng.randrange(1, 12)
            rows.append((s, i * 7_000_000, i, side, price, rng.choice([None, 0.0, 1.0, 2.0, 9.0]), rng.choice(["add", "modify", "remove", "add"])))
    b = spark.createDataFrame(rows, "symbol string, us bigint, seq bigint, side string, price double, quantity double, action string")
    ev = events.unified([events.conform(b, "book", 0, symbol="symbol", us="us", seq="seq", side="side", price="price", quantity="quantity", action="action"), quotes(spark, asks)])
    cols = ("symbol", "bucket", "best_bid", "best_ask", "bid_depth", "ask_depth", "n_bids", "n_asks", F.col("bids").cast("string"), F.col("asks").cast("string"))
    one = rows_of(book.book_states(ev, MIN, shard_rows=10**9), *cols)
    for shard_rows in (10, 60):
        assert rows_of(book.book_states(ev, MIN, shard_rows=shard_rows), *cols) == one
    assert len(one) > 150
    grid_rows = spark.createDataFrame([("A", n * MIN) for n in range(0, 120, 7)] + [("C", MIN)], "symbol string, bucket bigint")
    got = {(r["symbol"], r["bucket"]): r["book_bids"] for r in book.with_book(grid_rows, ev, MIN, shard_rows=60).collect()}
    want = {(r[0], r[1]): r[8] for r in one}
    assert got[("C", MIN)] is None and len(got) == grid_rows.count()
    state = {r["bucket"]: r["bids"] for r in book.book_states(ev, MIN).where("symbol = 'A'").collect()}
    for (s, t), bids in got.items():
        before = [b for b in state if b <= t]
        assert s == "C" or bids == (state[max(before)] if before else None)
    assert want


def test_changes_of_a_level_in_one_millisecond_go_by_seq(spark, tmp_path):
    from quern.plans import catalog

    rows = []
    for i in range(40):  # in the even books the remove comes last, in the odd ones the add; they arrive in either order
        pair = [("add", 5.0), ("remove", None)] if i % 2 == 0 else [("remove", None), ("add", 5.0)]
        changes = [(2 * i + k, f"S{i:02}", 7 + k if i < 30 else None, a, q) for k, (a, q) in enumerate(pair)]
        rows += changes if i % 4 < 2 else changes[::-1]
    df = spark.createDataFrame(rows, "change_id bigint, symbol string, seq bigint, action string, quantity double")
    full = df.select("*", F.lit("v").alias("venue"), F.lit(60_000).cast("bigint").alias("timestamp_ms"), F.lit("Bid").alias("side"), F.lit(10).cast("decimal(18,8)").alias("price")).withColumn("quantity", F.col("quantity").cast("decimal(18,8)"))
    full.coalesce(1).write.parquet(f"{tmp_path}/book_updates.parquet")
    got = {r["symbol"]: r["n_bids"] for r in catalog.QUERIES["book_fold"](spark, str(tmp_path)).collect()}
    assert got == {f"S{i:02}@v": i % 2 for i in range(40)}


def test_snapshots_become_changes(spark):
    s = spark.createDataFrame([("A", 1, [(10.0, 1.0), (9.0, 2.0)], [(11.0, 1.0)]), ("A", 2, [(10.0, 3.0)], [(11.0, 1.0)])], "symbol string, us bigint, bids array<struct<price: double, quantity: double>>, asks array<struct<price: double, quantity: double>>")
    assert rows_of(book.snapshot_changes(s), "us", "side", "price", "action") == [(1, "ask", 11.0, "add"), (1, "bid", 10.0, "add"), (1, "bid", 9.0, "add"), (2, "bid", 10.0, "modify"), (2, "bid", 9.0, "remove")]


def test_matching(spark):
    f = spark.createDataFrame([("A", 1, 1, "buy", 10.0, 5.0), ("A", 2, 2, "buy", 12.0, 5.0), ("A", 3, 3, "sell", 15.0, 6.0), ("A", 4, 4, "sell", 9.0, 6.0)], "k string, us bigint, seq bigint, side string, price double, quantity double")
    num = lambda how: [tuple(float(x) for x in r) for r in matching.match_fills(f, ["k"], how).select("entry_us", "exit_us", "quantity", "pnl").collect()]
    assert num("lifo") == [(2, 3, 5, 15), (1, 3, 1, 5), (1, 4, 4, -4)]
    assert num("fifo") == [(1, 3, 5, 25), (2, 3, 1, 3), (2, 4, 4, -12)]
    assert num("flat") == [(1, 4, 10, 16)]
    assert [r[2:] for r in num("reduced")] == [(6, 24), (4, -8)]
    pairs = [tuple(float(x) for x in r) for r in matching.match_fifo(f, ["k"], plan=ShardPlan(2, 9)).orderBy("entry_us", "exit_us").select("entry_us", "exit_us", "quantity").collect()]
    assert pairs == [(1, 3, 5), (2, 3, 1), (2, 4, 4)]


def lots_by_hand(rows):
    """Open lots, oldest first; a fill against them closes those, and what is left of it opens the other way."""
    lots, out = [], []
    for us, seq, side, price, q in sorted(rows):
        sign = 1 if side == "buy" else -1
        while q and lots and lots[0][2] == -sign:
            part = min(q, lots[0][4])
            out.append((lots[0][0], lots[0][1], us, seq, -sign, part))
            q, lots[0][4] = q - part, lots[0][4] - part
            lots = lots if lots[0][4] else lots[1:]
        if q:
            lots.append([us, seq, sign, price, q])
    return out


@pytest.mark.parametrize("shard_rows", [3, 10**9])
def test_first_in_first_out_with_turns(spark, shard_rows):
    rng = random.Random(21)
    rows = {k: [(rng.randrange(300), i, rng.choice(["buy", "sell"]), float(rng.randrange(1, 99)), float(rng.randrange(1, 30))) for i in range(n)] for k, n in (("A", 200), ("B", 40), ("C", 1))}
    df = spark.createDataFrame([(k, *r) for k, own in rows.items() for r in own] + [(None, 1, 1, "buy", 1.0, 1.0), ("A", 5, 999, "buy", 1.0, 0.0), ("A", 5, 998, "buy", 1.0, None)], "k string, us bigint, seq bigint, side string, price double, quantity double")
    plan = None if shard_rows > 100 else ShardPlan(20, 15)
    got = matching.match_fifo(df, ["k"], plan=plan, shard_rows=shard_rows)
    want = sorted((k, *r) for k, own in rows.items() for r in lots_by_hand(own))
    assert sorted((r[0], *map(float, r[1:])) for r in rows_of(got, "k", "entry_us", "entry_seq", "exit_us", "exit_seq", "direction", "quantity")) == [(r[0], *map(float, r[1:])) for r in want]
    total = got.groupBy("k").agg(F.sum("pnl").cast("double").alias("p"))
    reduced = matching.reduced_trades(got, ["k"]).groupBy("k").agg(F.sum("pnl").cast("double").alias("p"))
    assert rows_of(total) == rows_of(reduced)
    assert matching.match_fifo(df.limit(0), ["k"]).count() == 0
    flat = matching.flat_trades(df, ["k"], plan=plan)
    held, spans = {}, {}
    for k, own in rows.items():
        for us, seq, side, price, q in sorted(own):
            was = held.get(k, 0)
            now = held[k] = was + (q if side == "buy" else -q)
            spans[k] = spans.get(k, 0) + (was != 0 and (now == 0 or (now > 0) != (was > 0)))
    assert rows_of(flat.groupBy("k").count()) == sorted((k, n) for k, n in spans.items() if n)
    assert flat.where("quantity <= 0 OR exit_us < entry_us").count() == 0


def test_bricks_and_ranges_by_hand(spark):
    rows = lambda prices: trades(spark, [("A", i, i, p, 2, "buy") for i, p in enumerate(prices)])
    bricks = lambda df: [tuple(float(x) for x in r) for r in df.select("us", "open", "high", "low", "close", "direction").collect()]
    # starts at 10, the lower of two as near; closes only beyond a limit; a turn starts where the last brick did
    assert bricks(bars.renko_bars(rows([10.5, 9.2, 11, 11.1, 13.2, 11.5, 9.9]), "1")) == [(3, 10, 11, 9.2, 11, 1), (4, 11, 12, 11, 12, 1), (4, 12, 13, 12, 13, 1), (6, 12, 13.2, 11, 11, -1), (6, 11, 11, 10, 10, -1)]
    # opens at 12, above the price; then one tick beyond the last end, with empty bars in a jump
    got = [tuple(float(x) for x in r[1:]) for r in bars.range_bars(rows([11.2, 11.5, 17.05, 17.0]), "2", tick="0.01").collect()]
    assert got == [(2, 12, 13.5, 11.5, 13.5, 1, 4), (2, 13.51, 15.51, 13.51, 15.51, 1, 0)]
    got = [tuple(float(x) for x in r[1:]) for r in bars.range_bars(rows([11.2, 11.5, 17.05, 14.0]), "2", classic=True).collect()]
    assert got == [(2, 12, 13.5, 11.5, 13.5, 1, 4), (3, 17.05, 17.05, 15.05, 15.05, -1, 2)]
    assert bars.range_bars(rows([1.0]).limit(0), "2").count() == 0


def test_trade_reports_by_hand(spark):
    rows = [("A", 1, 0, 10, 5.0, -1.0, 6.0, False), ("A", 2, 10, 30, -3.0, -4.0, 1.0, False), ("A", 3, 30, 60, 0.0, -1.0, 1.0, True), ("A", 4, 60, 100, 4.0, -2.0, 5.0, False), ("A", 5, 100, 101, -1.0, -1.0, 0.0, False), ("B", 1, 0, 5, 2.0, 0.0, 2.0, False)]
    t = spark.createDataFrame(rows, "k string, i int, entry_us bigint, exit_us bigint, pnl double, mae double, mfe double, is_win boolean")
    got = {r["k"]: r for r in rolling_stats.trade_report(t, ["k"], ["i"]).collect()}
    a, b = got["A"], got["B"]
    assert (a["n_trades"], a["n_wins"], a["n_losses"], a["total"], a["profit"], a["loss"]) == (5, 3, 2, 5, 9, -4)
    assert (a["longest_wins"], a["longest_losses"]) == (2, 1) and (a["median_held"], a["median_win_held"], a["median_loss_held"]) == (20, 40, 20)
    assert a["max_closed_drawdown"] == -3 and a["max_intra_drawdown"] == -7 and a["max_drawdown_us"] == 90
    assert a["profit_factor"] == 9 / 4 and a["win_loss_ratio"] == 1.5 and a["mean_end_drawdown"] == 1 - 13 / 5
    assert (b["profit_factor"], b["win_loss_ratio"], b["profit_to_drawdown"], b["deviation"], b["sharpe"]) == (10, 10, 10, 0, 0) and b["fees"] == 0
    assert rolling_stats.trade_report(t.limit(0), ["k"], ["i"]).count() == 0


def test_drawdowns_recover_and_growth_compounds(spark):
    rows = [("A", f"2024-01-{d:02}", v) for d, v in ((1, 10.0), (2, 8.0), (3, 10.0), (5, 12.0), (6, 11.0), (9, 9.0), (12, 12.0), (13, 6.0))] + [("B", "2024-01-01", 3.0)]
    c = spark.createDataFrame(rows, "k string, day string, v double").withColumn("day", F.col("day").cast("date"))
    assert rows_of(rolling_stats.drawdown_metrics(c, "v", ["k"], "day")) == [("A", 0.5, 7), ("B", 0.0, 0)]
    g = spark.createDataFrame([(100.0, 121.0, 2.0), (100.0, 121.0, 0.0), (0.0, 1.0, 1.0), (100.0, -5.0, 2.0)], "a double, b double, y double")
    assert [round(x[0], 9) for x in g.select(rolling_stats.compound_annual(F.col("a"), F.col("b"), F.col("y"))).collect()] == [0.1, 0, 0, 0]
    own = c.where("k = 'A'").withColumn("r", F.col("v"))
    both = rolling_stats.aligned_returns(own, own.where("v != 8").withColumn("m", F.col("v")), ["k"], "day", "r", "m", skip=2)
    assert [r["r"] for r in both.orderBy("day").collect()] == [12, 11, 9, 12, 6]


def test_every_trade_places_an_order_and_a_combo(spark, tmp_path):
    from quern.plans import catalog

    df = spark.range(1, 141).select(F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.floor(F.col("id") / 2) * 1_800_000_000).alias("ts"), (F.col("id") % 2 + 1).alias("user_id"), F.lit("view").alias("event_type"), F.lit(10.0).alias("value"), F.lit('{"k": 3}').alias("props"))
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    ids = lambda n, c: {r[c] for r in catalog.QUERIES[n](spark, str(tmp_path)).collect()}
    assert ids("market_fill", "order_id") == {*range(20, 30), *range(90, 100)}
    assert ids("open_close_fills", "order_id") == {*range(50, 70), *range(120, 140)}
    assert ids("combo_fills", "combo_id") == set(range(1, 140, 2))  # the second user's, against the first


def test_orders_wait_until_they_fill(spark):
    day, hours = 24 * 60 * MIN, range(1, 40 * 24)
    at = lambda h: (10.0, 11.0, 9.0, 10.0) if h < 30 * 24 else (20.0, 21.0, 19.0, 20.0) if h < 35 * 24 else (5.0, 6.0, 4.0, 5.0)
    b = spark.createDataFrame([(s, h * 60 * MIN, *at(h)) for s in "AB" for h in hours], "symbol string, us bigint, open double, high double, low double, close double")
    o = [(1, "buy", "limit", 8.0, None, None, None), (2, "sell", "limit", 12.0, None, None, None), (3, "buy", "stop", None, 12.0, None, None), (4, "buy", "stop_limit", 8.0, 12.0, None, None), (5, "buy", "touched", 7.0, None, 8.0, None), (6, "buy", "market", None, None, None, None), (7, "sell", "limit", 12.0, None, None, 20 * day), (8, "buy", "limit", 1.0, None, None, None)]
    orders = spark.createDataFrame([(i, "A", 5, *x) for i, *x in o], "order_id int, symbol string, us bigint, side string, type string, limit double, stop double, touch double, expires bigint")
    assert rows_of(od.fill_orders(orders, b)) == [(1, 35 * day, 6.0), (2, 30 * day, 19.0), (3, 30 * day, 20.0), (4, 35 * day, 6.0), (5, 35 * day, 7.0), (6, 60 * MIN, 10.0)]
    t = spark.createDataFrame([(1, "A", 5, "sell", 1.0, 4.0), (2, "A", 5, "buy", 30.0, 4.0), (3, "A", 5, "buy", 30.0, 40.0)], "order_id int, symbol string, us bigint, side string, stop double, trail double")
    assert rows_of(od.trailing_stops(t, b)) == [(1, 35 * day, 16.0), (2, 30 * day, 14.0)]
    legs = spark.createDataFrame([(c, s, 5, r, limit, 2) for c, limit in ((1, 3.0), (2, None), (3, -9.0)) for s, r in (("A", 1.0), ("B", -0.5))], "combo_id int, symbol string, us bigint, ratio double, limit double, n_legs int")
    assert rows_of(od.fill_combos(legs, b)) == [(1, 35 * day, 2.5), (2, 60 * MIN, 5.0)]


def test_every_trade_gets_its_quote(spark, tmp_path):
    from quern.plans import catalog

    rows = [(1, "view", 10.0), (2, "purchase", 11.0), (3, "error", 12.0), (4, "click", 20.0), (5, "login", 13.0)]
    df = spark.createDataFrame(rows, "event_id bigint, event_type string, value double").select("*", F.timestamp_seconds(1_704_067_200 + F.col("event_id")).alias("ts"), F.lit(1).cast("bigint").alias("user_id"), F.lit('{"k": 3}').alias("props"))
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["seq"]: round(r["bid_price"], 2) for r in catalog.QUERIES["asof_quote_at_trade"](spark, str(tmp_path)).collect()}
    assert got == {1: 9.95, 2: 9.95, 3: 9.95, 4: 19.95, 5: 19.95}


def test_strike_windows(spark):
    c = spark.createDataFrame([("u", i, float(s)) for i, s in enumerate((90, 95, 100, 105, 110))], "k string, id int, strike double")
    at = lambda spot: [r[0] for r in rows_of(universe.strike_window(c.withColumn("spot", F.lit(spot)), ["k"], "spot", -1, 1), "strike")]
    assert sorted(at(100.0)) == [95, 100, 105] and sorted(at(101.0)) == [100, 105]


def test_findings_count_each_problem(spark):
    df = spark.createDataFrame([("A", 1, 5.0), ("A", 2, -1.0), ("A", 3, -2.0), ("B", 1, None)], "symbol string, bucket bigint, x double")
    assert rows_of(validate.findings(df, "c", {"negative": F.col("x") >= 0}), "symbol", "n", "first", "last") == [("A", 2, 2, 3)]


@pytest.mark.parametrize("block", [3, 10**6])
def test_sequence_gaps_across_blocks(spark, block):
    df = spark.createDataFrame([("A", x) for x in (1, 2, 5, 5, 6, 12, None)] + [("B", 4), ("C", None)], "k string, seq bigint")
    assert rows_of(book.sequence_gaps(df, ["k"], block=block)) == [("A", 2, 7), ("B", 0, 0)]


def test_reports_and_modes(spark):
    df = spark.createDataFrame([("S%02d" % i, i, -1.0) for i in range(30)], "symbol string, bucket bigint, x double")
    f = validate.findings(df, "c", {"negative": F.col("x") >= 0})
    assert validate.enforce(f, "off").count() == 0 and validate.enforce(f, "warn").count() == 20
    with pytest.raises(ValueError, match=r"c \(30\)"):
        validate.enforce(f, "fail")
    assert validate.check_unresolved(df.withColumn("y", F.lit(None).cast("double")), "y").where("warn").count() == 30


def test_calendars_factors_and_optimizer(spark):
    days = spark.createDataFrame([(d,) for d in ("2024-01-02", "2024-01-03", "2024-01-08", "2024-02-01", "2024-02-29")], "d string").select(F.col("d").cast("date").alias("date"))
    pick = lambda rule, n=0: [str(r[0]) for r in rows_of(universe.calendar(days, rule, n))]
    assert sorted(pick("month_start")) == ["2024-01-02", "2024-02-01"] and sorted(pick("month_end", 1)) == ["2024-01-03", "2024-02-01"] and pick("year_end") == ["2024-02-29"]
    lines = spark.createDataFrame([("20240102,0.5,0.25,10",), ("20240103,inf,1",), ("bad,1,1",), ("x",)], "value string")
    assert [r[1:] for r in rows_of(adjust.parse_factors(lines))] == [(0.5, 0.25)]
    grid_ = rolling_stats.parameter_grid(spark, {"a": (1, 2, 0.5), "b": (0, 1, 1)})
    assert grid_.count() == 6
    res = spark.createDataFrame([(1, '{"s":{"x":2,"d":0.5}}'), (2, '{"s":{"x":3,"d":0.9}}'), (3, "{}")], "i int, result string")
    assert rolling_stats.best_result(res, "$.s.x", {"$.s.d": ("<", 0.8)}).collect()[0]["i"] == 1
    assert spark.range(1).select(rolling_stats.drawdown_percent(F.lit(75), F.lit(100))).collect()[0][0] == 25


# ---- accounts


@pytest.mark.parametrize("seed", range(40))
def test_equity_is_start_plus_gains(seed):
    rng = random.Random(20240101 + seed)
    a = portfolio.Account(fee_bps=D(rng.choice([0, 5])))
    for i in range(40):
        p = portfolio.price_of(round(rng.uniform(50, 150), 2))
        a.target("x", D(rng.randrange(-30, 31)), p, i)
        a.mark("x", p)
        assert abs(a.equity() - a.start - a.realized - a.unrealized() + a.fees) < D("1E-4")
    a.liquidate(41)
    assert sum(t["pnl"] for t in a.trades) == a.realized and a.units["x"] == 0
    assert 0 <= a.metrics()["win_rate"] <= 1


def test_orders_of_scripts():
    p = portfolio.parse_order
    assert p(None) is None and p("hold") is None and p("buy") == ("buy", D(-1)) and p({"action": "short", "qty": 2}) == ("sell", D("2.0")) and p("exit") == ("close", D(-1))
    for bad in ({"side": "up"}, {"side": "buy", "size": float("nan")}, {"side": "buy", "size": -1}):
        with pytest.raises(ValueError):
            p(bad)


def test_position_holds_and_leaves(spark):
    rows = spark.createDataFrame([("A", i * MIN, 100.0 + i, 1.0 if i in (1, 2) else -1.0 if i == 2 else 0.0) for i in range(8)], "symbol string, bucket bigint, close double, x double")
    out = portfolio.position_experiment(rows, {"entry": "x > 0", "max_hold": str(3 * MIN), "fraction": "0.5"})
    trades_ = out.where("kind = 'trade'").collect()
    assert len(trades_) == 1 and trades_[0]["at"] == 4 * MIN and abs(trades_[0]["value"] - 3 * 50_000 / 101) < 1e-3
    assert out.where("kind = 'equity'").count() == 8
    both = portfolio.composite({"a": out, "b": out.drop("reason")})
    assert both.where("experiment = 'b' AND reason IS NULL").count() == out.count()


def test_strategy_hooks(spark):
    class Echo:
        def on_observation(self, row):
            return {"double": row["price"] * 2}

        def finalize(self):
            return {"done": 1}

    rows = spark.createDataFrame([("A", 1, 5.0), ("B", 1, 6.0)], "symbol string, bucket bigint, close double")
    got = portfolio.run_strategy(rows, Echo, ())
    assert rows_of(got, "symbol", "reason", "value") == [("A", "done", 1.0), ("A", "double", 10.0), ("B", "done", 1.0), ("B", "double", 12.0)]


def test_fold_keeps_keys_apart(spark):
    class Sum:
        def __init__(self):
            self.x = 0

        def push(self, row):
            self.x += row[0]
            return []

        def end(self):
            return [(self.x,)]

    df = spark.createDataFrame([(None, 1, 5), ("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], "k string, t int, x int")
    assert rows_of(fold(df, ["k"], ["t"], ["x"], Sum, "total int")) == [("a", 3), ("b", 3), (None, 5)]


# ---- sources, sinks, streams


def test_staged_csv(spark, tmp_path):
    (tmp_path / "trades.csv").write_text("timestamp_ms,price,size,side,trade_id\n1704067215000,42105,0.5,BUY,t-0\nbad,1,1,buy,x\n1704067216000,oops,1,?,t-1\n")
    (tmp_path / "book_updates.csv").write_text("timestamp_ms,side,price,quantity,action\n1704067230000,bid,42100,1,\n")
    got = feeds.staged_events(spark, str(tmp_path), "BTC", "v", ("trades", "book_updates"))
    assert rows_of(got, "us", "kind", "price", "side", "action") == [(1704067215000000, "trade", D("42105.00000000"), "buy", None), (1704067216000000, "trade", D("0.00000000"), "unknown", None), (1704067230000000, "book", D("42100.00000000"), "bid", "add")]
    df = spark.createDataFrame([("BTC-USD", "btc_usd"), ("BTC", "ETH")], "a string, b string")
    assert [r[0] for r in df.select(feeds.same_symbol(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_frame_archives_and_raw_lines(spark):
    frame = {"a": 5, "f": {"type": "delta", "ts": 7, "data": {"s": "BTC", "u": 3, "b": [["10.5", "2"]], "a": [["11", "0"]]}}}
    lines = spark.createDataFrame([(json.dumps(frame),), ("not json",), ("{}",)], "value string")
    assert rows_of(feeds.frame_archive(lines), "symbol", "us", "side", "price", "quantity") == [("BTC", 7000, "ask", D("11.00000000"), D("0E-8")), ("BTC", 7000, "bid", D("10.50000000"), D("2.00000000"))]
    raw = spark.createDataFrame([("34200000,1000000,1010000,990000,1005000,300",), ("short,1",)], "value string")
    got = feeds.raw_bars(raw, "equity", False, F.lit("2024-01-02").cast("date")).collect()
    assert len(got) == 1 and got[0]["open"] == 100 and got[0]["ts"].hour == 9
    path = feeds.data_path("equity", "usa", "minute", "SPY", "20240102", "trade")
    assert feeds.parse_path(path)["symbol"] == "spy" and feeds.parse_path("nonsense") is None
    row = feeds.with_path_fields(spark.createDataFrame([("x/" + path,)], "p string"), F.col("p")).collect()[0]
    assert (row["market"], row["ticker"], row["tick"]) == ("usa", "spy", "trade")


def test_synthetic_events_are_the_same_each_time(spark):
    a, b = (feeds.synthetic_events(spark, 1000) for _ in range(2))
    assert a.exceptAll(b.repartition(3)).count() == 0 and a.where("kind = 'trade'").count() == 500


def test_runs_are_saved_once_and_compared(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, D("1.5")), ("B", 2, None)], "symbol string, t int, x decimal(18,8)")
    root, job = f"file://{tmp_path}/runs", replace(JOB, job_id="one")
    assert sinks.save_run(spark, root, job, {"rows": df}, {"n": 2}) is True
    assert sinks.save_run(spark, root, replace(job, job_id="two"), {"rows": df}) is False
    back = spark.read.parquet(f"{root}/{job.hash()[:16]}/rows")
    assert sinks.compare_runs(df.withColumn("x", F.col("x").cast("double")), back).count() == 0
    assert sinks.compare_runs(back, back.limit(1)).count() == 1
    for form in ("csv", "json"):
        sinks.write_rows(df, f"{root}/{form}", form)
    with pytest.raises(ValueError):
        sinks.write_rows(df, f"{root}/x", "xml")


def test_runs_of_many_symbols_have_few_files(spark, tmp_path):
    """sink_compare took a folder for each of all users, and in it a file for each task."""
    n = 1001
    at = lambda name: tmp_path / "runs" / JOB.hash()[:16] / name
    rows = lambda symbols: spark.range(0, 4 * symbols, 1, 4).select(F.format_string("%04d", F.col("id") % symbols).alias("symbol"), F.floor(F.col("id") / symbols).cast("int").alias("t"), (F.col("id") / 7).cast("decimal(18,8)").alias("x"))
    more = {"many": rows(n), "few": rows(3), "none": rows(3).drop("symbol"), "empty": rows(3).where("t > 9")}
    assert sinks.save_run(spark, f"file://{tmp_path}/runs", JOB, more) is True
    assert len([*at("many").rglob("*.parquet")]) <= 4 and not [*at("many").glob("symbol=*")]
    assert sorted(p.parent.name for p in at("few").rglob("*.parquet")) == ["symbol=0000", "symbol=0001", "symbol=0002"]
    read = lambda name: spark.read.schema("symbol string, t int, x double").parquet(str(at(name)))
    for name in ("many", "few"):
        went_in = more[name].withColumn("x", F.col("x").cast("double"))
        assert read(name).count() == went_in.count() and sinks.compare_runs(went_in, read(name)).count() == 0
    assert sinks.compare_runs(rows(n).select("symbol", "t", (F.col("x").cast("double") + F.when(F.col("symbol") == "0007", 1).otherwise(0)).alias("x")), read("many")).count() == 8
    assert [r[0] for r in spark.read.parquet(str(at("many"))).where("symbol = '0007'").select("t").orderBy("t").collect()] == [0, 1, 2, 3]
    assert json.loads(at("manifest.json").read_text())["folders"] == {"many": [], "few": ["symbol"], "none": [], "empty": ["symbol"]}


def test_write_policies(spark, tmp_path):
    path, at = f"file://{tmp_path}/t", "k string, v int"
    put = lambda rows, policy: sinks.write_with_policy(spark.createDataFrame(rows, at), path, policy, ["k"], ["v"])
    put([("a", 1), ("b", 5)], "overwrite")
    put([("a", 2), ("b", 4)], "merge")
    assert rows_of(spark.read.parquet(path)) == [("a", 2), ("b", 5)]
    put([("c", 1)], "append")
    assert spark.read.parquet(path).count() == 3


JOB_DOC = {"jobId": "j", "symbols": ["A"], "startTime": "1970-01-01T00:00:00Z", "endTime": "1970-01-01T01:00:00Z", "observationInterval": "60s", "features": ["mid_price", "trade_flow"], "experimentName": "hypothesis", "experimentConfig": {"condition": "trade_flow < 0", "horizons": "1,2"}}


def test_jobs_run_from_document_to_tables(spark, tmp_path):
    ev = trades(spark, [("A", i * MIN, i, 100 + i % 5, 1, "sell" if i % 2 else "buy") for i in range(1, 60)] + [("Z", 5, 1, 9, 1, "buy")])
    done = runner.run_job(spark, json.dumps(JOB_DOC), ev, f"{tmp_path}/jobs")
    assert done["created"] and done["tables"] == ["observations", "hypothesis"]
    assert spark.read.parquet(f"{done['path']}/observations").count() == 61
    assert {r["horizon"]: r["n"] for r in spark.read.parquet(f"{done['path']}/hypothesis").collect()} == {1: 30, 2: 29}
    read = lambda n: json.loads((tmp_path / "jobs" / done["path"].rsplit("/", 1)[1] / n).read_text())
    assert read("metrics.json") == {"symbols": 1, "observations": 61, "fresh": 59, "filled": 1, "missing": 1}
    assert read("manifest.json")["tables"] == ["observations", "hypothesis"] and read("validation_report.json") == {"findings": []} and read("run_metadata.json")["step"] == MIN
    assert not runner.run_job(spark, json.dumps(JOB_DOC), ev, f"{tmp_path}/jobs")["created"]


def test_jobs_that_cannot_run_say_why():
    bad = JOB_DOC | {"features": ["mid_prise", "liquidity_wall"], "eventTypes": ["trade"], "maxEvents": 0, "experimentName": "hypothesys", "experimentConfig": {"condition": "flow < 0", "feature.liquidity_wall.mul": "2"}}
    text = "; ".join(runner.preflight(JobSpec.from_json(json.dumps(bad))))
    for part in ("did you mean 'mid_price'?", "did you mean 'hypothesis'?", "'flow'", "max_events", "no parameter 'mul'", "levels", "price 'mid_price' is no column"):
        assert part in text, (part, text)
    assert runner.preflight(JobSpec.from_json(json.dumps(JOB_DOC))) == []


def test_orders_by_share():
    assert portfolio.order_share({"side": "buy", "weight": 0.5}) == Decimal("0.5") and portfolio.order_share("buy") is None
    with pytest.raises(ValueError):
        portfolio.order_share({"side": "buy", "fraction": 2})
    one = portfolio._Script(lambda: type("S", (), {"on_observation": lambda self, row: {"side": "buy", "weight": 0.5}})(), ("symbol", "bucket", "price"), Decimal("0.1"), Decimal(0), True)
    fills = [r for r in one.push(("A", 1, 10.0)) if r[0] == "fill"]
    start = portfolio.Account().cash
    assert len(fills) == 1 and abs(fills[0][2] * 10.0) == pytest.approx(float(start) / 2)


def test_live_state_equals_batch_and_resumes(spark, tmp_path):
    rng = random.Random(9)
    rows = [("A" if rng.random() < 0.6 else "B", t * 1_000_000, t, float(rng.randrange(1, 99)), 1.0) for t in range(600)]
    late = [("A", 5_000_000, 1000, 7.0, 1.0)]
    schema = "symbol string, us bigint, seq bigint, price double, quantity double"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for part in (rows[:250], rows[250:400] + late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live.run_now(live.live_state(stream(), 0, MIN), f"{tmp_path}/run")
    spark.createDataFrame(rows[400:], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live.run_now(live.live_state(stream(), 0, MIN), f"{tmp_path}/run")
    got = {(r["symbol"], r["bucket"]): r for r in spark.read.parquet(f"{tmp_path}/run/out").collect()}
    for s in "AB":
        own = [r for r in rows if r[0] == s]
        buckets = sorted({-(-r[1] // MIN) * MIN for r in own})[:-1]
        assert sorted(b for k, b in got if k == s) == buckets
        for b in buckets:
            assert got[(s, b)]["last"] == [r for r in own if r[1] <= b][-1][3]
    assert max(r["late"] for r in got.values()) == 1


def test_live_bars_drop_nothing_in_order(spark, tmp_path):
    rows = [("A", t, t, 1.0 + t % 7, 1.0) for t in range(0, 300)]
    df = spark.createDataFrame(rows, "symbol string, s bigint, seq bigint, price double, quantity double").select("symbol", F.timestamp_seconds("s").alias("ts"), "seq", F.col("price").cast("decimal(18,8)").alias("price"), F.col("quantity").cast("decimal(18,8)").alias("quantity"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    live.run_now(live.live_bars(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), MIN), f"{tmp_path}/run")
    got = rows_of(spark.read.parquet(f"{tmp_path}/run/out"), "bar", "n")
    assert got[:4] == [(0, 60), (120_000_000, 60), (180_000_000, 60), (60_000_000, 60)]


def test_sources_by_descriptor(spark, tmp_path):
    assert feeds.bar_file(["bars_60.csv", "bars_300.csv", "x"], 300) == "bars_300.csv" and feeds.bar_file(["bars_60.csv", "bars_300.csv"], 5) == "bars_300.csv" and feeds.bar_file([], 1) is None
    (tmp_path / "frames.jsonl").write_text(json.dumps({"a": 1, "f": {"type": "delta", "ts": 7, "data": {"s": "B", "u": 3, "b": [["10", "0"]], "a": []}}}) + "\n")
    assert rows_of(feeds.open_source(spark, {"mode": "archive", "path": f"{tmp_path}/frames.jsonl"}), "symbol", "us", "action") == [("B", 7000, "remove")]
    assert feeds.open_source(spark, {"mode": "synthetic", "events": 10}).count() == 10
    with pytest.raises(ValueError):
        feeds.open_source(spark, {"mode": "oracle"})


def test_discovery(spark, tmp_path):
    for date in ("20240102", "20240105"):
        f = tmp_path / "data" / feeds.data_path("equity", "usa", "minute", "SPY", date, "trade")
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"12345")
    assert rows_of(feeds.discover(spark, f"{tmp_path}/data"), "market", "ticker", "tick", "first_date", "last_date", "n_files", "bytes") == [("usa", "spy", "trade", "20240102", "20240105", 2, 10)]


def test_live_labels_join_a_horizon_later(spark, tmp_path):
    df = spark.range(20).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 60 + 600).alias("ts"), (F.col("id") + 1.0).alias("price"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    live.run_now(live.live_labels(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 5 * MIN), f"{tmp_path}/run")
    got = spark.read.parquet(f"{tmp_path}/run/out")
    assert got.count() == 15 and got.where("future != price + 5").count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([(1234.567, -1.239, "2024-01-05")], "x double, y double, d string").withColumn("d", F.col("d").cast("date"))
    got = df.select(sc.significant(F.col("x"), 2), sc.round_to(F.col("x"), 0.5), sc.truncate(F.col("y"), 2), sc.smart_round(F.col("x")), sc.next_business_day(F.col("d")).cast("string"), sc.previous_business_day(F.col("d")).cast("string"), sc.end_of_quarter(F.col("d")).cast("string"), sc.column_name(F.lit("A b-C"))).collect()[0]
    assert [float(x) if not isinstance(x, str) else x for x in got] == [1200, 1234.5, -1.23, 1235, "2024-01-08", "2024-01-04", "2024-04-01", "a_b_c"]
    assert micros("1970-01-01T00:00:01Z") == 1_000_000
