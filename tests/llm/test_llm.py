"""Runs, nearest records, tokens, mixes and personal information."""

import json
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from held_out import CLEAN, HELD_OUT

from quern.llm.bpe import Bpe, count_tokens, encode_corpus
from quern.llm.mix import Mix, Target, largest_total, route, sized_records
from quern.llm.nearest import match_nearest
from quern.llm.pii import PiiFinder, estimate
from quern.llm.pii_labels import KINDS, Known, Lexicon, candidates
from quern.llm.queries import tokenizer_path
from quern.llm.runs import collapse_runs


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


# ---- runs

EVENT = "s string, v string, t bigint, id bigint, a double, b double, step double, run int, shard string, head int"


def runs_by_hand(rows):
    out, last = [], {}
    for s, v, t, i, a, b, step in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[0], r[1], r[2], r[3])):
        run = last.get((s, v))
        if a is None or b is None:
            last[(s, v)] = None
            continue
        near = lambda x, y: abs(x - y) * 2 < step if step and step > 0 else x == y
        if run and near(a, run[4]) and near(b, run[5]):
            run[3], run[4], run[5], run[6] = t, a, b, run[6] + 1
        else:
            run = [s, v, t, t, a, b, 1]
            out.append(run)
            last[(s, v)] = run
    return sorted((r[0], r[1], r[2], r[3], r[6]) for r in out)


@pytest.mark.parametrize("shard", [7, 10**9])
def test_runs_across_shards(spark, shard):
    rng = random.Random(1)
    rows, p = [], 10.0
    for i in range(700):
        p += rng.choice([0, 0, 0, 0.004, 0.3])
        step = rng.choice([0.01]) if i < 600 else None
        rows.append((rng.choice("AAAB"), rng.choice("XY"), rng.randrange(5000), i, rng.choice([p] * 9 + [None]), 1.0, step))
    rows += [(None, "X", 1, 1, 1.0, 1.0, 0.1), ("A", "X", None, 2, 1.0, 1.0, 0.1)] + rows[:5]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], EVENT)
    got = collapse_runs(df, ["s", "v"], "t", ["a", "b"], "id", "step", shard_rows=shard)
    assert rows_of(got, "s", "v", "start_ts", "end_ts", "n_events") == sorted(runs_by_hand(rows), key=repr)
    assert got.where(F.col("duration") != F.col("end_ts") - F.col("start_ts")).count() == 0


def test_runs_of_nothing(spark):
    df = spark.createDataFrame([], EVENT)
    assert collapse_runs(df, ["s", "v"], "t", ["a", "b"], "id", "step").count() == 0


# ---- nearest


@pytest.mark.parametrize("shard", [5, 10**9])
def test_nearest_with_ties_margins_and_repeats(spark, shard):
    rng = random.Random(2)
    facts = [(rng.choice("ABC"), rng.randrange(2000), i, "x") for i in range(300)] + [("A", None, 900, "x"), (None, 5, 901, "x")]
    probes = [(rng.choice("ABCD"), rng.randrange(2100), i, rng.choice([3, 20, 60]), i % 2) for i in range(400)]
    probes += probes[:10] + [("A", None, 1, 5, 0), (None, 1, 2, 5, 1)]
    a = spark.createDataFrame(facts, "k string, t bigint, id bigint, tag string")
    b = spark.createDataFrame(probes, "k string, t bigint, id bigint, tol bigint, tag int")
    got = rows_of(match_nearest(a, b, ["k"], "t", "id", "t", "id", "tol", "tag", shard_rows=shard), "tag", "id", "found", "gap")
    want = []
    for k, t, i, tol, tag in probes:
        near = sorted((abs(ft - t), ft > t, fi) for fk, ft, fi, _ in facts if k is not None and t is not None and fk == k and ft is not None and abs(ft - t) <= tol)
        if near:
            want.append((tag, i, near[0][2], near[0][0]))
    assert got == sorted(want, key=repr) and len(got) > 100


def test_nearest_of_nothing(spark):
    a = spark.createDataFrame([], "k string, t bigint, id bigint")
    b = spark.createDataFrame([("A", 1, 1, 5, 0)], "k string, t bigint, id bigint, tol bigint, tag int")
    assert match_nearest(a, b, ["k"], "t", "id", "t", "id", "tol", "tag").count() == 0
    assert match_nearest(b.drop("tag", "tol"), b.limit(0), ["k"], "t", "id", "t", "id", "tol", "tag").count() == 0


# ---- tokens

TEXTS = ["", None, " ", "x", "Hello  world\n\n\t it's 12,345.67", "<|endoftext|> and <|x|>", "naïve façade 盘口 🙂👩‍💻", "a" * 5000, "ab" * 900 + " " * 300, "1234567890" * 40, "​\x00\x07 \r\n", "Ünïcode ǅ ½ ①"]


def test_tokens_equal_the_library_s(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abc dé\n1🙂-_'sSTt") for _ in range(rng.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r[0]: list(r[1]) for r in encode_corpus(df, tokenizer_path()).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    counts = {r[0]: r[1] for r in count_tokens(df, tokenizer_path()).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode_corpus(df.limit(0), tokenizer_path()).count() == 0


def test_files_of_other_tokenizers_are_refused(tmp_path):
    whole = json.loads(Path(tokenizer_path()).read_text())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": whole["model"] | {"dropout": 0.1}}):
        (tmp_path / "t.json").write_text(json.dumps(whole | change))
        with pytest.raises(ValueError):
            Bpe(str(tmp_path / "t.json"))


def test_merge_takes_the_leftmost_of_the_lowest_rank():
    b = Bpe(tokenizer_path())
    rng = random.Random(4)
    for _ in range(200):
        word = bytes(rng.choice(b"aabst he") for _ in range(rng.randrange(1, 40)))
        ids = [b.of_byte[x] for x in word]
        while True:
            ranks = [(b.pairs[k][0], i) for i in range(len(ids) - 1) if (k := ids[i] * b.size + ids[i + 1]) in b.pairs]
            if not ranks:
                break
            i = min(ranks)[1]
            ids[i : i + 2] = [b.pairs[ids[i] * b.size + ids[i + 1]][1]]
        assert b.merge(word) == ids


# ---- mixes


def test_route_repeats_evenly_and_shares_overlap():
    flows = route({("a",): 100, ("b",): 10, ("a", "b"): 30}, [Target("a", 0.5, 1), Target("b", 0.5, 3)], 200)
    by = Counter()
    for p, parts in flows.items():
        for n, s, tokens in parts:
            by[s] += tokens
            assert n <= {"a": 1, "b": 3}[s] and tokens > 0
    assert by == {"a": 100, "b": 100}
    # b's 100: each of its 40 tokens twice comes before any is used a third time
    assert sum(t for p, parts in flows.items() for n, s, t in parts if n == 3) == 20


def test_mix_reaches_targets_and_keeps_caps(spark):
    rng = random.Random(5)
    rows = [(i, ["big"], rng.randrange(1, 60)) for i in range(3000)] + [(10_000 + i, ["small"], rng.randrange(1, 60)) for i in range(60)] + [(20_000 + i, ["big", "small"], 20) for i in range(40)] + [(30_000, ["other"], 50), (30_001, None, 50), (30_002, ["big"], 0), (None, ["big"], 5)]
    records = spark.createDataFrame(rows, "id bigint, sources array<string>, size bigint")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.1, 4), ("none", 0.1, 2)], "source string, share double, repeats int")
    mix = Mix(spark, records, targets, seed=7, total=40_000)
    got = mix.selection().collect()
    used, per = Counter(), defaultdict(int)
    for r in got:
        used[r["source"]] += r["n_uses"] * r["n_tokens"]
        per[r["id"]] += r["n_uses"]
        assert r["n_uses"] <= {"big": 1, "small": 4}[r["source"]]
    assert abs(used["big"] - 32_000) < 200 and abs(used["small"] - 4_000) < 200
    assert max(per.values()) <= 4 and not set(per) & {30_000, 30_001, 30_002, None}
    report = {r["source"]: r for r in mix.report().collect()}
    assert set(report) == {"big", "small", "none", "other"}
    assert report["none"]["tokens_used"] == 0 and report["other"]["target_share"] is None
    assert report["big"]["tokens_used"] == used["big"]
    assert rows_of(Mix(spark, records, targets, seed=7, total=40_000).selection()) == rows_of(mix.selection())


def test_mix_of_nothing(spark):
    records = spark.createDataFrame([], "id bigint, sources array<string>, size bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, share double, repeats int")
    mix = Mix(spark, records, targets)
    assert mix.selection().count() == 0 and mix.report().count() == 1


def test_copies_join_sources(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "y", "a"), (4, "", "a"), (5, "", "b"), (6, None, "a"), (7, "x", None), (8, "y", "a")], "doc_id bigint, text string, source string")
    rows = sized_records(spark, df, "doc_id", "text", F.col("source"), tokenizer_path()).collect()
    got = {r["id"]: (r["sources"], r["size"]) for r in rows}
    assert len(rows) == 8 and sorted(got[1][0]) == sorted(got[2][0]) == sorted(got[7][0]) == ["a", "b"]
    assert all(got[i][0] == ["a"] for i in (3, 4, 6, 8)) and got[5][0] == ["b"] and got[6][1] == 0 and got[1][1] == 1


def test_the_total_is_the_largest_with_every_source_at_its_share():
    """Against every total, on small cases; and the flow costs what the cheapest of all ways costs."""
    rng = random.Random(11)
    for _ in range(40):
        names = ["a", "b", "c"][: rng.randrange(1, 4)]
        targets = [Target(s, round(rng.choice([0.2, 0.3, 0.5]), 2), rng.randrange(1, 4)) for s in names]
        patterns = {p: rng.randrange(0, 12) for p in [("a",), ("b",), ("a", "b"), ("c",), ("b", "c")] if set(p) <= set(names)}
        patterns = {p: n for p, n in patterns.items() if n}
        stocked = [t for t in targets if any(t.source in p for p in patterns)]
        full = lambda total: sum(n for parts in route(patterns, stocked, total).values() for *_, n in parts) == sum(round(t.share * total) for t in stocked)
        best = largest_total(patterns, targets)
        assert full(best) and best <= sum(patterns.values())
        # rounding of quotas may let single greater totals through, but none a few tokens on
        assert not any(full(t) for t in range(best + 12, sum(patterns.values()) + 1))
    # 6 tokens of a and 4 of both; a wants 8 and b 4 of them with at most 2 uses of a token: by hand
    flows = route({("a",): 6, ("a", "b"): 4}, [Target("a", 0.8, 2), Target("b", 0.4, 2)], 10)
    cost = sum(n * n * tokens for parts in flows.values() for n, _, tokens in parts)
    assert cost == min(1 * (a1 + both1) + 4 * (12 - a1 - both1) for a1 in range(7) for both1 in range(5))


def test_mix_reaches_every_share(spark):
    rng = random.Random(15)
    rows = [(i, [rng.choice(["big", "big", "mid"])], rng.randrange(1, 40)) for i in range(4000)] + [(10_000 + i, ["small"], rng.randrange(1, 40)) for i in range(50)]
    records = spark.createDataFrame(rows, "id bigint, sources array<string>, size bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("none", 0.1, 2)], "source string, share double, repeats int")
    mix = Mix(spark, records, targets)
    small = sum(n for _, s, n in rows if s == ["small"])
    assert abs(mix.total - 40 * small) <= 40 and mix.total < sum(n for *_, n in rows)
    for r in mix.report().collect():
        assert abs(r["tokens_used"] - r["tokens_wanted"]) <= (0 if r["source"] == "none" else 80) or r["source"] == "none"
        assert r["source"] == "none" or abs(r["actual_share"] - r["target_share"] / 0.9) < 0.01


# ---- personal information

PIECES = {
    "email": ["anna.berg@mail.example.org", "k_m (at) north (dot) example (dot) com", "zoe[at]desk.example", "lo9 @ klar.example.net"],
    "phone": ["+44 (0)1632 960123", "+1 (202) 555-0173 ext. 71", "0012025550192", "555 00 03 79", "(02) 5550 9176", "202.555.0109", "01.99.00.74.72", "07700 900260", "+49 30 23125206"],
    "id_number": ["QQ123456A", "ZZ-9510-891-K", "99.998.442-R", "X0884671"],
    "address": ["1954 Saint Orin Lane", "Hopfengasse 92", "Camino de las Encinas, 154", "58 avenue du Vieux Moulin", "518 N. Wickham Gate Way"],
    "name": ["Talia Ostrettino", "Oskar J. Ulvingale", "B. Kessibarro", "Ostrnick, Tobias", "SOFIA DE LA MORENZA", "Zelda-Will Halouvier"],
}
FRAMES = {
    "email": ["contact: {} today", "The alert went to <{}> and nobody else."],
    "phone": ["Call me on {} before the open.", "tel. {}"],
    "id_number": ["Please remove my passport ({}) from the ticket.", "The form lists DNI {} and nothing else."],
    "address": ["New office: {}.", "Post it to {}, Marrowby, please."],
    "name": ["Reviewed by {} on the second pass.", "Account holder {}, SSN 990-42-8030, phone 020 7946 0957.", "Ask {} about the grid anchor."],
}
DECOYS = ["order 4830057807 acknowledged", "seq 950-86-4410 missing", "build 2.14.555.0199", "rate 4.5 @ 4851.4 done", "// fills at 3.5@2150.60 were test data", "ssh collector@talbit-node3 and look", "Liquidity is a 2 Way Street on kestra.", "window 07/01/2013-14/01/2013", "Frank Spread, as we call the fee-free one, was 2 bps."]
NAMES = [("Talia", "given"), ("Oskar", "given"), ("Tobias", "given"), ("Sofia", "given"), ("Frank", "given"), ("Ostrettino", "family"), ("Ulvingale", "family"), ("Kessibarro", "family"), ("Ostrnick", "family"), ("de la Morenza", "family"), ("Halouvier", "family")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    docs, truth = [], set()
    for i in range(400):
        parts = [rng.choice(DECOYS)]
        for _ in range(rng.randrange(3)):
            kind = rng.choice(KINDS)
            piece = rng.choice(PIECES[kind])
            parts.append(rng.choice(FRAMES[kind]).format(piece))
            truth.add((i, kind, piece))
            if "SSN 990-42-8030" in parts[-1]:
                truth |= {(i, "id_number", "990-42-8030"), (i, "phone", "020 7946 0957")}
        rng.shuffle(parts)
        docs.append((i, "\n".join(parts), "clash"))
    return docs + [(1000, None, ""), (1001, "", ""), (1002, " \n", "")], truth


def test_pii_is_found_and_decoys_are_not(spark, corpus):
    docs, truth = corpus
    df = spark.createDataFrame(docs, "doc_id bigint, text string, votes string")
    names = spark.createDataFrame(NAMES, "name string, name_kind string")
    finder = PiiFinder(spark, df, names)
    got = {tuple(r) for r in finder.found().collect()}
    assert len(got & truth) >= 0.95 * len(truth), sorted(truth - got)[:20]
    assert len(got & truth) >= 0.95 * len(got), sorted(got - truth)[:20]
    redacted = {r["doc_id"]: r for r in finder.redacted().collect()}
    assert len(redacted) == len(docs)
    assert redacted[1000]["text"] is None and redacted[1001]["text"] == "" and redacted[1002]["text"] == " \n"
    for i, text, _ in docs[:400]:
        want = text
        pieces = sorted(((k, p) for d, k, p in got if d == i), key=lambda x: -len(x[1]))
        for k, p in pieces:
            want = want.replace(p, f"[{k.upper()}]")
        assert redacted[i]["text"] == want


def test_pii_in_sentences_that_the_labelers_were_not_written_for(spark, corpus):
    """Recall of at least 0.9 of each kind, beside a corpus of other texts."""
    docs, _ = corpus
    rows = docs + [(5000 + i, t, "") for i, (t, _) in enumerate(HELD_OUT)] + [(9000 + i, t, "") for i, t in enumerate(CLEAN)]
    names = spark.createDataFrame(NAMES, "name string, name_kind string")
    got = {tuple(r) for r in PiiFinder(spark, spark.createDataFrame(rows, "doc_id bigint, text string, votes string"), names).found().collect()}
    every, hit = Counter(), Counter()
    for i, (_, pieces) in enumerate(HELD_OUT):
        for kind, piece in pieces:
            every[kind] += 1
            hit[kind] += (5000 + i, kind, piece) in got
    assert all(hit[k] >= 0.9 * every[k] for k in KINDS), (hit, every)
    assert len([x for x in got if x[0] >= 9000]) <= 1


def test_company_votes_are_the_same_for_copies_of_a_corpus(spark, corpus):
    docs, _ = corpus
    names = spark.createDataFrame(NAMES, "name string, name_kind string")
    found = lambda n: {(d % 10_000, k, p) for d, k, p in map(tuple, PiiFinder(spark, spark.createDataFrame([(i + 10_000 * c, t, "") for c in range(n) for i, t, _ in docs], "doc_id bigint, text string, votes string"), names).found().collect())}
    assert found(1) == found(6)


def test_pii_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    names = spark.createDataFrame([], "name string, name_kind string")
    finder = PiiFinder(spark, df, names)
    assert finder.found().count() == 0 and finder.redacted().count() == 0


def test_estimate_learns_who_is_right():
    rng = random.Random(7)
    counts = Counter()
    for _ in range(5000):
        real = rng.random() < 0.4
        vote = lambda right: "+" if (rng.random() < right) == real else "-"
        counts[vote(0.95) + vote(0.9) + vote(0.55) + rng.choice("0+-")] += 1
    p = estimate(counts)
    assert p["+++0"] > 0.9 and p["++-0"] > 0.9 and p["--+0"] < 0.1
    assert p["+--0"] < 0.9 and estimate({}) == {}


def test_candidates_stand_alone():
    known = Lexicon(Known.of(["talia"], ["ostrettino"]))
    t = 'AUDIT {"who":"Talia Ostrettino","mail":"talia@klar.example"} (see 1954 Saint Orin Lane).'
    got = {(KINDS[c.kind], t[c.start : c.end]) for c in candidates(t, known)}
    assert {("name", "Talia Ostrettino"), ("email", "talia@klar.example"), ("address", "1954 Saint Orin Lane")} <= got
    assert list(candidates("", known)) == []
    for text, piece in (("Ask Ostrettino, Talia. Then", "Ostrettino, Talia"), ("Ask Ostrettino, T. about the grid", "Ostrettino, T."), ("Ask Ostrettino, Talia K. about the grid", "Ostrettino, Talia K."), ("rang 718 555‑0129 twice", "718 555‑0129"), ("dial 1 718 555 0129 status=busy", "1 718 555 0129")):
        assert piece in {text[c.start : c.end] for c in candidates(text, known)}
