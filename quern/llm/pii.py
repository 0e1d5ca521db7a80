"""Personal information in free text: found, and replaced by typed placeholders.

Labelers (formats, gazetteers, contexts; see ``pii_labels``) vote on candidate
spans; two more votes come from the corpus, by the company that the parts of a name or
an address keep: rates, which say the same of a
corpus of any size.  Nobody says which labelers are right: expectation-maximisation
estimates their reliabilities from how they agree, over the counts of all vote
patterns, and with them how likely a span is.  On these likelihoods a span
classifier is trained, which also sees the span's shape and the words beside it; it
decides.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.pii_labels import KINDS, Known, Lexicon, candidates
from quern.workdir import fresh_dir

#: Most candidates of a kind on which the classifier is fitted; counts and votes cover all.
TRAIN_ROWS = 20_000
#: Features are hashed into so many places.
WIDTH = 4096
#: Largest share that one partner of a part may have, for a vote that the part goes with many.
ONE_PARTNER = 0.6
#: A pair of parts is a set phrase if it is so many times as frequent as pairs of its kind are on the average; a part's share of places in set phrases that speaks against it.
SET_TIMES, SET_SHARE = 10, 0.8

#: So many votes, 9 in 10 of them right, each labeler is believed to have cast before any are seen.
PRIOR = 20.0

_CANDIDATE = [("doc", pa.int64()), ("mark", pa.int64()), ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("piece", pa.string()), ("votes", pa.string()), ("one", pa.string()), ("two", pa.string()), ("left", pa.string()), ("right", pa.string())]
_SPANS = "doc bigint, mark bigint, kind int, start int, end int, piece string"


def known_names(names: DataFrame) -> Known:
    """The gazetteer, lower-cased; a table of a few hundred rows."""
    rows = names.where(F.col("name").isNotNull()).select(F.lower(F.trim("name")).alias("name"), "name_kind").distinct().collect()
    return Known.of((r["name"] for r in rows if r["name_kind"] == "given"), (r["name"] for r in rows if r["name_kind"] == "family"))


def _beside(t: str, a: int, b: int) -> tuple[str, str]:
    """The last word before and the first after, with the mark between, lower-cased."""
    left = re.search(r"(\w*)(\W{0,2})$", t[max(0, a - 24) : a])
    right = re.match(r"(\W{0,2})(\w*)", t[b : b + 24])
    return (left[1] + left[2].strip()).lower(), (right[1].strip() + right[2]).lower()


_CANDIDATE_DDL = "doc bigint, mark bigint, kind int, start int, end int, piece string, votes string, one string, two string, left string, right string"


def find_candidates(documents: DataFrame, id: str, text: str, known: Known) -> DataFrame:
    """All candidate spans of all texts with the labelers' votes."""
    schema = pa.schema(_CANDIDATE)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(known)
        for batch in batches:
            rows = []
            for doc, mark, t in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text"))):
                for c in candidates(t, lexicon):
                    rows.append((doc, mark, c.kind, c.start, c.end, t[c.start : c.end], c.votes, c.one, c.two, *_beside(t, c.start, c.end)))
                if len(rows) > 20_000:
                    yield _batch(rows, schema)
                    rows = []
            yield _batch(rows, schema)

    rows = documents.select(F.col(id).cast("bigint").alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).where(F.length("text") > 0)
    return rows.mapInArrow(find, _CANDIDATE_DDL)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def add_company(found: DataFrame) -> DataFrame:
    """The candidates with two more votes, one for each part: ``+`` if it goes with many partners, ``-`` if it is in a set phrase.

    Parts are names or streets, of which there are far fewer than candidates; candidates
    without parts are not joined.
    """
    both = F.col("one").isNotNull() & F.col("two").isNotNull()
    whole = found.where(both)
    pairs = whole.groupBy("kind", "one", "two").agg(F.count("*").alias("n"))
    pairs = pairs.join(pairs.groupBy("kind").agg(F.avg("n").alias("usual")), "kind")

    def of(part: str) -> DataFrame:
        set_phrase = (F.col("kind") == KINDS.index("name")) & (F.col("n") > SET_TIMES * F.col("usual"))
        parts = pairs.groupBy("kind", part).agg(F.sum(F.when(set_phrase, F.col("n")).otherwise(0)).alias("set"), F.max("n").alias("most"), F.sum("n").alias("n"))
        many = (F.col("n") > 1) & (F.col("most") <= ONE_PARTNER * F.col("n"))
        vote = F.when(F.length(part) < 2, "0").when(F.col("set") >= SET_SHARE * F.col("n"), "-").when(many, "+").otherwise("0")
        return parts.select("kind", part, vote.alias(f"of_{part}"))

    out = whole.join(of("two"), ["kind", "two"]).join(of("one"), ["kind", "one"])
    out = out.withColumn("votes", F.concat("votes", "of_two", "of_one")).select(*found.columns)
    return out.unionByName(found.where(~both).withColumn("votes", F.concat("votes", F.lit("00"))))


def estimate(patterns: Mapping[str, int], rounds: int = 100) -> dict[str, float]:
    """Likelihood that a span with each vote pattern is real, by expectation-maximisation.

    Two classes; given the class, labelers vote independently, and those that abstain
    say nothing; a span that none is for is not real.  It starts from the
    majority of votes, of which those against count twice, as they are rarer, and ends with the labelers' own rates of each vote in each class.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    votes = np.array([["-0+".index(v) for v in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    p = 1 / (1 + np.exp(-1.5 * np.choose(votes, (-2, 0, 1)).sum(axis=1)))
    labelers, some = np.arange(votes.shape[1]), (votes == 2).any(axis=1)
    p[~some] = 0
    for _ in range(rounds):
        rates = np.zeros((2, votes.shape[1], 3))
        for c, w in ((0, n * (1 - p)), (1, n * p)):
            for v in range(3):
                believed = 0 if v == 1 else PRIOR * (0.9 if (v == 2) == bool(c) else 0.1)
                rates[c, :, v] = 0 if v == 1 else ((votes == v) * w[:, None]).sum(axis=0) + believed
        rates /= rates.sum(axis=2, keepdims=True)
        # To abstain says nothing, and a labeler that is for a span counts for it, however the data lie.
        rates[:, :, 1] = 1
        for v, sign in ((0, 1), (2, -1)):
            bad = sign * (rates[1, :, v] - rates[0, :, v]) > 0
            mean = (rates[0, :, v] + rates[1, :, v]) / 2
            rates[0, bad, v] = rates[1, bad, v] = mean[bad]
        share = np.clip((n * p).sum() / n.sum(), 0.01, 0.99)
        log = np.log(rates[1, labelers, votes]).sum(axis=1) - np.log(rates[0, labelers, votes]).sum(axis=1) + math.log(share / (1 - share))
        p = np.where(some, 1 / (1 + np.exp(-np.clip(log, -30, 30))), 0.0)
    return dict(zip(keys, p.tolist()))


def _features(kind: int, piece: str, votes: str, one: str | None, two: str | None, left: str, right: str) -> list[int]:
    """Places of a candidate's features; the first is the same for all of its kind."""
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[^\W\d_]*[A-ZÀ-Þ][^\W\d_]*", "A", re.sub(r"\d", "0", piece)))
    names = ["", *(f"v{i}{v}" for i, v in enumerate(votes)), f"s{shape}", f"l{left}", f"r{right}", f"n{len(piece) // 6}"]
    if two:
        names += [f"e{two[-4:]}"]
    return [zlib.crc32(f"{kind}|{x}".encode()) % WIDTH for x in names]


@dataclass
class Classifier:
    """Logistic regression over hashed features."""

    weights: np.ndarray

    @classmethod
    def fit(cls, rows: list[list[int]], likely: np.ndarray, steps: int = 300) -> Classifier:
        """Full-batch gradient steps with momentum on likelihoods; L2 keeps rare features small."""
        w, v = np.zeros(WIDTH), np.zeros(WIDTH)
        if rows:
            flat = np.concatenate([np.array(r) for r in rows])
            of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            seen = np.maximum(np.bincount(flat, minlength=WIDTH), 1)
            for _ in range(steps):
                z = np.bincount(of, w[flat], minlength=len(rows))
                err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - likely
                step = np.bincount(flat, err[of], minlength=WIDTH) / np.sqrt(seen * len(rows)) + 1e-4 * w
                v = 0.9 * v - 0.3 * step
                w = w + v
        return cls(w)

    def score(self, places: list[int]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights[places].sum())))))


class PiiFinder:
    """Spans of personal information in ``documents`` (id, text), given some known names.

    Defined results: null and empty texts have none; texts of any length are searched
    whole; equal rows have equal spans; of overlapping spans the likelier counts, then
    the longer; a null id is kept; other columns are never read.
    """

    def __init__(self, spark: SparkSession, documents: DataFrame, names: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.5):
        self.documents, self.id, self.text, self.threshold = documents, id, text, threshold
        at = fresh_dir(spark, "pii")
        found = find_candidates(documents, id, text, known_names(names))
        found.write.parquet(f"{at}/candidates")
        voted = add_company(spark.read.schema(found.schema).parquet(f"{at}/candidates"))
        voted.write.parquet(f"{at}/voted")
        self.candidates = spark.read.schema(voted.schema).parquet(f"{at}/voted")
        counts: dict[int, dict[str, int]] = {}
        for r in self.candidates.groupBy("kind", "votes").count().collect():  # at most 3 ** labelers rows
            counts.setdefault(r["kind"], {})[r["votes"]] = r["count"]
        self.likely = {k: estimate(c) for k, c in counts.items()}
        self.model = self._fit({k: sum(c.values()) for k, c in counts.items()})

    def _fit(self, totals: dict[int, int]) -> Classifier:
        wanted, least = F.lit(False), TRAIN_ROWS * len(KINDS)
        draw = F.xxhash64("doc", "mark", "start", "kind")
        for k, n in totals.items():
            wanted = wanted | ((F.col("kind") == k) & (F.pmod(draw, F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, TRAIN_ROWS / n))))
        # The order makes the draw the same in every run, should hashes of equal rows make it larger than meant.
        rows = self.candidates.where(wanted).orderBy(draw, "doc", "start", "votes").select("kind", "piece", "votes", "one", "two", "left", "right").limit(2 * least).collect()
        return Classifier.fit([_features(*r) for r in rows], np.array([self.likely[r["kind"]][r["votes"]] for r in rows]))

    def spans(self) -> DataFrame:
        """doc, mark (a hash of the text), kind, start, end, piece; spans of a text don't overlap."""
        model, least = self.model, self.threshold

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = [model.score(_features(*r)) for r in zip(*(b.column(c).to_pylist() for c in ("kind", "piece", "votes", "one", "two", "left", "right")))]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc", "mark", "kind", "start", "end", "piece")], pa.array(p, pa.float64())], ["doc", "mark", "kind", "start", "end", "piece", "p"])

        scored = self.candidates.mapInArrow(score, _SPANS + ", p double").where(F.col("p") >= least).dropDuplicates(["doc", "mark", "kind", "start", "end"])
        together = scored.groupBy("doc", "mark").agg(F.collect_list(F.struct("p", "kind", "start", "end", "piece")).alias("spans"))

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("piece", pa.string())])
            for b in batches:
                rows = []
                for doc, mark, spans in zip(*(b.column(c).to_pylist() for c in ("doc", "mark", "spans"))):
                    rows += [(doc, mark, s["kind"], s["start"], s["end"], s["piece"]) for s in _apart(spans)]
                yield _batch(rows, schema)

        return together.mapInArrow(settle, _SPANS)

    def found(self) -> DataFrame:
        """Each different piece of a document once: id, pii_kind, pii_text."""
        kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
        return self.spans().select(F.col("doc").alias(self.id), kind.alias("pii_kind"), F.col("piece").alias("pii_text")).distinct()

    def redacted(self) -> DataFrame:
        """id, text, n_replaced: every row of the documents, with ``[EMAIL]`` and the like for each span."""
        spans = self.spans().groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
        rows = self.documents.select(F.col(self.id).cast("bigint").alias("doc"), F.col(self.text).alias("text"), F.xxhash64(self.text).alias("mark"))
        rows = rows.join(spans.withColumnsRenamed({"doc": "d", "mark": "m"}), F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
        # Built from the pieces between spans; start and end count code points, as the texts do.
        cut = F.aggregate(
            "spans",
            F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
            lambda a, s: F.struct(
                F.concat(a["out"], F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.element_at(F.array(*[F.lit(k.upper()) for k in KINDS]), s["kind"] + 1), F.lit("]")).alias("out"),
                s["end"].alias("at"),
            ),
            lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))),
        )
        return rows.select(F.col("doc").alias(self.id), F.coalesce(F.when(F.col("spans").isNotNull(), cut), F.col("text")).alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_replaced"))


def _apart(spans: list[dict]) -> list[dict]:
    """Spans that don't overlap: the likeliest first, of equals the longest, then the first."""
    taken: list[dict] = []
    for s in sorted(spans, key=lambda s: (-round(s["p"], 2), s["start"] - s["end"], s["start"], s["kind"])):
        if all(s["end"] <= t["start"] or t["end"] <= s["start"] for t in taken):
            taken.append(s)
    return taken
