"""Records of several sources combined to target shares.

A record may belong to several sources.  Records are aggregated by the set of
sources they belong to (their pattern); a min-cost flow routes the tokens of each
pattern, once for each allowed repetition, to the quotas of its sources.  A
repetition costs more than the one before, so the cheapest flow repeats as little
as it can and spreads repetitions evenly.  The mix is as large as it can be with
every source at its share.  Then records are taken in a seeded order until each flow
is used up.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.bpe import count_tokens
from quern.workdir import fresh_dir

#: Records that one bucket of the seeded order should hold.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


class _Flow:
    """Successive cheapest paths on a graph of a few hundred nodes."""

    def __init__(self) -> None:
        self.to, self.room, self.cost, self.of = [], [], [], {}

    def arc(self, a, b, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.of.setdefault(x, []).append(len(self.to))
            self.of.setdefault(y, [])
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, start, end) -> None:
        while True:
            best, via, queue, waiting = {start: 0}, {}, deque([start]), {start}
            while queue:
                x = queue.popleft()
                waiting.discard(x)
                for e in self.of[x]:
                    y, c = self.to[e], best[x] + self.cost[e]
                    if self.room[e] > 0 and c < best.get(y, float("inf")):
                        best[y], via[y] = c, e
                        if y not in waiting:
                            waiting.add(y)
                            queue.append(y)
            if end not in via:
                return
            path, x = [], end
            while x != start:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            step = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step


def route(patterns: dict[tuple[str, ...], int], targets: list[Target], total: int) -> dict[tuple[str, ...], list[tuple[int, str, int]]]:
    """For each pattern: (repetition, source, tokens), of the cheapest of the greatest flows.

    The n-th use of a token costs n * n, so that costs rise ever faster.
    """
    flow, by, arcs = _Flow(), {t.source: t for t in targets}, []
    for p, tokens in sorted(patterns.items()):
        for n in range(1, max([by[s].repeats for s in p if s in by], default=0) + 1):
            flow.arc("in", (p, n), tokens, n * n)
            for s in p:
                if s in by and n <= by[s].repeats:
                    arcs.append((p, n, s, flow.arc((p, n), s, tokens, 0)))
    for t in targets:
        if t.source in flow.of:
            flow.arc(t.source, "out", round(t.share * total), 0)
    if arcs:
        flow.run("in", "out")
    got: dict[tuple[str, ...], list[tuple[int, str, int]]] = {}
    for p, n, s, e in arcs:
        if flow.room[e ^ 1]:
            got.setdefault(p, []).append((n, s, flow.room[e ^ 1]))
    return got


def largest_total(patterns: dict[tuple[str, ...], int], targets: list[Target]) -> int:
    """The greatest total at which each source that has records gets its whole share, but no more than all records once.

    Sources without records are left out of account: nothing fills their shares.
    """
    stocked = {s for p, tokens in patterns.items() if tokens for s in p}
    wanted = [t for t in targets if t.source in stocked]
    filled = lambda total: sum(n for parts in route(patterns, wanted, total).values() for *_, n in parts) == sum(round(t.share * total) for t in wanted)
    low, high = 0, sum(tokens for p, tokens in patterns.items() if any(t.source in p for t in wanted))
    if filled(high):
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if filled(mid) else (low, mid)
    return low


class Mix:
    """A mix of ``records`` (id BIGINT, sources ARRAY<STRING>, size BIGINT) by ``targets``.

    ``total``: tokens the mix should have; by default the ``largest_total`` at which all
    sources that have records reach their shares, so a small source that may be repeated
    only so often bounds the size of the mix.  With a greater total, a source whose
    records, used as often as allowed, don't fill its quota gives all it has, and nothing
    takes its place.  Records are used whole: a share may be off by half of the record
    at which its source is cut.

    Defined results: sources without a target are never used, targets without records
    get nothing, and the report names both; records with a null id, no source or a null
    or zero size are never used; a source named twice in ``sources`` counts once; equal
    records count each; of a target named twice the greater share and repeats hold.
    Patterns come to the driver: there are no more than subsets of the fixed targets
    that occur.
    """

    def __init__(self, spark: SparkSession, records: DataFrame, targets: DataFrame, seed: int = 0, total: int | None = None):
        self.spark = spark
        rows = targets.where(F.col("source").isNotNull() & (F.col("share") > 0) & (F.col("repeats") > 0)).groupBy("source").agg(F.max("share").alias("share"), F.max("repeats").alias("repeats")).collect()
        self.targets = sorted((Target(r["source"], float(r["share"]), int(r["repeats"])) for r in rows), key=lambda t: t.source)
        known = F.array(*[F.lit(t.source) for t in self.targets]).cast("array<string>")
        at = fresh_dir(spark, "mix")
        order = F.xxhash64(F.lit(seed).cast("bigint"), F.col("id"))
        own = F.array_sort(F.array_distinct(F.filter("sources", lambda x: x.isNotNull())))
        kept = records.where(F.col("id").isNotNull() & (F.size(own) > 0) & (F.col("size") > 0))
        kept = kept.select("id", "size", own.alias("sources"), F.array_join(F.array_intersect(own, known), "\n").alias("pattern"), order.alias("order"))
        kept.write.parquet(at)
        self.sized = spark.read.schema(kept.schema).parquet(at)
        stats = self.sized.where("pattern != ''").groupBy("pattern").agg(F.sum("size").alias("tokens"), F.count("*").alias("n")).collect()
        self.patterns = {tuple(r["pattern"].split("\n")): int(r["tokens"]) for r in stats}
        self.buckets = max(1, -(-max([r["n"] for r in stats], default=0) // BUCKET_ROWS))
        self.total = largest_total(self.patterns, self.targets) if total is None else total
        self.flows = route(self.patterns, self.targets, self.total)

    def _cuts(self) -> DataFrame:
        """Of each pattern: (source, from, to) on the line of its tokens in seeded order, for each repetition."""
        rows = []
        for p, flows in self.flows.items():
            cuts, level, at = [], 0, 0
            for n, s, tokens in sorted(flows):
                level, at = (n, 0) if n != level else (level, at)
                cuts.append((s, at, at + tokens))
                at += tokens
            rows.append(("\n".join(p), cuts))
        return self.spark.createDataFrame(rows, "pattern string, cuts array<struct<source: string, lo: bigint, hi: bigint>>")

    def selection(self) -> DataFrame:
        """id, source, n_uses, n_tokens: the records of the mix, for which source, and how often.

        The place of a record on its pattern's line is that of its bucket, from sums of
        buckets, and its place in the bucket, so a pattern is never sorted in one task.
        """
        rows = self.sized.where("pattern != ''").withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 20), F.lit(self.buckets)).cast("int"))
        sums = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("tokens"))
        w = Window.partitionBy("pattern").orderBy("bucket")
        sums = sums.select("pattern", "bucket", (F.sum("tokens").over(w) - F.col("tokens")).alias("base"))
        inside = Window.partitionBy("pattern", "bucket").orderBy("order", "id")
        rows = rows.withColumn("inner", F.sum("size").over(inside) - F.col("size")).join(sums, ["pattern", "bucket"])
        # A record belongs to the cut in which its middle lies.
        rows = rows.join(self._cuts(), "pattern").withColumn("at", F.col("base") + F.col("inner") + F.floor(F.col("size") / 2))
        rows = rows.withColumn("uses", F.transform(F.filter("cuts", lambda c: (c["lo"] <= F.col("at")) & (F.col("at") < c["hi"])), lambda c: c["source"]))
        rows = rows.select("id", "size", "uses", F.explode(F.array_distinct("uses")).alias("source"))
        return rows.select("id", "source", F.size(F.filter("uses", lambda x: x == F.col("source"))).alias("n_uses"), F.col("size").alias("n_tokens"))

    def report(self) -> DataFrame:
        """One row for each source with a target or with records: what it has, should give and gives."""
        has = self.sized.select("size", F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n_records"), F.sum("size").alias("tokens_available"))
        used = self.selection().groupBy("source").agg(F.count("*").alias("n_used"), F.sum(F.col("n_uses") * F.col("n_tokens")).alias("tokens_used"), F.max("n_uses").alias("most_uses"))
        want = self.spark.createDataFrame([(t.source, t.share, t.repeats, round(t.share * self.total)) for t in self.targets], "source string, target_share double, max_repeats int, tokens_wanted bigint")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        out = want.join(has, "source", "full").join(used, "source", "left")
        whole = F.sum(zero("tokens_used")).over(Window.partitionBy(F.lit(1)))
        return out.select("source", "target_share", "max_repeats", zero("n_records"), zero("tokens_available"), zero("tokens_wanted"), zero("n_used"), zero("tokens_used"), zero("most_uses"), F.round(F.coalesce(F.try_divide(zero("tokens_used"), whole), F.lit(0.0)), 6).alias("actual_share"))


def sized_records(spark: SparkSession, documents: DataFrame, id: str, text: str, source: Column, tokenizer: str) -> DataFrame:
    """id, sources, size: every record, with the sources of all records of exactly its text, and its number of tokens.

    Texts are read once: what goes on are their sizes and hashes (MD5, 16 bytes).
    """
    rows = documents.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"), source.alias("source"), F.when(F.length(text) > 0, F.unhex(F.md5(F.col(text)))).alias("mark"))
    sized = count_tokens(rows, tokenizer, "id", "text", keep=["source", "mark"]).withColumnsRenamed({"doc_id": "id", "n_tokens": "size"})
    at = fresh_dir(spark, "sizes")
    sized.write.parquet(at)
    return with_copies(spark.read.schema(sized.schema).parquet(at))


def with_copies(records: DataFrame) -> DataFrame:
    """Records (id, source, mark, size) with ``sources`` in place of source: those of all records with the same mark.

    Marks of several sources are combined before the shuffle; a text of one source,
    however often it occurs, is only matched with what is left.  A null mark is no copy.
    """
    sets = records.where(F.col("source").isNotNull() & F.col("mark").isNotNull()).groupBy("mark").agg(F.min("source").alias("a"), F.max("source").alias("b"), F.collect_set("source").alias("all"))
    rows = records.join(sets.where("a != b").select("mark", "all"), "mark", "left")
    return rows.select("id", F.coalesce("all", F.when(F.col("source").isNotNull(), F.array("source"))).alias("sources"), "size")
