"""Byte-level BPE over whole columns of text, by a segment tree for each piece.

A text is cut into pieces by the tokenizer's pattern; each distinct piece is
merged once and remembered.  Over the byte positions of a piece lies a segment
tree whose nodes hold the least ``rank * 2**32 + position`` of their pairs, so its
root is the leftmost pair of the lowest rank.  A merge replaces that pair and
updates the points of its live neighbours, each on one path to the root, so a
piece of n bytes takes time of order n log n, however long it is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that cuts text into pieces, as published with the vocabulary.  Fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a worker; beyond that it starts anew, which changes no result.
REMEMBERED = 400_000
#: Characters of text that are encoded in one go.
AT_ONCE = 2_000_000
_NONE = 2**62


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The tokenizer in a file of the public ``tokenizers`` format with byte-level BPE.

    Files that do more with a text (normalise it, cut it by another pattern, mark words or
    drop merges at random) are refused, as their ids would be others.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, cut = whole["model"], whole.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(c) for c in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or whole.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space", True) or not cut.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE")
        vocab = model["vocab"]
        self.of_byte = [0] * 256
        for letter, b in _byte_letters().items():
            self.of_byte[b] = vocab[letter]
        self.size = max(vocab.values()) + 1
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.pairs = {vocab[a] * self.size + vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.pieces = regex.compile(PIECES)
        self.memory: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The tokens of one piece: each merge costs a few paths to the root."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        ids = [self.of_byte[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none, size, pairs = _NONE, self.size, self.pairs
        tree = [none] * (2 * width)
        for p in range(n - 1):
            hit = pairs.get(ids[p] * size + ids[p + 1])
            if hit:
                tree[width + p] = (hit[0] << 32) + p
        for p in range(width - 1, 0, -1):
            a, b = tree[2 * p], tree[2 * p + 1]
            tree[p] = a if a < b else b

        def put(p: int, value: int) -> None:
            p += width
            tree[p] = value
            while p > 1:
                p >>= 1
                a, b = tree[2 * p], tree[2 * p + 1]
                best = a if a < b else b
                if tree[p] == best:
                    return
                tree[p] = best

        while tree[1] < none:
            at = tree[1] & 0xFFFFFFFF
            gone = after[at]
            ids[at] = pairs[ids[at] * size + ids[gone]][1]
            ids[gone] = -1
            follow = after[gone]
            after[at] = follow
            if gone < width:
                put(gone, none)
            hit = None
            if follow < n:
                before[follow] = at
                hit = pairs.get(ids[at] * size + ids[follow])
            put(at, (hit[0] << 32) + at if hit else none)
            prev = before[at]
            if prev >= 0:
                hit = pairs.get(ids[prev] * size + ids[at])
                put(prev, (hit[0] << 32) + prev if hit else none)
        return [i for i in ids if i >= 0]

    def encode(self, texts: list[str | None]) -> list[list[list[int]]]:
        """For each text, the token lists of its pieces."""
        cut = [self.pieces.findall(t) if t else [] for t in texts]
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        for p in set(chain.from_iterable(cut)).difference(self.memory):
            self.memory[p] = self.merge(p.encode("utf-8", "replace"))
        find = self.memory.__getitem__
        return [list(map(find, pieces)) for pieces in cut]


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One for each worker process and file."""
    return Bpe(path)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in parts of at most about AT_ONCE bytes of text, at least one row each."""
    sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > AT_ONCE:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def encode_corpus(documents: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids: the tokens of each text, without special tokens.

    ``path``: the tokenizer's file, at the same place on every executor.

    Defined results: an empty and a null text have the empty list; strings that look
    like special tokens are ordinary text; a row for each row, repeated or not, with a
    null id as well; texts of any length are encoded whole; other columns are never read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in _parts(batch):
                docs = bpe.encode(part.column("text").to_pylist())
                flat = [list(chain.from_iterable(d)) for d in docs]
                ends = np.cumsum([0, *map(len, flat)], dtype=np.int32)
                values = np.fromiter(chain.from_iterable(flat), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "ids"])

    rows = documents.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, path: str, id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_tokens and the columns ``keep``: as ``encode_corpus``, only the number."""
    rows = documents.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), *keep)
    schema = rows.drop("text").withColumn("n_tokens", F.lit(0).cast("bigint")).schema
    names = schema.names

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in _parts(batch):
                n = pa.array([sum(map(len, d)) for d in bpe.encode(part.column("text").to_pylist())], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names[:-1]], n], names)

    return rows.mapInArrow(count, schema)
