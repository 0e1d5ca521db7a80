"""Folds in order of time, for what no window or aggregate can say.

Rows are partitioned by key and sorted within partitions, so Spark spills what does
not fit; Python then sees one sorted stream of Arrow batches and keeps the state of
one key at a time.  However many rows a key has, memory stays that of its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class State(Protocol):
    """What a fold does with one key's rows, in order: ``push`` and ``end`` return output rows without the key."""

    def push(self, row: tuple) -> list[tuple]: ...

    def end(self) -> list[tuple]: ...


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], inputs: Sequence[str], start: Callable[[], State], output: str) -> DataFrame:
    """Output rows ``keys + output`` of a fold over ``inputs`` of each key, in ``order``.

    Rows with a null key form a key of their own; an empty table gives no rows.
    """
    keys, inputs = list(keys), list(inputs)
    wanted = [*keys, *[c for c in inputs if c not in keys]]
    key_ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    ddl = f"{key_ddl}, {output}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            nonlocal out
            cols = list(zip(*out)) if out else [()] * len(schema)
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for b in batches:
            cols = [b.column(c).to_pylist() for c in wanted]
            k = len(keys)
            place = [wanted.index(c) for c in inputs]
            for row in zip(*cols):
                key = row[:k]
                if state is None or key != now:
                    if state is not None:
                        out += [now + r for r in state.end()]
                    now, state = key, start()
                out += [key + r for r in state.push(tuple(row[i] for i in place))]
            if len(out) > 5_000:
                yield flush()
        if state is not None:
            out += [now + r for r in state.end()]
        yield flush()

    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.select(*wanted).mapInArrow(run, ddl)
