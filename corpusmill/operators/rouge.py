"""Longest common subsequences of words, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.functions.words import words


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel: a row of the table is one integer."""
    at: dict[str, int] = {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, f = [], []
        for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            a, b = words(x), words(y)
            n.append(lcs(a, b))
            f.append(2.0 * n[-1] / (len(a) + len(b)) if a or b else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(f, pa.float64())], ["id", "lcs", "f1"])


def lcs_f1(df: DataFrame, id: str, a: str, b: str) -> DataFrame:
    """(id, lcs, f1) of two texts' words. Null and blank texts have no words; f1 is null if neither has any."""
    kind = df.schema[id].dataType.simpleString()
    return df.select(id, a, b).mapInArrow(_run, f"`{id}` {kind}, lcs int, f1 double")
