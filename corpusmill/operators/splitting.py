"""Cutting texts into pieces, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_END = re.compile(r"(?<=[.!?])\s+|\n+")
_MARK = re.compile(r"[.,;:!?)\]]$")


def cut_long(words: list[str], limit: int) -> list[list[str]]:
    """Pieces of at most `limit` words: each ends after the last word with a mark that fits, else at the limit."""
    out = []
    while len(words) > limit:
        k = next((i for i in range(limit, 0, -1) if _MARK.search(words[i - 1])), limit)
        out.append(words[:k])
        words = words[k:]
    return out + [words] if words else out


def _sentences(text: str) -> list[list[str]]:
    return [w for w in (s.split() for s in _END.split(text)) if w]


def _pieces(cut):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, texts, sizes = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, piece in enumerate(cut(text or "")):
                    ids.append(key), at.append(k), texts.append(" ".join(piece)), sizes.append(len(piece))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(at, pa.int32()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())], ["id", "piece", "text", "words"])

    return run


def _apply(df: DataFrame, id: str, text: str, cut) -> DataFrame:
    kind = df.schema[id].dataType.simpleString()
    return df.select(id, text).mapInArrow(_pieces(cut), f"`{id}` {kind}, piece int, text string, words int")


def split_sentences(df: DataFrame, id: str, text: str, limit: int) -> DataFrame:
    """(id, piece, text, words): sentences and lines, longer ones cut. Null and blank texts have none."""
    return _apply(df, id, text, lambda t: [p for s in _sentences(t) for p in cut_long(s, limit)])


def split_words(df: DataFrame, id: str, text: str, budget: int) -> DataFrame:
    """(id, piece, text, words): as many whole sentences as fit the budget; one above it is cut."""

    def cut(t: str) -> list[list[str]]:
        out: list[list[str]] = []
        for s in _sentences(t):
            for p in cut_long(s, budget):
                if out and len(out[-1]) + len(p) <= budget:
                    out[-1] = out[-1] + p
                else:
                    out.append(p)
        return out

    return _apply(df, id, text, cut)
