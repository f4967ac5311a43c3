"""Token streams: documents delimited by markers, chunks, padding, patches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let
from corpusmill.operators.ordered import running, with_previous

BOS, EOS = 50257, 50256


def stream(docs: DataFrame, by: str, order: str, ids: str, bos: int | None = BOS, eos: int | None = EOS) -> DataFrame:
    """(by, order, i, tok): the tokens of each document between its markers, i from 0 in the document."""
    parts = [F.col(ids).cast("array<int>")]
    if bos is not None:
        parts.insert(0, F.array(F.lit(bos)))
    if eos is not None:
        parts.append(F.array(F.lit(eos)))
    return docs.select(by, order, F.posexplode(F.concat(*parts)).alias("i", "tok"))


def offsets(docs: DataFrame, by: str, order: Sequence[str], size: Column) -> DataFrame:
    """docs with start and stop: half-open places in the stream of their group. By running totals over
    ranges of the order, so a hot group is shared by tasks."""
    return running(docs, order, {"stop": size}, [by]).withColumn("start", F.col("stop") - size)


def segments(tokens: DataFrame, by: str, pos: str, tok: str, bos: int = BOS, eos: int = EOS) -> DataFrame:
    """(by, start, stop, valid) of each document in a stream of positioned tokens: from a bos to before
    the next; valid if its only eos is its last token. Groups are independent streams of any length:
    the number of the document is a running total over ranges of places."""
    d = running(tokens.select(by, pos, tok), [pos], {"_d": (F.col(tok) == bos).cast("int")}, [by])
    d = d.groupBy(by, "_d").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("stop"), F.count_if(F.col(tok) == eos).alias("_e"), F.max_by(tok, pos).alias("_l"))
    return d.select(by, "start", "stop", ((F.col("_d") > 0) & (F.col("_e") == 1) & (F.col("_l") == eos)).alias("valid"))


def ends(tokens: DataFrame, by: str, pos: str, tok: str, eos: int = EOS) -> DataFrame:
    """(by, start, stop, valid) of each document that an eos ends; what is left after the last one of a
    stream is a row that isn't valid."""
    e = tokens.where(F.col(tok) == eos).select(by, (F.col(pos) + 1).alias("stop"))
    told = with_previous(e, ["stop"], "stop", "start", [by]).select(by, F.coalesce("start", F.lit(0)).alias("start"), "stop", F.lit(True).alias("valid"))
    last = tokens.groupBy(by).agg((F.max(pos) + 1).alias("stop"), F.max(F.when(F.col(tok) == eos, F.col(pos) + 1)).alias("start"))
    rest = last.select(by, F.coalesce("start", F.lit(0)).alias("start"), "stop", F.lit(False).alias("valid")).where("start < stop")
    return told.unionByName(rest)


def chunk_lengths(bounds: DataFrame, by: str, start: str, stop: str, size: int) -> DataFrame:
    """(by, chunk, lengths): how a stream's chunks of `size` tokens are made up of documents, in order.
    bounds: half-open places. A chunk has at most `size` pieces."""
    pieces = bounds.where(F.col(stop) > F.col(start)).select(by, start, stop, F.explode(F.sequence(F.floor(F.col(start) / size), F.floor((F.col(stop) - 1) / size))).alias("chunk"))
    low, high = F.greatest(start, F.col("chunk") * size), F.least(stop, (F.col("chunk") + 1) * size)
    cut = pieces.select(by, "chunk", F.struct(low.alias("at"), (high - low).alias("n")).alias("x"))
    return cut.groupBy(by, "chunk").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["n"]).alias("lengths"))


def chunks(items: Column, size: int) -> Column:
    """Whole chunks of `size` items; a rest is dropped."""
    n = F.floor(F.size(items) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(items, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<int>>"))


def document_lengths(items: Column, eos: int = EOS) -> Column:
    """Lengths of the documents in a chunk: each up to and with an eos, and what is left after the last."""
    n = F.size(items)
    at = F.filter(F.transform(items, lambda t, i: F.when(t == eos, i + 1)), lambda x: x.isNotNull())
    bounds = F.array_distinct(F.concat(F.array(F.lit(0)), at, F.array(n)))
    return F.transform(F.slice(bounds, 2, F.greatest(F.size(bounds) - 1, F.lit(0))), lambda x, i: x - F.get(bounds, i))


def padded(items: Column, width: Column, fill: int, left: bool = False) -> Column:
    more = F.array_repeat(F.lit(fill), F.greatest(width - F.size(items), F.lit(0)))
    return F.concat(more, items) if left else F.concat(items, more)


def patches(df: DataFrame, id: str, text: str, table: dict[str, str]) -> DataFrame:
    """(id, at, old, new, shift): each replacement in its text, in order; at from 0 in the old text;
    shift is how far later places move. Escapes don't overlap."""
    pattern = "|".join(table)
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = df.where(F.col(text).isNotNull()).select(id, F.posexplode(found).alias("k", "old"), parts.alias("parts"))
    lengths = F.aggregate(F.slice("parts", F.lit(1), F.col("k") + 1), F.lit(0), lambda a, x: a + F.length(x))
    new = F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("old"))
    width = len(next(iter(table)))
    return rows.select(id, (lengths + F.col("k") * width).alias("at"), "old", new.alias("new"), ((F.col("k") + 1) * (1 - width)).alias("shift"))


def replayed(text: Column, patches: Column, forward: bool = True) -> Column:
    """A text with its patches applied, or, if it is a patched one, taken back. patches: array of (at, old,
    new) in order of place, at in the old text. Pieces between them are joined once."""

    def at(x: Column, k: Column) -> Column:  # in the text at hand: each patch before moved it
        moved = F.aggregate(F.slice(patches, F.lit(1), k), F.lit(0), lambda a, y: a + F.length(y["new"]) - F.length(y["old"]))
        return x["at"] if forward else x["at"] + moved

    seen, put = ("old", "new") if forward else ("new", "old")
    cuts = F.transform(patches, lambda x, k: F.struct(at(x, k).alias("a"), (at(x, k) + F.length(x[seen])).alias("z"), x[put].alias("put")))

    def joined(c: Column) -> Column:
        pieces = F.transform(c, lambda x, k: F.concat(F.substring(text, F.coalesce(F.get(c, k - 1)["z"], F.lit(0)) + 1, x["a"] - F.coalesce(F.get(c, k - 1)["z"], F.lit(0))), x["put"]))
        tail = F.substring(text, F.coalesce(F.get(c, F.size(c) - 1)["z"], F.lit(0)) + 1, F.length(text))
        return F.concat(F.array_join(pieces, ""), tail)

    return let(cuts, joined)


def translated(df: DataFrame, id: str, text: str, table: dict[str, str], mark: str = "\n") -> DataFrame:
    """(id, old_at, new_at): the place after every `mark` of a text, before and after the replacements. Each
    text is read once; places are found in the sorted patches. Null texts have none."""
    pattern = re.compile("|".join(map(re.escape, table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, olds, news = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                if t is None:
                    continue
                found = [(m.end(), len(table[m[0]]) - len(m[0])) for m in pattern.finditer(t)]
                places = np.array([m.end() for m in re.finditer(re.escape(mark), t)], np.int64)
                shift = np.concatenate([[0], np.cumsum([d for _, d in found])]).astype(np.int64)
                new = places + shift[np.searchsorted([e for e, _ in found], places, side="right")] if found else places
                rows.append(np.full(len(places), k)), olds.append(places), news.append(new)
            at = np.concatenate(rows) if rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at.astype(np.int64))), *(pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (olds, news))], ["id", "old_at", "new_at"])

    return df.select(id, text).mapInArrow(run, f"`{id}` {df.schema[id].dataType.simpleString()}, old_at bigint, new_at bigint")
