"""Evaluation texts in the corpus: documents that hold a run of an item's words.

Method: a prefix-filtered set join. The shingles (runs of five words) of the items are counted over
all documents and ordered by rarity. A run of 13 words is in a document only with all nine of its
shingles, the rarest among them: that one is the run's necessary prefix token, and only prefix tokens
are looked up and joined. Bounds on place and length drop windows that stick out of the document;
the rest are verified, word by word, on the item-sized window that came with the hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.words import runs, word_hashes, words
from corpusmill.session import materialize

RUN = 5


def _item_windows(length: int):
    """(item, text) to (item, window, grams): each run of `length` words with the hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, windows, grams = [], [], []
            for item, text in zip(*(batch.column(k).to_pylist() for k in range(2))):
                found = words(text)
                if item is None or len(found) < length:
                    continue
                own = np.lib.stride_tricks.sliding_window_view(runs(word_hashes(found), RUN).view(np.int64), length - RUN + 1)
                items += [item] * len(own)
                windows += [" ".join(found[q : q + length]) for q in range(len(own))]
                grams += own.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(windows, pa.string()), pa.array(grams, pa.list_(pa.int64()))], ["item", "window", "grams"])

    return run


def _wanted(grams: DataFrame, size: int):
    """The column `gram` as a bit map of fixed size (size / 8 bytes, whatever the number of items),
    broadcast. Grams outside of it are not of the table; of the others a few may not be either."""
    bits = grams.select((F.pmod("gram", F.lit(size)) + 1).alias("at"))  # bits are numbered from 1
    parts = bits.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in parts:  # 4,096 bytes each
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.m, np.uint8)
    return grams.sparkSession.sparkContext.broadcast(out)


def _in(wanted: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places of the grams that the bit map has."""
    at = grams % (8 * len(wanted))
    return np.flatnonzero(wanted[at >> 3] >> (at & 7).astype(np.uint8) & 1)


def _counts(wanted, length: int):
    """How often each wanted shingle stands in the texts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                own = words(text)
                if len(own) >= length:
                    grams = runs(word_hashes(own), RUN).view(np.int64)
                    found.append(grams[_in(bits, grams)])
            grams, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n, pa.int64())], ["gram", "n"])

    return run


def _hits(wanted, length: int):
    """Places of the wanted shingles in each document, with the words that any window over them can have."""
    span = length - RUN + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            docs, pos, size, hit, ctx = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                if doc is None or len(found) < length:
                    continue
                grams = runs(word_hashes(found), RUN).view(np.int64)
                for p in _in(bits, grams).tolist():
                    docs.append(doc), pos.append(p), size.append(len(found)), hit.append(int(grams[p]))
                    ctx.append(" ".join(found[max(0, p - span + 1) : p + length]))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((docs, pos, size, hit, ctx), kinds)], ["doc", "pos", "size", "gram", "ctx"])

    return run


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", fields: tuple[str, ...] = ("passage", "question"), length: int = 13, bits: int = 1 << 26) -> DataFrame:
    """(item_id, doc_id), once each: the document holds at least `length` consecutive words of one of
    the item's fields, next to each other and in the same order.

    Null, empty and short texts on either side match nothing; null ids are ignored; repeated rows
    count once; extra columns are ignored; empty tables give no rows. The documents are read twice,
    however many items there are: once to count the items' shingles, once for the prefix tokens. What
    is sent to the executors is a map of `bits` bits (a multiple of 32,768; 8 MB); the joins themselves are on the shingles."""
    span = length - RUN + 1
    own = [items.select(F.col(item_id).cast("bigint").alias("item"), F.col(f).alias("text")) for f in fields]
    every = own[0]
    for w in own[1:]:
        every = every.unionByName(w)
    windows = materialize(every.mapInArrow(_item_windows(length), "item bigint, window string, grams array<bigint>").distinct(), "windows")
    grams = windows.select("item", "window", F.posexplode("grams").alias("o", "gram"))
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    counted = read.where("doc is not null").select("text").mapInArrow(_counts(_wanted(grams.select("gram").distinct(), bits), length), "gram bigint, n bigint")
    rarity = materialize(counted.groupBy("gram").agg(F.sum("n").alias("df")), "rarity")
    # a window one of whose shingles stands nowhere is in no document
    rare = grams.join(rarity, "gram").groupBy("item", "window").agg(F.count("*").alias("met"), F.min(F.struct("df", "o", "gram")).alias("rare")).where(F.col("met") == span)
    rare = materialize(rare.select("item", "window", F.col("rare.o").alias("o"), F.col("rare.gram").alias("gram")), "prefixes")
    hits = read.mapInArrow(_hits(_wanted(rare.select("gram").distinct(), bits), length), "doc bigint, pos int, size int, gram bigint, ctx string")
    found = hits.join(rare, "gram").where((F.col("pos") >= F.col("o")) & (F.col("pos") - F.col("o") + length <= F.col("size")))
    found = found.where(F.instr(F.concat(F.lit(" "), "ctx", F.lit(" ")), F.concat(F.lit(" "), "window", F.lit(" "))) > 0)
    return found.select(F.col("item").alias(item_id), F.col("doc").alias(doc_id)).distinct()
