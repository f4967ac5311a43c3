"""Encoding of texts with a public byte-level BPE tokenizer.

Method: a segment tree over the byte positions of a piece. A leaf holds the rank of the pair that
starts at its byte with the live token there and the next live one; an inner node holds the least
of its leaves, so the root leads to the leftmost pair of the least rank. A merge changes three
leaves (the joined token, the one before it, the one that is swallowed), each in a logarithmic
number of steps. A piece of n bytes takes O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: how the tokenizer cuts a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 62
CACHE = 1 << 19


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a vocabulary: in folder, in CORPUSMILL_TOKENIZERS, or of the installed public_tokenizers."""
    folder = folder or os.environ.get("CORPUSMILL_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return read_ranks(lines)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1
    while size < n:
        size *= 2
    end = list(range(1, n + 1))  # of the token that starts here
    before = list(range(-1, n - 1))  # start of the live token before
    tree = [_NONE] * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        tree[size + i] = rank(piece[i : i + 2], _NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    while (least := tree[1]) < _NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != least:
                i += 1
        i -= size
        j = end[i]
        stop = end[i] = end[j]
        put(j, _NONE)
        if stop < n:
            before[stop] = i
            put(i, rank(piece[i : end[stop]], _NONE))
        else:
            put(i, _NONE)
        if i:
            h = before[i]
            put(h, rank(piece[h:stop], _NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder(dict):
    """Ids by piece. A piece that is itself an entry of the vocabulary is its own id (a test shows
    that merging every entry's bytes gives that entry). Emptied when full: memory stays bounded;
    long pieces aren't kept."""

    def __init__(self, vocabulary: bytes):
        self.ranks = read_ranks(vocabulary.splitlines())
        self.pieces = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        own = self.ranks.get(raw)
        ids = (own,) if own is not None else tuple(merge(raw, self.ranks))
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text)))) if text else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """For use where the file is: executors get it as a broadcast."""
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path] = Encoder(f.read())
    return _ENCODERS[path]


def _shared(name: str, file) -> Encoder:
    """One encoder a worker process, from the broadcast file."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(file.value)
    return _ENCODERS[name]


def _run(spark: SparkSession, path: str, counts: bool):
    with open(path, "rb") as f:
        file = f.read()
    name, shared = f"{path} {xxhash.xxh3_64_hexdigest(file)}", spark.sparkContext.broadcast(file)  # a file of about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _shared(name, shared).encode
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):  # so that ids of long texts don't pile up
                part = batch.slice(k, 1000)
                lists = [encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
                if counts:
                    out = pa.array(np.diff(ends), pa.int64())
                else:
                    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
                    out = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["id", "out"])

    return run


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the ids of each row's text, without special tokens, whose strings are ordinary text.

    One row out for each row in, repeated rows and null ids too; null and empty texts give an empty
    list; blank ones are encoded. No shuffle. Extra columns are ignored."""
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(_run(docs.sparkSession, path or tokenizer_file(), False), f"`{id}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, tokens): the number of ids of each row's text, as encode() has them."""
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(_run(docs.sparkSession, path or tokenizer_file(), True), f"`{id}` {kind}, tokens bigint")
