"""The nearest text of one side for each text of the other, without a table of the pairs.

Texts are kept in blocks of some megabytes, compressed. Each block tells which runs of five words it has, as short
keys in a bit or so a key more than their number needs; a bucket of keys answers with a bit a key whether the other side has it too.
What is left of a block are the places of runs that both sides may have. These lists are small; each of one side
meets each of the other in memory, where pairs are counted and only the best of each text is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.words import _STEP, mix
from corpusmill.operators.similarity import _hashed, _split
from corpusmill.session import drop as drop_tables
from corpusmill.session import materialize

#: Words of the runs that are counted and of those that cover; a run of LONG words is LONG - SHORT + 1 consecutive runs of SHORT.
SHORT, LONG = 5, 13
#: Bytes of text in a block, documents and runs in a list of each side, and rows made at once of two lists.
_TEXT, _DOCS, _RUNS, _ROWS = 9_000_000, (2500, 1500), 400_000, 2_000_000
#: Bits of a key beyond those of the number of all runs: one in 16 or less passes by chance, and meets nothing later.
_SPARE = 4


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, side, body) to blocks; a key is a SHA-256 of the body."""
    parts, held, made = [], 0, 0

    def block() -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        every = [x.encode() for x in t["body"].to_pylist()]
        text = b"\n".join(every)
        one = lambda x: pa.ListArray.from_arrays([0, t.num_rows], x)
        own = pa.array([(TaskContext.get().partitionId() << 20) + made], pa.int64())
        return pa.RecordBatch.from_arrays([own, pa.array([len(text)], pa.int64()), one(t["id"].combine_chunks()), one(t["side"].combine_chunks()), one(pa.array([hashlib.sha256(x).digest() for x in every], pa.binary())), pa.array([pa.compress(text, "zstd", asbytes=True)], pa.binary())], ["block", "size", "ids", "sides", "keys", "text"])

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            parts.append(pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(len(c)))) for c in part.columns], part.schema.names))
            held += part.nbytes
            if held >= _TEXT:
                yield block()
                parts, held, made = [], 0, made + 1
    if parts:
        yield block()


def packed(docs: DataFrame) -> DataFrame:
    """(block, size, ids, sides, keys, text) of docs (id, side, body), written once. side: 0 or 1, body: words with a space between."""
    rows = docs.select(F.col("id").cast("bigint").alias("id"), F.col("side").cast("int").alias("side"), "body")
    return materialize(rows.mapInArrow(_packed, "block bigint, size bigint, ids array<bigint>, sides array<int>, keys array<binary>, text binary"), "blocks")


def _words(text: bytes, size: int) -> pa.ListArray:
    return _split(pa.array(pa.decompress(text, size, "zstd", asbytes=True).decode().split("\n"), pa.string()))


def _coded(keys: np.ndarray, bits: int) -> bytes:
    """Sorted different keys of so many bits (Elias and Fano): the lower bits of each, then a one for each at its upper part and number."""
    low = max(0, bits - len(keys).bit_length())
    upper = np.zeros(len(keys) + (1 << bits - low), np.uint8)
    upper[(keys >> np.uint64(low)).astype(np.int64) + np.arange(len(keys))] = 1
    lower = (keys[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    return np.packbits(lower).tobytes() + np.packbits(upper).tobytes()


def _decoded(raw: bytes, count: int, bits: int) -> np.ndarray:
    low = max(0, bits - count.bit_length())
    data, own = np.frombuffer(raw, np.uint8), (count * low + 7) // 8
    keys = (np.flatnonzero(np.unpackbits(data[own:]))[:count] - np.arange(count)) << low
    lower = np.unpackbits(data[:own], count=count * low).reshape(count, low)
    for k in range(low):
        keys |= lower[:, k].astype(np.int64) << k
    return keys


def _told(bits: int, log: int):
    """Blocks to (bucket, block, side, n, keys): the keys of each side's runs, in 2 ** log buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, size, sides, text = (batch.column(c)[row] for c in ("block", "size", "sides", "text"))
                flat, count = _hashed(_words(text.as_py(), size.as_py()), SHORT)
                slot, side = flat.view(np.uint64) >> np.uint64(64 - bits), np.repeat(sides.values.to_numpy().astype(np.int8), count)
                del flat
                for k in (0, 1):
                    own = np.unique(slot[side == k])
                    bucket = (own >> np.uint64(bits - log)).astype(np.int32)
                    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
                    ends = [*cuts[1:], len(own)]
                    own &= np.uint64((1 << bits - log) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket[cuts]), pa.array([block.as_py()] * len(cuts), pa.int64()), pa.array([k] * len(cuts), pa.int32()), pa.array([b - a for a, b in zip(cuts, ends)], pa.int32()), pa.array([_coded(own[a:b], bits - log) for a, b in zip(cuts, ends)], pa.binary())],
                        ["bucket", "block", "side", "n", "keys"],
                    )

    return run


def _answered(bits: int):
    """All of a bucket to (block, side, bucket, known, ids): a bit for each key of each block's side, whether the other side has it; ids null."""

    def run(table: pa.Table) -> pa.Table:
        sides, ns = table["side"].to_pylist(), table["n"].to_pylist()
        has = np.zeros((2, 1 << bits), bool)
        every = [_decoded(raw, n, bits) for raw, n in zip(table["keys"].to_pylist(), ns)]
        for side, keys in zip(sides, every):
            has[side, keys] = True
        known = [np.packbits(has[1 - side, keys]).tobytes() for side, keys in zip(sides, every)]
        return pa.table([table["block"], table["side"], table["bucket"], pa.array(known, pa.binary()), pa.nulls(len(ns), pa.list_(pa.int64()))], ["block", "side", "bucket", "known", "ids"])

    return run


_LIST = "list bigint, side int, runs bigint, ids binary, ms binary, ns binary, sizes binary, steps binary, hashes binary, at binary"


def _bytes(x: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers as bytes, the highest of all first, which compresses and moves faster than arrays."""
    return np.ascontiguousarray(x.astype(f">u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _numbers(raw: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f">u{width}").reshape(-1).astype(f"i{width}")


def _different(doc: np.ndarray, h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many different runs each document has: few come again, and only these are sorted by document."""
    mixed = h.view(np.uint64) ^ mix(np.arange(len(count), dtype=np.uint64))[doc]
    every = np.sort(mixed)
    again = np.flatnonzero(np.isin(mixed, every[1:][every[1:] == every[:-1]]))
    doc, h = doc[again], h[again]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    return count - np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (h[1:] == h[:-1])], minlength=len(count))


def _listed(bits: int, log: int):
    """A block and its answers to lists: of the first documents of each content those runs that the other side may have."""

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        out, first = [], told.filter(pc.is_valid(told["ids"]))
        if not block.num_rows or not first.num_rows:
            return pa.table([pa.array([], t) for t in _TYPES], _NAMES)
        ids, sides = (block[c].combine_chunks().flatten().to_numpy() for c in ("ids", "sides"))
        words = _words(block["text"][0].as_py(), block["size"][0].as_py())
        h, count = _hashed(words, SHORT)
        n = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        del words
        doc, pos = np.repeat(np.arange(len(count), dtype=np.int32), count), np.arange(len(h), dtype=np.int32)
        pos -= np.repeat((np.cumsum(count) - count).astype(np.int32), count)
        m = _different(doc, h, count)
        side, slot = np.repeat(sides.astype(np.int8), count), h.view(np.uint64) >> np.uint64(64 - bits)
        kept = np.zeros(len(h), bool)
        for k in (0, 1):
            mine = told.filter(pc.and_(pc.is_null(told["ids"]), pc.equal(told["side"], k))).sort_by("bucket")
            own, at = np.unique(slot[side == k], return_inverse=True)
            each = np.bincount((own >> np.uint64(bits - log)).astype(np.int64), minlength=1 << log)
            known = [np.unpackbits(np.frombuffer(raw, np.uint8), count=each[b]) for b, raw in zip(mine["bucket"].to_pylist(), mine["known"].to_pylist())]
            kept[side == k] = np.concatenate(known)[at] > 0 if known else False
        del side, slot
        doc, pos, h = doc[kept], pos[kept], h[kept]
        sizes = np.bincount(doc, minlength=len(count))
        ends, chosen = np.cumsum(sizes), np.isin(ids, first["ids"].combine_chunks().flatten().to_numpy())
        for k in (0, 1):
            mine = np.flatnonzero((sides == k) & chosen & (sizes > 0))
            mine = mine[np.argsort(ids[mine])]
            part = np.maximum.accumulate(np.maximum(np.arange(len(mine)) // _DOCS[k], np.cumsum(sizes[mine]) // _RUNS))
            for own in np.split(mine, np.flatnonzero(np.diff(part)) + 1) if len(mine) else []:
                total = np.cumsum(sizes[own])
                rows = np.arange(total[-1]) + np.repeat(ends[own] - total, sizes[own])
                step = np.diff(pos[rows], prepend=0)
                begin = total - sizes[own]
                step[begin] = pos[rows][begin]
                distinct, at = np.unique(h[rows].view(np.uint64), return_inverse=True)
                name = block["block"][0].as_py() * 2048 + len(out)
                out.append((name, k, len(rows), _bytes(ids[own], 8), *(_bytes(x) for x in (m[own], n[own], sizes[own], step)), _bytes(distinct, 8), _bytes(at)))
        return pa.table([pa.array([x[c] for x in out], t) for c, t in enumerate(_TYPES)], _NAMES)

    return run


_NAMES = [c.split(" ")[0] for c in _LIST.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 7]


class _Texts:
    """A list in memory: ids, m and n of documents; doc, pos and at, a hash of `hashes`, of their runs."""

    def __init__(self, ids: bytes, ms: bytes, ns: bytes, sizes: bytes, steps: bytes, hashes: bytes = b"", at: bytes = b""):
        self.ids, self.m, self.n = _numbers(ids, 8), _numbers(ms).astype(np.int64), _numbers(ns).astype(np.int64)
        self.hashes, self.at, sizes, steps = _numbers(hashes, 8).view(np.uint64), _numbers(at), _numbers(sizes), _numbers(steps).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.ids)), sizes)
        ends = np.cumsum(sizes)
        own = np.cumsum(steps)
        self.pos = own - np.repeat(own[ends - sizes] - steps[ends - sizes], sizes)

    def part(self, a: int, b: int) -> _Texts:
        out = object.__new__(_Texts)
        rows = slice(*np.searchsorted(self.doc, [a, b]))
        out.ids, out.m, out.n, out.at, out.doc, out.pos, out.hashes = self.ids[a:b], self.m[a:b], self.n[a:b], self.at[rows], self.doc[rows] - a, self.pos[rows], self.hashes
        return out


class _Best:
    """The best of each text of a list by similarity, containment and coverage, with their ids, and which runs begin one of LONG words that any has."""

    def __init__(self, texts: _Texts):
        self.value, self.source = np.full((3, len(texts.ids)), -1.0), np.zeros((3, len(texts.ids)), np.int64)
        self.met = np.zeros(len(texts.doc), bool)

    def take(self, kind: int, a: np.ndarray, value: np.ndarray, source: np.ndarray) -> None:
        """Values of texts a, sorted by a and then source."""
        if not len(a):
            return
        cuts = np.flatnonzero(np.diff(a, prepend=-1))
        top = np.maximum.reduceat(value, cuts)
        hits = np.flatnonzero(value == np.repeat(top, np.diff(cuts, append=len(a))))
        hits = hits[np.flatnonzero(np.diff(a[hits], prepend=-1))]  # the smallest of equals
        self.merge(kind, a[cuts], top, source[hits])

    def merge(self, kind: int, a: np.ndarray, value: np.ndarray, source: np.ndarray) -> None:
        new = (value > self.value[kind, a]) | ((value == self.value[kind, a]) & (source < self.source[kind, a]))
        self.value[kind, a[new]], self.source[kind, a[new]] = value[new], source[new]


def _posts(run: np.ndarray, doc: np.ndarray, docs: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents of each of `count` runs, one run after the other, where they begin, and how many they are."""
    both = np.sort(run.astype(np.int64) * docs + doc)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])[: len(both)]]
    run = both // docs
    doc = both - run * docs
    own = np.bincount(run, minlength=count)
    return doc, np.cumsum(own) - own, own


def _numbered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of each pair among the different ones, and how many these are."""
    order = np.lexsort((y, x))
    new = np.concatenate([[False], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum()) + 1


def _drawn(count: int, seed: int) -> np.ndarray:
    """64 bits for each number."""
    return mix(np.arange(count, dtype=np.uint64) * np.uint64(4) + np.uint64(seed))


def _long(texts: _Texts, common: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows at which a run of LONG words begins, all of common short ones, and 128 bits of these."""
    k = LONG - SHORT
    linked = (common[:-1] >= 0) & (common[1:] >= 0) & (texts.doc[1:] == texts.doc[:-1]) & (texts.pos[1:] == texts.pos[:-1] + 1)
    total = np.concatenate([[0], np.cumsum(linked)])
    at = np.flatnonzero(total[k:] - total[:-k] == k) if len(total) > k else np.empty(0, np.int64)
    if not len(at):
        return at, []
    names = []
    for seed in (1, 2):
        own, name = _drawn(common.max() + 1, seed), np.zeros(len(at), np.uint64)
        for step in range(k + 1):
            name = name * _STEP + own[common[at + step]]
        names.append(mix(name))
    return at, names


def _met(a: _Texts, b: _Texts, best: _Best) -> None:
    """What the texts of b are to those of a."""
    docs = len(b.ids)
    at = np.minimum(np.searchsorted(a.hashes, b.hashes), len(a.hashes) - 1)
    same = np.flatnonzero(a.hashes[at] == b.hashes)
    seen = np.zeros(len(b.hashes), bool)
    seen[b.at] = True  # a part of a list has not all of its runs
    same = same[seen[same]]
    if not len(same):
        return
    to_a, to_b = np.full(len(a.hashes), -1, np.int32), np.full(len(b.hashes), -1, np.int32)
    to_a[at[same]] = to_b[same] = np.arange(len(same))
    in_a, in_b = to_a[a.at], to_b[b.at]
    x, x0, xn = _posts(in_a[in_a >= 0], a.doc[in_a >= 0], len(a.ids), len(same))
    y, y0, yn = _posts(in_b[in_b >= 0], b.doc[in_b >= 0], docs, len(same))
    # runs that the same texts have, under 128 bits of each side's, as one with their number
    names = [np.add.reduceat(_drawn(size, seed)[v], v0) for v, v0, size in ((x, x0, len(a.ids)), (y, y0, docs)) for seed in (1, 2)]
    names[0] ^= mix(names[2])
    names[1] ^= mix(names[3] + np.uint64(1))
    number, kinds = _numbered(names[0], names[1])
    weight, own = np.bincount(number, minlength=kinds), np.empty(kinds, np.int64)
    own[number] = np.arange(len(number))
    begin, name_a = _long(a, in_a)
    begin_b, name_b = _long(b, in_b)
    longs = len(begin) and len(begin_b)
    if longs:
        number, kinds = _numbered(np.concatenate([name_a[0], name_b[0]]), np.concatenate([name_a[1], name_b[1]]))
        long_a, long_b = number[: len(begin)], number[len(begin) :]
        z, z0, zn = _posts(long_b, b.doc[begin_b], docs, kinds)
    if docs > 1 and max((xn[own] * yn[own]).sum(), zn[long_a].sum() if longs else 0, len(a.ids) * docs) > _ROWS:
        _met(a, b.part(0, docs // 2), best)
        _met(a, b.part(docs // 2, docs), best)
        return
    entries = np.repeat(x0[own] - np.cumsum(xn[own]) + xn[own], xn[own]) + np.arange(xn[own].sum())
    each = np.repeat(own, xn[own])
    many = yn[each]
    cell = np.repeat(x[entries] * docs, many) + y[np.repeat(y0[each] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    shared = np.bincount(cell, np.repeat(np.repeat(weight, xn[own]).astype(np.float64), many), len(a.ids) * docs)
    cell = np.flatnonzero(shared > 0)
    shared = shared[cell]
    i = cell // docs
    j = cell - i * docs
    best.take(0, i, shared / (a.m[i] + b.m[j] - shared), b.ids[j])
    kept = np.flatnonzero(shared >= 20)
    i, j, shared = i[kept], j[kept], shared[kept]
    kept = np.minimum(a.n[i], b.n[j]) >= 50
    i, j, shared = i[kept], j[kept], shared[kept]
    best.take(1, i, shared / np.minimum(a.m[i], b.m[j]), b.ids[j])
    if longs:
        many = zn[long_a]
        best.met[begin[many > 0]] = True
        cell = np.repeat(a.doc[begin] * docs, many) + z[np.repeat(z0[long_a] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        place = np.sort(cell << 32 | np.repeat(a.pos[begin], many))
        cell, place = place >> 32, place & 0xFFFFFFFF
        covers = np.full(len(cell), LONG)
        covers[:-1] = np.where(cell[1:] == cell[:-1], np.minimum(place[1:] - place[:-1], LONG), LONG)
        cuts = np.flatnonzero(np.diff(cell, prepend=-1))
        if len(cuts):
            i, j = np.divmod(cell[cuts], docs)
            best.take(2, i, np.add.reduceat(covers, cuts) / a.n[i], b.ids[j])


_SHAPE = ("ids", "ms", "ns", "sizes", "steps")


def _texts(batch: pa.RecordBatch, row: int, prefix: str) -> _Texts:
    return _Texts(*(batch.column(prefix + c)[row].as_py() for c in (*_SHAPE, "hashes", "at")))


def _bests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of lists to (list, value, source, met): the best of each text of a list, over its pairs that come one after the other."""
    held = a = best = None

    def row() -> pa.RecordBatch:
        one = lambda x, t: pa.array([x.reshape(-1)], pa.list_(t))
        return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), one(best.value, pa.float64()), one(best.source, pa.int64()), pa.array([np.packbits(best.met).tobytes()], pa.binary())], ["list", "value", "source", "met"])

    for batch in batches:
        for k in range(batch.num_rows):
            if (name := batch.column("a_list")[k].as_py()) != held:
                if held is not None:
                    yield row()
                held, a = name, _texts(batch, k, "a_")
                best = _Best(a)
            _met(a, _texts(batch, k, "b_"), best)
    if held is not None:
        yield row()


_FOUND = ["a", "max_jaccard", "jaccard_source", "max_containment", "containment_source", "max_coverage", "coverage_source", "union_coverage"]


def _merged(lists: pa.Table, rows: pa.Table) -> pa.Table:
    """A list of side 0 and all its bests to a row for each text."""
    if not rows.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), *[pa.float64(), pa.int64()] * 3, pa.float64())], _FOUND)
    a = _Texts(*(lists[c][0].as_py() for c in _SHAPE))
    best, every = _Best(a), np.arange(len(a.ids))
    for value, source, met in zip(*(rows[c].to_pylist() for c in ("value", "source", "met"))):
        for kind, (v, s) in enumerate(zip(np.reshape(value, (3, -1)), np.reshape(source, (3, -1)))):
            best.merge(kind, every, v, s)
        best.met |= np.unpackbits(np.frombuffer(met, np.uint8), count=len(best.met)).astype(bool)
    doc, pos = a.doc[best.met], a.pos[best.met]
    covers = np.full(len(doc), LONG)
    covers[:-1] = np.where(doc[1:] == doc[:-1], np.minimum(pos[1:] - pos[:-1], LONG), LONG)
    union = np.bincount(doc, covers, len(a.ids)) / a.n
    cols = [x for kind in range(3) for x in (pa.array(np.maximum(best.value[kind], 0.0)), pa.array(best.source[kind], mask=best.value[kind] < 0))]
    return pa.table([pa.array(a.ids), *cols, pa.array(union)], _FOUND)


def nearest(blocks: DataFrame) -> DataFrame:
    """(a, max_jaccard, jaccard_source, max_containment, containment_source, max_coverage, coverage_source, union_coverage) for
    each first document a of a content of side 0 that shares a run of SHORT words with side 1: the greatest values over all of side 1, with the
    smallest id of equals, and the share of a's words in runs of LONG words that any has. blocks: of packed(), and taken away.
    Containment is of pairs of at least 50 words and 20 shared runs; 0 and no source where there is none."""
    spark = blocks.sparkSession
    size, count = blocks.agg(F.sum("size"), F.count("*")).first()
    log = max(4, (4 * count).bit_length())
    bits = min(62, max(log + 8, (size or 1).bit_length() - 2 + _SPARE))  # a word has five letters or so
    told = blocks.select("block", "size", "sides", "text").mapInArrow(_told(bits, log), "bucket int, block bigint, side int, n int, keys binary")
    answers = told.groupBy("bucket").applyInArrow(_answered(bits - log), "block bigint, side int, bucket int, known binary, ids array<bigint>")
    first = contents(blocks).groupBy("side", "key").agg(F.min(F.struct("id", "block")).alias("x")).groupBy("x.block").agg(F.collect_list("x.id").alias("ids"))
    said = answers.unionByName(first.select("block", F.lit(0).alias("side"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("known"), "ids"))
    lists = materialize(blocks.select("block", "size", "ids", "sides", "text").groupBy("block").cogroup(said.groupBy("block")).applyInArrow(_listed(bits, log), _LIST), "lists")
    drop_tables(blocks)
    runs = lists.where("side = 1").agg(F.sum("runs")).first()[0] or 0
    side = lambda k, p: lists.where(F.col("side") == k).select(*(F.col(c).alias(p + c) for c in lists.columns if c not in ("side", "runs")))
    pairs = side(0, "a_").crossJoin(side(1, "b_").coalesce(max(2, runs // 8_000_000)))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")  # a row has megabytes
    try:
        found = materialize(pairs.mapInArrow(_bests, "list bigint, value array<double>, source array<bigint>, met binary"), "found")
    finally:
        spark.conf.set(name, before)
    names = "a bigint, max_jaccard double, jaccard_source bigint, max_containment double, containment_source bigint, max_coverage double, coverage_source bigint, union_coverage double"
    return lists.where("side = 0").select("list", *_SHAPE).groupBy("list").cogroup(found.groupBy("list")).applyInArrow(_merged, names)


def contents(blocks: DataFrame) -> DataFrame:
    """(block, id, side, key) of each document."""
    return blocks.select("block", F.explode(F.arrays_zip("ids", "sides", "keys")).alias("x")).select("block", F.col("x.ids").alias("id"), F.col("x.sides").alias("side"), F.col("x.keys").alias("key"))
