"""Similarity joins on runs of words, by equi-joins on hashes of the runs.

Runs are hashed once, in Arrow: each different word of a batch once, runs by a rolling sum over the
flat array of all words. Sets and lists of runs are then 8 bytes a run (64 bits), or 16 (128 bits)
where a single false match would count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.words import runs as run_hashes
from corpusmill.session import drop as drop_tables
from corpusmill.session import materialize


def _hashed(words: pa.ListArray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of all lists, one after the other, and the number of each list's."""
    flat = words.flatten()
    kinds = flat.dictionary_encode() if len(flat) else None
    sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.maximum(sizes - n + 1, 0)
    if kinds is None or not count.any():
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in kinds.dictionary.to_pylist()), np.uint64, len(kinds.dictionary))
    every = run_hashes(own[kinds.indices.to_numpy()], n)
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())  # runs over the end of a list are left out
    return every[at].view(np.int64), count


def _lists(flat: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), pa.array(flat, pa.int64()))


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, count = _hashed(batch.column(1), n)
            doc = np.repeat(np.arange(len(count)), count)
            order = np.lexsort((flat, doc))
            flat, doc = flat[order], doc[order]
            new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])]) if len(flat) else np.empty(0, bool)
            own = np.bincount(doc[new], minlength=len(count))
            keep = count > 0
            sizes = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), pa.array(sizes[keep].astype(np.int32)), _lists(flat[new], own[keep])], ["id", "words_n", "grams"])

    return run


def gram_sets(docs: DataFrame, id: str, words: str, n: int) -> DataFrame:
    """(id, words_n, grams): the distinct runs of n words, as sorted 64-bit hashes; documents without one
    are left out."""
    return docs.select(id, words).mapInArrow(_sets(n), f"`{id}` {docs.schema[id].dataType.simpleString()}, words_n int, grams array<bigint>")


def _positioned(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, count = _hashed(batch.column(1), n)
            i, _ = _hashed(batch.column(1), n, 1)
            at = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count) + 1
            for k in range(0, max(1, len(h)), 1_000_000):  # so that long texts don't pile up
                part = slice(k, k + 1_000_000)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(count)), count)[part]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at[part].astype(np.int32)), pa.array(h[part], pa.int64()), pa.array(i[part], pa.int64())], ["id", "pos", "h", "i"])

    return run


def run_rows(docs: DataFrame, id: str, words: str, n: int) -> DataFrame:
    """(id, pos, h, i) of every run of n words: its place from 1 and 128 bits of it."""
    return docs.select(id, words).mapInArrow(_positioned(n), f"`{id}` {docs.schema[id].dataType.simpleString()}, pos int, h bigint, i bigint")


#: Hash buckets of shared_runs: the upper bits of a run's hash; 32 more are sent.
_BUCKETS = 1024


def _planes(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys byte by byte of all, the highest first, which compresses."""
    return np.ascontiguousarray(keys.astype(">u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(">u4").reshape(-1).astype(np.uint32)


def _split(bodies: pa.Array) -> pa.ListArray:
    return pc.split_pattern(bodies, " ").cast(pa.list_(pa.string()))


def _slots(flat: np.ndarray) -> np.ndarray:
    """Bucket and 32 bits more of each hash, as one number."""
    return flat.view(np.uint64) >> np.uint64(22)


def _told(ns: tuple[int, ...]):
    """(id, body, side, block) to (n, bucket, block, side, keys, df): the runs of the documents of a batch
    and block, each once, with the number of these documents that have it, 255 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(3).to_numpy().astype(np.int64) * 2 + batch.column(2).to_numpy()
            for own in np.unique(place).tolist():
                words = _split(batch.column(1).filter(pa.array(place == own)))
                for n in ns:
                    flat, count = _hashed(words, n)
                    if not len(flat):
                        continue
                    slot, doc = _slots(flat), np.repeat(np.arange(len(count)), count)
                    order = np.lexsort((doc, slot))
                    slot, doc = slot[order], doc[order]
                    slot = slot[np.concatenate([[True], (slot[1:] != slot[:-1]) | (doc[1:] != doc[:-1])])]
                    slot, df = np.unique(slot, return_counts=True)
                    bucket = (slot >> np.uint64(32)).astype(np.int32)
                    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
                    ends = [*cuts[1:], len(slot)]
                    low, df = (slot & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(df, 255).astype(np.uint8)
                    k = len(cuts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n] * k, pa.int32()), pa.array(bucket[cuts]), pa.array([own // 2] * k, pa.int32()), pa.array([own % 2] * k, pa.int32()), pa.array([_planes(low[a:b]) for a, b in zip(cuts, ends)], pa.binary()), pa.array([df[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())],
                        ["n", "bucket", "block", "side", "keys", "df"],
                    )

    return run


def _answered(self_join: bool):
    """All of a bucket to (n, bucket, block, keys, df): for each block those of its runs that another document,
    or one of the other side, has, with the number of documents."""

    def run(table: pa.Table) -> pa.Table:
        every = [_unplaned(x) for x in table["keys"].to_pylist()]
        sizes = np.array([len(x) for x in every])
        keys, at = np.unique(np.concatenate(every), return_inverse=True)
        df = np.frombuffer(b"".join(table["df"].to_pylist()), np.uint8)
        total = np.bincount(at, df, len(keys))
        side = np.repeat(table["side"].to_numpy(), sizes)
        shared = total > 1 if self_join else (np.bincount(at, side == 0, len(keys)) > 0) & (np.bincount(at, side == 1, len(keys)) > 0)
        block, out = np.repeat(table["block"].to_numpy(), sizes), []
        kept = shared[at]
        block, at = block[kept], at[kept]
        order = np.lexsort((at, block))
        block, at = block[order], at[order]
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist() if len(at) else []
        for a, b in zip(cuts, [*cuts[1:], len(at)]):
            own = np.unique(at[a:b])
            out.append((int(block[a]), _planes(keys[own]), np.minimum(total[own], 255).astype(np.uint8).tobytes()))
        n, bucket = table["n"][0].as_py(), table["bucket"][0].as_py()
        return pa.table([pa.array([n] * len(out), pa.int32()), pa.array([bucket] * len(out), pa.int32()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["n", "bucket", "block", "keys", "df"])

    return run


def _kept_runs(ns: tuple[int, ...], places: tuple[int, ...]):
    """A block's documents and its answers to a row for each document and n."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for n in ns:
            mine = answers.filter(pc.equal(answers["n"], n)).sort_by("bucket")
            if not mine.num_rows:
                continue
            every = [_unplaned(x) for x in mine["keys"].to_pylist()]
            known = np.concatenate([x.astype(np.uint64) | (np.uint64(k) << np.uint64(32)) for k, x in zip(mine["bucket"].to_pylist(), every)])
            df = np.frombuffer(b"".join(mine["df"].to_pylist()), np.uint8)
            for chunk in docs.to_batches(max_chunksize=4000):
                words = _split(chunk.column("body"))
                h, count = _hashed(words, n)
                i, _ = _hashed(words, n, 1)
                if not len(h):
                    continue
                doc = np.repeat(np.arange(len(count)), count)
                pos = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count) + 1
                order = np.lexsort((h, doc))
                new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
                m = np.bincount(doc[order][new], minlength=len(count))  # different runs
                slot = _slots(h)
                found = np.minimum(np.searchsorted(known, slot), len(known) - 1)
                hit = known[found] == slot
                doc, pos, h, i, rare = doc[hit], pos[hit], h[hit], i[hit], df[found[hit]]
                order = np.lexsort((pos, h, rare, doc))  # a document's runs, the rarest first
                if n not in places:
                    order = order[np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])])] if len(order) else order
                own = np.bincount(doc[order], minlength=len(count))
                some = own > 0
                parts = [_lists(x[order], own[some]) if n in places or x is h else pa.nulls(int(some.sum()), pa.list_(pa.int64())) for x in (pos, h, i)]
                out.append(pa.table([pa.array([n] * int(some.sum()), pa.int32()), chunk.column("side").filter(pa.array(some)), chunk.column("id").filter(pa.array(some)), pa.array(pc.list_value_length(words).to_numpy(zero_copy_only=False)[some].astype(np.int32)), pa.array(m[some].astype(np.int32)), *parts], ["n", "side", "id", "words_n", "m", "at", "h", "i"]))
        empty = pa.schema([("n", pa.int32()), ("side", pa.int32()), ("id", docs.schema.field("id").type), ("words_n", pa.int32()), ("m", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("at", "h", "i"))])
        return pa.concat_tables([t.cast(empty) for t in out]) if out else empty.empty_table()

    return run


def shared_runs(docs: DataFrame, ns: tuple[int, ...], places: tuple[int, ...], self_join: bool) -> DataFrame:
    """(n, side, id, words_n, m, at, h, i), written once: for each document and each n of ns the runs of n words
    that another document (self_join) or one of the other side has too: their places, and 128 bits of each, those
    that the fewest documents have first. m: how many different runs the document has. Documents without
    such a run are left out. For an n that isn't in `places`, each different run has its 64-bit hash h once, and at and
    i are null. docs: (id, body, side, block), body being words with a space between, side 0 or 1,
    block a part of documents that fits in memory; a document is in one block.

    Most runs are one document's alone, so they aren't sent about as rows. Each block tells its runs, as sorted
    42-bit keys in 1,024 buckets, 3 to 4 bytes a run; a bucket answers which others have; only these become
    rows. Two runs with one key let a run through that no other has: it meets nothing on 128 bits."""
    told = docs.select("id", "body", "side", "block").mapInArrow(_told(ns), "n int, bucket int, block int, side int, keys binary, df binary")
    answers = told.groupBy("n", "bucket").applyInArrow(_answered(self_join), "n int, bucket int, block int, keys binary, df binary")
    kind = docs.schema["id"].dataType.simpleString()
    both = docs.select("id", "body", "side", "block").groupBy("block").cogroup(answers.groupBy("block"))
    return materialize(both.applyInArrow(_kept_runs(ns, places), f"n int, side int, id {kind}, words_n int, m int, at array<bigint>, h array<bigint>, i array<bigint>"), "shared")


def overlapping(runs: DataFrame, least: float, min_words: int = 0) -> DataFrame:
    """overlap_pairs() within one set of documents, of shared_runs() of one n without places: a < b, without ga and gb but with
    ma and mb. Any so many runs of the smaller set serve as its prefix, so the rarest are taken as they come."""
    one = runs.select("id", "words_n", "m", F.col("h").alias("g"))
    need = F.ceil(F.lit(least) * F.col("m") - 1e-9)
    p = one.select(F.col("id").alias("x"), F.col("words_n").alias("nx"), F.col("m").alias("mx"), F.explode(F.slice("g", F.lit(1), F.greatest(F.lit(0), F.size("g") - need + 1).cast("int"))).alias("h"))
    q = one.select(F.col("id").alias("y"), F.col("words_n").alias("ny"), F.col("m").alias("my"), F.explode("g").alias("h"))
    pairs = p.join(q, "h").where("mx <= my and x <> y")
    if min_words:
        pairs = pairs.where((F.least("nx", "ny") >= min_words) | (F.col("mx") >= F.lit(least) * F.col("my") - 1e-9))
    pairs = materialize(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    of = lambda k: one.select(F.col("id").alias(k), F.col("words_n").alias(f"n{k}"), F.col("m").alias(f"m{k}"), F.col("g").alias(f"g{k}")).join(pairs.select(k).distinct(), k, "left_semi")
    found = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("shared", F.size(F.array_intersect("ga", "gb"))).drop("ga", "gb")
    return found.where(F.col("shared") >= F.lit(least) * F.least("ma", "mb") - 1e-9)


def shared_pairs(runs: DataFrame) -> DataFrame:
    """shared_counts() of shared_runs() of one n without places and two sides. Runs that the same documents of both sides have are
    joined as one with their number, so a template costs its pairs once, not once for each of its runs."""
    sides = runs.select("side", "id", F.explode("h").alias("h"))
    own = lambda k: F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("id"))))
    posts = sides.groupBy("h").agg(own(0).alias("xs"), own(1).alias("ys")).where("size(xs) > 0 and size(ys) > 0")
    key = F.sha2(F.concat_ws("|", F.concat_ws(",", F.col("xs").cast("array<string>")), F.concat_ws(",", F.col("ys").cast("array<string>"))), 256)
    groups = posts.groupBy(key.alias("k")).agg(F.any_value("xs").alias("xs"), F.any_value("ys").alias("ys"), F.count("*").alias("runs"))
    pairs = groups.select("runs", "ys", F.explode("xs").alias("a")).select("runs", "a", F.explode("ys").alias("b")).groupBy("a", "b").agg(F.sum("runs").alias("shared"))
    sizes = lambda side, k: runs.where(F.col("side") == side).select(F.col("id").alias(k), F.col("m").alias(f"m{k}"), F.col("words_n").alias(f"n{k}"))
    return pairs.join(sizes(0, "a"), "a").join(sizes(1, "b"), "b")


def placed(runs: DataFrame) -> DataFrame:
    """(side, id, words_n, pos, h, i): a row for each run of shared_runs()."""
    return runs.select("side", "id", "words_n", F.explode(F.arrays_zip("at", "h", "i")).alias("r")).select("side", "id", "words_n", F.col("r.at").cast("int").alias("pos"), "r.h", "r.i")


def covered(rows: DataFrame, n: int) -> DataFrame:
    """(id, covered): words of the documents of side 0 in runs that side 1 has too, of placed() rows; documents
    without one are left out."""
    known = rows.where("side = 1").select("h", "i").distinct()
    hit = rows.where("side = 0").join(known, ["h", "i"], "left_semi")
    return hit.groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("at")).select("id", _covered("at", n).alias("covered"))


def frequent(rows: DataFrame, least: int) -> DataFrame:
    """(h, i) of the runs of placed() that `least` documents have, 2 or more."""
    return rows.groupBy("h", "i").agg(F.countDistinct("id").alias("df")).where(F.col("df") >= least).select("h", "i")


def classes(docs: DataFrame, id: str, words: str) -> DataFrame:
    """(id, class_id): the smallest id of the documents with the same words in the same order, by 128
    bits. Documents without words are one class."""
    keys = docs.select(id, F.sha2(F.array_join(words, " "), 256).alias("_k"))
    low = keys.groupBy("_k").agg(F.min(id).alias("class_id"))
    return keys.join(low, "_k").select(id, "class_id")


def overlap_pairs(left: DataFrame, right: DataFrame, least: float, self_join: bool = False, min_words: int = 0) -> DataFrame:
    """(a, b, na, nb, ga, gb, shared) for pairs whose shared runs are at least `least` of the smaller
    set. left and right: (id, words_n, grams) as gram_sets() has them, one row for each content, as
    pairs of n equal ones are n times n rows. With min_words, pairs whose smaller text is shorter must
    also allow a similarity of `least` by their sizes.

    Prefix filter: of a set of m runs ordered by rarity, any set that shares least * m of them has
    one of the rarest m - ceil(least * m) + 1. So the rare prefix of the smaller set is joined with
    the whole of the larger one. Runs that can't be shared come first in the order; hot runs
    (templates) fall out of prefixes. Candidates are verified on their runs."""
    side = lambda d, k: d.select(F.lit(k).cast("tinyint").alias("side"), "id", F.explode("grams").alias("h"))
    # one shuffle by run, used both to count and to pick the runs that can be shared
    rows = (side(left, 0) if self_join else side(left, 0).unionByName(side(right, 1))).repartition("h")
    shared = rows.groupBy("h").agg(F.count("id").alias("df"), F.min("side").alias("low"), F.max("side").alias("high")).where("df > 1" if self_join else "low < high").select("h", "df")
    met = materialize(rows.join(shared, "h"), "shared")
    size = lambda d, k: d.select(F.lit(k).cast("tinyint").alias("side"), "id", "words_n", F.size("grams").alias("m"))
    sizes = size(left, 0) if self_join else size(left, 0).unionByName(size(right, 1))
    ordered = met.groupBy("side", "id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("x")).join(sizes, ["side", "id"])
    cut = F.expr(f"slice(x, 1, cast(greatest(0, size(x) - ceil({least} * m - 1e-9) + 1) as int))")
    p = ordered.select("side", F.col("id").alias("x"), F.col("words_n").alias("nx"), F.col("m").alias("mx"), F.explode(cut).alias("k")).select("side", "x", "nx", "mx", "k.h")
    q = met.join(sizes, ["side", "id"]).select(F.col("side").alias("other"), F.col("id").alias("y"), F.col("words_n").alias("ny"), F.col("m").alias("my"), "h")
    pairs = p.join(q, "h").where(F.col("mx") <= F.col("my"))
    if min_words:
        pairs = pairs.where((F.least("nx", "ny") >= min_words) | (F.col("mx") >= F.lit(least) * F.col("my") - 1e-9))
    if self_join:
        pairs = pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    else:
        pairs = pairs.where("side <> other").select(F.when(F.col("side") == 0, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(F.col("side") == 0, F.col("y")).otherwise(F.col("x")).alias("b"))
    pairs = materialize(pairs.distinct(), "pairs")
    of = lambda d, k: d.select(F.col("id").alias(k), F.col("words_n").alias(f"n{k}"), F.col("grams").alias(f"g{k}")).join(pairs.select(k).distinct(), k, "left_semi")
    found = pairs.join(of(left, "a"), "a").join(of(left if self_join else right, "b"), "b").withColumn("shared", F.size(F.array_intersect("ga", "gb")))
    return found.where(F.col("shared") >= F.lit(least) * F.least(F.size("ga"), F.size("gb")) - 1e-9)


def jaccard() -> Column:
    return F.col("shared") / (F.size("ga") + F.size("gb") - F.col("shared"))


def near(pairs: DataFrame, threshold: float = 0.8, min_words: int = 50, min_shared: int = 20) -> DataFrame:
    """(a, b, jaccard, containment) of near pairs: similar as sets, or the smaller one, if both are
    long enough, is for the most part in the larger."""
    if "ma" not in pairs.columns:
        pairs = pairs.withColumns({"ma": F.size("ga"), "mb": F.size("gb")})
    j, c = F.col("shared") / (F.col("ma") + F.col("mb") - F.col("shared")), F.col("shared") / F.least("ma", "mb")
    scored = pairs.select("a", "b", "na", "nb", "shared", j.alias("jaccard"), c.alias("containment"))
    return scored.where((F.col("jaccard") >= threshold) | ((F.col("containment") >= threshold) & (F.least("na", "nb") >= min_words) & (F.col("shared") >= min_shared))).select("a", "b", "jaccard", "containment")


def template_keys(docs: DataFrame, n: int, floor: int, words: str = "words") -> DataFrame:
    """(h, i, df): runs of n words in at least `floor` documents and a hundredth of them."""
    least = max(floor, -(-docs.count() // 100))
    df = run_rows(docs, "id", words, n).select("id", "h", "i").distinct().groupBy("h", "i").agg(F.count("*").alias("df"))
    return df.where(F.col("df") >= least)


def _covered(starts: str, n: int) -> Column:
    """Words in runs of n that begin at sorted places: a start covers n, or as many as there are to the next."""
    return F.expr(f"aggregate(transform({starts}, (p, k) -> least({n}, coalesce(get({starts}, k + 1) - p, {n}))), 0, (t, x) -> t + x)")


def coverage(left: DataFrame, right: DataFrame, n: int, drop: DataFrame | None = None) -> DataFrame:
    """(id, covered, words_n): how many of a left document's words lie in runs of n words that any
    right document has. left, right: (id, words); drop: (h, i) to be left out (templates).

    The right side is reduced to distinct runs before the join, and the join is a semi-join, so a
    run that many documents have is matched once."""
    rows = run_rows(left, "id", "words", n)
    known = run_rows(right, "id", "words", n).select("h", "i").distinct()
    hit = rows.join(known, ["h", "i"], "left_semi")
    if drop is not None:
        hit = hit.join(drop.select("h", "i"), ["h", "i"], "left_anti")
    places = hit.groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("at")).select("id", _covered("at", n).alias("covered"))
    return left.select("id", F.size("words").alias("words_n")).join(places, "id", "left").select("id", F.coalesce("covered", F.lit(0)).alias("covered"), "words_n")


def pair_coverage(left: DataFrame, right: DataFrame, n: int, self_join: bool = False, drop: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """(a, b, ca, cb, na, nb): for pairs that share a run of n words, the words of each that lie in runs
    the other has, and their numbers of words. left, right: (id, words). With self_join, a < b.

    Runs that only one document (or side) has are left out first. A run is joined once for each document,
    with all its places there, so that texts that repeat themselves don't multiply. Pairs are counted
    before their places are gathered: those whose runs, of n words each, can't cover `least` of either
    text are left out there."""
    one = run_rows(left, "id", "words", n).withColumn("side", F.lit(0))
    rows = one if self_join else one.unionByName(run_rows(right, "id", "words", n).withColumn("side", F.lit(1)))
    if drop is not None:
        rows = rows.join(drop.select("h", "i"), ["h", "i"], "left_anti")
    na, nb = left.select(F.col("id").alias("a"), F.size("words").alias("na")), (left if self_join else right).select(F.col("id").alias("b"), F.size("words").alias("nb"))
    return covered_pairs(rows, na, nb, n, self_join, least)


def covered_pairs(rows: DataFrame, na: DataFrame, nb: DataFrame, n: int, self_join: bool = False, least: float = 0.0) -> DataFrame:
    """pair_coverage() from rows (side, id, pos, h, i) of runs, na (a, na) and nb (b, nb). Runs that the same
    documents have are joined as one, under 128 bits of the set of these, with the places of all: a passage that
    two documents share is one row of the join, not one for each of its words."""
    rows = materialize(rows.groupBy("h", "i", "side", "id").agg(F.collect_list("pos").alias("at")), "runs")
    name = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "side", "id"))
    common = rows.groupBy("h", "i").agg(F.min("id" if self_join else "side").alias("low"), F.max("id" if self_join else "side").alias("high"), name(1).alias("k"), name(2).alias("l")).where("low < high").select("h", "i", "k", "l")
    every, rows = rows, materialize(rows.join(common, ["h", "i"]).groupBy("k", "l", "side", "id").agg(F.flatten(F.collect_list("at")).alias("at")), "common")
    drop_tables(every)
    x = rows.where("side = 0").select("k", "l", F.col("id").alias("a"), F.col("at").alias("pa"))
    y = (rows if self_join else rows.where("side = 1")).select("k", "l", F.col("id").alias("b"), F.col("at").alias("pb"))
    met = x.join(y, ["k", "l"])
    met = met.where("a < b") if self_join else met
    if least:
        told = met.groupBy("a", "b").agg(F.sum(F.size("pa")).alias("ka"), F.sum(F.size("pb")).alias("kb")).join(na, "a").join(nb, "b")
        met = met.join(materialize(told.where(f"ka * {n} >= {least} * na - 1e-9 or kb * {n} >= {least} * nb - 1e-9").select("a", "b"), "likely"), ["a", "b"], "left_semi")
    starts = met.groupBy("a", "b").agg(F.array_sort(F.flatten(F.collect_list("pa"))).alias("pa"), F.array_sort(F.flatten(F.collect_list("pb"))).alias("pb"))
    return starts.select("a", "b", _covered("pa", n).alias("ca"), _covered("pb", n).alias("cb")).join(na, "a").join(nb, "b").select("a", "b", "ca", "cb", "na", "nb")


def partial_pairs(docs: DataFrame, n: int = 13, least: float = 0.3, min_words: int = 50, drop: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b, both of `min_words` words or more, where the runs of n words that both have cover
    `least` of either one's words. docs: (id, words); drop: (h, i) to be left out (templates)."""
    long = docs.where(F.size("words") >= min_words)
    both = pair_coverage(long, long, n, True, drop, least)
    return both.where((F.col("ca") / F.col("na") >= least) | (F.col("cb") / F.col("nb") >= least)).select("a", "b")


def shared_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, ma, mb, na, nb, shared) for every pair that shares a run. left, right: as gram_sets() has
    them. One row of the join for each shared run of each pair: a run that many documents of both
    sides have costs the product of their numbers, and AQE splits its partition."""
    one, two = (d.select(F.col("id").alias(k), F.size("grams").alias(f"m{k}"), F.col("words_n").alias(f"n{k}"), F.explode("grams").alias("h")) for d, k in ((left, "a"), (right, "b")))
    pairs = one.select("a", "h").join(two.select("b", "h"), "h").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sizes = lambda d, k: d.select(F.col("id").alias(k), F.size("grams").alias(f"m{k}"), F.col("words_n").alias(f"n{k}"))
    return pairs.join(sizes(left, "a"), "a").join(sizes(right, "b"), "b")


def _band_keys(bands: int, rows: int):
    """Lists of hashes to lists of `bands` keys, each of `rows` least hashes; a million at a time."""
    draw = np.random.default_rng(1)
    mult, add = (draw.integers(0, 2**64, bands * rows, dtype=np.uint64) for _ in range(2))

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, flat = np.diff(lists.offsets.to_numpy()).cumsum(), lists.flatten().to_numpy().view(np.uint64)
            keys, i = np.zeros((len(lists), bands), np.uint64), 0
            while i < len(lists):
                start = int(ends[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(ends, start + 1_000_000, "right")))
                part, at = flat[start : ends[j - 1]], np.concatenate([[0], ends[i : j - 1] - start]).astype(np.int64)
                for k in range(bands * rows):
                    least = np.minimum.reduceat(mixed(part * (mult[k] | np.uint64(1)) + add[k]), at)
                    keys[i:j, k // rows] = mixed(keys[i:j, k // rows] * np.uint64(0xC2B2AE3D27D4EB4F) + least)
                i = j
            offsets = np.arange(0, keys.size + 1, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))], ["id", "keys"])

    return run


def minhash_bands(docs: DataFrame, id: str, words: str, n: int = 5, bands: int = 14, rows: int = 8) -> DataFrame:
    """(id, band, key): the key of each band of `rows` least hashes of the document's runs. Equal
    documents meet in every band; at similarity s two meet in at least one with probability
    1 - (1 - s^rows)^bands."""
    hashes = gram_sets(docs, id, words, n).select(id, "grams")
    keys = hashes.mapInArrow(_band_keys(bands, rows), f"id {docs.schema[id].dataType.simpleString()}, keys array<bigint>")
    return keys.select(F.col("id").alias(id), F.posexplode("keys").alias("band", "key"))


def band_links(bands: DataFrame, id: str) -> DataFrame:
    """(a, b): each member of a band's bucket and the smallest one of it, which is enough to connect
    the bucket; not all pairs."""
    low = bands.groupBy("band", "key").agg(F.min(id).alias("a"), F.count("*").alias("n")).where("n > 1")
    return bands.join(low, ["band", "key"]).where(F.col(id) != F.col("a")).select("a", F.col(id).alias("b")).distinct()


def bucket_pairs(bands: DataFrame, id: str) -> DataFrame:
    """(a, b), a < b: every pair that meets in a bucket of any band, each once. For pairs that are
    verified later: two members may be similar to each other and to the bucket's smallest not."""
    bands = materialize(bands.select(id, "band", "key"), "bands")
    shared = bands.join(bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key"), ["band", "key"], "left_semi")
    one, two = shared.select("band", "key", F.col(id).alias("a")), shared.select("band", "key", F.col(id).alias("b"))
    return one.join(two, ["band", "key"]).where("a < b").select("a", "b").distinct()
