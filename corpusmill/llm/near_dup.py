"""Near-duplicate documents: groups linked by a Jaccard similarity of five-word runs.

Method: a byte-position inverted index with count filtering. A document is sketched as 160 byte
positions; at each stands one byte of the smallest hash of its runs under that position's
permutation, so that two documents agree at a position with probability J (and by chance 1/256).
The index posts a document under its positions, four at a time, as one posting needs more than a
byte to be selective. Documents that share a posting are candidates; their agreeing positions are
tallied, pairs that reach the guaranteed minimum are kept, and these are verified on their runs.

Posting lists that hold several groups, as those of a page template do, aren't paired within: there
a pair must also share a run among the rarest of either one, which pairs at the threshold must.

Bounds: at J = 0.7 a pair shares no posting with probability (1 - 0.7^4)^40 < 2e-5, and its tally
falls below the minimum (4.5 standard deviations below the mean) with probability < 4e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.words import runs, sequence_hash, word_hashes, words
from corpusmill.operators.graph import connected_components
from corpusmill.session import materialize

RUN, BANDS, PER_BAND = 5, 40, 4
POSITIONS = BANDS * PER_BAND
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = (_RNG.integers(0, 1 << 31, POSITIONS, np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, POSITIONS, np.uint32)
_C = np.uint32(0x85EBCA6B)


def minimum_tally(threshold: float) -> int:
    """Agreeing byte positions that a pair at the threshold has at least."""
    mean = POSITIONS * threshold
    return max(1, int(mean - 4.5 * (mean * (1 - threshold)) ** 0.5))


def sketch(grams: np.ndarray) -> np.ndarray:
    """160 bytes as 40 signed integers. grams: hashes of the document's runs, one at least."""
    g = (grams >> np.uint64(32)).astype(np.uint32)
    low = None
    for k in range(0, len(g), 2048):
        part = (g[k : k + 2048, None] * _A + _B).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    low = (low ^ (low >> np.uint32(15))) * _C
    return (low >> np.uint32(24)).astype(np.uint8).view("<i4")


def _sketched(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h1, h2, sizes, sigs = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                if doc is None or len(found) < min_words:
                    continue
                grams = np.unique(runs(word_hashes(found), RUN))
                a, b = sequence_hash(found)
                ids.append(doc), h1.append(a), h2.append(b), sizes.append(len(grams)), sigs.append(sketch(grams))
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int32)
            sig = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sizes, pa.int32()), sig], ["id", "h1", "h2", "n", "sig"])

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, sorted distinct hashes of runs)."""
    for batch in batches:
        sets = [np.unique(runs(word_hashes(words(t)), RUN)).view(np.int64) for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], ["id", "grams"])


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id) in order, to links of neighbours with the same key, and of each with the
    first of its key in this partition. The partition's first and last rows come out as well
    (kind 1 and 2), so that a key over several partitions can be joined up."""
    part, last, head = TaskContext.get().partitionId(), None, None
    names = ["kind", "part", "key", "a", "b"]

    def edge(kind: int, key: int, doc: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([key], pa.int64()), pa.array([doc], pa.int64()), pa.array([doc], pa.int64())], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if last is None:
            yield edge(1, int(keys[0]), int(ids[0]))
            last, head = (int(keys[0]), int(ids[0])), int(ids[0])
            carried = False
        else:
            keys, ids, carried = np.concatenate([[last[0]], keys]), np.concatenate([[last[1]], ids]), True
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = ids[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        if carried or keys[0] == last[0]:
            same = np.cumsum(new) == 1
            first = np.where(same, head, first)
        at = np.flatnonzero(~new)
        a = np.concatenate([ids[at - 1], first[at]])
        b = np.concatenate([ids[at], ids[at]])
        k = np.concatenate([keys[at], keys[at]])
        keep = (a != b) & ~np.concatenate([np.zeros(len(at), bool), first[at] == ids[at - 1]])
        a, b, k = a[keep], b[keep], k[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(np.full(len(a), part, np.int32)), pa.array(k), pa.array(a), pa.array(b)], names)
        last, head = (int(keys[-1]), int(ids[-1])), int(first[-1])
    if last is not None:
        yield edge(2, *last)


def _postings(sketches: DataFrame) -> DataFrame:
    key = F.shiftleft(F.col("pos").cast("bigint"), 32).bitwiseOR(F.col("quad").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    return sketches.select("id", F.posexplode("sig").alias("pos", "quad")).select(key.alias("key"), "id")


def _candidates(sketches: DataFrame) -> DataFrame:
    """(key, a, b), a < b: links of each document with its neighbour and the first document in each
    posting list, so that the links of a list reach all its members. Lists are cut over partitions
    by key and id: a list of any length is shared by many tasks and is never held as a whole."""
    spark = sketches.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _postings(sketches).repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")
    found = materialize(rows.mapInArrow(_adjacent, "kind int, part int, key bigint, a bigint, b bigint"), "neighbours")
    # two rows of each partition: a list over several partitions goes on with the next one's first
    ends = found.where("kind > 0").selectExpr("part", "kind", "key", "a", "lag(struct(key, a, part)) over (order by part, kind) before")
    over = ends.where("kind = 1 and before.key = key and before.part < part").selectExpr("key", "before.a a", "a b")
    return found.where("kind = 0").select("key", "a", "b").unionByName(over).where("a <> b").select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _mixed(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, own): members of posting lists that hold several groups, and their groups. A list whose
    members are all of one group, however many they are, gives none."""
    of = labels.select(F.col("node").alias("id"), "component")
    members = links.select("key", F.explode(F.array("a", "b")).alias("id")).distinct().join(of, "id", "left").select("key", "id", F.coalesce("component", "id").alias("own"))
    mixed = members.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("key")
    return materialize(members.join(mixed, "key", "left_semi").select("id", "own").distinct(), "mixed")


def rare_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of different groups that share a run of their prefixes. sets: (id, own, grams).

    Runs are ordered by how many of the sets have them. A set of m runs and any of at least m that is
    near share 2t / (1 + t) * m runs, and the larger one, of n, shares t * n: the first run that they
    share is among the rarest m - ceil(2t / (1 + t) * m) + 1 of the one and n - ceil(t * n) + 1 of the
    other. Runs of a template are the last in every order, so that they join nothing below the
    threshold; runs that only one set has come first and can't be shared. Lengths must allow the
    similarity, as must what is left after the places of the run."""
    t = threshold
    rows = sets.select("id", "own", F.size("grams").alias("m"), F.explode("grams").alias("g"))
    df = rows.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    ordered = rows.join(df, "g").groupBy("id", "own", "m").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("met"))
    ordered = ordered.select("id", "own", "m", (F.col("m") - F.size("met")).alias("alone"), F.expr(f"slice(met, 1, cast(greatest(0, size(met) - ceil({t} * m - 1e-9) + 1) as int))").alias("met"))
    prefix = materialize(ordered.select("id", "own", "m", "alone", F.posexplode("met").alias("k", "x")).select("id", "own", "m", F.col("x.g").alias("g"), (F.col("alone") + F.col("k") + 1).alias("p")), "prefix")
    x = prefix.where(f"p <= m - ceil({2 * t / (1 + t)} * m - 1e-9) + 1").toDF("x", "cx", "mx", "g", "px")
    y = prefix.toDF("y", "cy", "my", "g", "py")
    met = x.join(y, "g").where("cx <> cy and (mx < my or mx = my and x < y)").where(f"mx >= {t} * my - 1e-9 and least(px, py) + least(mx - px, my - py) >= {t / (1 + t)} * (mx + my) - 1e-9")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _tallied(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose sketches agree at enough byte positions."""
    one = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    same = "aggregate(zip_with(sa, sb, (x, y) -> x ^ y), 0, (t, z) -> t + if(z & 255 = 0, 1, 0) + if(z & 65280 = 0, 1, 0) + if(z & 16711680 = 0, 1, 0) + if(z & -16777216 = 0, 1, 0))"
    return pairs.join(one, "a").join(two, "b").where(f"least(na, nb) >= {threshold} * greatest(na, nb)").selectExpr("a", "b", "na", "nb", f"{same} tally").where(f"tally >= {minimum_tally(threshold)}")


def _gathered(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, grams) of the documents in ids."""
    return materialize(texts.join(ids.select("id"), "id", "left_semi").mapInArrow(_grams, "id bigint, grams array<bigint>"), "grams")


def _verified(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose exact similarity reaches the threshold."""
    both = pairs.join(grams.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("shared"), (F.size("ga") + F.size("gb")).alias("total"))
    return both.where(F.col("shared") >= F.lit(threshold) * (F.col("total") - F.col("shared")) - 1e-9).select("a", "b")


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8, min_words: int = 50) -> DataFrame:
    """(first_id, id): each member but the smallest of each group of near documents.

    Two documents of at least min_words words are near when the distinct runs of five consecutive
    words in both are at least threshold of those in either; equal word sequences are near too. A
    group is a component of that relation. Null, empty and short texts, and null ids, are in no
    group; extra columns are ignored; an empty table gives no rows. Equal texts are collapsed
    first and are only brought back at the end, so that copies cost one row each.

    All candidates are treated: first each document's best one by shared postings, which connects
    most groups, then all candidates that lie between different groups, then the members of any
    posting list that still holds several groups, where they also share one of their rare runs. So a
    family of edits, or of pages of one template, costs its sketches and texts about once, and not
    once for each of its pairs.
    """
    docs = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    base = materialize(docs.mapInArrow(_sketched(min_words), "id bigint, h1 bigint, h2 bigint, n int, sig array<int>"), "sketches")
    firsts = base.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    copies = materialize(base.select("id", "h1", "h2").join(firsts.where("copies > 1").select("h1", "h2", "first"), ["h1", "h2"]).where("id <> first").select("id", "first"), "copies")
    reps = base.join(copies.select("id"), "id", "left_anti").select("id", "n", "sig")
    neighbours = materialize(_candidates(reps), "neighbours")
    pairs = materialize(neighbours.groupBy("a", "b").agg(F.count("*").alias("postings")), "pairs")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("postings", -F.col("a"))).alias("a")).select("a", "b")
    links, labels = None, None

    def linked(kept: DataFrame, grams: DataFrame | None = None) -> None:
        nonlocal links, labels
        kept = materialize(_tallied(kept, reps, threshold), "kept")
        if links is None or not kept.isEmpty():
            own = _gathered(docs, kept.select(F.explode(F.array("a", "b")).alias("id")).distinct()) if grams is None else grams
            near = materialize(_verified(kept, own, threshold), "links")
            links = near if links is None else links.unionByName(near)
            labels = materialize(connected_components(links), "labels")

    linked(best)
    linked(_across(pairs, labels))
    mixed = _mixed(neighbours, labels)
    if not mixed.isEmpty():
        grams = _gathered(docs, mixed)
        linked(rare_pairs(grams.join(mixed, "id"), threshold), grams)
    of = labels.select(F.col("node").alias("first"), "component")
    return (
        copies.join(of, "first", "left").select(F.coalesce("component", "first").alias("first_id"), "id")
        .unionByName(labels.where("node <> component").select(F.col("component").alias("first_id"), F.col("node").alias("id")))
        .withColumnRenamed("id", id)
    )


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different groups."""
    one = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.select("a", "b").join(one, "a", "left").join(two, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
