from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.words import runs, word_hashes, words
from corpusmill.llm import near_dup


def brute(texts, threshold, least):
    sets = {i: set(runs(word_hashes(w), 5).tolist()) for i, t in texts if i is not None and len(w := words(t)) >= least}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((find(i), i) for i in ids if find(i) != i)


def edited(rng, own, edits):
    own = list(own)
    for _ in range(edits):
        k = rng.randrange(len(own))
        if rng.random() < 0.5:
            own[k] = f"e{rng.randrange(9999)}"
        else:
            own[k:k] = [f"i{rng.randrange(9999)}"]
    return own


@pytest.mark.parametrize("parts", [1, 6])
def test_against_all_pairs(spark, parts):
    rng = random.Random(7)
    texts, i = [], 0
    for family in range(8):
        base = [f"f{family}w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(6):
            texts.append((i, " ".join(edited(rng, base, rng.randrange(0, 9))).capitalize() + ("." if i % 2 else " !")))
            i += 1
    texts += [(900, texts[0][1]), (901, texts[0][1].upper()), (902, None), (903, ""), (904, " \n"), (905, "short text"), (None, texts[0][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("a", F.lit(1)).repartition(parts)
    got = near_dup.near_groups(df, threshold=0.7)
    assert got.columns == ["first_id", "doc_id"]
    assert sorted(map(tuple, got.collect())) == brute(texts, 0.7, 50)


def test_hot_family(spark):
    """A third of all rows are edits of one page, another part equal copies."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    texts = [(i, " ".join(edited(rng, base, 3))) for i in range(60)] + [(100 + i, " ".join(base)) for i in range(60)] + [(1000 + i, " ".join(f"u{i}x{k}" for k in range(60))) for i in range(60)]
    got = near_dup.near_groups(spark.createDataFrame(texts, "doc_id long, text string"), threshold=0.8).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 60)) + list(range(100, 160)) and {r.first_id for r in got} == {0}


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_groups(empty).collect() == []
    long = " ".join(f"w{k % 7919}" for k in range(120_000))
    got = near_dup.near_groups(spark.createDataFrame([(2, long), (1, long + " end")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 2)]


def test_posting_lists_over_partitions(monkeypatch):
    """Links within a list are the same however it is cut into batches."""
    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(near_dup, "TaskContext", Context)
    keys, ids = [1, 1, 1, 2, 3, 3], [10, 11, 12, 10, 11, 15]
    for cut in range(1, 6):
        parts = [(keys[:cut], ids[:cut]), (keys[cut:], ids[cut:])]
        batches = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(i, pa.int64())], ["key", "id"]) for k, i in parts]
        out = [r for b in near_dup._adjacent(iter(batches)) for r in b.to_pylist()]
        links = {(r["key"], r["a"], r["b"]) for r in out if r["kind"] == 0}
        assert links == {(1, 10, 11), (1, 11, 12), (1, 10, 12), (3, 11, 15)}
        assert [(r["kind"], r["key"], r["a"]) for r in out if r["kind"]] == [(1, 1, 10), (2, 3, 15)]


def test_members_of_mixed_lists(spark):
    links = spark.createDataFrame([(1, 10, 11), (1, 11, 12), (2, 20, 21)], "key long, a long, b long")
    labels = spark.createDataFrame([(10, 10), (11, 10), (20, 20), (21, 20)], "node long, component long")
    assert sorted(map(tuple, near_dup._mixed(links, labels).collect())) == [(10, 10), (11, 10), (12, 12)]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8])
def test_rare_pairs_lose_none(spark, threshold):
    rng = random.Random(3)
    sets = {}
    for i in range(80):
        base = rng.randrange(4) * 1000
        sets[i] = sorted({base + rng.randrange(60) for _ in range(rng.randrange(1, 90))} | {base + k for k in range(rng.randrange(40))})
    near = {(a, b) for a in sets for b in sets if a < b and a % 7 != b % 7 and len(set(sets[a]) & set(sets[b])) >= threshold * len(set(sets[a]) | set(sets[b]))}
    rows = spark.createDataFrame([(i, i % 7, g) for i, g in sets.items()], "id long, own long, grams array<long>")
    got = set(map(tuple, near_dup.rare_pairs(rows, threshold).collect()))
    assert near and near <= got and all(a < b and a % 7 != b % 7 for a, b in got)


def test_template_family_gives_few_pairs(spark):
    """Pages of one template that aren't near (similarity about 0.55) aren't paired with each other."""

    def pairs(n):
        rows = [(i, i, [*range(100), *range(1000 + 100 * i, 1040 + 100 * i)]) for i in range(n)]  # 100 runs of 180 in common
        rows += [(n + i, n + i, [*range(100), *range(1000 + 100 * i, 1038 + 100 * i)]) for i in range(10)]  # near to the first ten
        return near_dup.rare_pairs(spark.createDataFrame(rows, "id long, own long, grams array<long>"), 0.7).count()

    assert pairs(200) == pairs(400) == 10
