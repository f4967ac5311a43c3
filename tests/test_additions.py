"""Operators of the second round against brute force, and on nulls, empty tables and clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.words import BRACKETS
from corpusmill.operators import binary, ordered, packing, similarity, streams, trees
from corpusmill.session import drop, materialize
from corpusmill.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_packing_over_levels(spark, fan):
    rng = random.Random(fan)
    sizes = [rng.choice([None, 0, 1, 3, 9, 10, 40]) for _ in range(120)]
    want, chunk, fill = [], 1, 0
    for i, n in enumerate(sizes):
        n = min(n or 0, 10)
        if fill + n > 10:
            chunk, fill = chunk + 1, 0
        fill += n
        want.append((i, chunk))
    got = packing.greedy_chunks(spark.createDataFrame(list(enumerate(sizes)), "i int, n int").withColumn("s", F.lit("clash")), "i", "n", 10, rows=9, fan=fan)
    assert [tuple(r) for r in got.orderBy("i").collect()] == want


def test_running_of_doubles_and_null_groups(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", None, "b"]), rng.choice([1, None]), i, rng.choice([None, 0.5, -2.25])) for i in range(300)]
    df = spark.createDataFrame(data, "g string, h int, i int, v double").repartition(6)
    total, want = {}, []
    for g, h, i, v in data:
        total[g, h] = total.get((g, h), 0.0) + (v or 0.0)
        want.append((i, total[g, h]))
    got = ordered.running(df, ["i"], {"t": F.col("v")}, ["g", "h"])
    assert rows(got.select("i", "t")) == sorted(want, key=str) and got.columns == ["g", "h", "i", "v", "t"]
    assert ordered.running(df.limit(0), ["i"], {"t": F.col("v")}, ["g"]).collect() == []


def _runs(words, n):
    return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]


def _texts():
    rng = random.Random(9)
    base = [f"w{rng.randrange(50)}" for _ in range(120)]
    out = {}
    for i in range(16):
        k = rng.randrange(80)
        out[i] = base[k : k + rng.randrange(0, 60)] + [f"x{rng.randrange(400)}" for _ in range(rng.randrange(30))] + base[:14] * rng.randrange(3)
    out[20], out[21] = [], ["one"]
    return out


def test_pair_coverage_against_brute_force(spark):
    texts = _texts()
    df = spark.createDataFrame([*texts.items(), (30, None)], "id int, words array<string>").withColumn("h", F.lit("clash"))
    want = []
    for a in texts:
        for b in texts:
            if a < b:
                covered = [len({p for k, g in enumerate(_runs(texts[x], 13)) if g in set(_runs(texts[y], 13)) for p in range(k, k + 13)}) for x, y in ((a, b), (b, a))]
                if covered[0]:
                    want.append((a, b, *covered, len(texts[a]), len(texts[b])))
    assert rows(similarity.pair_coverage(df, df, 13, True)) == sorted(want, key=str)
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    assert {r[:2] for r in rows(similarity.pair_coverage(left, right, 13))} == {((a, b) if a % 2 == 0 else (b, a)) for a, b, *_ in want if a % 2 != b % 2}
    partial = {(a, b) for a, b, ca, cb, na, nb in want if min(na, nb) >= 50 and (ca / na >= 0.3 or cb / nb >= 0.3)}
    assert partial and set(rows(similarity.partial_pairs(df))) == partial
    assert similarity.partial_pairs(df.limit(0)).collect() == []


def test_shared_counts_and_classes(spark):
    texts = _texts() | {40: _texts()[3]}
    df = spark.createDataFrame(list(texts.items()), "id int, words array<string>")
    g = similarity.gram_sets(df, "id", "words", 5)
    want = [(a, b, len(x & y)) for a in texts for b in texts if (x := set(_runs(texts[a], 5))) & (y := set(_runs(texts[b], 5)))]
    assert rows(similarity.shared_counts(g, g).select("a", "b", "shared")) == sorted(want, key=str)
    assert dict(rows(similarity.classes(df, "id", "words")))[40] == 3
    runs = similarity.run_rows(df, "id", "words", 5)
    assert runs.count() == sum(max(0, len(w) - 4) for w in texts.values()) and runs.select("h", "i").distinct().count() == len({g for w in texts.values() for g in _runs(w, 5)})


@pytest.mark.parametrize("seed", range(3))
def test_replay_and_translation(spark, seed):
    rng = random.Random(seed)
    texts = [(i, "".join(rng.choice(["-LRB-", "-RSB-", "ab", " ", "\n", "é", "-"]) for _ in range(rng.randrange(40)))) for i in range(30)] + [(90, ""), (91, None)]
    df = spark.createDataFrame(texts, "id int, t string")
    p = streams.patches(df, "id", "t", BRACKETS).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "old", "new"))).alias("p"))
    d = df.join(p, "id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<struct<at:int,old:string,new:string>>"))).withColumn("new", streams.replayed(F.col("t"), F.col("p")))
    for r in d.select("t", "new", streams.replayed(F.col("new"), F.col("p"), False).alias("back")).collect():
        want = r.t
        for a, b in BRACKETS.items():
            want = want and want.replace(a, b)
        assert r.new == want and r.back == r.t
    text = dict(texts)
    for r in streams.translated(df, "id", "t", BRACKETS).collect():
        before = text[r.id][: r.old_at]
        for a, b in BRACKETS.items():
            before = before.replace(a, b)
        assert r.new_at == len(before)


def test_end_marks(spark):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate([5, 9, 5, 5, 9, 5])] + [("b", 0, 5)], "s string, pos int, tok int")
    assert rows(streams.ends(df, "s", "pos", "tok", 9)) == [("a", 0, 2, True), ("a", 2, 5, True), ("a", 5, 6, False), ("b", 0, 1, False)]


def test_tree_forms(spark):
    tree = ["<(S>", "a", "<(N>", "b", "</s>", "c", "<N)>", "<S)>", "</s>"]
    df = spark.createDataFrame([(1, tree), (2, None), (3, [])], "id int, tree array<string>")
    assert rows(binary.without_inner(df, "id", "tree")) == [(1, [t for t in tree[:4]] + tree[5:]), (2, None), (3, [])]
    doubled = spark.createDataFrame([(1, ["<(N>", "a", "<N)>", "<N)>"]), (2, ["<N)>"]), (3, ["<N)>", "<S)>"])], "id int, tree array<string>")
    assert rows(binary.undoubled(doubled, "id", "tree")) == [(1, ["<(N>", "a", "<N)>"]), (2, None), (3, None)]
    assert binary.grafted(["<(S>", "<(N>", "a", "<N)>", "b", "<S)>"], ["a"], ["z"]) == ["<(S>", "z", "b", "<S)>"]
    assert binary.grafted(["<(S>", "<(N>", "a", "<N)>", "<S)>"], ["a"], ["z"]) == ["<(S>", "z", "<S)>"] and binary.grafted(["a"], ["a"], []) is None and binary.grafted(tree, [], ["x"]) is None
    for n in range(9):
        x = spark.createDataFrame([([f"t{k}" for k in range(n)],)], "x array<string>").select(trees.pauses(F.col("x"), 3, 2).alias("p"), "x")
        r = x.select("x", "p", trees.unpaused(F.col("p"), 3, 2).alias("u"), trees.pause_mask(F.col("p"), 3, 2).alias("m"), trees.without_last_pauses(F.col("p")).alias("c")).first()
        assert r.u == r.x and [t == "<pause>" for t in r.p] == r.m and len(r.p) == n + n // 2 * 3 and (not r.c or r.c[-1] != "<pause>")
    e = spark.createDataFrame([(["<s>", "a", "</s>"],), (["a"],), (["a", "<s>"],), (["</s>", "a"],), ([],)], "x array<string>")
    assert [r[0] for r in e.select(trees.frame_error(F.col("x"))).collect()] == [None, None, "misplaced <s>", "misplaced </s>", None]


def test_spans_have_their_split(spark):
    p = spark.createDataFrame([(1, "(S (NP (D the) (N dog)) (VP (V saw) (NP (N it))))"), (2, "(S"), (3, None), (4, "(X (Y a))")], "parse_id int, parsed string")
    assert rows(trees.spans(p)) == sorted([(1, "NP", 0, 0, 1), (1, "NP", 3, 3, 3), (1, "S", 0, 1, 3), (1, "VP", 2, 2, 3), (4, "X", 0, 0, 0)], key=str)


def test_sources(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    text = "Größe über alles\nzwei"
    for name, raw in {"a": text.encode(), "b": b"\xef\xbb\xbf" + text.encode(), "c": text.encode("utf-16"), "d": text.encode("latin-1"), "e": b""}.items():
        (d / f"{name}.txt").write_bytes(raw)
    got = {r.path[-5]: r.text for r in files.read_encoded(spark, f"file://{d}").collect()}
    assert got == {k: text for k in "abcd"}
    df = spark.createDataFrame([(1, 0, "x"), (2, 1, None), (3, None, "yy")], "id int, split int, t string")
    path = f"file://{tmp_path}/out"
    assert rows(files.publish(df, "split", "t", path)) == [(0, 1, 1, True), (1, 1, 0, True), (None, 1, 2, True)]
    assert spark.read.parquet(path + "/data").count() == 3
    with pytest.raises(FileExistsError):
        files.publish(df, "split", "t", path)
    assert rows(files.unpacked(df, "split")) == [(0, 1, 1, 0, 0), (1, 1, 1, 0, 0), (None, 1, 1, 0, 0)]
    with pytest.raises(FileNotFoundError):
        files.read_arrow(spark, f"file://{d}", "*.parquet")


def test_tables_are_dropped(spark, tmp_path):
    t = materialize(spark.range(3), "gone")
    path = t._table[len("file://") :]
    import os

    assert t.count() == 3 and os.path.isdir(path)
    drop(t, None)
    assert not os.path.isdir(path)
