from __future__ import annotations

import random

import pytest

from corpusmill.operators import binary, rouge


def forest(rng, depth=0):
    if depth > 4 or rng.random() < 0.3:
        return ["w"]
    return ["<(X>", *sum((forest(rng, depth + 1) for _ in range(rng.randrange(1, 4))), []), "<X)>"]


@pytest.mark.parametrize("left", [True, False])
def test_merges_are_a_permutation_in_post_order(left):
    rng = random.Random(1)
    for _ in range(200):
        tree = forest(rng) + forest(rng)
        n = sum(t == "w" for t in tree)
        nodes = binary.binary_spans(tree, left)
        assert sorted(s for _, s, _ in nodes) == list(range(n - 1))
        done: set = {(k, k) for k in range(n)}
        for lo, s, hi in nodes:
            assert (lo, s) in done and (s + 1, hi) in done
            done.add((lo, hi))


def test_deep_and_odd_trees():
    deep = ["<(X>"] * 5000 + ["w", "w"] + ["<X)>"] * 5000
    assert binary.binary_spans(deep, True) == [(0, 0, 1)]
    assert binary.binary_spans([], True) == [] and binary.binary_spans(["w"], False) == [] and binary.binary_spans(["<X)>", "<(X>"], True) == []


def test_shuffle_keeps_leaves(spark):
    rows = [(1, ["<(A>", "a", "<(B>", "b", "<B)>", "<A)>"]), (2, []), (3, None), (None, ["x"])]
    df = spark.createDataFrame(rows, "id int, tree array<string>")
    got = {r.id: r.tree for r in binary.shuffled_markers(df, "id", "tree", 7).collect()}
    again = {r.id: r.tree for r in binary.shuffled_markers(df.repartition(3), "id", "tree", 7).collect()}
    assert got == again and sorted(got[1]) == sorted(rows[0][1]) and got[1][1] == "a" and got[1][3] == "b" and got[2] == [] and got[3] is None
    assert {r.id: r.merges for r in binary.merge_order(df, "id", "tree").collect()}[1] == [0]


def test_lcs():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 12))] for _ in "xy")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert rouge.lcs(a, b) == table[-1][-1]
