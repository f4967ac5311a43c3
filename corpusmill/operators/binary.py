"""Binary trees over leaves, in Arrow batches: binarization, merge order, seeded shuffles of markers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame


def _is_open(t: str) -> bool:
    return t.startswith("<(") and t.endswith(">")


def _is_close(t: str) -> bool:
    return t.startswith("<") and t.endswith(")>")


def binary_spans(tree: list[str], left: bool) -> list[tuple[int, int, int]]:
    """(l, split, r) of the nodes of the binarized forest in post-order: unary chains are collapsed; a
    node of several children is cut after its first (right-branching) or before its last (left).
    A node's left part is l..split, its right part split+1..r. Iterative, so depth has no bound."""
    out: list[tuple[int, int, int]] = []
    stack: list[list[tuple[int, int]]] = [[]]
    leaves = 0

    def joined(parts: list[tuple[int, int]]) -> tuple[int, int] | None:
        if not parts:
            return None
        lo, hi = parts[0][0], parts[-1][1]
        if len(parts) > 1:
            cuts = [p[1] for p in parts[:-1]]
            # post-order: the innermost node first
            out.extend((lo, c, parts[k + 1][1]) for k, c in enumerate(cuts)) if left else out.extend((parts[k][0], cuts[k], hi) for k in range(len(cuts) - 1, -1, -1))
        return lo, hi

    for t in tree:
        if _is_open(t):
            stack.append([])
        elif _is_close(t):
            if len(stack) > 1:
                node = joined(stack.pop())
                if node:
                    stack[-1].append(node)
        else:
            stack[-1].append((leaves, leaves))
            leaves += 1
    while len(stack) > 1:
        node = joined(stack.pop())
        if node:
            stack[-1].append(node)
    joined(stack[0])
    return out


def _lists(f, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else f(t) for t in batch.column(1).to_pylist()], kind)], ["id", "out"])

    return run


def binarized(df: DataFrame, id: str, tree: str, left: bool = False) -> DataFrame:
    """(id, spans) of each forest's marker array; null stays null, a forest of one leaf has no node."""
    kind = pa.list_(pa.struct([("l", pa.int32()), ("s", pa.int32()), ("r", pa.int32())]))
    key = df.schema[id].dataType.simpleString()
    return df.select(id, tree).mapInArrow(_lists(lambda t: [dict(zip("lsr", x)) for x in binary_spans(t, left)], kind), f"`{id}` {key}, spans array<struct<l:int,s:int,r:int>>")


def merge_order(df: DataFrame, id: str, tree: str, left: bool = False) -> DataFrame:
    """(id, merges): the gaps between leaves in the order in which they are closed: a permutation of 0..n-2."""
    key = df.schema[id].dataType.simpleString()
    return df.select(id, tree).mapInArrow(_lists(lambda t: [s for _, s, _ in binary_spans(t, left)], pa.list_(pa.int32())), f"`{id}` {key}, merges array<int>")


def shuffled_markers(df: DataFrame, id: str, tree: str, seed: int = 0) -> DataFrame:
    """(id, tree): the markers of each array permuted over the places that markers have; leaves stay.
    The permutation is a function of the array's content and the seed, not of its place."""

    def one(t: list[str]) -> list[str]:
        at = [k for k, x in enumerate(t) if _is_open(x) or _is_close(x)]
        rng = np.random.Generator(np.random.PCG64(xxhash.xxh3_64_intdigest("\x1f".join(t), seed)))
        out = list(t)
        for k, j in zip(at, rng.permutation(len(at)).tolist()):
            out[k] = t[at[j]]
        return out

    key = df.schema[id].dataType.simpleString()
    return df.select(id, tree).mapInArrow(_lists(one, pa.list_(pa.string())), f"`{id}` {key}, tree array<string>")


def undoubled(df: DataFrame, id: str, tree: str) -> DataFrame:
    """(id, tree): the array before every closing marker was doubled; null where a closing marker has no
    equal neighbour to go with."""

    def one(t: list[str]) -> list[str] | None:
        out, k = [], 0
        while k < len(t):
            out.append(t[k])
            if _is_close(t[k]):
                if k + 1 >= len(t) or t[k + 1] != t[k]:
                    return None
                k += 1
            k += 1
        return out

    key = df.schema[id].dataType.simpleString()
    return df.select(id, tree).mapInArrow(_lists(one, pa.list_(pa.string())), f"`{id}` {key}, tree array<string>")


def without_inner(df: DataFrame, id: str, tree: str, mark: str = "</s>") -> DataFrame:
    """(id, tree): marks taken out where brackets are open; those between trees stay."""

    def one(t: list[str]) -> list[str]:
        depth, out = 0, []
        for x in t:
            depth += _is_open(x) - _is_close(x)
            if x != mark or depth <= 0:
                out.append(x)
        return out

    key = df.schema[id].dataType.simpleString()
    return df.select(id, tree).mapInArrow(_lists(one, pa.list_(pa.string())), f"`{id}` {key}, tree array<string>")


def grafted(tree: list[str], leaves: list[str], put: list[str]) -> list[str] | None:
    """The tree with the smallest phrase whose leaves are `leaves` replaced by `put`; the first of equals.
    Null where no phrase has just these leaves."""
    stack, best = [], None
    words: list[str] = []
    for k, t in enumerate(tree):
        if _is_open(t):
            stack.append((k, len(words)))
        elif _is_close(t):
            if stack:
                start, at = stack.pop()
                if words[at:] == leaves and (best is None or k - start < best[1] - best[0]):
                    best = (start, k)
        else:
            words.append(t)
    return None if best is None or not leaves else tree[: best[0]] + put + tree[best[1] + 1 :]


def graft(df: DataFrame, id: str, tree: str, leaves: str, put: str) -> DataFrame:
    """(id, tree): grafted() of each row; null arrays give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if None in r else grafted(*r) for r in rows], pa.list_(pa.string()))], ["id", "tree"])

    key = df.schema[id].dataType.simpleString()
    return df.select(id, tree, leaves, put).mapInArrow(run, f"`{id}` {key}, tree array<string>")
