"""Greedy packing in order: a sequential recurrence, cut into blocks that run in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize


def _block(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row as the first of a chunk: the first row of the next chunk, the fill of the last
    chunk at the end of the block, and the number of chunks from there. No size is above the limit."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    after = np.searchsorted(total, total[:-1] + limit, side="right") - 1
    fill, count = np.empty(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for k in range(n - 1, -1, -1):
        j = after[k]
        fill[k], count[k] = (min(total[n] - total[k], limit), 1) if j >= n else (fill[j], count[j] + 1)
    return after, fill, count


def _first(total: np.ndarray, state: int, limit: int) -> int:
    """The first row that doesn't fit beside `state`, which the open chunk already holds."""
    return int(np.searchsorted(total, limit - state, side="right") - 1)


def greedy_chunks(df: DataFrame, order: str, size: str, limit: int, rows: int = 200_000, fan: int = 256) -> DataFrame:
    """(order, chunk): rows in order, each in the current chunk if it fits into `limit`, else in the
    next; a row above the limit is alone; chunk counts from 1. Null and zero sizes take no space,
    sizes above the limit as much as the limit.

    What crosses from block to block is how full the open chunk is, 0 to limit. Each block of about
    `rows` rows tells, for every such state, the state at its end and how many chunks it begins: two
    functions of limit + 1 values. Those of `fan` neighbouring blocks are composed into one, on the
    executors, level by level, until at most `fan` are left, whose true states a task gives out; going
    down again, every block learns its own and is numbered. Nothing comes to the driver but counts."""
    kind = df.schema[order].dataType.simpleString()
    own = df.select(order, F.least(F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)), F.lit(limit)).cast("bigint").alias("_n"))
    blocks = max(1, -(-own.count() // rows))
    cut = materialize(own.repartitionByRange(blocks, order).withColumn("_p", F.spark_partition_id()), "blocks")

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values(order)["_n"].to_numpy()
        total = np.concatenate([[0], np.cumsum(sizes)])
        _, fill, count = _block(sizes, limit)
        ends, counts = [], []
        for t in range(limit + 1):
            k = _first(total, t, limit)
            ends.append(int(t + total[-1]) if k >= len(sizes) else int(fill[k]))
            counts.append(0 if k >= len(sizes) else int(count[k]))
        return pd.DataFrame({"p": [int(pdf["_p"].iloc[0])], "ends": [ends], "counts": [counts]})

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        state, count = np.arange(limit + 1), np.zeros(limit + 1, np.int64)
        for ends, counts in zip(pdf["ends"], pdf["counts"]):
            ends, counts = np.minimum(np.asarray(ends), limit), np.asarray(counts)
            state, count = ends[state], count + counts[state]
        return pd.DataFrame({"p": [int(pdf["p"].iloc[0]) // fan], "ends": [state.tolist()], "counts": [count.tolist()]})

    def given(pdf: pd.DataFrame) -> pd.DataFrame:
        """States and chunk numbers at the beginning of each of a group of neighbours."""
        pdf = pdf.sort_values("p")
        state, done, out = int(pdf["s"].iloc[0]), int(pdf["d"].iloc[0]), []
        for p, ends, counts in zip(pdf["p"], pdf["ends"], pdf["counts"]):
            out.append((p, state, done))
            state, done = min(limit, int(ends[state])), done + int(counts[state])
        return pd.DataFrame(out, columns=["p", "s", "d"])

    kinds = "p bigint, ends array<bigint>, counts array<bigint>"
    levels = [materialize(cut.groupBy("_p").applyInPandas(summary, kinds), "told")]
    n = blocks
    while n > fan:
        levels.append(materialize(levels[-1].groupBy(F.floor(F.col("p") / fan)).applyInPandas(composed, kinds), "told"))
        n = -(-n // fan)
    states = levels[-1].select("p", "ends", "counts", F.lit(0).alias("s"), F.lit(1).alias("d"), F.lit(0).alias("up"))
    states = states.groupBy("up").applyInPandas(given, "p bigint, s bigint, d bigint")
    for level in reversed(levels[:-1]):
        down = level.withColumn("up", F.floor(F.col("p") / fan)).join(states.withColumnRenamed("p", "up"), "up")
        states = down.groupBy("up").applyInPandas(given, "p bigint, s bigint, d bigint")
    begun = cut.join(states.withColumnRenamed("p", "_p"), "_p")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        sizes = pdf["_n"].to_numpy()
        state, done = int(pdf["s"].iloc[0]), int(pdf["d"].iloc[0])
        after, _, _ = _block(sizes, limit)
        starts = np.zeros(len(sizes), np.int64)
        k = _first(np.concatenate([[0], np.cumsum(sizes)]), state, limit)
        while k < len(sizes):
            starts[k], k = 1, after[k]
        return pd.DataFrame({order: pdf[order], "chunk": done + np.cumsum(starts)})

    return begun.groupBy("_p").applyInPandas(number, f"`{order}` {kind}, chunk bigint")
