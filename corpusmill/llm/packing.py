"""Filling containers of fixed capacity with documents.

Method: the configuration linear program over the histogram of lengths (at most `capacity` rows,
whatever the number of documents). Multiplicative weights raise the price of lengths that the
configurations so far leave behind; the next configuration is the one of highest price that fits,
found by dynamic programming over the capacity (a bounded knapsack). The solution is rounded down to
whole containers; what rounding leaves is priced and placed in the same way, a configuration at a
time and as often as the lengths last. Documents are then numbered within their length and look up
the container of their number. Dual feasible functions bound the number of containers from below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.bpe import token_counts
from corpusmill.session import materialize

#: Rounds of the linear program, and of configurations for what rounding left; lengths that a round prices.
ROUNDS, RESIDUAL, COLUMNS = 100, 4096, 128
#: Exponent of a length in its first price (long items are the hard ones), and step of the weights.
HARD, STEP = 1.2, 20.0
#: Rows of the histograms of all capacities.
HISTOGRAM = 1 << 22


def best_configuration(lengths: np.ndarray, prices: np.ndarray, capacity: int, most: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """The multiset of lengths of highest total price that fits, each at most `most` times, and that
    price. Places by length. A step a length and power of two: O(capacity) each."""
    best, steps = np.zeros(capacity + 1), []
    limit = capacity // lengths if most is None else np.minimum(most, capacity // lengths)
    for i, (size, price, left) in enumerate(zip(lengths.tolist(), prices.tolist(), limit.tolist())):
        k = 1
        while left > 0:
            k = min(k, left)
            own = best[: -k * size] + k * price
            take = own > best[k * size :] + 1e-12
            steps.append((i, k, k * size, take))
            np.copyto(best[k * size :], own, where=take)
            left, k = left - k, 2 * k
    used, c = np.zeros(len(lengths), np.int64), capacity
    for i, k, width, take in reversed(steps):
        if c >= width and take[c - width]:
            used[i] += k
            c -= width
    return used, float(best[capacity])


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> float:
    """Containers that any packing needs: the best of some dual feasible functions, prices under which
    no container holds more than 1: by volume; 1 for what is beyond capacity - k and 0 for what is
    below k; and volume rounded down to p-ths of p + 1 parts."""
    parts = [lengths / capacity] + [np.where(lengths * (p + 1) % capacity == 0, lengths / capacity, lengths * (p + 1) // capacity / p) for p in range(1, 20)]
    ks = np.unique(np.linspace(0, capacity // 2, 65).astype(int))
    return max(float((np.where(lengths > capacity - k, 1.0, np.where(lengths < k, 0.0, f)) if k else f) @ counts) for f in parts for k in ks)


def configuration_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[np.ndarray], np.ndarray]:
    """Configurations, and how often each is used.

    Each round gives the best configuration an equal share of the containers; a length's weight falls
    by the share of its documents that are placed and rises with the rounds. Only the COLUMNS lengths
    of highest weight are priced in a round, those left behind among them."""
    share = max(1.0, float(lengths @ counts) / capacity) / rounds
    weights, found = np.zeros(len(lengths)), {}
    turn = np.arange(len(lengths)) * 7919  # equal weights take turns
    for t in range(rounds):
        on = np.sort(np.argsort(-weights + 1e-9 * ((turn + t * 104729) % len(lengths)), kind="stable")[:COLUMNS])
        used = np.zeros(len(lengths), np.int64)
        used[on] = best_configuration(lengths[on], (lengths[on] / capacity) ** HARD * np.exp(weights[on]), capacity, counts[on])[0]
        key = used.tobytes()
        found[key] = found.get(key, 0.0) + share
        weights = np.clip(weights + STEP * (1 / rounds - share * used / counts), -4, 4)
    return [np.frombuffer(k, np.int64) for k in found], np.array(list(found.values()))


def _configured(lengths: np.ndarray, left: np.ndarray, capacity: int, rounds: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, times): the linear program rounded down, then a configuration at a time for what
    is left. Takes what it places out of `left`; none may be longer than the capacity."""
    groups: list[tuple[np.ndarray, int]] = []

    def place(used: np.ndarray, times: int) -> None:
        at = np.flatnonzero(used)
        n = int(min(times, (left[at] // used[at]).min())) if len(at) else 0
        if n:
            left[at] -= n * used[at]
            groups.append((used, n))

    configs, times = configuration_lp(lengths, left.copy(), capacity, rounds)
    for k in np.argsort(-times, kind="stable"):
        place(configs[k], int(times[k]))
    for _ in range(RESIDUAL):
        on = np.flatnonzero(left)
        if not len(on):
            break
        if len(on) > COLUMNS:  # the longest, and others evenly over the rest
            half = COLUMNS // 2
            on = np.concatenate([on[: len(on) - half][np.arange(half) * (len(on) - half) // half], on[-half:]])
        used = np.zeros(len(lengths), np.int64)
        used[on] = best_configuration(lengths[on], (lengths[on] / capacity) ** HARD, capacity, left[on])[0]
        place(used, int(left.max()))
    return groups


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int, groups: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, int]]:
    """groups with what is left added: longest first, into the least space that takes it; equal
    containers stay one group."""
    spaces: dict[int, list[tuple[np.ndarray, int]]] = {}
    for used, n in groups:
        spaces.setdefault(capacity - int(used @ lengths), []).append((used, n))
    for i in np.flatnonzero(left)[::-1].tolist():
        size, rest = int(lengths[i]), int(left[i])
        while rest:
            space = min((s for s, own in spaces.items() if s >= size and own), default=None)
            if space is None:
                fit = min(capacity // size, rest)
                used, n = np.zeros(len(lengths), np.int64), rest // fit
                used[i] = fit
                spaces.setdefault(capacity - fit * size, []).append((used, n))
                rest -= n * fit
                continue
            used, n = spaces[space].pop()
            fit = min(space // size, rest)
            k = min(n, rest // fit)
            if n > k:
                spaces[space].append((used, n - k))
            more = used.copy()
            more[i] += fit
            spaces.setdefault(space - fit * size, []).append((more, k))
            rest -= k * fit
    return [g for own in spaces.values() for g in own]


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[int, np.ndarray], int, float]:
    """Per length, rows (first number, first container, copies in each container) in order of the
    first number; the number of containers; the lower bound. Bounded by rounds and capacity. Best fit
    alone takes the place of the program where it needs fewer containers."""
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    bound = lower_bound(lengths, counts, capacity) if len(lengths) else 0.0
    left = counts.copy()
    groups = _best_fit(lengths, left, capacity, _configured(lengths, left, capacity, rounds)) if len(lengths) else []
    plain = _best_fit(lengths, counts, capacity, [])
    if sum(n for _, n in plain) < sum(n for _, n in groups):
        groups = plain
    rows: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in lengths}
    number, place = 0, np.zeros(len(lengths), np.int64)
    for used, n in groups:
        for i in np.flatnonzero(used):
            rows[int(lengths[i])].append((int(place[i]), number, int(used[i])))
            place[i] += n * int(used[i])
        number += n
    return {s: np.array(r, np.int64) for s, r in rows.items() if r}, number, bound


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pack_id, ..., tokens) with the number of this task and each row's number among the rows
    of its capacity and length in it."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        n = batch.num_rows
        pack, size = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pack_id", "tokens"))
        order = np.lexsort((np.arange(n), size, pack))
        p, s = pack[order], size[order]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])) if n else np.empty(0, int)
        runs = np.diff(np.append(first, n))
        before = []
        for key, k in zip(zip(p[first].tolist(), s[first].tolist()), runs.tolist()):
            before.append(seen.get(key, 0))
            seen[key] = before[-1] + k
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(first - np.array(before, np.int64).reshape(-1), runs)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(rank)], [*batch.schema.names, "part", "rank"])


def _placed(plans, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {}
        for p, rows in plans.value.items():  # by length and first number, in one array
            table[p] = np.concatenate([np.column_stack([np.full(len(r), s), r]) for s, r in sorted(rows.items())]) if rows else np.empty((0, 4), np.int64)
        for batch in batches:
            pack, size, number = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("pack_id", "tokens", "number"))
            out = np.empty(len(pack), np.int64)
            for p in np.unique(pack):
                own = np.flatnonzero(pack == p)
                flat = table[int(p)]
                low = np.searchsorted(flat[:, 0], size[own])
                high = np.searchsorted(flat[:, 0], size[own], side="right")
                while (open_ := high - low > 1).any():  # the last row of the length whose first number isn't beyond
                    mid = (low + high) // 2
                    right = open_ & (flat[mid, 1] <= number[own])
                    low, high = np.where(right, mid, low), np.where(open_ & ~right, mid, high)
                out[own] = flat[low, 2] + (number[own] - flat[low, 1]) // flat[low, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], pa.array(out)], [*names[:-1], "container"])

    return run


def pack(sizes: DataFrame, limits: DataFrame, id: str = "doc_id", tokens: str = "tokens", rounds: int = ROUNDS) -> DataFrame:
    """(pack_id, id, piece, start, tokens, container) for every row of sizes and each capacity.

    A row of more tokens than the capacity is cut into pieces of the capacity, which follow each
    other from `start`, and a last one of the rest; no other row is cut. Rows of null, zero or
    negative size, and limits of null or non-positive capacity, are left out. Rows of equal ids are
    packed as rows of their own. Containers are numbered from 0 within a pack_id. Limits are a small
    table of settings: at most 1,000 rows, and histograms of at most HISTOGRAM rows in all, else an
    error. Rows are numbered within their length task by task, so that a length that a third of all
    rows have is not one task's.
    """
    spark = sizes.sparkSession
    caps = limits.where("pack_id is not null and capacity > 0").select(F.col("pack_id").cast("int"), F.col("capacity").cast("bigint")).distinct().limit(1001).collect()
    if len(caps) > 1000:
        raise ValueError("more than 1,000 capacities")
    kind = sizes.schema[id].dataType.simpleString()
    schema = f"pack_id int, `{id}` {kind}, piece int, start bigint, tokens bigint, container bigint"
    if not caps:
        return spark.createDataFrame([], schema)
    rows = sizes.select(F.col(id), F.col(tokens).cast("bigint").alias("size")).where("size > 0")
    cap = F.explode(F.array(*(F.struct(F.lit(r.pack_id).alias("pack_id"), F.lit(r.capacity).cast("bigint").alias("capacity")) for r in caps))).alias("cap")
    items = rows.select(id, "size", cap).select("cap.pack_id", id, "size", "cap.capacity")
    items = items.select("pack_id", id, "size", "capacity", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / F.col("capacity")).cast("int"))).alias("piece"))
    items = items.select("pack_id", id, "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.least("capacity", F.col("size") - F.col("piece") * F.col("capacity")).alias("tokens"))
    items = materialize(items.mapInArrow(_ranked, f"pack_id int, `{id}` {kind}, piece int, start bigint, tokens bigint, part int, rank bigint"), "items")
    parts = materialize(items.groupBy("pack_id", "tokens", "part").agg(F.count("*").alias("n")), "parts")
    seen = parts.groupBy("pack_id", "tokens").agg(F.sum("n").alias("n")).limit(HISTOGRAM + 1).toPandas()
    if len(seen) > HISTOGRAM:
        raise ValueError(f"more than {HISTOGRAM} lengths of all capacities")
    if not len(seen):
        return spark.createDataFrame([], schema)
    plans = {}
    for r in caps:
        own = seen[seen.pack_id == r.pack_id]
        plans[r.pack_id] = plan(own.tokens.to_numpy(), own.n.to_numpy(), r.capacity, rounds)[0]
    past = Window.partitionBy("pack_id", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("pack_id", "tokens", "part", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("base"))
    numbered = items.join(base, ["pack_id", "tokens", "part"]).select("pack_id", id, "piece", "start", "tokens", (F.col("base") + F.col("rank")).alias("number"))
    return numbered.mapInArrow(_placed(spark.sparkContext.broadcast(plans), numbered.columns), schema)


def pack_documents(docs: DataFrame, limits: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """pack() over the documents' sizes in tokens. Null and empty texts have none and are left out."""
    return pack(materialize(token_counts(docs, id, text, path), "sizes"), limits, id)
