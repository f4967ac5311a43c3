"""Splits, budgets, allocations and samples: all a function of content hashes or of a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.ordered import numbered, running


def hash_split(sha: Column, buckets: int = 2048) -> Column:
    """1 and 2 (validation) for the first two of `buckets` by the digest's first eight bytes, else 0.
    buckets divides 4096, so only the lowest twelve of those 64 bits matter."""
    low = F.conv(F.substring(sha, 14, 3), 16, 10).cast("int") % buckets
    return F.when(low == 0, 1).when(low == 1, 2).otherwise(0)


def budgeted(df: DataFrame, order: Sequence[str], size: str, by: str, targets: dict[int, int]) -> DataFrame:
    """Rows in order until the total of their group has reached its target: a row is taken when what
    was before it is below the target. Adds `before`. Groups without a target give nothing."""
    target = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))
    summed = running(df, order, {"before": F.col(size)}, [by]).withColumn("before", F.col("before") - F.coalesce(size, F.lit(0)))
    return summed.where(F.col("before") < F.element_at(target, F.col(by)))


def allocated(strata: DataFrame, key: str, n: str, total: int | Column, by: Sequence[str] = (), last_key_first: bool = False) -> DataFrame:
    """strata with `share`: `total` dealt in proportion to n by largest remainder; equal remainders go
    to the smallest key first (or the largest). strata is small: one row a stratum."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    total = total if isinstance(total, Column) else F.lit(total)
    product = F.col(n) * total
    sums = F.sum(n).over(whole)
    df = strata.withColumn("_q", F.floor(product / sums)).withColumn("_r", product % sums).withColumn("_left", total - F.sum("_q").over(whole))
    rank = F.row_number().over(whole.orderBy(F.desc("_r"), F.desc(key) if last_key_first else F.asc(key)))
    return df.withColumn("share", (F.col("_q") + (rank <= F.col("_left")).cast("int")).cast("bigint")).drop("_q", "_r", "_left")


def hash_order(*parts: Column | str) -> Column:
    """A fixed pseudo-random order that any engine can repeat: SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def shuffled(df: DataFrame, id: str, seed: str, name: str = "rn") -> DataFrame:
    """df with each row's number in hash order, from 1; `h` is the hash."""
    return numbered(df.withColumn("h", hash_order(seed, F.col(id))), ["h", id], name)


def ranks(n: Column, world: int) -> Column:
    return (n - 1) % world


def parts(n: Column, rows: int, world: int) -> Column:
    """The contiguous part, from 0, of row n of `rows`; the first ones take one more where world doesn't divide."""
    q, more = divmod(rows, world)
    k = n - 1
    return F.when(k < more * (q + 1), F.floor(k / (q + 1))).otherwise(more + F.floor((k - more * (q + 1)) / max(q, 1))).cast("bigint")
