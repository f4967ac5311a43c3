"""Running totals and row numbers over a total order of any length, without a one-task window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import materialize


def _changed(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row but the first differs from the one before in any of the columns; null equals null."""
    out = np.zeros(max(len(columns[0]) - 1, 0), bool) if columns else np.zeros(0, bool)
    for c in columns:
        one, two = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        differs = pc.fill_null(pc.not_equal(one, two), False).to_numpy(zero_copy_only=False)
        out |= differs | (pc.is_null(one).to_numpy(zero_copy_only=False) ^ pc.is_null(two).to_numpy(zero_copy_only=False))
    return out


def _summed(by: list[str], values: list[str]):
    """Rows in order to rows with the running sum of each value within the task, from 0 in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, totals = None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(batch.schema.get_field_index(c)) for c in by]
            first = tuple(k[0].as_py() for k in keys)
            new = np.concatenate([[True], _changed(keys)]) if keys else np.arange(n) == 0
            at = np.flatnonzero(new)
            goes_on, out = last == first, []
            for v in values:
                x = batch.column(batch.schema.get_field_index(v)).to_numpy(zero_copy_only=False)
                total = np.cumsum(x)
                before = total[at] - x[at]
                if goes_on:
                    before[0] -= totals[v]
                total = total - np.repeat(before, np.diff(np.append(at, n)))
                totals[v] = total[-1]
                out.append(pa.array(total))
            last = tuple(k[n - 1].as_py() for k in keys)
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *(f"_r{v}" for v in values)])

    return run


def running(df: DataFrame, order: Sequence[str], values: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """df with, for each name, the sum of its value over the rows up to and with this one, in the
    order given, within `by`. Nulls count as 0; rows equal in `order` share no defined order, so the
    order should be total. Whole numbers give bigint, others double.

    Two phases: rows are cut into ranges of the order, sorted and summed there, and written once; the
    totals of the ranges before (as many as partitions, times groups) are joined and added. The rows
    themselves are shuffled once."""
    whole = ("tinyint", "smallint", "int", "bigint", "boolean")
    cut = df.select("*", *(F.coalesce(v, F.lit(0)).alias(f"_v_{n}") for n, v in values.items()))
    kinds = {f"_v_{n}": "bigint" if cut.schema[f"_v_{n}"].dataType.simpleString() in whole else "double" for n in values}
    cut = cut.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
    keys = [*by, *order]
    ranged = cut.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, *(T.StructField(f"_r{c}", T.LongType() if k == "bigint" else T.DoubleType()) for c, k in kinds.items())])
    ranged = materialize(ranged.mapInArrow(_summed(list(by), list(kinds)), schema), "ranges")
    totals = ranged.groupBy(*by, "_p").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values))
    past = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, "_p", *(F.coalesce(F.sum(f"_t_{n}").over(past), F.lit(0)).alias(f"_c_{n}") for n in values))
    joined = ranged.join(carry.withColumnsRenamed({b: f"_k_{b}" for b in by}).withColumnRenamed("_p", "_kp"), [F.col("_p") == F.col("_kp"), *(F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by)])
    return joined.select(*df.columns, *((F.col(f"_r_v_{n}") + F.col(f"_c_{n}")).alias(n) for n in values))


def numbered(df: DataFrame, order: Sequence[str], name: str = "rn", by: Sequence[str] = ()) -> DataFrame:
    """df with the number of each row in the order, from 1."""
    return running(df, order, {name: F.lit(1)}, by).withColumn(name, F.col(name).cast("bigint"))


def with_previous(df: DataFrame, order: Sequence[str], value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with the value of the row before in the order, within `by`; null for the first. By row
    numbers and an equi-join on them, so that a hot group isn't one task's."""
    n = materialize(numbered(df, order, "_rn", by), "numbered")
    prev = n.select(*(F.col(b).alias(f"_b_{b}") for b in by), (F.col("_rn") + 1).alias("_next"), F.col(value).alias(name))
    same = [n["_rn"] == prev["_next"], *(n[b].eqNullSafe(prev[f"_b_{b}"]) for b in by)]
    return n.join(prev, same, "left").select(*df.columns, name)


def top(df: DataFrame, k: int, by: Sequence[str], *order: Column) -> DataFrame:
    """The first k rows of each group in a total order. Spark cuts each task to its own first k
    before the shuffle, so a hot group costs k rows a task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
