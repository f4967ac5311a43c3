"""Evaluation records to accuracies, perplexities and intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_delivery(scores: DataFrame, key: Sequence[str], seen: str, *more: str) -> DataFrame:
    """One row of each key: the earliest by `seen` (null times last), ties by the other columns given."""
    rest = [c for c in scores.columns if c not in key]
    row = F.min(F.struct(F.col(seen).isNull().alias("_late"), seen, *(F.struct(F.col(m).isNull(), F.col(m)).alias(f"_o_{m}") for m in more), F.struct(*rest).alias("_row")))
    return scores.groupBy(*key).agg(row.alias("_m")).select(*key, "_m._row.*").select(*scores.columns)


def chosen(scores: DataFrame, by: Sequence[str], choice: str, score: str) -> DataFrame:
    """(by..., pred): the choice of the highest score, the lowest choice on a tie. Null scores are
    left out; a case with a gap in its choice numbers is skipped."""
    ok = scores.where(F.col(score).isNotNull() & ~F.isnan(score))
    cases = ok.groupBy(*by).agg(F.max_by(choice, F.struct(score, -F.col(choice))).alias("pred"), F.max(choice).alias("_last"), F.countDistinct(choice).alias("_n"))
    return cases.where("_last < _n").drop("_last", "_n")


def with_macro(scored: DataFrame, run: str, task: str, value: Column, name: str) -> DataFrame:
    """(run, task, cases, name) by task, and for task `_` the unweighted mean over tasks."""
    own = scored.groupBy(run, task).agg(F.count("*").alias("cases"), F.avg(value).alias(name))
    macro = own.groupBy(run).agg(F.lit("_").alias(task), F.sum("cases").alias("cases"), F.avg(name).alias(name))
    return own.unionByName(macro)


def log_sum_exp(by: Sequence[str], value: str, df: DataFrame) -> DataFrame:
    """(by..., lse) with the largest value taken out first, so that nothing overflows."""
    top = df.groupBy(*by).agg(F.max(value).alias("_m"))
    return df.join(top, list(by)).groupBy(*by).agg((F.max("_m") + F.log(F.sum(F.exp(F.col(value) - F.col("_m"))))).alias("lse"))


#: Resamples that are kept together as one array.
CHUNK = 500


def _resampled(names: list[str], keys: int, samples: int, seed: int):
    """Rows (keys, values, count) to (keys, chunk, sums of the values in the chunk's resamples), a group and
    batch at a time; chunk -1 has the sums themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, np.ndarray] = {}
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, values, count = row[:keys], np.array(row[keys:-1]), row[-1]
                draw = np.random.Generator(np.random.PCG64([seed, xxhash.xxh3_64_intdigest(repr(row[:-1]))])).poisson(count, samples)
                sums = groups.setdefault(key, np.zeros((len(values), samples + 1)))
                sums[:, 0] += values * count
                used = np.flatnonzero(values)
                sums[used, 1:] += values[used, None] * draw
            for key, sums in groups.items():
                cuts = [(-1, 0, 1), *((k, 1 + k * CHUNK, min(1 + (k + 1) * CHUNK, samples + 1)) for k in range(-(-samples // CHUNK)))]
                fixed = [pa.array([k] * len(cuts), batch.schema.field(i).type) for i, k in enumerate(key)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array([c[0] for c in cuts], pa.int32()), *(pa.array([x[a:b] for _, a, b in cuts], pa.list_(pa.float64())) for x in sums)], names)

    return run


def bootstrap(df: DataFrame, by: Sequence[str], sums: Sequence[str], metrics: dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]], samples: int = 10_000, macro: str | None = None, seed: int = 1) -> DataFrame:
    """(by..., metric, value, low, high): functions of sums over the rows of each group, and their 95 %
    intervals over resamples. A row's times in a resample are Poisson(1); those of k equal rows together
    are Poisson(k), so that rows are combined by their values before anything is drawn: a metric of
    few values costs as much for a billion cases as for a thousand. All metrics of a group are of the
    same resamples (paired). Draws are a function of the values and the seed. With macro, rows where that
    column of `by` is `_` have the unweighted mean over it, resample by resample. Null sums count as 0;
    what a metric can't divide is null and left out of its interval.

    Sums of resamples move as arrays, by group and chunk of resamples: what a task holds is bounded by
    the number of tasks before it and by groups of one run, not by rows."""
    spark = df.sparkSession
    kept = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums]
    equal = df.select(*by, *kept).groupBy(*by, *sums).agg(F.count("*").alias("_k")).repartition(spark.sparkContext.defaultParallelism)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    drawn = equal.mapInArrow(_resampled([*by, "chunk", *sums], len(by), samples, seed), f"{kinds}, chunk int, " + ", ".join(f"`{c}` array<double>" for c in sums))

    def measured(pdf: pd.DataFrame) -> pd.DataFrame:
        total = {c: np.sum(np.stack(pdf[c].to_list()), axis=0) for c in sums}
        with np.errstate(divide="ignore", invalid="ignore"):
            told = [(n, np.asarray(f(total), float)) for n, f in metrics.items()]
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(told) for c in by}, "chunk": [pdf["chunk"].iloc[0]] * len(told), "metric": [n for n, _ in told], "v": [v for _, v in told]})

    each = drawn.groupBy(*by, "chunk").applyInPandas(measured, f"{kinds}, chunk int, metric string, v array<double>")
    rest = [c for c in by if c != macro]

    def banded(pdf: pd.DataFrame) -> pd.DataFrame:
        first, out = pdf.iloc[0], []
        groups = {k: (g[g.chunk == -1]["v"].iloc[0][0], np.concatenate(g[g.chunk >= 0].sort_values("chunk")["v"].to_list())) for k, g in (pdf.groupby(macro, dropna=False) if macro else [(None, pdf)])}
        if macro:
            groups["_"] = (np.nanmean([v for v, _ in groups.values()]), np.nanmean(np.stack([x for _, x in groups.values()]), axis=0))
        for k, (value, x) in groups.items():
            x = x[np.isfinite(x)]
            low, high = np.percentile(x, [2.5, 97.5]) if len(x) else (None, None)
            out.append({**{c: k if c == macro else first[c] for c in by}, "metric": first["metric"], "value": value if np.isfinite(value) else None, "low": low, "high": high})
        return pd.DataFrame(out)

    return each.groupBy(*rest, "metric").applyInPandas(banded, f"{kinds}, metric string, value double, low double, high double")
