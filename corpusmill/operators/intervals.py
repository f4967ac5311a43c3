"""Points in half-open intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], pos: str, start: str, end: str, width: int = 4096) -> DataFrame:
    """Points joined with the intervals that hold them (start <= pos < end) within `by`. Both sides go
    to cells of equal width, so it is an equi-join whose keys spread a hot `by` over its cells; an
    interval is in as many cells as it touches. Empty intervals hold nothing; nulls match nothing."""
    at = lambda c: c.cast("bigint") - F.pmod(c.cast("bigint"), F.lit(width).cast("bigint"))  # noqa: E731  # a cell's first place, in whole numbers
    cells = intervals.where(F.col(end) > F.col(start)).withColumn("_cell", F.explode(F.sequence(at(F.col(start)), at(F.col(end) - 1), F.lit(width).cast("bigint"))))
    return points.withColumn("_cell", at(F.col(pos))).join(cells, [*by, "_cell"]).where((F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))).drop("_cell")


def steps_in(intervals: DataFrame, start: str, end: str, step: int, name: str, block: int = 100_000) -> DataFrame:
    """A row for each multiple of step, from 0, that each interval holds (start <= multiple < end): what a
    join with a grid of these gives, without the grid. In blocks of so many multiples, as one array of all
    those of a long interval needn't fit in memory."""
    whole = lambda v: F.lit(v).cast("bigint")
    low = F.greatest(F.col(start).cast("bigint"), whole(0))
    first = low + F.pmod(-low, whole(step))
    held = intervals.where(F.col(end) > first).withColumn("_from", F.explode(F.sequence(first, F.col(end).cast("bigint") - 1, whole(step * block))))
    return held.withColumn(name, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + whole(step * (block - 1)), F.col(end).cast("bigint") - 1), whole(step)))).drop("_from")
