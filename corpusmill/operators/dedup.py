"""Exact copies: first occurrence, census, lines, groups and decisions over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(df: DataFrame, key: Sequence[str], *order: str) -> DataFrame:
    """One row of each key: the first in `order` (total, so that the result is defined). Null keys
    are a key of their own. By min over a struct, which is combined before the shuffle: a key that a
    third of all rows have costs one row a task."""
    rest = [c for c in df.columns if c not in order]
    row = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key))).agg(row).select("_row.*").select(*df.columns)


def marked(df: DataFrame, key: Sequence[str], id: str) -> DataFrame:
    """Every row with the smallest id of its key (duplicate_of, null for that row itself) and the
    number of its copies. Rows of null keys are left out."""
    low = df.groupBy(*key).agg(F.min(id).alias("_low"), F.count("*").alias("copies"))
    return df.join(low, list(key)).withColumn("duplicate_of", F.when(F.col("_low") < F.col(id), F.col("_low"))).drop("_low")


def census(df: DataFrame, key: str, shard: str, profiles: dict[str, Column]) -> DataFrame:
    """Per profile: documents, unique contents, extra copies, contents that occur once, contents in
    several shards, and the most copies of one. Two levels: by content, then over contents."""
    tagged = df.select(key, shard, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in profiles.items())))).alias("profile"))
    by_shard = tagged.where(F.col(key).isNotNull()).groupBy("profile", key, shard).count()
    contents = by_shard.groupBy("profile", key).agg(F.sum("count").alias("n"), F.count("*").alias("shards"))
    return contents.groupBy("profile").agg(
        F.sum("n").alias("documents"),
        F.count("*").alias("unique_contents"),
        F.sum(F.col("n") - 1).alias("extra_copies"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        F.count_if(F.col("shards") > 1).alias("cross_shard"),
        F.max("n").alias("most_copies"),
        F.round(100.0 * F.count("*") / F.sum("n"), 6).alias("unique_percent"),
    )


def copy_histogram(df: DataFrame, key: str) -> DataFrame:
    """(copies, contents): how many contents have each number of copies. Null keys are left out."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("contents"))


def unique_lines(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, lines, kept, text) with each line kept where it first occurs in its document."""
    lines = F.split(text, "\n")
    first = F.array_distinct(lines)
    return df.where(F.col(text).isNotNull()).select(id, F.size(lines).alias("lines"), F.size(first).alias("kept"), F.array_join(first, "\n").alias("text"))


def decisions(members: DataFrame, reasons: DataFrame, node: str = "node", group: str = "component", limit: int = 100) -> DataFrame:
    """(node, component, reasons, eligible): each member inherits the reasons of its whole group; a
    group of more than `limit` members needs review; members other than the representative (the
    smallest) say so. members: one row each; reasons: (node, reason), any number of rows.

    Reasons are few and collected as a set; members are never gathered."""
    of = members.join(reasons, node, "left")
    groups = of.groupBy(group).agg(F.array_sort(F.collect_set("reason")).alias("_r"), F.countDistinct(node).alias("_n"))
    all_reasons = F.array_compact(F.concat("_r", F.array(F.when(F.col("_n") > limit, F.lit("large_content_group_requires_review")), F.when(F.col(node) != F.col(group), F.lit("content_group_nonrepresentative")))))
    return members.join(groups, group).select(node, group, all_reasons.alias("reasons")).withColumn("eligible", F.size("reasons") == 0)

