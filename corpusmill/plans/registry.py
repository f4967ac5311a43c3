"""How plan modules name their queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import QUERIES, SQL


def query(sql: str | None):
    """Register a function (spark, sf_dir) under its name, with DuckDB SQL that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")
