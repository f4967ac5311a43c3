"""Named queries of the core and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

from corpusmill.plans import filters, matching, metrics, splits, streams, texts, trees  # noqa: E402, F401
