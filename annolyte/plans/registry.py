"""All queries outside the corpus operators, with the SQL that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

FLAGSHIP = "hybrid_summary"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: adds a query, and its oracle where SQL can express it."""

    def add(f):
        @functools.wraps(f)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = shipped
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    """Registers the queries of all plan modules."""
    from . import assembly, evaluation, filters, io_queries, matching, records_queries, sessions, smoke, tracking, validation, video_queries  # noqa: F401



