"""Registry of named queries: each takes (spark, sf_dir) and may name the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """Spark 4.1 may zip the partitions of a union's sides that adaptive execution has coalesced to different
    numbers, and fail; without this setting a union only appends them."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = wraps(f)(lambda spark, sf_dir: f(prepared(spark), sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
