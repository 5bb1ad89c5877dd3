"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from folionaut.llm.session import prepare

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name."""

    def register(function):
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, whole."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
