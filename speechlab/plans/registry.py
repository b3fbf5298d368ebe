"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from speechlab.plans.fixtures import duck, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None, *names: str):
    """Register a function of the named tables' DataFrames; a derived table that several of them stand on is stored."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(*tables(spark, sf_dir, names))
        if sql is not None:
            SQL[name] = duck(sql)
        return f

    return put
