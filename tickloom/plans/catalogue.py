"""The registry of queries: a name, a function of (spark, sf_dir) and the SQL of the same rows, if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def r6(**columns: Column | str) -> list[Column]:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """All double columns to 6 places; with names, only those columns."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c)) for c in (keep or df.columns)))
