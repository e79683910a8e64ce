"""Query registration: a function of (spark, sf_dir), and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to a number of places, so that the order of summing shows in no result."""
    pick = lambda c, t: F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c)
    return df.select(*[pick(c, t) for c, t in df.dtypes])


def long(c: Column) -> Column:
    return c.cast("long")
