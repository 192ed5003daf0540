"""Collects the named queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} exists already")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, so that both engines can be compared by value."""
    names = [f.name for f in df.schema if f.dataType.typeName() == "double" and f.name not in skip]
    return df.withColumns({n: F.round(F.col(n), digits) for n in names}) if names else df


def r6(c: Column) -> Column:
    return F.round(c, 6)
