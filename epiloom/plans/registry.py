"""The register of queries: name -> callable of (spark, sf_dir), and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def fixed(c: Column, digits: int = 6) -> Column:
    """A double cut to ``digits`` decimals by the same IEEE operations in any engine; see sql_fixed."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def sql_fixed(x: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


def whole(c: Column, scale: float) -> Column:
    """c times ``scale``, as a whole number whose sums don't depend on their order; see sql_whole."""
    return F.floor(c * F.lit(float(scale)) + F.lit(0.5)).cast("decimal(38,0)")


def sql_whole(x: str, scale: float) -> str:
    return f"CAST(floor(({x}) * {float(scale)} + 0.5) AS BIGINT)"
