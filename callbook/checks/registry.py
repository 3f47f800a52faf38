"""Name -> (query, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callbook.checks.domain import Domain
from callbook.checks.prelude import PRELUDE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a function of a Domain. ``sql`` follows the prelude's CTEs; it may
    start with a comma to add more of them."""
    def register(fn: Callable[[Domain], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Domain(spark, folder))
        if sql is not None:
            ORACLES[name] = PRELUDE + sql
        return fn
    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round computed doubles to six decimals before they are compared."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def significant(df: DataFrame, *columns: str) -> DataFrame:
    """Nine significant digits, for values that grow without a bound."""
    return df.withColumns({
        c: F.format_string("%.8e", F.col(c)).cast("double") for c in columns})
