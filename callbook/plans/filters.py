"""Composable predicates (P1-P4, P7) and small reports on coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage_filter(df: DataFrame, *, primary_only: bool = False,
                    verified_only: bool = False) -> DataFrame:
    if primary_only:
        df = df.filter("is_primary")
    if verified_only:
        df = df.filter("verified")
    return df


def in_days(df: DataFrame, start=None, end=None, day: str = "published_day") -> DataFrame:
    """Days from start to end, both included; None leaves that side open.

    Where the rows have their month, the same range of months prunes partitions.
    """
    for bound, inside in ((start, Column.__ge__), (end, Column.__le__)):
        if bound is None:
            continue
        limit = F.lit(bound).cast("date")
        df = df.filter(inside(F.col(day), limit))
        if "month" in df.columns:
            df = df.filter(inside(F.col("month"), F.date_format(limit, "yyyy-MM")))
    return df


def directional(score: str = "stance_score") -> Column:
    return F.col(score) != 0


def bullish(score: str = "stance_score") -> Column:
    return F.col(score) > 0


def bearish(score: str = "stance_score") -> Column:
    return F.col(score) < 0


def select_calls(df: DataFrame, direction: str = "All", author: str | None = None) -> DataFrame:
    """Directional rows of one side ("All", "Bullish", "Bearish") and author."""
    calls = df.filter(directional())
    if author is not None:
        calls = calls.filter(F.col("author") == author)
    if direction == "Bullish":
        calls = calls.filter(bullish())
    elif direction == "Bearish":
        calls = calls.filter(bearish())
    return calls
