"""Date functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_text(day: Column) -> Column:
    return F.date_format(day, "yyyy/MM")


def month_start(text: Column) -> Column:
    """First day of a ``YYYY/MM`` month."""
    return F.to_date(F.concat(text, F.lit("/01")), "yyyy/MM/dd")


def months_between(spark: SparkSession, start: Column, end: Column) -> DataFrame:
    """Every ``YYYY/MM`` from start to end, both included; empty when reversed."""
    first, last = month_start(start), month_start(end)
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))
    return spark.range(1).select(F.explode(months).alias("d")).select(
        month_text(F.col("d")).alias("month"))


def months_back(n: Column | int, today: Column | None = None) -> tuple[Column, Column]:
    """(start, end) of the n-month range that ends in this month."""
    today = F.current_date() if today is None else today
    n = F.lit(n) if isinstance(n, int) else n
    this_month = F.trunc(today, "MM")
    return month_text(F.add_months(this_month, -(n - 1))), month_text(this_month)


def utc_now() -> Column:
    return F.current_timestamp()


def local_day(ts: Column, zone: str) -> Column:
    """Calendar day of an instant in a time zone (session time zone: UTC)."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def today_local(zone: str) -> Column:
    return local_day(utc_now(), zone)


def week_ending_monday(day: Column) -> Column:
    """The Monday on or after a day."""
    return F.next_day(F.date_sub(day, 1), "MON")


def quarter_start(day: Column) -> Column:
    return F.trunc(day, "quarter")
