"""Dense time buckets whose width follows the span (A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callbook.functions.dates import week_ending_monday

# Longest span, in days, shown by day and by week.
DAY_SPAN, WEEK_SPAN = 45, 400


def bucket_by_time(daily: DataFrame, day: str = "day", keys: tuple[str, ...] = ()) -> DataFrame:
    """Roll (keys, day, articles, net_stance) up to days, weeks or months.

    Up to 45 days: days. Up to 400: weeks, named by the Monday they end on.
    Longer: months. Empty periods between the first and the last covered one
    become zeros, outer ones are dropped. ``daily`` holds one row per key and
    day, so its windows are bounded by the calendar.
    """
    per_key = Window.partitionBy(*keys)
    span = F.datediff(F.max(day).over(per_key), F.min(day).over(per_key))
    unit = F.when(span <= DAY_SPAN, "Day").when(span <= WEEK_SPAN, "Week").otherwise("Month")
    period = (F.when(F.col("unit") == "Day", F.col(day))
              .when(F.col("unit") == "Week", week_ending_monday(F.col(day)))
              .otherwise(F.trunc(day, "MM")))
    rolled = (
        daily.withColumn("unit", unit).withColumn("period", period)
        .groupBy(*keys, "unit", "period")
        .agg(F.sum("articles").alias("articles"),
             F.coalesce(F.sum("net_stance"), F.lit(0)).alias("net_stance"))
        .filter(F.col("articles") > 0)
    )
    # Each period also emits the empty ones up to the next covered period.
    following = F.lead("period").over(per_key.orderBy("period"))

    def through(step: str):
        step_ = F.expr(f"interval {step}")
        end = F.greatest(F.col("period"), (F.col("next") - step_).cast("date"))
        return F.sequence(F.col("period"), end, step_)

    filled = (F.when(F.col("unit") == "Day", through("1 day"))
              .when(F.col("unit") == "Week", through("7 day"))
              .otherwise(through("1 month")))
    return (
        rolled.withColumn("next", following)
        .select(*keys, "unit", "articles", "net_stance", F.posexplode(filled).alias("i", "period"))
        .select(*keys, "unit", "period",
                F.when(F.col("i") == 0, F.col("articles")).otherwise(0).alias("articles"),
                F.when(F.col("i") == 0, F.col("net_stance")).otherwise(0).alias("net_stance"))
    )
