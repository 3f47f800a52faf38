"""Coverage timeline: first coverage, ramp and the price path around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbook.functions.stance import order_key
from callbook.operators.ordering import day_totals
from callbook.operators.quantiles import value_stats
from callbook.operators.sessions import dated_legs, guarded_entries, first_session
from callbook.plans.filters import coverage_filter
from callbook.plans.study import BENCHMARK

# Calendar months as trading sessions.
MONTH_WINDOWS = {"1m": 21, "3m": 63, "12m": 252}


def _ramp(cov: DataFrame) -> DataFrame:
    """Per ticker: first and latest day, totals, ramp counts, day of the 2nd article."""
    day, first = F.col("published_day"), F.col("first_day")

    def within(days: int) -> Column:
        return F.sum(F.when(day <= F.date_add(first, days), F.col("n")).otherwise(0))

    second = F.min(F.when(F.col("before") + F.col("n") >= 2, day))
    return day_totals(cov, "ticker", "published_day").groupBy("ticker").agg(
        F.min(day).alias("first_covered"), F.sum("n").alias("articles"),
        within(30).alias("articles_30d"), within(90).alias("articles_90d"),
        F.datediff(second, F.min(day)).alias("days_to_2nd"),
        F.max(day).alias("latest_article"))


def coverage_timeline(coverage: DataFrame, tickers: DataFrame, prices: DataFrame, *,
                      primary_only: bool = True, market_adjusted: bool = True,
                      censor_days: int = 45, min_articles: int = 1,
                      benchmark: str = BENCHMARK) -> DataFrame:
    """One row per covered ticker, newest first coverage first.

    Returns are market-adjusted over the same dates; without any benchmark
    close they fall back to raw ones.
    """
    cov = coverage_filter(coverage, primary_only=primary_only, verified_only=True)
    start = cov.agg(F.min("published_day")).scalar()
    names = tickers.select("ticker", "name", F.col("price_symbol").alias("symbol"))
    firsts = _ramp(cov).filter(F.col("articles") >= min_articles).join(names, "ticker", "left")

    sessions = MONTH_WINDOWS.values()
    legs = dated_legs(prices, benchmark, forward=sessions, backward=sessions, to_last=True)
    rows = guarded_entries(firsts, legs, day="first_covered")
    adjust = F.lit(market_adjusted) & first_session(prices, benchmark).isNotNull()

    def leg(stock: str, bench: str) -> Column:
        return F.when(adjust, F.col(stock) - F.col(bench)).otherwise(F.col(stock))

    return rows.filter(first_session(prices).isNotNull()).select(
        "ticker", "name", "first_covered", "articles",
        (F.col("first_covered") <= F.date_add(start, censor_days)).alias("censored"),
        "articles_30d", "articles_90d", "days_to_2nd", "latest_article",
        *[leg(f"back_{s}", f"bback_{s}").alias(f"before_{m}") for m, s in MONTH_WINDOWS.items()],
        *[leg(f"ret_{s}", f"bench_{s}").alias(f"after_{m}") for m, s in MONTH_WINDOWS.items()],
        leg("ret_last", "bench_last").alias("since_first"),
    ).orderBy(F.desc("first_covered"), "ticker")


def timeline_notes(timeline: DataFrame, prices: DataFrame | None = None,
                   benchmark: str = BENCHMARK) -> DataFrame:
    """(code, count, text): companies at the edge of the data, and, given the prices,
    companies whose returns are raw because no benchmark close is stored."""
    missing = F.lit(False) if prices is None else first_session(prices, benchmark).isNull()
    cells = {
        "censored": (F.col("censored"), "companies first seen at the edge of the data"),
        "raw": (F.when(F.col("missing"), F.col("companies")).otherwise(0),
                "companies shown with raw returns: there is no benchmark"),
    }
    return timeline.agg(
        F.count_if("censored").alias("censored"), F.count(F.lit(1)).alias("companies")
    ).withColumn("missing", missing).select(F.inline(F.array(*[
        F.struct(F.lit(code).alias("code"), n.cast("bigint").alias("count"),
                 F.lit(text).alias("text")) for code, (n, text) in cells.items()]))
    ).filter(F.col("count") > 0)


def before_after(timeline: DataFrame) -> DataFrame:
    """Median return before and after first coverage per window."""
    cells = F.array(*[
        F.struct(F.lit(m).alias("window"), F.lit(phase).alias("phase"),
                 F.col(f"{phase}_{m}").alias("value"))
        for m in MONTH_WINDOWS for phase in ("before", "after")])
    stats = value_stats(timeline.select(F.inline(cells)), ["window", "phase"], few_keys=True)
    return stats.select("window", "phase", "n", "median").orderBy(
        order_key(F.col("window"), list(MONTH_WINDOWS)), F.desc("phase"))


def coverage_reading(timeline: DataFrame) -> DataFrame:
    """One row: does coverage follow the move or lead it (Q16)?"""
    cells = F.array(*[
        F.struct(F.lit(c).alias("what"), F.col(c).cast("double").alias("value"))
        for c in ("articles_30d", "before_12m", "after_12m")])
    stats = value_stats(timeline.select(F.inline(cells)), ["what"], few_keys=True)

    def median(what: str) -> Column:
        return F.max(F.when(F.col("what") == what, F.col("median"))).alias(what)

    before, after = F.col("before_12m"), F.col("after_12m")
    # Every company has a first 30 days, so their number is that sample's size.
    companies = F.max(F.when(F.col("what") == "articles_30d", F.col("n"))).alias("companies")
    return stats.agg(companies, median("articles_30d"), median("before_12m"),
                     median("after_12m")).select(
        F.coalesce("companies", F.lit(0)).alias("companies"),
        F.col("articles_30d").alias("median_articles_30d"),
        before.alias("median_before_12m"), after.alias("median_after_12m"),
        F.when((before > 5) & (before > after), "follows the move")
        .when(after > before, "suggestive").alias("reading"))
