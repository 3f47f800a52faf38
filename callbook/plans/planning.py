"""What to fetch next: symbols, price refresh, history gaps, months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callbook.functions.dates import months_between
from callbook.plans.filters import coverage_filter
from callbook.plans.study import BENCHMARK

# Fixed values.
LEAD_DAYS, SLACK_DAYS = 400, 7
FOREIGN_SUFFIX = ".TO"


def symbol_candidates(tickers: DataFrame) -> DataFrame:
    """(ticker, symbol, priority): the price symbols to try for each ticker."""
    base = F.replace("ticker", F.lit("."), F.lit("-"))
    return tickers.select("ticker", F.posexplode(
        F.array(base, F.concat(base, F.lit(FOREIGN_SUFFIX)))).alias("priority", "symbol"))


def resolve_symbols(tickers: DataFrame, priced: DataFrame) -> DataFrame:
    """Fill price_symbol and price_failed from the symbols that have data.

    A known symbol or an earlier failure is kept; otherwise the first candidate
    with data wins and none marks the ticker as failed.
    """
    open_ = tickers.filter(F.coalesce("price_symbol", F.lit("")) == "").filter(
        ~F.coalesce("price_failed", F.lit(False))).select("ticker")
    hits = (symbol_candidates(open_).join(priced.select("symbol").distinct(), "symbol")
            .groupBy("ticker").agg(F.min_by("symbol", "priority").alias("_found")))
    resolved = tickers.join(hits, "ticker", "left")
    known = F.coalesce("price_symbol", F.lit("")) != ""
    failed = F.coalesce("price_failed", F.lit(False))
    return (
        resolved.withColumn("price_failed", failed | (~known & F.col("_found").isNull()))
        .withColumn("price_symbol", F.when(known, F.col("price_symbol")).otherwise(F.col("_found")))
        .select(*tickers.columns)
    )


def symbol_of(wanted: DataFrame, tickers: DataFrame) -> DataFrame:
    """Price symbol of each wanted ticker, NULL when unknown."""
    known = tickers.select("ticker", F.nullif("price_symbol", F.lit("")).alias("price_symbol"))
    return wanted.join(known, "ticker", "left")


def refresh_list(coverage: DataFrame, min_articles: int = 1) -> DataFrame:
    """Tickers with enough coverage rows, most covered first."""
    return (coverage.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_articles).orderBy(F.desc("n"), "ticker"))


def refresh_plan(coverage: DataFrame, tickers: DataFrame, prices: DataFrame,
                 min_articles: int = 1, only_missing: bool = False,
                 benchmark: str = BENCHMARK) -> DataFrame:
    """(ticker, symbol, n) to refresh: the benchmark, then tickers by their coverage (Q12).

    ``only_missing`` leaves out tickers whose symbol is stored already. Tickers
    without a resolved symbol are listed with symbol NULL: they would fail.
    """
    wanted = refresh_list(coverage, min_articles)
    plan = symbol_of(wanted, tickers).withColumnRenamed("price_symbol", "symbol")
    if only_missing:
        plan = plan.join(prices.select("symbol").distinct(), "symbol", "left_anti")
    head = coverage.sparkSession.range(1).select(
        F.lit(benchmark).alias("ticker"), F.lit(benchmark).alias("symbol"),
        F.lit(None).cast("bigint").alias("n"))
    return head.unionByName(plan.select("ticker", "symbol", "n")).orderBy(
        F.desc_nulls_first("n"), "ticker")


def first_calls(coverage: DataFrame, tickers: DataFrame) -> DataFrame:
    """First day, count and history marker of each verified primary ticker."""
    firsts = coverage_filter(coverage, primary_only=True, verified_only=True).groupBy(
        "ticker").agg(F.min("published_day").alias("first_day"), F.count(F.lit(1)).alias("n"))
    markers = tickers.select("ticker", "price_symbol", "history_from")
    return firsts.join(markers, "ticker", "left").orderBy(F.desc("n"), "ticker")


def earliest_prices(prices: DataFrame) -> DataFrame:
    """First stored day of every symbol."""
    return prices.groupBy("symbol").agg(F.min("date").alias("earliest"))


def history_plan(coverage: DataFrame, tickers: DataFrame, prices: DataFrame,
                 lead_days: int = LEAD_DAYS, benchmark: str = BENCHMARK) -> DataFrame:
    """(ticker, symbol, need, n, action) per verified primary ticker and the benchmark (Q11).

    ``need`` is how far back history must reach. Actions: ``asked`` (the marker
    says it was fetched), ``satisfied`` (stored closes reach back, set the
    marker), ``no_symbol``, ``fetch``.
    """
    need = F.date_sub("first_day", lead_days)
    reaches = F.col("earliest") <= F.date_add("need", SLACK_DAYS)
    earliest = earliest_prices(prices)
    firsts = first_calls(coverage, tickers).withColumn("need", need).withColumnRenamed(
        "price_symbol", "symbol")
    action = (
        F.when(F.col("history_from") <= F.col("need"), "asked")
        .when(F.col("symbol").isNull(), "no_symbol")
        .when(reaches, "satisfied").otherwise("fetch"))
    rows = firsts.join(earliest, "symbol", "left").select(
        "ticker", "symbol", "need", "n", action.alias("action"))
    bench = (
        firsts.agg(F.min("need").alias("need")).filter(F.col("need").isNotNull())
        .withColumn("symbol", F.lit(benchmark)).join(earliest, "symbol", "left")
        .select(F.lit(benchmark).alias("ticker"), "symbol", "need",
                F.lit(None).cast("bigint").alias("n"),
                F.when(reaches, "satisfied").otherwise("fetch").alias("action")))
    return bench.unionByName(rows)


def history_todo(plan: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows to fetch: the benchmark first, then the most covered tickers."""
    todo = plan.filter(F.col("action") == "fetch").orderBy(F.desc_nulls_first("n"), "ticker")
    return todo if limit is None else todo.limit(limit)


def history_marks(plan: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    """(ticker, need) markers to set without fetching."""
    return plan.filter((F.col("action") == "satisfied") & (F.col("ticker") != benchmark)).select(
        "ticker", "need")


def month_plan(spark: SparkSession, start: Column, end: Column, enumerated: DataFrame,
               refresh: bool = False) -> DataFrame:
    """Months wanted and not enumerated yet, all of them on refresh (Q15)."""
    wanted = months_between(spark, start, end)
    if not refresh:
        wanted = wanted.join(enumerated.select("month"), "month", "left_anti")
    return wanted.orderBy("month")


def pending_queue(frontier: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending paths, newest first."""
    queue = frontier.filter(F.col("state") == "pending").select("path", "published_day").orderBy(
        F.desc("published_day"), "path")
    return queue if limit is None else queue.limit(limit)
