"""Call outcomes: what the stock and the benchmark did after each call (Q3, Q5, Q9)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callbook.functions.stance import stance_bucket
from callbook.functions.stats import direction
from callbook.functions.text import path_month
from callbook.operators.merge import upsert_replace
from callbook.operators.sessions import (
    MAX_ENTRY_GAP_DAYS,
    dated_legs,
    guarded_entries,
    first_session,
    latest_close,
    next_session,
)
from callbook.plans.filters import coverage_filter
from callbook.plans.study import BENCHMARK
from callbook.session import settle
from callbook.sources import discovery
from callbook.sources.tables import (
    append,
    drop_partitions,
    partitions,
    read_table,
    rewrite,
    touched,
)

# Holding periods in trading sessions.
TRACK_HORIZONS = {"1m": 21, "3m": 63, "6m": 126, "12m": 252}
LONGEST = max(TRACK_HORIZONS.values())

KEYS = ["path", "ticker"]


def open_calls(coverage: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Verified primary (path, ticker) rows still to be scored.

    With ``stored`` outcomes, only new rows and rows whose 12-month legs are
    not both closed: closed ones can never change.
    """
    calls = coverage_filter(coverage, primary_only=True, verified_only=True).select(
        "path", "ticker", "published_day")
    if stored is None:
        return calls
    closed = stored.filter(F.col(f"ret_{LONGEST}").isNotNull()
                           & F.col(f"bench_{LONGEST}").isNotNull())
    return calls.join(closed.select(*KEYS), KEYS, "left_anti")


def compute_outcomes(coverage: DataFrame, tickers: DataFrame, prices: DataFrame,
                     stored: DataFrame | None = None, benchmark: str = BENCHMARK) -> DataFrame:
    """Outcome rows to write: entry, and stock and benchmark return per horizon.

    Calls without a usable price keep NULLs instead of disappearing; tickers
    without a price symbol are no calls. Nothing is computed while no benchmark
    close is stored. Entries and legs are found once per (ticker, day). With
    ``stored`` outcomes the open calls are settled first, and only the closes
    that these need are read.
    """
    symbols = _symbols(tickers)
    calls = open_calls(coverage, stored)
    days = calls.select("ticker", "published_day").distinct().join(symbols, "ticker")
    if stored is None:
        return _scored(calls, days, prices, prices, benchmark)
    calls = settle(calls.join(symbols, "ticker"))
    days = calls.select("ticker", "published_day", "symbol").distinct()
    return _scored(calls.drop("symbol"), days, prices, needed_prices(prices, days, benchmark), benchmark)


def _symbols(tickers: DataFrame) -> DataFrame:
    return tickers.filter(F.col("price_symbol").isNotNull()).select(
        "ticker", F.col("price_symbol").alias("symbol"))


RETURNS = [f"{leg}_{h}" for h in TRACK_HORIZONS.values() for leg in ("ret", "bench")]


def _scored(calls: DataFrame, days: DataFrame, prices: DataFrame, needed: DataFrame,
            benchmark: str, *more: str) -> DataFrame:
    """Outcome rows of calls whose days have a symbol. ``more`` may name ``ahead``, the sessions of
    the symbol after the entry, and ``last_date``, its last session."""
    legs = dated_legs(needed, benchmark, forward=TRACK_HORIZONS.values())
    if more:
        series = Window.partitionBy("symbol")
        legs = legs.withColumn("ahead", F.max("idx").over(series) - F.col("idx")).withColumn(
            "last_date", F.max("date").over(series))
    scored = calls.join(guarded_entries(days, legs.drop("idx")), ["ticker", "published_day"])
    return scored.filter(first_session(prices, benchmark).isNotNull()).select(
        "path", "ticker", "published_day", "entry_date", "entry_close", *RETURNS, *more)


def needed_prices(prices: DataFrame, days: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    """Closes of the symbols of ``days`` and the benchmark, from the earliest day on.

    Entries and legs only look forward, so they are the same as among all closes.
    Where prices have their month, only months from that day on are read.
    """
    first = days.agg(F.min("published_day")).scalar()
    since = prices.filter(F.col("date") >= first)
    if "month" in prices.columns:
        since = since.filter(F.col("month") >= F.date_format(first, "yyyy-MM"))
    bench = prices.sparkSession.range(1).select(F.lit(benchmark).alias("symbol"))
    return since.join(days.select("symbol").union(bench).distinct(), "symbol", "left_semi")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """(computed, scored) of a run: rows, and rows with a usable entry."""
    return outcomes.agg(F.count(F.lit(1)).alias("computed"),
                        F.count("entry_date").alias("scored"))


def merge_outcomes(stored: DataFrame, computed: DataFrame) -> DataFrame:
    return upsert_replace(stored, computed, KEYS)


def _due(day: Column) -> Column:
    """The day from which a call may have a leg that is open now, ``day`` at least.

    A series has at most one session a day, so the first open horizon takes at least as many
    days after its last one as it lacks sessions. A call without an entry, or whose
    benchmark lags behind, is due at once.
    """
    first_open = F.coalesce(*[
        F.when(F.col(f"ret_{h}").isNull(), F.lit(h)).when(F.col(f"bench_{h}").isNull(), F.lit(0))
        for h in TRACK_HORIZONS.values()])
    return F.greatest(day, F.date_add("last_date", (first_open - F.col("ahead")).cast("int")))


def schedule(calls: DataFrame, scored: DataFrame, day: Column) -> DataFrame:
    """(path, ticker, published_day, due, due_month) of the calls that are still open after a run.

    ``scored`` has ``ahead`` and ``last_date``; calls that are not among its rows wait for a
    symbol or for a benchmark.
    """
    closed = F.col(f"ret_{LONGEST}").isNotNull() & F.col(f"bench_{LONGEST}").isNotNull()
    due = F.coalesce(_due(day), day, F.lit("1970-01-01").cast("date"))
    return (calls.join(scored.select(*KEYS, *RETURNS, "ahead", "last_date"), KEYS, "left")
            .filter(~closed).select(*KEYS, "published_day", due.alias("due"))
            .withColumn("due_month", F.date_format("due", "yyyy-MM")))


def _last_price_day(spark: SparkSession, root: str) -> date | None:
    months = partitions(spark, root, "prices")
    if not months:
        return None
    prices = read_table(spark, root, "prices").filter(F.col("month") == months[-1])
    return prices.agg(F.max("date")).first()[0]


def _reschedule(spark: SparkSession, root: str, still: DataFrame, today: date | None, full: bool) -> None:
    """Put open calls under their next due month and take out what was due.

    The new rows are written first. A job that dies before the old ones are gone scores them once
    more; one that dies in a full run leaves no index, and the next run makes it anew.
    """
    index = partitions(spark, root, "open_calls")
    if full or today is None:
        if full:
            drop_partitions(spark, root, "open_calls", index)
        append(still, root, "open_calls")
        return
    this = f"{today:%Y-%m}"
    append(still.filter(F.col("due_month") != this), root, "open_calls")
    waiting = read_table(spark, root, "open_calls").filter(
        (F.col("due_month") == this) & (F.col("due") > F.lit(today)))
    here = settle(waiting.unionByName(still.filter(F.col("due_month") == this).select(*waiting.columns)))
    if here.isEmpty():
        drop_partitions(spark, root, "open_calls", [this])
    else:
        rewrite(root, "open_calls", here)
    drop_partitions(spark, root, "open_calls", [m for m in index if m < this])


def update_outcomes(spark: SparkSession, root: str, *, full: bool = False,
                    benchmark: str = BENCHMARK) -> DataFrame:
    """Score new and maturing calls of the stored tables and write them back.

    Run after each price load. Returns the (computed, scored) row. What is open stands in an
    index by the month in which it falls due, so a run reads the coverage months that were written since
    the last run, the calls that are due, and the stored outcomes of the months of both. ``full`` scores
    everything anew; it repairs closes that changed inside a window and closes that were loaded late in
    the middle of a series.
    """
    today = _last_price_day(spark, root)
    coverage, stored = read_table(spark, root, "coverage"), read_table(spark, root, "call_outcomes")
    first = full or not partitions(spark, root, "open_calls")
    files = None
    if partitions(spark, root, "coverage"):
        files = discovery.new_files(spark, root, "coverage", f"{root}/coverage", "*.parquet")
    if first:
        calls = open_calls(coverage, None if full else stored)
    else:
        month = F.url_decode(F.regexp_extract("file", "/month=([^/]+)/", 1))
        months = [r[0] for r in files.select(month.alias("month")).distinct().collect()] if files is not None else []
        calls = open_calls(coverage.filter(F.col("month").isin(months)), stored.filter(F.col("month").isin(months)))
        if today is not None:
            due = read_table(spark, root, "open_calls").filter(
                (F.col("due_month") <= f"{today:%Y-%m}") & (F.col("due") <= F.lit(today)))
            calls = calls.unionByName(due.select(*calls.columns)).distinct()
    calls, prices = settle(calls), read_table(spark, root, "prices")
    days = settle(calls.select("ticker", "published_day").distinct().join(
        _symbols(read_table(spark, root, "tickers")), "ticker"))
    scored = settle(_scored(calls, days, prices, needed_prices(prices, days, benchmark), benchmark,
                            "ahead", "last_date"))
    rows = scored.drop("ahead", "last_date").withColumn("computed_ts", F.current_timestamp()).withColumn(
        "month", path_month(F.col("path")))
    rewrite(root, "call_outcomes", merge_outcomes(touched(stored, rows, "month"), rows))
    day = F.col("published_day") if today is None else F.lit(today)
    _reschedule(spark, root, settle(schedule(calls, scored, day)), today, full)
    if files is not None:
        discovery.note_files(spark, root, "coverage", files)
    return outcome_counts(rows)


def track_record(outcomes: DataFrame, articles: DataFrame) -> DataFrame:
    """Outcomes with today's stance: per horizon excess, call and hit.

    excess = stock - benchmark; call = excess signed by the call's direction;
    hit = call > 0. call and hit are NULL without a direction.
    """
    joined = outcomes.join(
        articles.select("path", "title", "author", "stance", "stance_score"), "path")
    side = direction(F.col("stance_score"))
    cols = []
    for label, h in TRACK_HORIZONS.items():
        excess = F.col(f"ret_{h}") - F.col(f"bench_{h}")
        cols += [excess.alias(f"excess_{label}"), (excess * side).alias(f"call_{label}"),
                 (excess * side > 0).alias(f"hit_{label}")]
    return joined.select("*", stance_bucket(F.col("stance")).alias("bucket"), *cols)


def returns_since(days: DataFrame, prices: DataFrame) -> DataFrame:
    """Percent return from the first close on or after each (symbol, day) to the
    latest one (Q9). NULL when that close is more than a week late, missing or
    zero, or when no later session exists.
    """
    entry = next_session(days, prices)
    rows = days.join(entry, ["symbol", "day"], "left").join(
        latest_close(prices), "symbol", "left")
    usable = (
        (F.datediff("entry_date", "day") <= MAX_ENTRY_GAP_DAYS)
        & (F.col("entry_close") != 0) & (F.col("last_date") > F.col("entry_date")))
    base = F.col("entry_close")
    return rows.withColumn(
        "pct_return", F.when(usable, (F.col("last_close") - base) / base * 100.0))
