"""Keyed merges, upkeep and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from callbook.checks.registry import check
from callbook.functions.dates import months_back, months_between
from callbook.operators import merge as M
from callbook.plans import planning as P
from callbook.plans import upkeep as U
from callbook.schemas import TICKERS

# --- K1-K4 ------------------------------------------------------------------------
_REPRICED = """
, repriced AS (
 SELECT symbol, date, max(close) + 1 AS close, CAST(0 AS BIGINT) AS volume FROM prices
 WHERE volume > 40 GROUP BY ALL)"""


@check("upsert_prices", _REPRICED + """
SELECT p.symbol, p.date, CASE WHEN r.symbol IS NULL THEN p.close ELSE r.close END AS close,
  CASE WHEN r.symbol IS NULL THEN p.volume ELSE r.volume END AS volume
FROM prices p LEFT JOIN repriced r ON r.symbol = p.symbol AND r.date = p.date""")
def upsert_prices(d):
    new = d.prices.filter(F.col("volume") > 40).groupBy("symbol", "date").agg(
        (F.max("close") + 1).alias("close"), F.lit(0).cast("bigint").alias("volume"))
    return M.upsert_replace(d.prices, new, ["symbol", "date"])


@check("last_row_wins", """
SELECT symbol, max(date) AS date, arg_max_null(close, date) AS close,
  arg_max(volume, date) AS volume FROM prices GROUP BY symbol""")
def last_row_wins(d):
    return M.last_per_key(d.prices.withColumn("seq", F.col("date")), ["symbol"], "seq").drop("seq")


@check("first_seen_upsert", """
, seen AS (SELECT ticker, min(published_day) AS d FROM coverage GROUP BY ticker)
SELECT coalesce(t.ticker, s.ticker) AS ticker, least(t.first_seen_day, s.d) AS first_seen_day
FROM tickers t FULL JOIN seen s ON s.ticker = t.ticker""")
def first_seen_upsert(d):
    return M.upsert_first_seen(d.tickers, d.coverage).select("ticker", "first_seen_day")


@check("coverage_cascade", """
, again AS (SELECT path, min(ticker) AS ticker, max(published_day) AS published_day FROM coverage
 WHERE is_primary GROUP BY path)
SELECT ticker, path, published_day, is_primary, source FROM coverage
WHERE path NOT IN (SELECT path FROM articles WHERE stance = 'buy')
UNION ALL
SELECT a.ticker, a.path, a.published_day, TRUE, 'primary_meta' FROM again a
WHERE a.path IN (SELECT path FROM articles WHERE stance = 'buy')""")
def coverage_cascade(d):
    stored = d.coverage.drop("verified")
    restored = d.articles.filter(F.col("stance") == "buy")
    new = stored.filter("is_primary").groupBy("path").agg(
        F.min("ticker").alias("ticker"), F.max("published_day").alias("published_day"),
        F.lit(True).alias("is_primary"), F.lit("primary_meta").alias("source"))
    return M.replace_coverage(stored, new.join(restored.select("path"), "path", "left_semi"),
                              restored)


# --- K6-K8, K10, K12 -----------------------------------------------------------------
@check("frontier_results", """
, results AS (
 SELECT path, CASE priority WHEN '1-URGENT' THEN 'gone' WHEN '2-HIGH' THEN 'failed'
   WHEN '3-MEDIUM' THEN 'deferred' WHEN '4-NOT SPECIFIED' THEN 'throttled' ELSE 'ok' END AS kind,
   repeat(priority || ' ', 40) AS message FROM headlines WHERE order_state = 'O')
SELECT f.path, CASE r.kind WHEN 'gone' THEN 'skipped' WHEN 'failed' THEN 'failed'
    WHEN 'ok' THEN 'done' ELSE f.state END AS state,
  CAST(f.attempts + CASE WHEN r.kind IN ('gone', 'failed', 'ok') THEN 1 ELSE 0 END AS INTEGER)
    AS attempts,
  CASE WHEN r.kind <> 'ok' THEN r.message END AS last_error
FROM frontier f LEFT JOIN results r ON r.path = f.path""")
def frontier_results(d):
    return M.apply_fetch_results(d.frontier, d.fetch_results).select(
        "path", "state", "attempts", "last_error")


@check("requeue_failed", """
SELECT path, CASE WHEN state = 'failed' AND attempts < 5 THEN 'pending' ELSE state END AS state
FROM frontier""")
def requeue_failed(d):
    return M.requeue_failed(d.frontier).select("path", "state")


@check("requeue_count",
       "SELECT count(*) FILTER (state = 'failed' AND attempts < 5) AS requeued FROM frontier")
def requeue_count(d):
    return M.requeue_count(d.frontier)


@check("names_backfill", """
SELECT t.ticker, coalesce(t.name, u.name) AS name
FROM tickers t LEFT JOIN universe u ON u.ticker = t.ticker""")
def names_backfill(d):
    return M.backfill_names(d.tickers, d.universe).select("ticker", "name")


@check("additive_migration", """
SELECT ticker, name, price_symbol, price_failed, first_seen_day,
  CAST(NULL AS DATE) AS history_from FROM tickers""")
def additive_migration(d):
    return M.to_schema(d.tickers.drop("history_from"), TICKERS)


# --- K9, A26, A30, D4 ------------------------------------------------------------------
_OLD = """
, stale AS (SELECT *, CASE WHEN section = 'retirement' THEN 'analysis'
   WHEN stance = 'buy_lean' THEN 'buy' ELSE stance END AS old FROM articles)"""


def _stale(d):
    old = (F.when(F.col("section") == "retirement", "analysis")
           .when(F.col("stance") == "buy_lean", "buy").otherwise(F.col("stance")))
    return d.articles.withColumn("stance", old)


@check("relabel_moves", _OLD + """
SELECT old || ' -> ' || stance AS move, count(*) AS n FROM stale
WHERE old <> stance GROUP BY 1 ORDER BY n DESC, move LIMIT 15""")
def relabel_moves(d):
    return U.relabel_moves(U.relabel(_stale(d)))


@check("relabel_apply", "SELECT path, stance, stance_score FROM articles")
def relabel_apply(d):
    return U.apply_relabel(U.relabel(_stale(d))).select("path", "stance", "stance_score")


@check("status", """
SELECT 'articles' AS metric, CAST(count(*) AS VARCHAR) AS value FROM articles
UNION ALL SELECT 'first_day', CAST(min(published_day) AS VARCHAR) FROM articles
UNION ALL SELECT 'last_day', CAST(max(published_day) AS VARCHAR) FROM articles
UNION ALL SELECT 'authors', CAST(count(DISTINCT author) AS VARCHAR) FROM articles
UNION ALL SELECT 'coverage_rows', CAST(count(*) AS VARCHAR) FROM coverage
UNION ALL SELECT 'tickers', CAST(count(DISTINCT ticker) AS VARCHAR) FROM coverage
UNION ALL SELECT 'primary_tickers', CAST(count(DISTINCT ticker) FILTER (is_primary) AS VARCHAR)
  FROM coverage
UNION ALL SELECT 'price_rows', CAST(count(*) AS VARCHAR) FROM prices
UNION ALL SELECT 'price_symbols', CAST(count(DISTINCT symbol) AS VARCHAR) FROM prices
UNION ALL SELECT 'universe', CAST(count(*) AS VARCHAR) FROM universe
UNION ALL SELECT 'months', CAST(count(DISTINCT strftime(published_day, '%Y/%m')) AS VARCHAR)
  FROM headlines
UNION ALL SELECT 'queue ' || state, CAST(count(*) AS VARCHAR) FROM frontier GROUP BY state
UNION ALL SELECT 'stance ' || stance, CAST(count(*) AS VARCHAR) FROM articles GROUP BY stance""")
def status(d):
    months = d.sitemap_pages.select("month").distinct()
    return U.status(d.articles, d.coverage, d.prices, d.universe, months, d.frontier)


_RUNS = """
, runs AS (SELECT CASE event_type WHEN 'view' THEN 'daily' WHEN 'click' THEN 'crawl'
   ELSE 'backfill' END AS kind, ts AS finished_ts FROM events)"""


@check("last_daily_day", _RUNS + """
SELECT CAST((max(finished_ts) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS day
FROM runs WHERE kind = 'daily'""")
def last_daily_day(d):
    return U.last_daily_day(d.runs, "America/New_York")


@check("freshness", _RUNS + """
SELECT CAST(max(finished_ts) AS DATE) AS last_run_day,
  epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(max(finished_ts))) <= 21600 AS fresh
FROM runs""")
def freshness(d):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return U.freshness(d.runs, now).select(F.to_date("last_run").alias("last_run_day"), "fresh")


# --- D1, D2, Q15 ---------------------------------------------------------------------
@check("month_plan", """
, bounds AS (SELECT min(published_day) AS a, max(published_day) AS b FROM headlines),
months AS (SELECT strftime(unnest(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP),
   CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)), '%Y/%m') AS month FROM bounds)
SELECT month FROM months WHERE month NOT IN (
 SELECT strftime(published_day, '%Y/%m') FROM headlines WHERE order_state = 'F'
 GROUP BY 1 HAVING count(*) >= 60)""")
def month_plan(d):
    bounds = d.headlines.agg(F.struct(
        F.date_format(F.min("published_day"), "yyyy/MM").alias("a"),
        F.date_format(F.max("published_day"), "yyyy/MM").alias("b"))).scalar()
    done = d.headlines.filter(F.col("order_state") == "F").groupBy(
        F.date_format("published_day", "yyyy/MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 60)
    return P.month_plan(d.spark, bounds["a"], bounds["b"], done)


@check("months_back", """
SELECT strftime(unnest(generate_series(
  CAST(date_trunc('month', b) - INTERVAL 35 MONTH AS TIMESTAMP), CAST(b AS TIMESTAMP),
  INTERVAL 1 MONTH)), '%Y/%m') AS month FROM (SELECT max(published_day) AS b FROM headlines)""")
def three_years_back(d):
    last = d.headlines.agg(F.max("published_day")).scalar()
    return months_between(d.spark, *months_back(36, last))


# --- F11, F12, A11-A13, Q11, Q12, T6 ----------------------------------------------------
@check("resolve_symbols", """
, priced AS (SELECT DISTINCT symbol FROM prices),
open AS (SELECT ticker, replace(ticker, '.', '-') AS b FROM tickers),
found AS (SELECT ticker, CASE WHEN b IN (SELECT symbol FROM priced) THEN b
  WHEN b || '.TO' IN (SELECT symbol FROM priced) THEN b || '.TO' END AS symbol FROM open)
SELECT t.ticker, CASE WHEN t.price_failed THEN NULL ELSE f.symbol END AS price_symbol,
  t.price_failed OR f.symbol IS NULL AS price_failed
FROM tickers t JOIN found f ON f.ticker = t.ticker""")
def resolve_symbols(d):
    fresh = d.tickers.withColumn("price_symbol", F.lit(None).cast("string"))
    return P.resolve_symbols(fresh, d.prices).select("ticker", "price_symbol", "price_failed")


@check("symbol_lookup", """
SELECT DISTINCT c.ticker, t.price_symbol FROM coverage c LEFT JOIN tickers t ON t.ticker = c.ticker""")
def symbol_lookup(d):
    return P.symbol_of(d.coverage.select("ticker").distinct(), d.tickers)


@check("refresh_list", """
SELECT ticker, count(*) AS n FROM coverage GROUP BY 1 HAVING count(*) >= 100""")
def refresh_list(d):
    return P.refresh_list(d.coverage, 100)


_WANTED = """
, wanted AS (SELECT c.ticker, t.price_symbol AS symbol, c.n FROM
  (SELECT ticker, count(*) AS n FROM coverage GROUP BY 1 HAVING count(*) >= 3) c
  LEFT JOIN tickers t ON t.ticker = c.ticker)
SELECT 'SPY' AS ticker, 'SPY' AS symbol, CAST(NULL AS BIGINT) AS n
UNION ALL SELECT ticker, symbol, n FROM wanted"""


@check("refresh_plan", _WANTED)
def refresh_plan(d):
    return P.refresh_plan(d.coverage, d.tickers, d.prices, min_articles=3)


@check("refresh_plan_missing", _WANTED + """
 WHERE symbol IS NULL OR symbol NOT IN (SELECT symbol FROM prices WHERE volume > 100)""")
def refresh_plan_missing(d):
    return P.refresh_plan(d.coverage, d.tickers, d.prices.filter(F.col("volume") > 100),
                          min_articles=3, only_missing=True)


_FIRSTS = """
, firsts AS (SELECT c.ticker, min(c.published_day) AS first_day, count(*) AS n,
   max(t.price_symbol) AS price_symbol, max(t.history_from) AS history_from
 FROM coverage c LEFT JOIN tickers t ON t.ticker = c.ticker
 WHERE c.is_primary AND c.verified GROUP BY c.ticker)"""


@check("first_calls", _FIRSTS + " SELECT * FROM firsts")
def first_calls(d):
    return P.first_calls(d.coverage, d.tickers)


@check("earliest_prices", "SELECT symbol, min(date) AS earliest FROM prices GROUP BY 1")
def earliest_prices(d):
    return P.earliest_prices(d.prices)


_PLAN = _FIRSTS + """
, earliest AS (SELECT symbol, min(date) AS e FROM prices GROUP BY 1),
plan AS (
 SELECT f.ticker, f.price_symbol AS symbol, f.first_day - 400 AS need, f.n,
  CASE WHEN f.history_from <= f.first_day - 400 THEN 'asked' WHEN f.price_symbol IS NULL
   THEN 'no_symbol' WHEN e.e <= f.first_day - 400 + 7 THEN 'satisfied' ELSE 'fetch' END AS action
 FROM firsts f LEFT JOIN earliest e ON e.symbol = f.price_symbol
 UNION ALL
 SELECT 'SPY', 'SPY', m.need, NULL, CASE WHEN e.e <= m.need + 7 THEN 'satisfied' ELSE 'fetch' END
 FROM (SELECT min(first_day) - 400 AS need FROM firsts) m
 LEFT JOIN earliest e ON e.symbol = 'SPY')"""


@check("history_plan", _PLAN + " SELECT * FROM plan")
def history_plan(d):
    return P.history_plan(d.coverage, d.tickers, d.prices)


@check("history_marks", _PLAN + """
SELECT t.ticker, coalesce(p.need, t.history_from) AS history_from FROM tickers t
LEFT JOIN plan p ON p.ticker = t.ticker AND p.action = 'fetch'""")
def history_marks(d):
    plan = P.history_plan(d.coverage, d.tickers, d.prices)
    asked = P.history_todo(plan).filter(F.col("ticker") != "SPY").select("ticker", "need")
    return M.mark_history(d.tickers, asked).select("ticker", "history_from")


@check("pending_queue", "SELECT path, published_day FROM frontier WHERE state = 'pending'")
def pending_queue(d):
    return P.pending_queue(d.frontier)
