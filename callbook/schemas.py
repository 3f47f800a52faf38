"""Explicit schemas of the stored tables (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**cols) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_B, _DAY, _TS = T.BooleanType(), T.DateType(), T.TimestampType()

ARTICLES = _schema(
    path=_S, title=_S, author=_S, published_day=_DAY, published_ts=_TS, section=_S,
    stance=_S, stance_score=_I, ticker_count=_L, fetched_ts=_TS, month=_S,
)
COVERAGE = _schema(
    ticker=_S, path=_S, published_day=_DAY, is_primary=_B, source=_S, verified=_B, month=_S,
)
FRONTIER = _schema(
    path=_S, section=_S, published_day=_DAY, discovered_ts=_TS, state=_S, attempts=_I,
    last_error=_S, result_ts=_TS, month=_S,
)
ARCHIVE_MONTHS = _schema(month=_S, urls_found=_L, enumerated_ts=_TS)
UNIVERSE = _schema(ticker=_S, name=_S, exchange=_S, is_etf=_B)
TICKERS = _schema(
    ticker=_S, name=_S, price_symbol=_S, price_failed=_B, first_seen_day=_DAY, history_from=_DAY,
)
PRICES = _schema(symbol=_S, date=_DAY, close=_D, volume=_L, month=_S)
CALL_OUTCOMES = _schema(
    path=_S, ticker=_S, published_day=_DAY, entry_date=_DAY, entry_close=_D,
    ret_21=_D, bench_21=_D, ret_63=_D, bench_63=_D, ret_126=_D, bench_126=_D,
    ret_252=_D, bench_252=_D, computed_ts=_TS, month=_S,
)
RUNS = _schema(
    kind=_S, started_ts=_TS, finished_ts=_TS, articles_new=_L, coverage_new=_L, notes=_S,
)
OPEN_CALLS = _schema(path=_S, ticker=_S, published_day=_DAY, due=_DAY, due_month=_S)
BATCHES = _schema(batch=_S, kind=_S, applied_ts=_TS, rows=_L)
LANDED_FILES = _schema(kind=_S, file=_S, modified_ts=_TS, read_ts=_TS)

#: name -> (schema, key columns, partition column). The partition column is a
#: function of the key, so a row never moves between partitions.
TABLES = {
    "articles": (ARTICLES, ["path"], "month"),
    "coverage": (COVERAGE, ["ticker", "path"], "month"),
    "frontier": (FRONTIER, ["path"], "month"),
    "archive_months": (ARCHIVE_MONTHS, ["month"], None),
    "universe": (UNIVERSE, ["ticker"], None),
    "tickers": (TICKERS, ["ticker"], None),
    "prices": (PRICES, ["symbol", "date"], "month"),
    "call_outcomes": (CALL_OUTCOMES, ["path", "ticker"], "month"),
    # Moves between partitions as its calls mature; see callbook.plans.outcomes.
    "open_calls": (OPEN_CALLS, [], "due_month"),
    "runs": (RUNS, [], None),
    "batches": (BATCHES, [], None),
    "landed_files": (LANDED_FILES, [], None),
}
