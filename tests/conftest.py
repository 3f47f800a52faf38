from __future__ import annotations

import os
import sys
from datetime import date, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from callbook.functions.stance import SCORES  # noqa: E402
from callbook.session import ensure_checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "callbook-tests")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


def open_days(first: date, n: int) -> list[date]:
    """Weekdays from `first` on without every eleventh, a holiday of this exchange."""
    weekdays = (first + timedelta(days=i) for i in range(2 * n + 20))
    kept = [d for i, d in enumerate(d for d in weekdays if d.weekday() < 5) if i % 11 != 10]
    return kept[:n]


SESSIONS = open_days(date(2019, 5, 6), 320)
#: symbol -> (first session, first close, growth a session); the benchmark moves too.
SERIES = {"SPY": (0, 50.0, 1.002), "TIN": (0, 12.5, 1.007), "RYE": (0, 80.0, 0.996), "FLAX": (40, 55.0, 1.0005)}


def close_of(symbol: str, session: int) -> float:
    start, first, growth = SERIES[symbol]
    return first * growth ** (session - start)


def gain(symbol: str, sessions: int) -> float:
    """Percent that a series makes over so many sessions, wherever they begin."""
    return (SERIES[symbol][2] ** sessions - 1) * 100


class Market:
    """Three stocks and a benchmark that grow at fixed rates, and five articles about them."""

    STANCE = {2: "buy", 1: "buy_lean", 0: "news", -1: "warning", -2: "sell"}

    def __init__(self, spark):
        self.spark = spark
        self.price_rows = [(symbol, SESSIONS[i], close_of(symbol, i), 10 + i) for symbol, (start, _, _) in SERIES.items()
                           for i in range(start, len(SESSIONS))]
        self.ticker_rows = [(s, f"{s.title()} Works", s, False, None, None) for s in ("TIN", "RYE", "FLAX")]
        self.article_rows, self.coverage_rows = [], []
        self.add("/mining/tin-list/", "Four Metals Worth Owning", 0, 2, "TIN", "Ada Moss")
        self.add("/farming/rye-storm/", "Storm Clouds Over Rye", 0, -1, "RYE", "Ben Ford")
        self.add("/farming/rye-cheap/", "Rye Looks Cheap", 2, 1, "RYE", "Ada Moss")
        self.add("/mining/tin-report/", "Tin Works Reports", 2, 0, "TIN", "Ben Ford")
        self.add("/cloth/flax-exit/", "Leave Flax Behind", 45, -2, "FLAX", "Cy Dunn")

    def add(self, path, title, day, score, ticker, author="Ada Moss"):
        """An article on a session (by its number) or on any day."""
        day = SESSIONS[day] if isinstance(day, int) else day
        self.article_rows.append((path, title, author, day, self.STANCE[score], score))
        self.coverage_rows.append((ticker, path, day, True, "primary_meta", True))

    @property
    def prices(self):
        return self.spark.createDataFrame(
            self.price_rows, "symbol string, date date, close double, volume bigint")

    @property
    def tickers(self):
        return self.spark.createDataFrame(
            self.ticker_rows, "ticker string, name string, price_symbol string, "
            "price_failed boolean, first_seen_day date, history_from date")

    @property
    def articles(self):
        return self.spark.createDataFrame(
            self.article_rows, "path string, title string, author string, published_day date, "
            "stance string, stance_score int")

    @property
    def coverage(self):
        return self.spark.createDataFrame(
            self.coverage_rows, "ticker string, path string, published_day date, "
            "is_primary boolean, source string, verified boolean")


@pytest.fixture
def market(spark):
    return Market(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]


__all__ = ["F", "SCORES", "SERIES", "SESSIONS", "Market", "close_of", "gain", "one", "open_days", "rows"]
