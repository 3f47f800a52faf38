from __future__ import annotations

from collections import Counter
from datetime import date, timedelta

import pytest
from conftest import SESSIONS, gain, one, rows
from pyspark.sql import functions as F

from callbook.plans import reports as R
from callbook.sources.tables import day_bounds, query


DAY = SESSIONS[0]


@pytest.fixture
def busy(market):
    """One article on three tickers, blank and missing authors, an old and a busy ticker."""
    market.coverage_rows.append(("RYE", "/mining/tin-list/", DAY, False, "meta", True))
    market.coverage_rows.append(("OAT", "/mining/tin-list/", DAY, True, "primary_meta", False))
    for i in range(4):
        market.add(f"/later/{i}/", f"Dark Days {i}", DAY + timedelta(days=100 + i), -1, "TIN", "Sam Lee")
    market.add("/later/blank/", "x", DAY + timedelta(days=103), 0, "TIN", "")
    market.add("/later/none/", "x", DAY + timedelta(days=103), 2, "TIN", None)
    return market


def test_kpis_mix_and_ratio(busy):
    k = one(R.kpis(busy.articles, busy.coverage))
    assert (k["articles"], k["tickers"], k["authors"]) == (11, 4, 5)
    k = one(R.kpis(busy.articles, busy.coverage, str(DAY), str(DAY), primary_only=True, verified_only=True))
    assert (k["articles"], k["tickers"], k["authors"]) == (2, 2, 2)
    assert rows(R.stance_mix(busy.articles)) == [
        ("Buy", 2), ("Buy (question)", 1), ("No call", 2), ("Caution", 5), ("Sell", 1)]
    b = one(R.bull_bear(busy.articles))
    assert (b["bull"], b["bear"], b["bull_per_bear"]) == (3, 6, 0.5)
    none = one(R.bull_bear(busy.articles.filter("stance_score >= 0")))
    assert none["bear"] == 0 and none["bull_per_bear"] is None


def test_volume(busy):
    periods = R.volume_by_period(busy.articles).collect()
    assert {r["unit"] for r in periods} == {"Week"}
    assert sum(r["articles"] for r in periods) == 11 and sum(r["net_stance"] for r in periods) == -2


def test_ticker_tables(busy):
    top = R.top_tickers(busy.coverage, busy.articles, busy.tickers, n=2).collect()
    assert [(r["ticker"], r["articles"], r["avg_stance"]) for r in top] == [("TIN", 8, 0.0), ("RYE", 3, 0.67)]
    options = R.ticker_options(busy.coverage, busy.tickers, primary_only=True).collect()
    assert [(r["ticker"], r["n"]) for r in options] == [("TIN", 8), ("RYE", 2), ("FLAX", 1), ("OAT", 1)]
    s = {r["ticker"]: r["days"] for r in R.ticker_summary(busy.coverage, busy.articles).collect()}
    assert s == {"TIN": 103, "RYE": (SESSIONS[2] - DAY).days, "FLAX": 0, "OAT": 0}
    p = R.ticker_periods(busy.coverage, busy.articles).groupBy("ticker").agg(F.sum("articles"))
    assert dict(rows(p)) == {"TIN": 8, "RYE": 3, "FLAX": 1, "OAT": 1}


def test_article_lists(busy):
    panel = R.article_panel(busy.coverage, busy.articles, "TIN", 3, "https://ledger.test").collect()
    assert [r["path"] for r in sorted(panel, key=lambda r: r["rank"])] == ["/later/3/", "/later/blank/", "/later/none/"]
    assert {r["total"] for r in panel} == {8} and panel[0]["url"].startswith("https://ledger.test/later/")
    every = R.ticker_articles(busy.coverage, busy.articles).collect()
    assert Counter(r["ticker"] for r in every) == {"TIN": 8, "RYE": 3, "FLAX": 1, "OAT": 1}
    assert R.ticker_articles(busy.coverage, busy.articles, "RYE", primary_only=True).count() == 2


def test_price_history(busy):
    r = {r["ticker"]: r for r in R.ticker_price_history(busy.coverage, busy.tickers, busy.prices).collect()}
    last = len(SESSIONS) - 1
    for ticker, first in (("TIN", 0), ("RYE", 0), ("FLAX", 45)):
        assert r[ticker]["since_first"] == pytest.approx(gain(ticker, last - first))
        assert r[ticker]["bench_since_first"] == pytest.approx(gain("SPY", last - first))
        assert r[ticker]["gap"] == pytest.approx(gain(ticker, last - first) - gain("SPY", last - first))
    assert r["OAT"]["since_first"] is None and r["OAT"]["bench_since_first"] is None
    late = busy.coverage.withColumn("published_day", F.lit(SESSIONS[-1]))
    assert {x["since_first"] for x in R.ticker_price_history(late, busy.tickers, busy.prices).collect()} == {None}
    assert R.rebased_prices(late, busy.tickers, busy.prices).count() == 3


def test_flips_look_back_past_the_window(busy):
    since = str(DAY + timedelta(days=30))
    got = {r["url"]: r for r in R.stance_flips(busy.coverage, busy.articles, since, None, base="https://l.test").collect()}
    # /later/0/ turns on the first day's call, which lies before the window.
    assert set(got) == {"https://l.test/later/0/", "https://l.test/later/none/"}
    first = got["https://l.test/later/0/"]
    assert (first["direction"], first["prev_day"], first["days_between"], first["prev_score"]) == (
        "turned cautious", DAY, 100, 2)
    assert got["https://l.test/later/none/"]["direction"] == "turned bullish"
    early = R.stance_flips(busy.coverage, busy.articles, None, str(SESSIONS[2])).collect()
    assert sorted((r["ticker"], r["prev_score"], r["stance_score"]) for r in early) == [("RYE", -1, 2), ("RYE", 2, -1)][:len(early)]


def test_spikes(busy):
    got = {r["ticker"]: r for r in R.coverage_spikes(busy.coverage, busy.articles, busy.tickers).collect()}
    assert set(got) == {"TIN"}
    tin = got["TIN"]
    assert (tin["last_30d"], tin["status"]) == (6, "accelerating")
    assert tin["prior_avg_30d"] == pytest.approx(2 / 3) and tin["multiple"] == pytest.approx(9.0)


def test_authors_count_an_article_once(busy):
    got = {r["author"]: r for r in R.author_table(busy.articles, busy.coverage).collect()}
    assert {a: (r["articles"], r["tickers"], r["avg_stance"]) for a, r in got.items()} == {
        "Ada Moss": (2, 3, 1.5), "Ben Ford": (2, 2, -0.5), "Cy Dunn": (1, 1, -2.0), "Sam Lee": (4, 1, -1.0)}
    s = one(R.author_summary(R.author_table(busy.articles, busy.coverage)))
    assert (s["authors"], s["median_articles"], s["most_prolific"]) == (4, 2.0, "Sam Lee")


def test_turned_cautious(busy):
    got = R.turned_cautious(busy.coverage, busy.articles, str(DAY + timedelta(days=30)), min_articles=5, below=0.0)
    assert rows(got) == [("TIN", 1.0, -0.33, 8)]


def test_bounds_and_queries(busy, spark):
    assert rows(day_bounds(busy.articles))[0] == (DAY, DAY + timedelta(days=103))
    first, last = rows(day_bounds(busy.articles.limit(0)))[0]
    assert first == date(2020, 1, 1) and last >= date(2024, 1, 1)
    got = query(spark, "SELECT count(*) AS n FROM {a} WHERE author = :who", {"who": "Sam Lee"},
                a=busy.articles)
    assert rows(got) == [(4,)]
