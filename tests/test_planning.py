"""What to fetch next: history, symbols, refresh order and months."""

from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import SESSIONS, rows
from pyspark.sql import functions as F

from callbook.operators.merge import mark_history
from callbook.plans import planning as P

REACH = timedelta(days=P.LEAD_DAYS)
FIRST = {"TIN": SESSIONS[0], "RYE": SESSIONS[0], "FLAX": SESSIONS[45]}


def planned(m, tickers=None):
    return P.history_plan(m.coverage, m.tickers if tickers is None else tickers, m.prices)


def action(m, ticker):
    return {r["ticker"]: r["action"] for r in planned(m).collect()}[ticker]


def test_the_need_lies_a_lead_before_the_first_article(market):
    needs = {r["ticker"]: r["need"] for r in planned(market).collect()}
    assert needs == {t: day - REACH for t, day in FIRST.items()} | {"SPY": min(FIRST.values()) - REACH}


@pytest.mark.parametrize("late, wanted", [(-3, "satisfied"), (0, "satisfied"), (P.SLACK_DAYS, "satisfied"),
                                          (P.SLACK_DAYS + 1, "fetch"), (500, "fetch")])
def test_closes_may_start_a_little_late(market, late, wanted):
    need = FIRST["FLAX"] - REACH
    market.price_rows = [r for r in market.price_rows if r[0] != "FLAX"] + [
        ("FLAX", need + timedelta(days=late), 4.0, 1)]
    assert action(market, "FLAX") == wanted
    marks = dict(rows(P.history_marks(planned(market))))
    assert marks == ({"FLAX": need} if wanted == "satisfied" else {})


def test_only_verified_primary_coverage_counts(market):
    early = SESSIONS[0] - timedelta(days=60)
    market.coverage_rows += [("FLAX", "/cloth/aside/", early, False, "meta", True),
                             ("FLAX", "/cloth/unlisted/", early, True, "primary_meta", False)]
    assert {r["ticker"]: r["need"] for r in planned(market).collect()}["FLAX"] == FIRST["FLAX"] - REACH


def test_what_was_asked_or_cannot_be_asked(market):
    need = FIRST["RYE"] - REACH
    market.ticker_rows = [("RYE", None, "RYE", False, None, need), ("TIN", None, "TIN", False, None, need + timedelta(days=1)),
                          ("FLAX", None, None, True, None, None)]
    found = {r["ticker"]: r["action"] for r in planned(market).collect()}
    assert found == {"RYE": "asked", "TIN": "fetch", "FLAX": "no_symbol", "SPY": "fetch"}


def test_a_history_that_was_asked_for_is_not_asked_for_again(market):
    todo = P.history_todo(planned(market))
    assert rows(todo)[0][0] == "SPY" and P.history_todo(planned(market), 2).count() == 2
    marked = mark_history(market.tickers, todo.select("ticker", "need"))
    assert [r["ticker"] for r in P.history_todo(planned(market, marked)).collect()] == ["SPY"]


def test_price_symbols(market):
    """A dash for a dot, the foreign form as second choice, what is known or failed stays."""
    market.ticker_rows = [(t, None, symbol, failed, None, None) for t, symbol, failed in (
        ("HAY.A", None, False), ("LOAM", None, None), ("MOSS", "", None), ("PEAT", None, False), ("REED", None, True),
        ("SAND", "SAND-OLD", False))]
    priced = market.spark.createDataFrame([(s,) for s in ("HAY-A", "HAY.A", "LOAM.TO", "MOSS.TO", "MOSS", "REED", "SAND")],
                                          "symbol string")
    found = {r["ticker"]: (r["price_symbol"], r["price_failed"]) for r in P.resolve_symbols(market.tickers, priced).collect()}
    assert found == {"HAY.A": ("HAY-A", False), "LOAM": ("LOAM.TO", False), "MOSS": ("MOSS", False), "PEAT": (None, True),
                     "REED": (None, True), "SAND": ("SAND-OLD", False)}


def test_refresh_goes_by_coverage(market):
    for i in range(3):
        market.add(f"/oat/{i}/", "x", 7 + i, 0, "OAT")
    assert rows(P.refresh_list(market.coverage, 2)) == [("OAT", 3), ("RYE", 2), ("TIN", 2)]
    order = [(r["ticker"], r["symbol"]) for r in P.refresh_plan(market.coverage, market.tickers, market.prices).collect()]
    assert order == [("SPY", "SPY"), ("OAT", None), ("RYE", "RYE"), ("TIN", "TIN"), ("FLAX", "FLAX")]
    market.price_rows = [r for r in market.price_rows if r[0] != "TIN"]
    absent = P.refresh_plan(market.coverage, market.tickers, market.prices, only_missing=True)
    assert {r["ticker"] for r in absent.collect()} == {"SPY", "OAT", "TIN"}


def test_months_still_to_enumerate(spark):
    done = spark.createDataFrame([("2031/03",), ("2031/05",)], "month string")

    def months(**options):
        return [m for m, in rows(P.month_plan(spark, F.lit("2031/02"), F.lit("2031/06"), done, **options))]
    assert months() == ["2031/02", "2031/04", "2031/06"]
    assert months(refresh=True) == [f"2031/0{m}" for m in range(2, 7)]
