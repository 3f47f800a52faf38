"""Outcomes and the track record, against the series' rates and against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import date, timedelta
from statistics import fmean, median

import numpy as np
import pytest
from conftest import SESSIONS, close_of, gain, one, rows

from callbook.plans import track as T
from callbook.plans.filters import in_days, select_calls
from callbook.plans.outcomes import (
    TRACK_HORIZONS,
    compute_outcomes,
    merge_outcomes,
    open_calls,
    outcome_counts,
    returns_since,
    track_record,
)

MARGIN = 1e-9


def scored(m, stored=None, prices=None):
    return compute_outcomes(m.coverage, m.tickers, m.prices if prices is None else prices, stored)


def record(m):
    return track_record(scored(m), m.articles)


def keyed(df):
    return {r["path"]: r.asDict() for r in df.collect()}


# --- outcomes ------------------------------------------------------------------------------------
@pytest.mark.parametrize("horizon", TRACK_HORIZONS.values())
def test_each_horizon_holds_the_rate_of_both_legs(market, horizon):
    found = keyed(scored(market))
    for path, symbol, session in (("/mining/tin-list/", "TIN", 0), ("/farming/rye-cheap/", "RYE", 2),
                                  ("/cloth/flax-exit/", "FLAX", 45)):
        r = found[path]
        assert (r["entry_date"], r["entry_close"]) == (SESSIONS[session], pytest.approx(close_of(symbol, session)))
        assert r[f"ret_{horizon}"] == pytest.approx(gain(symbol, horizon), rel=MARGIN)
        assert r[f"bench_{horizon}"] == pytest.approx(gain("SPY", horizon), rel=MARGIN)


def test_excess_takes_the_side_of_the_call(market):
    found = keyed(record(market))
    for path, symbol, side in (("/mining/tin-list/", "TIN", 1), ("/farming/rye-storm/", "RYE", -1),
                               ("/farming/rye-cheap/", "RYE", 1), ("/cloth/flax-exit/", "FLAX", -1)):
        for label, h in TRACK_HORIZONS.items():
            ahead = gain(symbol, h) - gain("SPY", h)
            assert found[path][f"excess_{label}"] == pytest.approx(ahead, rel=MARGIN)
            assert found[path][f"call_{label}"] == pytest.approx(side * ahead, rel=MARGIN)
            assert found[path][f"hit_{label}"] is (side * ahead > 0)
    neutral = found["/mining/tin-report/"]
    assert neutral["call_6m"] is None and neutral["hit_6m"] is None and neutral["excess_6m"] > 0


def test_prices_that_arrive_in_pieces_give_the_full_result(market):
    """Scored after each piece; some calls mature late, one never, one has no price."""
    rng = random.Random(17)
    for i in range(25):
        market.add(f"/piece/{i}/", "x", rng.randrange(len(SESSIONS)), rng.choice([-2, -1, 1, 2]), rng.choice(["TIN", "RYE", "FLAX"]))
    market.add("/piece/before/", "x", date(2018, 1, 9), 2, "TIN")
    stored = None
    for session in (30, 64, 200, len(SESSIONS) - 1):
        known = market.prices.filter(f"date <= DATE'{SESSIONS[session]}'")
        fresh = scored(market, stored, known)
        stored = fresh if stored is None else merge_outcomes(stored, fresh)
        stored = market.spark.createDataFrame(stored.collect(), stored.schema)
    assert sorted(rows(stored), key=str) == sorted(rows(scored(market)), key=str)


def test_closed_calls_are_left_alone(market):
    whole = scored(market)
    assert rows(outcome_counts(whole)) == [(5, 5)]
    assert open_calls(market.coverage).count() == 5
    assert rows(outcome_counts(scored(market, whole))) == [(0, 0)]
    market.add("/cloth/flax-again/", "x", 300, 1, "FLAX")
    assert {r["path"] for r in open_calls(market.coverage, whole).collect()} == {"/cloth/flax-again/"}


def test_a_new_label_turns_the_call(market):
    was = keyed(record(market))["/farming/rye-storm/"]["call_12m"]
    path, title, author, day, _, _ = market.article_rows[1]
    market.article_rows[1] = (path, title, author, day, "buy", 2)
    assert keyed(record(market))["/farming/rye-storm/"]["call_12m"] == pytest.approx(-was, rel=MARGIN)


def test_a_late_entry_counts_for_a_week(market):
    for early in range(11):
        market.add(f"/gap/{early}/", "x", SESSIONS[40] - timedelta(days=early), 1, "FLAX")
    found = keyed(scored(market))
    assert [found[f"/gap/{n}/"]["entry_date"] for n in range(11)] == [SESSIONS[40] if n <= 7 else None for n in range(11)]
    assert all((found[f"/gap/{n}/"]["ret_21"] is None) is (n > 7) for n in range(11))


def test_what_cannot_be_scored(market):
    assert scored(market, prices=market.prices.filter("symbol != 'SPY'")).isEmpty()
    market.ticker_rows = [r if r[0] != "RYE" else ("RYE", None, None, True, None, None) for r in market.ticker_rows]
    assert not any("rye" in path for path in keyed(scored(market)))


def test_returns_up_to_the_last_close(market):
    asked = [("RYE", SESSIONS[100]), ("FLAX", SESSIONS[40] - timedelta(days=7)), ("FLAX", SESSIONS[40] - timedelta(days=8)),
             ("TIN", SESSIONS[-1]), ("TIN", SESSIONS[-1] + timedelta(days=900)), ("OAT", SESSIONS[3])]
    days = market.spark.createDataFrame(asked, "symbol string, day date")
    found = {(r["symbol"], r["day"]): r["pct_return"] for r in returns_since(days, market.prices).collect()}
    last = len(SESSIONS) - 1
    assert found[asked[0]] == pytest.approx(gain("RYE", last - 100))
    assert found[asked[1]] == pytest.approx(gain("FLAX", last - 40))
    assert [found[a] for a in asked[2:]] == [None] * 4


# --- reports, against plain Python over many calls -----------------------------------------------------
@pytest.fixture
def many(market):
    """Calls of all kinds on random sessions, some of them too late to be scored, some never priced."""
    rng = random.Random(23)
    for i in range(160):
        market.add(f"/many/{i:03}/", f"Call {i}", rng.randrange(len(SESSIONS)), rng.choice([-2, -1, 0, 1, 2]),
                   rng.choice(["TIN", "RYE", "FLAX"]), rng.choice(["Ada Moss", "Ben Ford", None]))
    return market


def plain(m):
    """(article, ticker, call by horizon, excess legs) worked out without Spark."""
    out, index = [], {d: i for i, d in enumerate(SESSIONS)}
    for (path, title, author, day, stance, score), (ticker, *_) in zip(m.article_rows, m.coverage_rows):
        i = index[day]
        late = ticker == "FLAX" and i < 40
        start = 40 if late and (SESSIONS[40] - day).days <= 7 else None if late else i
        calls, legs = {}, {}
        for label, h in TRACK_HORIZONS.items():
            ok = start is not None and start + h < len(SESSIONS)
            legs[label] = (gain(ticker, h), gain("SPY", h)) if ok else None
            calls[label] = (legs[label][0] - legs[label][1]) * (1 if score > 0 else -1) if ok and score else None
        out.append({"path": path, "author": author, "day": day, "stance": stance, "score": score, "ticker": ticker,
                    "start": start, "calls": calls, "legs": legs})
    return out


def values(calls, label):
    return [c["calls"][label] for c in calls if c["calls"][label] is not None]


def test_scorecard_against_statistics(many):
    groups = defaultdict(list)
    for c in plain(many):
        if c["score"]:
            groups[c["stance"]].append(c)
    card = {r["stance"]: r for r in T.scorecard(record(many), "stance").collect()}
    assert {s: r["calls"] for s, r in card.items()} == {s: len(g) for s, g in groups.items()}
    for stance, calls in groups.items():
        for label in TRACK_HORIZONS:
            got, v = card[stance], values(calls, label)
            assert got[f"n_{label}"] == len(v)
            if v:
                assert got[f"median_{label}"] == pytest.approx(median(v)) and got[f"mean_{label}"] == pytest.approx(fmean(v))
                assert got[f"hit_{label}"] == pytest.approx(100 * sum(x > 0 for x in v) / len(v))
                assert got[f"lo_{label}"] <= got[f"hit_{label}"] <= got[f"hi_{label}"]
            else:
                assert got[f"hit_{label}"] is None and got[f"median_{label}"] is None
    long = T.scorecard_long(record(many), "bucket")
    assert long.agg({"n": "sum"}).first()[0] == sum(len(values(g, h)) for g in groups.values() for h in TRACK_HORIZONS)


def test_a_group_whose_calls_are_too_young_is_listed(market):
    market.add("/young/", "x", len(SESSIONS) - 2, 1, "TIN")
    market.article_rows = [a for a in market.article_rows if a[4] != "buy_lean" or a[0] == "/young/"]
    r = one(T.scorecard(record(market), "stance").filter("stance = 'buy_lean'"))
    assert (r["calls"], r["n_1m"], r["hit_1m"], r["median_12m"]) == (1, 0, None, None)


def test_monthly_baskets_against_a_loop(many):
    first = {}
    for c in sorted(plain(many), key=lambda c: (c["day"], c["path"])):
        if c["score"] > 0 and c["legs"]["1m"]:
            first.setdefault((c["day"].replace(day=1), c["ticker"]), c["legs"]["1m"])
    months, grown, bench = defaultdict(list), 1.0, 1.0
    for (month, _), legs in first.items():
        months[month].append(legs)
    got = T.follow_the_calls(record(many)).orderBy("month").collect()
    assert [r["month"] for r in got] == sorted(months)
    for r in got:
        legs = months[r["month"]]
        grown *= 1 + fmean(a for a, _ in legs) / 100
        bench *= 1 + fmean(b for _, b in legs) / 100
        assert (r["calls"], r["follow_growth"], r["bench_growth"]) == (
            len(legs), pytest.approx(grown), pytest.approx(bench))
    lines = T.growth_series(T.follow_the_calls(record(many)))
    assert lines.count() == 2 * len(got) and {r["month"] for r in lines.filter("is_last").collect()} == {max(months)}
    s = one(T.basket_summary(T.follow_the_calls(record(many))))
    assert s["months"] == len(months) and s["mean_calls"] == pytest.approx(fmean(map(len, months.values())))


def test_selections(many):
    many.add("/never/", "x", date(2018, 2, 1), 2, "TIN", "Ada Moss")
    known = [c for c in plain_known(many)]
    for kind, side in (("Bullish", 1), ("Bearish", -1)):
        mine = [c for c in known if c["score"] * side > 0]
        r = one(T.selection_summary(select_calls(record(many), kind), "6m"))
        v = values(mine, "6m")
        assert (r["scored"], r["hits"]) == (len(v), sum(x > 0 for x in v))
        assert r["median"] == pytest.approx(median(v)) and r["mean"] == pytest.approx(fmean(v))
        assert r["unpriced"] == sum(c["start"] is None for c in mine) + (side > 0)
        assert r["maturing"] == sum(c["start"] is not None for c in mine) - len(v)
    mine = [c for c in known if c["author"] == "Ben Ford" and c["score"]]
    r = one(T.selection_summary(select_calls(record(many), author="Ben Ford"), "1m"))
    assert r["scored"] == len(values(mine, "1m"))
    nobody = one(T.selection_summary(select_calls(record(many), author="Eve Gray"), "1m"))
    assert (nobody["scored"], nobody["hit_rate"], nobody["reading"]) == (0, None, None)


def plain_known(m):
    """The calls of `plain` on days that are sessions."""
    kept = [(a, c) for a, c in zip(m.article_rows, m.coverage_rows) if a[3] in set(SESSIONS)]
    view = type("View", (), {"article_rows": [a for a, _ in kept], "coverage_rows": [c for _, c in kept]})
    return plain(view)


def test_histogram_against_numpy(many):
    v = np.array([x for c in plain(many) if c["score"] for x in values([c], "3m")])
    bars = T.histogram(select_calls(record(many)), "3m").collect()
    low, high = np.floor(np.quantile(v, 0.01) / 4) * 4, np.ceil(np.quantile(v, 0.99) / 4) * 4
    want = Counter(low + 4 * np.floor((min(max(x, low), high - 1e-9) - low) / 4) for x in v.tolist())
    assert {r["start"]: r["calls"] for r in bars} == dict(want)
    assert all(r["side"] == ("Call paid" if r["start"] >= 0 else "Call did not pay") for r in bars)


def test_quarters_with_few_calls_are_hidden(many):
    quarters = defaultdict(list)
    for c in plain(many):
        if c["calls"]["1m"] is not None:
            quarters[date(c["day"].year, 3 * ((c["day"].month - 1) // 3) + 1, 1)].append(c["calls"]["1m"])
    got = T.by_quarter(select_calls(record(many)), "1m", min_calls=20).collect()
    assert [(r["quarter"], r["calls"]) for r in got] == [(q, len(v)) for q, v in sorted(quarters.items()) if len(v) >= 20]
    assert [r["median"] for r in got] == pytest.approx([median(quarters[r["quarter"]]) for r in got])


def test_lists_of_calls(many):
    calls, ranked = select_calls(record(many)), [c for c in plain(many) if c["calls"]["12m"] is not None]
    best = T.extreme_calls(calls, "12m", True, 3, "https://ledger.test").collect()
    worst = T.extreme_calls(calls, "12m", False, 2).collect()
    top = max(c["calls"]["12m"] for c in ranked)
    assert best[0]["call_12m"] == pytest.approx(top) and best[0]["url"] == "https://ledger.test" + best[0]["path"]
    assert [r["path"] for r in best] == [c["path"] for c in sorted(
        ranked, key=lambda c: (-round(c["calls"]["12m"], 6), c["path"]))][:3]
    assert worst[0]["call_12m"] == pytest.approx(min(c["calls"]["12m"] for c in ranked))
    directed = [c for c in plain(many) if c["score"]]
    page = T.every_call(calls, n=7).collect()
    assert T.every_call(calls).count() == len(directed)
    assert [r["path"] for r in page] == [c["path"] for c in sorted(
        directed, key=lambda c: (-c["day"].toordinal(), c["path"]))][:7]


def test_authors_and_days(many):
    directed = Counter(c["author"] for c in plain(many) if c["score"] and c["author"])
    assert dict(rows(T.author_call_counts(record(many)))) == dict(directed)
    start, end = SESSIONS[50], SESSIONS[80]
    inside = sum(start <= c["day"] <= end for c in plain(many))
    assert in_days(record(many), str(start), str(end)).count() == inside
    assert in_days(record(many), str(SESSIONS[-1] + timedelta(days=1)), None).isEmpty()
