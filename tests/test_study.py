from __future__ import annotations

import math
import random
import statistics as st
from bisect import bisect_left
from collections import defaultdict
from datetime import date, timedelta

import pytest
from conftest import Market, SESSIONS, gain, one, rows
from pyspark.sql import functions as F

from callbook.functions import stats as N
from callbook.plans import authors as A
from callbook.plans import study as E
from callbook.plans import timeline as L


# --- scalar statistics -----------------------------------------------------------------
def wilson_by_hand(hits, n, z=1.96):
    if n == 0:
        return None, None
    p = hits / n
    mid, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return max(0, (mid - half) / scale) * 100, min(1, (mid + half) / scale) * 100


def test_wilson(spark):
    cases = [(2, 3), (457, 811), (0, 0), (0, 17), (17, 17), (13, 29), (2, 2), (0, 1), (7, 190)]
    df = spark.createDataFrame(cases, "hits bigint, n bigint")
    got = rows(df.select(N.wilson_low(F.col("hits"), F.col("n")),
                         N.wilson_high(F.col("hits"), F.col("n"))))
    for (hits, n), (lo, hi) in zip(cases, got):
        assert (lo, hi) == (pytest.approx(wilson_by_hand(hits, n)) if n else (None, None))
        assert n == 0 or 0 <= lo <= hi <= 100
    assert got[0][1] - got[0][0] > 60 and got[1][1] - got[1][0] < 8


def test_buckets(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 6, 7, 10, 11, 25, 26, 99)], "n int")
    got = rows(df.select("n", N.ordinal_bucket(F.col("n")), N.intensity_bucket(F.col("n"))))
    assert [(a, b) for _, a, b in got] == [
        ("1st article", "2 articles"), ("2nd article", "2 articles"), ("3rd article", "3-5"),
        ("4th-5th", "3-5"), ("4th-5th", "3-5"), ("6th-10th", "6-10"), ("6th-10th", "6-10"),
        ("6th-10th", "6-10"), ("11th+", "11-25"), ("11th+", "11-25"), ("11th+", "26+"),
        ("11th+", "26+")]


def test_small_scalars(spark):
    df = spark.range(1).select(
        N.pct_return(F.lit(0.0), F.lit(5.0)), N.pct_return(F.lit(10.0), F.lit(None)),
        N.pct_return(F.lit(10.0), F.lit(5.0)), N.direction(F.lit(0)), N.direction(F.lit(-2)),
        N.ci_verdict(F.lit(51.0), F.lit(60.0)), N.ci_verdict(F.lit(40.0), F.lit(49.0)),
        N.ci_verdict(F.lit(49.0), F.lit(51.0)), N.multiple_of(F.lit(4), F.lit(0.0)),
        N.multiple_of(F.lit(4), F.lit(2.0)), N.spike_status(F.lit(0.0)))
    assert rows(df) == [(None, None, -50.0, None, -1.0, "Beats a coin flip",
                         "Worse than a coin flip", "Can't tell", None, 2.0, "newly covered")]


# --- verdict ---------------------------------------------------------------------------
PAIRED = ("horizon string, tickers bigint, first_mean double, second_mean double, "
          "first_median double, second_median double, mean_diff double, median_diff double, "
          "first_wins_pct double")


@pytest.mark.parametrize("n,mean,median,wins,code,phrase", [
    (7, 2.5, 2.0, 80.0, "too_few", "below the minimum"),
    (64, 0.9, 0.0, 58.0, "no_evidence", "no side"),
    (64, 0.4, 0.45, 61.0, "coin_flip", "chance"),
    (90, 2.2, 1.7, 56.0, "earlier_better", "favours the opening"),
    (90, -1.6, -2.4, 31.0, "earlier_worse", "favours the later"),
    (90, -2.0, 1.1, 71.0, "no_evidence", "no side"),
    (90, 1.4, 0.9, 44.0, "no_evidence", "no side"),
    (90, 3.1, 2.6, 45.0, "coin_flip", "chance"),
])
def test_verdict(spark, n, mean, median, wins, code, phrase):
    df = spark.createDataFrame([("21d", n, 0., 0., 0., 0., mean, median, wins)], PAIRED)
    r = one(E.verdict(df))
    assert r["code"] == code and phrase in r["text"]


def test_verdict_prefers_a_month(spark):
    def row(h):
        return (h, 50, 0., 0., 0., 0., 1., 1., 60.)

    def pick(*hs):
        return one(E.verdict(spark.createDataFrame([row(h) for h in hs], PAIRED)))["horizon"]

    assert pick("1d", "5d", "21d", "63d") == "21d" and pick("1d", "5d", "63d") == "63d"
    assert pick("1d", "5d") == "5d" and pick("1d") == "1d"
    r = one(E.verdict(spark.createDataFrame([], PAIRED)))
    assert r["code"] == "nothing" and "empty" in r["text"]


# --- event study against plain Python ---------------------------------------------------
def random_market(spark, seed=1):
    rng = random.Random(seed)
    m = Market(spark)
    m.article_rows.clear(), m.coverage_rows.clear()
    m.ticker_rows.clear()
    tickers = ["HOT", "T1", "T2", "T3", "T4", "NOSYM", "LATE"]
    for t in tickers:
        m.ticker_rows.append((t, None if t == "T2" else f"{t} Inc", None if t == "NOSYM" else t,
                              False, None, None))
        days = SESSIONS[200:] if t == "LATE" else [d for d in SESSIONS if rng.random() < 0.8]
        price = 50.0
        for d in days:
            price *= 1 + rng.uniform(-0.04, 0.04)
            if t != "NOSYM":
                m.price_rows.append((t, d, round(price, 2), 1))
    m.price_rows = [r for r in m.price_rows if r[0] != "SPY"]
    level = 400.0
    for d in SESSIONS[10:]:
        if rng.random() < 0.9:
            level *= 1 + rng.uniform(-0.01, 0.012)
            m.price_rows.append(("SPY", d, round(level, 2), 1))
    for i in range(260):
        t = "HOT" if i % 3 else rng.choice(tickers)
        day = SESSIONS[0] + timedelta(days=rng.randint(0, 420))
        if t == "T4":
            day = SESSIONS[0] + timedelta(days=rng.randint(200, 400))
        m.add(f"/p/{i:03d}/", f"t{i}", day, rng.choice([-2, -1, 0, 1, 2]), t,
              author=rng.choice(["Ann", "Bo", "", None]))
    m.coverage_rows.append(("T3", "/p/000/", m.article_rows[0][3], False, "meta", True))
    m.coverage_rows.append(("UNLISTED", "/p/001/", m.article_rows[1][3], True, "meta", False))
    return m


def plain_study(m, censor, least):
    """(events, notes) worked out row by row."""
    series = defaultdict(list)
    for s, d, c, _ in sorted(m.price_rows, key=lambda r: r[:2]):
        series[s].append((d, c))
    symbol = {t[0]: t[2] for t in m.ticker_rows}
    score = {a[0]: (a[5], a[2]) for a in m.article_rows}
    cov = defaultdict(list)
    for t, p, d, prim, _, ver in m.coverage_rows:
        if prim and ver and symbol.get(t):
            cov[t].append((d, p))
    start = min(d for g in cov.values() for d, _ in g)
    events, notes = {}, defaultdict(int)
    for t, group in cov.items():
        group.sort()
        if group[0][0] <= start + timedelta(days=censor):
            notes["censored"] += 1
            continue
        if len(group) < least:
            notes["thin"] += len(group)
            continue
        for i, (day, path) in enumerate(group):
            own, spy = series[symbol[t]], series["SPY"]
            e, b = (bisect_left([d for d, _ in s], day) for s in (own, spy))
            if e >= len(own) or b >= len(spy) or (own[e][0] - day).days > 7:
                notes["unpriced"] += 1
                continue

            def gain(s, k, h):
                return (s[k + h][1] - s[k][1]) / s[k][1] * 100 if k + h < len(s) else None

            legs = {}
            for h in E.HORIZONS:
                r, x = gain(own, e, h), gain(spy, b, h)
                legs[h] = None if r is None or x is None else r - x
            if all(v is None for v in legs.values()):
                notes["unmeasured"] += 1
            else:
                events[path] = (t, i + 1, len(group), (day - group[0][0]).days, *score[path], legs)
    return events, dict(notes)


@pytest.fixture(scope="module")
def studied(spark):
    m = random_market(spark)
    study = E.Study(m.coverage, m.articles, m.tickers, m.prices, censor_days=5, min_articles=2)
    return m, study, plain_study(m, 5, 2)


def test_events(studied):
    _, study, (want, _) = studied
    got = {r["path"]: r for r in study.events.collect()}
    assert set(got) == set(want) and len(got) > 30
    for path, (t, ordinal, total, since, score, author, legs) in want.items():
        r = got[path]
        assert (r["ticker"], r["ordinal"], r["total_articles"], r["days_since_first"],
                r["stance_score"], r["author"]) == (t, ordinal, total, since, score, author)
        for h, v in legs.items():
            assert r[f"adj_{h}d"] == (None if v is None else pytest.approx(v, abs=1e-9))


def test_notes(studied):
    _, study, (_, notes) = studied
    assert {r["code"]: r["count"] for r in study.notes.collect()} == notes
    assert {"censored", "unpriced"} <= set(notes)


def grouped(want, key):
    out = defaultdict(list)
    for path, e in want.items():
        out[key(e)].append(e)
    return out


def test_return_tables(studied):
    _, study, (want, _) = studied
    label = {"by_ordinal": lambda e: next(
        b for top, b in N.ORDINAL_BUCKETS if top is None or e[1] <= top),
        "by_intensity": lambda e: next(
        b for top, b in N.INTENSITY_BUCKETS if top is None or e[2] <= top)}
    for name, key in label.items():
        got = getattr(study, name).collect()
        groups = grouped(want, key)
        assert {r[0] for r in got} == set(groups)
        assert [r["position"] for r in got] == sorted(r["position"] for r in got)
        for r in got:
            g = groups[r[0]]
            assert (r["articles"], r["tickers"]) == (len(g), len({e[0] for e in g}))
            for h in E.HORIZONS:
                v = [e[-1][h] for e in g if e[-1][h] is not None]
                assert r[f"n_{h}d"] == len(v)
                if v:
                    assert r[f"mean_{h}d"] == pytest.approx(st.fmean(v))
                    assert r[f"median_{h}d"] == pytest.approx(st.median(v))
                    assert r[f"win_{h}d"] == pytest.approx(sum(x > 0 for x in v) / len(v) * 100)


def test_paired_and_headline(studied):
    _, study, (want, _) = studied
    legs = {(e[0], e[1]): e[-1] for e in want.values()}
    got = {r["horizon"]: r for r in study.paired.collect()}
    most = 0
    for h in E.HORIZONS:
        pairs = [(legs[t, 1][h], legs[t, 2][h]) for t, o in legs if o == 1 and (t, 2) in legs]
        pairs = [p for p in pairs if None not in p]
        most = max(most, len(pairs))
        if not pairs:
            assert f"{h}d" not in got
            continue
        r, diff = got[f"{h}d"], [a - b for a, b in pairs]
        assert r["tickers"] == len(pairs)
        assert r["median_diff"] == pytest.approx(st.median(diff))
        assert r["first_mean"] == pytest.approx(st.fmean(a for a, _ in pairs))
        assert r["second_median"] == pytest.approx(st.median(b for _, b in pairs))
        assert r["first_wins_pct"] == pytest.approx(sum(d > 0 for d in diff) / len(diff) * 100)
    assert tuple(one(E.headline(study.events, study.paired))) == (
        len(want), len({e[0] for e in want.values()}), most)


def test_no_benchmark_no_events(spark):
    m = random_market(spark)
    prices = m.prices.filter("symbol <> 'SPY'")
    days = E.study_days(m.coverage, m.tickers, prices, censor_days=0, min_articles=1)
    assert E.study_events(m.coverage, m.articles, days).count() == 0

    def codes(**kw):
        made = {"coverage": m.coverage, "prices": m.prices, **kw}
        study = E.Study(made["coverage"], m.articles, m.tickers, made["prices"],
                        censor_days=made.get("censor_days", 0), min_articles=1)
        return {r["code"] for r in study.notes.collect()}

    assert codes(prices=prices) >= {"no_benchmark"} and "unpriced" not in codes(prices=prices)
    assert "no_prices" in codes(prices=m.prices.limit(0))
    assert codes(coverage=m.coverage.limit(0)) == {"no_coverage"}
    assert codes(censor_days=9999) == {"censored", "nothing_left"}
    last = m.prices.filter(F.col("date") >= F.lit(SESSIONS[-1]))
    assert "nothing_measured" in codes(prices=last.unionByName(
        m.prices.filter("symbol = 'SPY'")).distinct())


def test_author_scores(spark):
    m = random_market(spark, 2)
    want, _ = plain_study(m, 0, 1)
    scores = A.author_scores(m.coverage, m.articles, m.tickers, m.prices, min_calls=12)
    calls = [(e[5], e[0], e[4] > 0, (1 if e[4] > 0 else -1) * e[-1][21]) for e in want.values()
             if e[4] and e[-1][21] is not None]
    base = sum(c[3] > 0 for c in calls) / len(calls) * 100
    b = one(scores.base)
    assert b["calls"] == len(calls) and b["hit_rate"] == pytest.approx(base)
    assert b["bullish_calls"] + b["bearish_calls"] == b["calls"]
    assert b["authors"] == len({c[0] for c in calls} - {None})
    got = {r["author"]: r for r in scores.authors.collect()}
    assert set(got) == {c[0] for c in calls} - {None}
    for author, r in got.items():
        mine = [c for c in calls if c[0] == author]
        hits = sum(c[3] > 0 for c in mine)
        lo, hi = wilson_by_hand(hits, len(mine))
        assert (r["calls"], r["hits"]) == (len(mine), hits)
        assert (r["ci_low"], r["ci_high"]) == pytest.approx((lo, hi))
        assert r["vs_base"] == pytest.approx(hits / len(mine) * 100 - base)
        assert r["median_call_return"] == pytest.approx(st.median(c[3] for c in mine))
        assert r["tickers"] == len({c[1] for c in mine})
        assert r["beats_base"] == (lo > base) and r["enough_data"] == (len(mine) >= 12)
    board = A.leaderboard(scores.authors).collect()
    assert [r["author"] for r in board] == [
        a for a, r in sorted(got.items(), key=lambda x: (-x[1]["hit_rate"], -x[1]["calls"], x[0]))
        if r["enough_data"]]
    nobody = A.leaderboard(scores.authors.withColumn("enough_data", F.lit(False))).collect()
    assert [r["calls"] for r in nobody] == sorted((r["calls"] for r in got.values()), reverse=True)
    notes = {r["code"]: r["count"] for r in scores.notes.collect()}
    assert notes["qualified"] == len(board) and notes["calls"] == len(calls)
    assert notes["ranked"] == len(got) and notes["right"] == sum(c[3] > 0 for c in calls)


# --- timeline ----------------------------------------------------------------------------
def ahead(symbol, sessions):
    return gain(symbol, sessions) - gain("SPY", sessions)


def test_timeline_against_the_rates(market):
    market.article_rows.clear(), market.coverage_rows.clear()
    market.ticker_rows.append(("HUSK", "No Price", None, True, None, None))
    first = SESSIONS[70]
    for i, (offset, ticker) in enumerate([(0, "TIN"), (0, "TIN"), (0, "TIN"), (29, "TIN"), (30, "TIN"), (31, "TIN"), (89, "TIN"),
                                          (90, "TIN"), (91, "TIN"), (150, "TIN"), (4, "RYE"), (61, "HUSK"), (66, "HUSK")]):
        market.add(f"/line/{i}/", "x", first + timedelta(days=offset), 0, ticker)
    got = {r["ticker"]: r for r in L.coverage_timeline(
        market.coverage, market.tickers, market.prices, censor_days=3).collect()}
    tin, rye, husk = got["TIN"], got["RYE"], got["HUSK"]
    assert (tin["articles"], tin["articles_30d"], tin["articles_90d"], tin["days_to_2nd"]) == (10, 5, 8, 0)
    assert (husk["articles"], husk["days_to_2nd"], rye["days_to_2nd"]) == (2, 5, None)
    assert [r["censored"] for r in (tin, rye, husk)] == [True, False, False]
    for label, sessions in L.MONTH_WINDOWS.items():
        room = sessions <= 70
        assert tin[f"before_{label}"] == (pytest.approx(ahead("TIN", sessions)) if room else None)
        assert tin[f"after_{label}"] == (pytest.approx(ahead("TIN", sessions)) if 70 + sessions < len(SESSIONS) else None)
    assert tin["since_first"] == pytest.approx(ahead("TIN", len(SESSIONS) - 71))
    assert husk["after_1m"] is None and husk["name"] == "No Price"
    assert tin["latest_article"] == first + timedelta(days=150)


def test_timeline_without_a_benchmark_is_raw(market):
    prices = market.prices.filter("symbol != 'SPY'")
    timeline = L.coverage_timeline(market.coverage, market.tickers, prices)
    found = {r["ticker"]: r["after_3m"] for r in timeline.collect()}
    assert found == {t: pytest.approx(gain(t, 63)) for t in ("TIN", "RYE", "FLAX")}
    assert {n["code"]: n["count"] for n in L.timeline_notes(timeline, prices).collect()}["raw"] == 3
    assert L.coverage_timeline(market.coverage, market.tickers, prices.limit(0)).isEmpty()


def test_readings(spark):
    cols = ("ticker string, censored boolean, articles_30d bigint, "
            + ", ".join(f"{p}_{m} double" for m in L.MONTH_WINDOWS for p in ("before", "after")))

    def frame(before, after):
        return spark.createDataFrame(
            [(f"T{i}", i == 0, 2 + i, None, None, None, None, before + i, after + i)
             for i in range(3)], cols)

    assert one(L.coverage_reading(frame(9.0, 1.0)))["reading"] == "follows the move"
    assert one(L.coverage_reading(frame(1.0, 2.0)))["reading"] == "suggestive"
    r = one(L.coverage_reading(frame(3.0, 1.0)))
    assert r["reading"] is None and (r["companies"], r["median_articles_30d"]) == (3, 3.0)
    assert rows(L.before_after(frame(1.0, 2.0))) == [("12m", "before", 3, 2.0),
                                                     ("12m", "after", 3, 3.0)]
    assert rows(L.timeline_notes(frame(1.0, 2.0)).select("code", "count")) == [("censored", 1)]
