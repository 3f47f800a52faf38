from __future__ import annotations

import random
from bisect import bisect_left
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from callbook.operators import ordering as O
from callbook.operators import sessions as P
from callbook.operators.periods import bucket_by_time
from callbook.operators.quantiles import ONE_BUFFER, value_stats

DAY0 = date(2024, 1, 1)


# --- quantiles -------------------------------------------------------------------------
def samples() -> dict[str, list[float]]:
    rng = random.Random(3)
    return {
        "one": [4.25],
        "two": [-3.0, 8.5],
        "same": [1.5] * 501,
        "normal": [rng.gauss(0.4, 12) for _ in range(3001)],
        "dense": [5 + rng.random() * 1e-4 for _ in range(2000)],     # one bin
        "tails": [rng.lognormvariate(0, 6) * rng.choice([-1, 1]) for _ in range(1500)],
        "ties": [float(rng.randint(-2, 2)) for _ in range(999)],
        "tiny": [rng.random() * 1e-9 for _ in range(400)],
        "huge": [1e308, -1e308, 0.0, 1e200],
    }


#: All values in one buffer, or, with none allowed, by bins and slices.
BUFFERS = [ONE_BUFFER, 0]


@pytest.mark.parametrize("buffer", BUFFERS)
@pytest.mark.parametrize("few", [True, False])
def test_value_stats_equal_numpy(spark, few, buffer):
    probs = (0.01, 0.25, 0.5, 0.99)
    data = [(k, v) for k, vs in samples().items() for v in vs] + [
        (None, 1.0), (None, 2.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, value double").repartition(7)
    got = {r["k"]: r for r in value_stats(
        df, ["k"], probs=probs, few_keys=few, one_buffer=buffer).collect()}
    assert set(got) == {*samples(), None}
    for key, values in {**samples(), None: [1.0, 2.0]}.items():
        r = got[key]
        assert r["n"] == len(values) and r["positives"] == sum(v > 0 for v in values)
        with np.errstate(over="ignore"):
            want = np.quantile(np.array(values), probs)
        have = [r["p1"], r["p25"], r["median"], r["p99"]]
        if key != "huge":
            assert have == pytest.approx(list(want), rel=1e-12, abs=1e-15)
            assert r["mean"] == pytest.approx(np.mean(values), rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("buffer", BUFFERS)
def test_value_stats_do_not_depend_on_partitioning(spark, buffer):
    data = [(k, v) for k, vs in samples().items() for v in vs if k != "huge"]
    random.Random(5).shuffle(data)
    df = spark.createDataFrame(data, "k string, value double")
    cols = ["k", "n", "median", "positives"]
    a, b = (sorted(rows(value_stats(df.repartition(n), ["k"], one_buffer=buffer).select(*cols))) for n in (1, 11))
    assert a == b


@pytest.mark.parametrize("buffer", [ONE_BUFFER, -1])
def test_value_stats_of_nothing(spark, buffer):
    df = spark.createDataFrame([], "k string, value double")
    assert rows(value_stats(df, ["k"], one_buffer=buffer)) == []


# --- order within a key ------------------------------------------------------------------
def coverage_sample(n=900):
    """One ticker holds most rows, and many rows share a day."""
    rng = random.Random(11)
    out = []
    for i in range(n):
        ticker = "HOT" if rng.random() < 0.6 else rng.choice(["A", "B", "C"])
        out.append((ticker, DAY0 + timedelta(days=rng.randint(0, 40)), f"/p{rng.random():.9f}/",
                    rng.choice([-2, -1, 1, 2])))
    return out


def test_ordinals(spark):
    data = coverage_sample()
    df = spark.createDataFrame(data, "ticker string, day date, path string, score int")
    got = {r["path"]: (r["ordinal"], r["total"], r["first_day"])
           for r in O.with_ordinal(df.repartition(5), "ticker", "day", ["path"]).collect()}
    groups = defaultdict(list)
    for t, d, p, _ in data:
        groups[t].append((d, p))
    want = {p: (i + 1, len(g), min(g)[0]) for g in map(sorted, groups.values())
            for i, (_, p) in enumerate(g)}
    assert got == want


def test_previous_row(spark):
    data = coverage_sample()
    df = spark.createDataFrame(data, "ticker string, day date, path string, score int")
    got = {r["path"]: (r["prev"]["path"], r["prev"]["score"]) if r["prev"] else None
           for r in O.with_previous(df, "ticker", "day", "path", ["path", "score"]).collect()}
    want = {}
    for ticker in {r[0] for r in data}:
        last = None
        for _, path, score in sorted((d, p, s) for t, d, p, s in data if t == ticker):
            want[path], last = last, (path, score)
    assert got == want


def test_newest_per_key(spark):
    df = spark.createDataFrame(coverage_sample(), "ticker string, day date, path string, score int")
    top = O.newest_per_key(df, "ticker", [F.desc("day"), F.asc("path")], 3)
    assert top.groupBy("ticker").count().filter("count != 3").count() == 0


# --- sessions --------------------------------------------------------------------------------
def gappy_prices(rng, symbols=("S1", "S2", "SPY")):
    data = []
    for s in symbols:
        day = DAY0 + timedelta(days=rng.randint(0, 30))
        for _ in range(60):
            day += timedelta(days=rng.choice([1, 1, 1, 2, 3, 9, 15]))
            close = None if rng.random() < 0.05 else float(rng.choice([0, 10, 11, 12.5, 20]))
            data.append((s, day, close, 1))
    return data


def by_symbol(data, with_null=False):
    series = defaultdict(list)
    for s, d, c, _ in sorted(data, key=lambda r: (r[0], r[1])):
        if c is not None or with_null:
            series[s].append((d, c))
    return series


def entry(series, day):
    i = bisect_left([d for d, _ in series], day)
    return i if i < len(series) else None


def ret(p0, p1):
    return None if not p0 or p1 is None else (p1 - p0) / p0 * 100.0


def approx(value):
    return None if value is None else pytest.approx(value, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("seed", range(3))
def test_legs_equal_brute_force(spark, seed):
    data = gappy_prices(random.Random(seed))
    prices = spark.createDataFrame(data, "symbol string, date date, close double, volume bigint")
    days = [(s, DAY0 + timedelta(days=k)) for s in ("S1", "S2") for k in range(-20, 420, 3)]
    events = spark.createDataFrame(days, "symbol string, published_day date")
    legs = P.dated_legs(prices, "SPY", forward=[1, 4], backward=[2], to_last=True)
    got = {(r["symbol"], r["published_day"]): r for r in P.guarded_entries(events, legs).collect()}
    series = by_symbol(data)
    bench = series["SPY"]

    def bench_leg(d0, d1):
        i0, i1 = entry(bench, d0), entry(bench, d1)
        if i0 is None or i1 is None or i1 <= i0:
            return None
        return ret(bench[i0][1], bench[i1][1])

    assert len(got) == len(days)
    for s, day in days:
        r, own = got[s, day], series[s]
        i = entry(own, day)
        if i is None or (own[i][0] - day).days > 7:
            assert r["entry_date"] is None and r["ret_1"] is None
            continue
        assert (r["entry_date"], r["entry_close"]) == own[i]

        def leg(i0, i1):
            if i0 < 0 or i1 >= len(own) or i1 <= i0:
                return None, None
            return ret(own[i0][1], own[i1][1]), bench_leg(own[i0][0], own[i1][0])

        for cols, span in ((("ret_1", "bench_1"), (i, i + 1)), (("ret_4", "bench_4"), (i, i + 4)),
                           (("back_2", "bback_2"), (i - 2, i)),
                           (("ret_last", "bench_last"), (i, len(own) - 1))):
            assert (r[cols[0]], r[cols[1]]) == tuple(map(approx, leg(*span)))


def test_entries_neither_multiply_nor_shuffle_the_sessions(spark):
    """Legs stay where their window put them; rows without a symbol or a day, and repeated ones, are kept."""
    data = [("A", date(2024, 1, d), float(d)) for d in (2, 3, 12)] + [(None, date(2024, 1, 2), 5.0)]
    prices = spark.createDataFrame(data, "symbol string, date date, close double")
    asked = [("A", date(2024, 1, 1)), ("A", date(2024, 1, 1)), ("A", date(2024, 1, 4)), ("A", date(2024, 1, 6)),
             ("A", None), ("A", date(2024, 1, 13)), (None, date(2024, 1, 2)), ("B", date(2024, 1, 2))]
    days = spark.createDataFrame(asked, "symbol string, published_day date")
    found = P.guarded_entries(days, P.forward_returns(P.price_book(prices), [1]))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(((*r,) for r in found.select("symbol", "published_day", "entry_date", "ret_1").collect()), key=str)
    entries = {("A", date(2024, 1, 1)): (date(2024, 1, 2), 50.0), ("A", date(2024, 1, 6)): (date(2024, 1, 12), None)}
    assert got == sorted(((*a, *entries.get(a, (None, None))) for a in asked), key=str)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not any("ret_1" in line for line in plan.splitlines() if "Exchange" in line)


def test_next_session_and_latest(spark):
    data = gappy_prices(random.Random(9))
    prices = spark.createDataFrame(data, "symbol string, date date, close double, volume bigint")
    days = [(s, DAY0 + timedelta(days=k)) for s in ("S1", "S2", "NONE") for k in range(-5, 420, 2)]
    events = spark.createDataFrame(days, "symbol string, day date")
    got = {(r["symbol"], r["day"]): (r["entry_date"], r["entry_close"])
           for r in P.next_session(events, prices).collect()}
    series = by_symbol(data, with_null=True)
    for s, day in days:
        i = entry(series[s], day)
        assert got[s, day] == ((None, None) if i is None else series[s][i])
    assert {r[0]: (r[1], r[2]) for r in rows(P.latest_close(prices))} == {
        s: v[-1] for s, v in series.items() if v}


def test_price_book_indexes(spark):
    data = gappy_prices(random.Random(4))
    prices = spark.createDataFrame(data, "symbol string, date date, close double, volume bigint")
    wanted = spark.createDataFrame([("S1",), ("MISSING",), (None,)], "symbol string")
    got = sorted(rows(P.price_book(prices, wanted)))
    assert got == [("S1", d, c, i) for i, (d, c) in enumerate(by_symbol(data)["S1"])]


# --- periods ---------------------------------------------------------------------------------
def bucketed(spark, data):
    df = spark.createDataFrame(data, "day date, articles bigint, net_stance bigint")
    return [(r["unit"], r["period"], r["articles"], r["net_stance"])
            for r in bucket_by_time(df).orderBy("period").collect()]


def test_days_weeks_and_months(spark):
    d = date(2026, 9, 1)      # a Tuesday
    assert bucketed(spark, [(d, 1, 2), (d + timedelta(days=3), 2, -1)]) == [
        ("Day", d, 1, 2), ("Day", date(2026, 9, 2), 0, 0), ("Day", date(2026, 9, 3), 0, 0),
        ("Day", date(2026, 9, 4), 2, -1)]
    weeks = bucketed(spark, [(d, 1, 1), (date(2026, 9, 7), 1, 1), (date(2026, 9, 8), 1, 0),
                             (date(2026, 11, 1), 4, None)])
    assert weeks[0] == ("Week", date(2026, 9, 7), 2, 2)
    assert weeks[1] == ("Week", date(2026, 9, 14), 1, 0)
    assert weeks[-1] == ("Week", date(2026, 11, 2), 4, 0) and len(weeks) == 9
    months = bucketed(spark, [(d, 1, 1), (date(2027, 12, 31), 1, 1)])
    assert months[0][:2] == ("Month", d) and months[-1][1] == date(2027, 12, 1)
    assert len(months) == 16 and sum(m[2] for m in months) == 2


def test_outer_empty_days_are_dropped(spark):
    d = date(2026, 9, 1)
    got = bucketed(spark, [(d, 0, 0), (date(2026, 9, 2), 3, 1), (date(2026, 9, 5), 0, 0)])
    assert got == [("Day", date(2026, 9, 2), 3, 1)]
    assert bucketed(spark, []) == []
