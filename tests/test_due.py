"""The index of open calls: what a run reads, and that it equals a full run."""

from __future__ import annotations

import os
import random
from pathlib import Path

import pytest
from conftest import SESSIONS, rows
from pyspark.sql import functions as F

from callbook.plans import ingest as I
from callbook.plans import outcomes as O
from callbook.sources import tables as T


def load(spark, m, root, upto, since=0, symbols=None):
    prices = m.prices.filter(f"date <= DATE'{SESSIONS[upto]}' AND date >= DATE'{SESSIONS[since]}'")
    I.store_prices(spark, root, prices if symbols is None else prices.filter(F.col("symbol").isin(symbols)))


def add_coverage(spark, m, root, start):
    """Store the articles from a number on, filed under the month in their path."""
    cov = spark.createDataFrame(m.coverage_rows[start:], m.coverage.schema).withColumn(
        "month", F.date_format("published_day", "yyyy-MM"))
    old = T.touched(T.read_table(spark, root, "coverage"), cov, "month")
    T.rewrite(root, "coverage", old.unionByName(cov.select(*old.columns)))


def outcomes(spark, root):
    return sorted(rows(T.read_table(spark, root, "call_outcomes").drop("computed_ts", "month")), key=str)


def whole(m, upto):
    prices = m.prices.filter(f"date <= DATE'{SESSIONS[upto]}'")
    return sorted(rows(O.compute_outcomes(m.coverage, m.tickers, prices)), key=str)


@pytest.fixture
def calls(market):
    rng = random.Random(41)
    market.article_rows.clear(), market.coverage_rows.clear()
    for i in range(60):
        day = SESSIONS[rng.randrange(250)]
        market.add(f"/investing/{day:%Y/%m/%d}/c{i}/", "x", day, 1, rng.choice(["TIN", "RYE", "FLAX", "OAT"]))
    market.coverage_rows.sort(key=lambda r: r[2])
    return market


def test_every_run_equals_a_full_one(spark, tmp_path, calls):
    """Coverage and prices arrive in turns, one symbol late, one ticker gets its symbol late."""
    root, known = str(tmp_path), 0
    T.rewrite(root, "tickers", calls.tickers)
    all_rows = list(calls.coverage_rows)
    for upto, n in ((20, 8), (21, 8), (70, 25), (140, 40), (141, 40), (300, 60), (319, 60)):
        calls.coverage_rows = all_rows[:n]
        if n > known:
            add_coverage(spark, calls, root, known)
            known = n
        if upto == 141:
            calls.ticker_rows.append(("OAT", None, "TIN", False, None, None))
            T.rewrite(root, "tickers", calls.tickers)
        load(spark, calls, root, upto, symbols=["SPY", "TIN", "FLAX"])
        O.update_outcomes(spark, root)
        load(spark, calls, root, upto, symbols=["RYE"])       # the same day again, with the symbol that was late
        O.update_outcomes(spark, root)
        assert outcomes(spark, root) == whole(calls, upto), upto
    before = outcomes(spark, root)
    O.update_outcomes(spark, root, full=True)
    assert outcomes(spark, root) == before


def test_a_run_reads_new_months_and_due_calls_only(spark, tmp_path, calls):
    root = str(tmp_path)
    T.rewrite(root, "tickers", calls.tickers)
    late = [r for r in calls.coverage_rows if r[2] >= SESSIONS[200]]
    calls.coverage_rows = [r for r in calls.coverage_rows if r[2] < SESSIONS[60]]
    add_coverage(spark, calls, root, 0)
    load(spark, calls, root, 318)
    O.update_outcomes(spark, root)
    # Files of the months that are done are spoilt; whoever opens one of them fails.
    for table in ("coverage", "call_outcomes"):
        for file in Path(root, table).rglob("*.parquet"):
            stat = file.stat()
            file.write_bytes(b"spoilt")
            os.utime(file, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    waiting = {r["ticker"] for r in T.read_table(spark, root, "open_calls").collect()}
    assert waiting <= {"OAT", "FLAX"}
    for month in T.partitions(spark, root, "open_calls"):       # they wait for a symbol or an entry, here for good
        T.drop_partitions(spark, root, "open_calls", [month])
    T.append(spark.createDataFrame([("/p/", "NONE", SESSIONS[0], SESSIONS[-1], f"{SESSIONS[-1]:%Y-%m}")],
                                   "path string, ticker string, published_day date, due date, due_month string"), root, "open_calls")
    n = len(calls.coverage_rows)
    calls.coverage_rows += late
    add_coverage(spark, calls, root, n)
    load(spark, calls, root, 319, 300)
    scored = [r for r in late if r[0] != "OAT"]
    assert rows(O.update_outcomes(spark, root)) == [(len(scored), len(scored))]
    open_now = T.read_table(spark, root, "open_calls").filter("ticker NOT IN ('OAT', 'NONE')")
    assert open_now.count() == len(scored) and open_now.filter(F.col("due") <= F.lit(SESSIONS[-1])).isEmpty()


def test_nothing_is_lost_without_prices_or_benchmark(spark, tmp_path, calls):
    root = str(tmp_path)
    T.rewrite(root, "tickers", calls.tickers)
    add_coverage(spark, calls, root, 0)
    assert rows(O.update_outcomes(spark, root)) == [(0, 0)]
    load(spark, calls, root, 319, symbols=["TIN", "RYE", "FLAX"])
    assert rows(O.update_outcomes(spark, root)) == [(0, 0)]
    load(spark, calls, root, 319, symbols=["SPY"])
    O.update_outcomes(spark, root)
    assert outcomes(spark, root) == whole(calls, 319)
