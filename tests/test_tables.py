from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from conftest import SESSIONS, one, rows
from pyspark.sql import functions as F

from callbook.operators import merge as M
from callbook.plans import ingest as I
from callbook.plans import outcomes as O
from callbook.plans import upkeep as U
from callbook.plans.planning import pending_queue
from callbook.schemas import TABLES, TICKERS
from callbook.sources import tables as T
from callbook.streaming.ingest import after_price_load, start_ingest

SITE, HOST = "Daily Ledger", "https://www.example.com"


def page(title, tickers="NVDA", primary="NVDA", author="Ann"):
    return (f'<head><title>{title} | {SITE}</title><meta name="author" content="{author}">'
            f'<meta name="tickers" content="{tickers}"/>'
            f'<meta name="primary_tickers" content="{primary}"/></head><body>')


def path(i, month="01"):
    return f"/investing/2026/{month}/02/a{i}/"


def landed(spark, *pages):
    return spark.createDataFrame([(p, h, datetime(2026, 3, 1, 0, 0, n))
                                  for n, (p, h) in enumerate(pages)],
                                 "path string, html string, landed_ts timestamp")


@pytest.fixture
def root(spark, tmp_path):
    listings = spark.createDataFrame(
        [("NVDA", "Nvidia", "NASDAQ", False), ("AAPL", "Apple", "NASDAQ", False)],
        "ticker string, name string, exchange string, is_etf boolean")
    I.store_universe(spark, str(tmp_path), listings)
    return str(tmp_path)


def stored(spark, root, name):
    return T.read_table(spark, root, name)


# --- merges ------------------------------------------------------------------------------
def test_upsert_ignore_and_last(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (3, "c")], "k int, v string")
    assert sorted(rows(M.upsert_replace(old, new.distinct(), ["k"]))) == [
        (1, "a"), (2, "B"), (3, "c")]
    assert rows(M.insert_ignore(old, new, ["k"])) == [(3, "c")]
    seq = spark.createDataFrame([(1, 1, "x"), (1, 3, None), (1, 2, "y")], "k int, s int, v string")
    assert rows(M.last_per_key(seq, ["k"], "s")) == [(1, 3, None)]


def test_first_seen_is_the_earliest(spark):
    tick = spark.createDataFrame(
        [("A", None, None, None, date(2026, 1, 5), None), ("B", None, None, None, None, None),
         ("C", None, None, True, date(2026, 1, 1), None)], TICKERS)
    seen = spark.createDataFrame(
        [("A", date(2026, 1, 3)), ("A", date(2026, 1, 9)), ("B", date(2026, 1, 4)),
         ("D", date(2026, 1, 6)), ("D", None)], "ticker string, published_day date")
    got = {r["ticker"]: r["first_seen_day"] for r in M.upsert_first_seen(tick, seen).collect()}
    assert got == {"A": date(2026, 1, 3), "B": date(2026, 1, 4), "C": date(2026, 1, 1),
                   "D": date(2026, 1, 6)}


FRONTIER = "path string, state string, attempts int, last_error string"


def test_fetch_results_and_requeue(spark):
    f = spark.createDataFrame([(p, "pending", 0, None) for p in "abcdef"], FRONTIER)
    res = spark.createDataFrame([
        ("a", "ok", None), ("b", "gone", "404"), ("c", "failed", "x" * 400),
        ("d", "deferred", "later"), ("e", "throttled", "slow")],
        "path string, kind string, message string")
    got = {r["path"]: (r["state"], r["attempts"], r["last_error"])
           for r in M.apply_fetch_results(f, res).collect()}
    assert got == {"a": ("done", 1, None), "b": ("skipped", 1, "404"),
                   "c": ("failed", 1, "x" * 400), "d": ("pending", 0, "later"),
                   "e": ("pending", 0, "slow"), "f": ("pending", 0, None)}
    q = spark.createDataFrame([("a", "failed", 4, None), ("b", "failed", 5, None),
                               ("c", "done", 1, None)], FRONTIER)
    assert [r["state"] for r in M.requeue_failed(q).orderBy("path").collect()] == [
        "pending", "failed", "done"]
    assert rows(M.requeue_count(q)) == [(1,)]


def test_names(spark):
    tick = spark.createDataFrame([("A", None), ("B", "Own"), ("C", None)],
                                 "ticker string, name string")
    uni = spark.createDataFrame([("A", "Alpha"), ("B", "Beta")], "ticker string, name string")
    assert sorted(rows(M.backfill_names(tick, uni)), key=str) == [
        ("A", "Alpha"), ("B", "Own"), ("C", None)]
    assert rows(M.backfill_count(tick)) == [(2,)]


# --- stored tables -----------------------------------------------------------------------
def test_missing_tables_are_empty(spark, tmp_path):
    for name, (schema, _, _) in TABLES.items():
        df = T.read_table(spark, str(tmp_path), name)
        assert df.schema == schema and df.count() == 0


def test_older_files_gain_new_columns(spark, tmp_path):
    spark.createDataFrame([("A", "Alpha")], "ticker string, name string").write.parquet(
        f"{tmp_path}/tickers")
    r = one(T.read_table(spark, str(tmp_path), "tickers"))
    assert r["name"] == "Alpha" and r["history_from"] is None


def snapshot(spark, root, *names):
    skip = {"fetched_ts", "computed_ts", "discovered_ts", "enumerated_ts"}
    return {n: sorted(rows(stored(spark, root, n).drop(*skip)), key=repr) for n in names}


def test_storing_pages(spark, root):
    pages = landed(spark, (path(1), page("Is Nvidia a Buy?", "NVDA,AAPL,ZZZ")),
                   (path(2, "02"), page("Bad News for Apple", "AAPL", "AAPL")),
                   (path(3), page("A Closer Look", "", "")))
    I.store_pages(spark, root, pages, SITE, "landed_ts")
    arts = {r["path"]: r for r in stored(spark, root, "articles").collect()}
    assert {p: (r["stance"], r["ticker_count"], r["month"]) for p, r in arts.items()} == {
        path(1): ("buy_lean", 3, "2026-01"), path(2, "02"): ("warning", 1, "2026-02"),
        path(3): ("analysis", 0, "2026-01")}
    cov = {(r["ticker"], r["path"]): (r["is_primary"], r["verified"], r["source"])
           for r in stored(spark, root, "coverage").collect()}
    assert cov == {
        ("NVDA", path(1)): (True, True, "primary_meta"), ("AAPL", path(1)): (False, True, "meta"),
        ("ZZZ", path(1)): (False, False, "meta"),
        ("AAPL", path(2, "02")): (True, True, "primary_meta")}
    assert {r["ticker"]: r["first_seen_day"] for r in stored(spark, root, "tickers").collect()} == {
        "NVDA": date(2026, 1, 2), "AAPL": date(2026, 1, 2), "ZZZ": date(2026, 1, 2)}

    # The same pages again change nothing.
    names = ("articles", "coverage", "tickers", "frontier")
    before = snapshot(spark, root, *names)
    I.store_pages(spark, root, pages, SITE, "landed_ts")
    assert snapshot(spark, root, *names) == before

    # A page that comes back replaces all its coverage; other months stay untouched.
    I.store_pages(spark, root, landed(
        spark, (path(1), page("older")), (path(1), page("Time to Sell", "AAPL", "AAPL"))),
        SITE, "landed_ts")
    cov = {(r["ticker"], r["path"]) for r in stored(spark, root, "coverage").collect()}
    assert cov == {("AAPL", path(1)), ("AAPL", path(2, "02"))}
    assert stored(spark, root, "articles").filter(F.col("path") == path(1)).collect()[0][
        "stance"] == "sell"
    assert stored(spark, root, "articles").count() == 3

    # Coverage also goes when the page comes back without tickers.
    I.store_pages(spark, root, landed(spark, (path(1), page("x", "", ""))), SITE, "landed_ts")
    assert {r["path"] for r in stored(spark, root, "coverage").collect()} == {path(2, "02")}


def test_sitemaps_then_results(spark, root):
    body = "".join(f"<loc>{HOST}{p}</loc>" for p in (
        path(1) + "?x=1", path(1), path(2, "02"), "/about/", "/retirement/2026/01/02/r/"))
    pages = spark.createDataFrame([("2026/01", body)], "month string, body string")
    for _ in range(2):
        I.store_sitemaps(spark, root, pages, HOST)
    f = {r["path"]: r["state"] for r in stored(spark, root, "frontier").collect()}
    assert f == {path(1): "pending", path(2, "02"): "pending",
                 "/retirement/2026/01/02/r/": "skipped"}
    assert rows(stored(spark, root, "archive_months").select("month", "urls_found")) == [
        ("2026/01", 5)]
    assert [r["path"] for r in pending_queue(stored(spark, root, "frontier")).collect()] == [
        path(2, "02"), path(1)]
    I.store_results(spark, root, spark.createDataFrame(
        [(path(1), "failed", "boom")], "path string, kind string, message string"))
    I.store_pages(spark, root, landed(spark, (path(2, "02"), page("t"))), SITE, "landed_ts")
    f = {r["path"]: (r["state"], r["attempts"]) for r in stored(spark, root, "frontier").collect()}
    assert f[path(1)] == ("failed", 1) and f[path(2, "02")] == ("done", 1)


def test_outcomes_in_store(spark, root, market):
    T.rewrite(root, "coverage", market.coverage.withColumn("month", F.lit("undated")))
    T.rewrite(root, "tickers", market.tickers)
    half = str(SESSIONS[150])
    assert I.store_prices(spark, root, market.prices.filter(f"date <= '{half}'")) == 4 * 151 - 40
    assert rows(after_price_load(spark, root)) == [(5, 5)]
    I.store_prices(spark, root, market.prices.filter(f"date >= '{SESSIONS[140]}'"))
    assert stored(spark, root, "prices").count() == market.prices.count()
    assert rows(O.update_outcomes(spark, root)) == [(5, 5)]       # still maturing before
    assert rows(O.update_outcomes(spark, root)) == [(0, 0)]
    whole = O.compute_outcomes(market.coverage, market.tickers, market.prices)
    assert sorted(rows(stored(spark, root, "call_outcomes").select(whole.columns))) == sorted(rows(whole))
    assert rows(O.update_outcomes(spark, root, full=True)) == [(5, 5)]

    # One open call late in the series: earlier months and other symbols are not read.
    late = spark.createDataFrame([("RYE", SESSIONS[201])], "symbol string, published_day date")
    some = O.needed_prices(stored(spark, root, "prices"), late)
    assert {r["symbol"] for r in some.collect()} == {"RYE", "SPY"}
    assert some.agg(F.min("date")).first()[0] == SESSIONS[201]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert any("month#" in x.partition("PartitionFilters: [")[2].split("PushedFilters")[0]
               for x in plan.splitlines())


def test_relabel_in_store(spark, root):
    I.store_pages(spark, root, landed(spark, (path(1), page("Is Nvidia a Buy?")),
                                      (path(2), page("Time to Sell")),
                                      (path(3, "02"), page("x"))), SITE, "landed_ts")
    arts = stored(spark, root, "articles")
    stale = F.when(F.col("path") == path(1), "news").otherwise(F.col("stance"))
    T.rewrite(root, "articles", arts.withColumn("stance", stale))
    assert rows(U.store_relabel(spark, root)) == [("news -> buy_lean", 1)]
    assert rows(U.store_relabel(spark, root)) == []
    assert stored(spark, root, "articles").count() == 3


def test_runs(spark, root):
    runs = stored(spark, root, "runs")
    assert one(U.last_daily_day(runs, "America/New_York"))["day"] is None
    now = F.lit("2026-09-24 08:00:00").cast("timestamp")
    assert one(U.freshness(runs, now))["fresh"] is True
    done = spark.createDataFrame(
        [("daily", datetime(2026, 9, 23, 22, 45)), ("crawl", datetime(2026, 9, 24, 1, 59, 59))],
        "kind string, finished_ts timestamp")
    T.append(done, root, "runs")
    runs = stored(spark, root, "runs")
    assert one(U.last_daily_day(runs, "America/New_York"))["day"] == date(2026, 9, 23)
    assert one(U.freshness(runs, now))["fresh"] is False
    U.log_run(spark, root, "daily", F.current_timestamp(), 3, 9, "failed=0 gone=0")
    assert stored(spark, root, "runs").count() == 3
    assert one(U.freshness(stored(spark, root, "runs"), F.current_timestamp()))["fresh"] is True


def test_status(spark, root, market):
    got = dict(rows(U.status(market.articles, market.coverage, market.prices,
                             stored(spark, root, "universe"),
                             stored(spark, root, "archive_months"),
                             stored(spark, root, "frontier"))))
    assert got["articles"] == "5" and got["primary_tickers"] == "3" and got["universe"] == "2"
    assert got["price_rows"] == str(4 * len(SESSIONS) - 40) and got["stance buy"] == "1" and got["months"] == "0"


def test_csv_export(spark, tmp_path, market):
    T.write_csv(market.articles, f"{tmp_path}/out")
    back = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert back.columns == market.articles.columns and back.count() == 5


# --- stream ------------------------------------------------------------------------------
def write_json(folder, name, *pages):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"path": p, "html": h, "landed_ts": ts}) for p, h, ts in pages]
    (folder / name).write_text("\n".join(lines))


def test_streamed_pages_equal_a_batch(spark, root, tmp_path):
    land = tmp_path / "landing"
    write_json(land, "1.json", (path(1), page("Is Nvidia a Buy?"), "2026-03-01T00:00:00Z"),
               (path(2), page("first version"), "2026-03-01T00:00:00Z"))
    start_ingest(spark, str(land), root, SITE).awaitTermination(120)
    write_json(land, "2.json", (path(2), page("Time to Sell", "AAPL", "AAPL"), "2026-03-02T00:00:00Z"),
               (path(3, "02"), page("Why Apple Fell"), "2026-03-02T00:00:00Z"))
    start_ingest(spark, str(land), root, SITE).awaitTermination(120)
    streamed = snapshot(spark, root, "articles", "coverage")
    assert len(streamed["articles"]) == 3
    assert {r["path"]: r["stance"] for r in stored(spark, root, "articles").collect()} == {
        path(1): "buy_lean", path(2): "sell", path(3, "02"): "news"}

    other = str(tmp_path / "batch")
    I.store_universe(spark, other, stored(spark, root, "universe"))
    I.store_pages(spark, other, spark.read.schema(
        "path string, html string, landed_ts timestamp").json(str(land)), SITE, "landed_ts")
    assert snapshot(spark, other, "articles", "coverage") == streamed

    # A batch that is processed again, as after a failure, leaves the same rows.
    start_ingest(spark, str(land), root, SITE, checkpoint=str(tmp_path / "again")
                 ).awaitTermination(120)
    assert snapshot(spark, root, "articles", "coverage") == streamed


def test_batches_with_repeated_keys_and_replays(spark, root):
    pages = landed(spark, (path(1), page("Time to Sell", "AAPL", "AAPL")), (path(1), page("Is Nvidia a Buy?", "NVDA", "NVDA")))
    sitemap = spark.createDataFrame([("2026/01", f"<url><loc>{HOST}{path(1)}</loc></url>" * 2)], "month string, body string")
    first = I.store_sitemaps(spark, root, sitemap, HOST).first()[0]
    assert (first, I.store_sitemaps(spark, root, sitemap, HOST).first()[0]) == (1, 0)
    I.store_pages(spark, root, pages, SITE, "landed_ts")
    before = snapshot(spark, root, "articles", "coverage", "tickers", "frontier")
    assert len(before["articles"]) == 1 and len(before["frontier"]) == 1
    I.store_pages(spark, root, pages, SITE, "landed_ts")
    assert snapshot(spark, root, "articles", "coverage", "tickers", "frontier") == before
    quotes = spark.createDataFrame([("Q", date(2026, 1, 5), c, v, v) for c, v in ((1.0, 1), (2.0, 2))],
                                   "symbol string, date date, close double, volume bigint, seq bigint")
    I.store_prices(spark, root, quotes, "seq")
    assert [(r["close"], r["volume"]) for r in stored(spark, root, "prices").filter("symbol = 'Q'").collect()] == [(2.0, 2)]
    twice = spark.createDataFrame([(path(1), "failed", "a"), (path(1), "ok", None)], "path string, kind string, message string")
    I.store_results(spark, root, twice)
    assert stored(spark, root, "frontier").count() == 1


def test_windows_prune_months(spark, root):
    from callbook.plans import reports
    I.store_pages(spark, root, landed(spark, (path(1), page("a")), (path(2, "02"), page("b"))), SITE, "landed_ts")
    arts, cov = stored(spark, root, "articles"), stored(spark, root, "coverage")
    for df in (reports.top_tickers(cov, arts, stored(spark, root, "tickers"), "2026-02-01", "2026-02-28"),
               reports.author_table(arts, cov, "2026-02-01", "2026-02-28")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        pruned = [line for line in plan.splitlines() if "month#" in line.partition("PartitionFilters: [")[2].split("]")[0]]
        assert len(pruned) >= 2
