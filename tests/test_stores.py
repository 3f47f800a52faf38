"""Stored tables: versions, lost tables, batches that come again or late, counts of writes."""

from __future__ import annotations

import shutil
from datetime import date, datetime
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from callbook.operators import merge as M
from callbook.plans import ingest as I
from callbook.plans import upkeep as U
from callbook.schemas import TICKERS
from callbook.sources import tables as T

SITE = "Evening Post"
TICKER_ROWS = [("KLM", "Kilim", "KLM", False, date(2025, 3, 4), date(2024, 1, 1)),
               ("OPQ", None, None, True, date(2025, 3, 6), None)]


@pytest.fixture
def root(spark, tmp_path):
    T.rewrite(str(tmp_path), "tickers", spark.createDataFrame(TICKER_ROWS, TICKERS))
    return str(tmp_path)


def tickers(spark, root):
    return sorted(rows(T.read_table(spark, root, "tickers")))


def test_a_write_that_fails_leaves_the_old_rows(spark, root):
    broken = T.read_table(spark, root, "tickers").withColumn(
        "name", F.when(F.col("ticker") == "OPQ", F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        T.rewrite(root, "tickers", broken)
    assert tickers(spark, root) == TICKER_ROWS
    # Nor does one whose rows are complete but that died before they were in use.
    spark.createDataFrame([], TICKERS).write.parquet(f"{root}/tickers/{T.VERSION.format(99)}")
    assert tickers(spark, root) == TICKER_ROWS
    assert T.rewrite(root, "tickers", T.read_table(spark, root, "tickers").limit(1)) == 1
    assert len(tickers(spark, root)) == 1


def test_a_first_write_that_fails_leaves_an_empty_table(spark, tmp_path):
    root = str(tmp_path)
    broken = spark.createDataFrame(TICKER_ROWS, TICKERS).withColumn("name", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        T.rewrite(root, "tickers", broken)
    assert tickers(spark, root) == []
    assert T.rewrite(root, "tickers", spark.createDataFrame(TICKER_ROWS, TICKERS)) == 2
    assert tickers(spark, root) == TICKER_ROWS


def test_a_merge_into_months_writes_its_rows_once(spark, tmp_path, monkeypatch):
    """Rows may be read from the months that they replace; other months stay as they are."""
    root = str(tmp_path)
    quotes = [("A", date(2024, 1, 2), 1.0, 1), ("A", date(2024, 2, 1), 2.0, 1), ("B", date(2024, 1, 3), 3.0, 1)]
    prices = spark.createDataFrame(quotes, "symbol string, date date, close double, volume long").withColumn(
        "month", F.date_format("date", "yyyy-MM"))
    monkeypatch.setattr(T, "settle_counted", lambda df: pytest.fail("written twice"))
    assert T.rewrite(root, "prices", prices) == 3
    january = T.read_table(spark, root, "prices").filter("month = '2024-01'")
    assert T.rewrite(root, "prices", january.withColumn("close", F.col("close") * 10)) == 2
    assert T.rewrite(root, "prices", prices.filter("symbol = 'none'")) == 0
    got = T.read_table(spark, root, "prices").select("symbol", "date", "close", "volume")
    assert sorted(rows(got)) == [("A", date(2024, 1, 2), 10.0, 1), ("A", date(2024, 2, 1), 2.0, 1),
                                 ("B", date(2024, 1, 3), 30.0, 1)]


def test_a_lost_table_is_an_error(spark, root):
    shutil.rmtree(f"{root}/tickers")
    with pytest.raises(T.LostTable):
        T.read_table(spark, root, "tickers")
    I.store_prices(spark, root, spark.createDataFrame(
        [("KLM", date(2025, 3, 4), 7.5, 3)], "symbol string, date date, close double, volume bigint"))
    shutil.rmtree(f"{root}/prices")
    with pytest.raises(T.LostTable):
        T.read_table(spark, root, "prices")


def test_only_the_last_versions_stay(spark, root):
    for _ in range(4):
        T.rewrite(root, "tickers", T.read_table(spark, root, "tickers"))
    assert len(list(Path(root, "tickers").iterdir())) == 1 + T.OLDER_VERSIONS
    assert tickers(spark, root) == TICKER_ROWS


def test_rows_of_a_folder_without_versions(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame(TICKER_ROWS, TICKERS).write.parquet(f"{root}/tickers")
    assert tickers(spark, root) == TICKER_ROWS
    T.rewrite(root, "tickers", T.read_table(spark, root, "tickers"))
    assert tickers(spark, root) == TICKER_ROWS


# --- batches --------------------------------------------------------------------------------------
def at(hour, minute=0):
    return datetime(2025, 3, 7, hour, minute)


RESULT = "path string, kind string, message string, at timestamp"
PATHS = [f"/investing/2025/0{m}/0{d}/{n}/" for m, d, n in ((3, 1, "one"), (3, 2, "two"), (4, 3, "three"), (4, 4, "four"))]


@pytest.fixture
def queue(spark, tmp_path):
    root = str(tmp_path)
    T.append(spark.createDataFrame([(p, "investing", "pending", 0, p[11:15] + "-" + p[16:18]) for p in PATHS],
                                   "path string, section string, state string, attempts int, month string"), root, "frontier")
    return root


def states(spark, root):
    return {r["path"]: (r["state"], r["attempts"], r["last_error"])
            for r in T.read_table(spark, root, "frontier").collect()}


def test_results_count_once_and_old_ones_never_win(spark, queue):
    one, two, three, four = PATHS
    early = spark.createDataFrame([(one, "failed", "slow", at(8)), (two, "gone", "404", at(8)),
                                   (three, "failed", "slow", at(8)), (four, "deferred", "later", at(8))], RESULT)
    late = spark.createDataFrame([(one, "ok", None, at(9)), (three, "failed", "again", at(9)),
                                  (three, "throttled", "wait", at(8, 30))], RESULT)
    I.store_results(spark, queue, early, "at")
    once = states(spark, queue)
    assert once == {one: ("failed", 1, "slow"), two: ("skipped", 1, "404"), three: ("failed", 1, "slow"),
                    four: ("pending", 0, "later")}
    I.store_results(spark, queue, early, "at")
    assert states(spark, queue) == once
    I.store_results(spark, queue, late, "at")
    both = states(spark, queue)
    assert both == once | {one: ("done", 1 + 1, "slow"), three: ("failed", 2, "again")}
    for batch in (early, late, early):      # in any order, as often as you like
        I.store_results(spark, queue, batch, "at")
        assert states(spark, queue) == both
    # What is done stays done, also when a later fetch fails.
    I.store_results(spark, queue, spark.createDataFrame([(one, "failed", "x", at(11))], RESULT), "at")
    assert states(spark, queue) == both


def test_named_batches_count_once_without_times(spark, queue):
    failed = spark.createDataFrame([(PATHS[0], "failed", "slow")], "path string, kind string, message string")
    assert I.store_results(spark, queue, failed, batch="a") > 0
    assert I.store_results(spark, queue, failed, batch="a") == 0
    assert states(spark, queue)[PATHS[0]] == ("failed", 1, "slow")
    I.store_results(spark, queue, failed, batch="b")
    assert states(spark, queue)[PATHS[0]] == ("failed", 2, "slow")


def html(title, tickers):
    return (f'<html><head><title>{title} | {SITE}</title><meta name="author" content="Q"/>'
            f'<meta name="tickers" content="{tickers}"/><meta name="primary_tickers" content="{tickers}"/></head>')


def landed(spark, *pages):
    return spark.createDataFrame(list(pages), "path string, html string, landed_ts timestamp")


def all_of(spark, root):
    return {n: sorted(rows(T.read_table(spark, root, n)), key=repr)
            for n in ("articles", "coverage", "tickers", "frontier")}


def test_pages_out_of_order(spark, tmp_path):
    new = landed(spark, (PATHS[0], html("A Second Look", "OPQ"), at(10)), (PATHS[2], html("Three", ""), at(10)))
    old = landed(spark, (PATHS[0], html("A First Look", "KLM"), at(9)), (PATHS[1], html("Two", "KLM"), at(9)))
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    assert I.store_pages(spark, a, old, SITE, "landed_ts", keep_newer=True) == I.Stored(2, 2)
    assert I.store_pages(spark, a, new, SITE, "landed_ts", keep_newer=True) == I.Stored(2, 1)
    assert I.store_pages(spark, b, new, SITE, "landed_ts", keep_newer=True) == I.Stored(2, 1)
    assert I.store_pages(spark, b, old, SITE, "landed_ts", keep_newer=True) == I.Stored(1, 1)
    done = all_of(spark, a)
    assert done == all_of(spark, b)
    assert [r[1] for r in done["articles"] if r[0] == PATHS[0]] == ["A Second Look"]
    assert {r[0] for r in done["coverage"] if r[1] == PATHS[0]} == {"OPQ"}
    I.store_pages(spark, b, old, SITE, "landed_ts", keep_newer=True)
    assert all_of(spark, b) == done


def test_a_noted_batch_is_skipped_and_its_counts_go_to_the_log(spark, tmp_path):
    root = str(tmp_path)
    pages = landed(spark, (PATHS[0], html("One", "KLM,OPQ"), at(9)), (PATHS[3], html("Four", "KLM"), at(9)))
    stored = I.store_pages(spark, root, pages, SITE, "landed_ts", batch="first")
    assert stored == I.Stored(2, 3)
    assert I.store_pages(spark, root, pages, SITE, "landed_ts", batch="first") == I.Stored()
    U.log_run(spark, root, "daily", F.current_timestamp(), stored.articles, stored.coverage, "")
    assert rows(T.read_table(spark, root, "runs").select("articles_new", "coverage_new")) == [(2, 3)]
    assert rows(T.read_table(spark, root, "batches").select("batch", "kind", "rows")) == [("first", "pages", 2)]


def test_last_row_of_equal_times_is_the_same_every_time(spark):
    twin = [("k", 1, "b", 2), ("k", 1, "a", 9), ("k", 1, "b", 1), ("l", 0, None, 1)]
    want = [("k", 1, "b", 2), ("l", 0, None, 1)]
    for given in (twin, twin[::-1], twin[2:] + twin[:2]):
        df = spark.createDataFrame(given, "key string, seq int, v string, n int").repartition(3)
        assert sorted(rows(M.last_per_key(df, ["key"], "seq"))) == want


def test_only_pages_later_than_the_stored_ones_are_labelled(spark, tmp_path, monkeypatch):
    root, labelled, article_rows = str(tmp_path), [], I.article_rows

    def noted(heads, coverage):
        labelled.append(sorted(r["path"] for r in heads.select("path").collect()))
        return article_rows(heads, coverage)

    monkeypatch.setattr(I, "article_rows", noted)
    first = landed(spark, (PATHS[0], html("One", "OPQ"), at(10)), (PATHS[1], html("Two", "OPQ"), at(10)))
    late = landed(spark, (PATHS[0], html("Old", "KLM,OPQ"), at(9)), (PATHS[1], html("Two", "OPQ"), at(10)),
                  (PATHS[2], html("Three", ""), at(9)), (PATHS[2], html("Three", "RST"), at(8)))
    assert I.store_pages(spark, root, first, SITE, "landed_ts", keep_newer=True) == I.Stored(2, 2)
    before = all_of(spark, root)
    assert I.store_pages(spark, root, late, SITE, "landed_ts", keep_newer=True) == I.Stored(1, 0)
    assert labelled == [sorted(PATHS[:2]), [PATHS[2]]]
    done = all_of(spark, root)
    assert done["coverage"] == before["coverage"] and set(before["articles"]) < set(done["articles"])
    # What an older page names is a ticker all the same.
    assert [r[0] for r in done["tickers"]] == ["KLM", "OPQ"]


def test_a_batch_without_a_later_page_rewrites_no_month(spark, tmp_path):
    root = str(tmp_path)
    pages = landed(spark, (PATHS[0], html("One", "KLM"), at(10)), (PATHS[3], html("Four", "KLM"), at(10)))
    I.store_pages(spark, root, pages, SITE, "landed_ts", keep_newer=True)
    files = [T.read_table(spark, root, n).inputFiles() for n in ("articles", "coverage")]
    assert I.store_pages(spark, root, pages, SITE, "landed_ts", keep_newer=True) == I.Stored()
    assert [T.read_table(spark, root, n).inputFiles() for n in ("articles", "coverage")] == files
