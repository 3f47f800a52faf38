from __future__ import annotations

import json
from datetime import date, datetime

from conftest import one, rows
from pyspark.sql import functions as F

from callbook.sources import articles as A
from callbook.sources import charts, listings, sitemaps

SITE = "Daily Ledger"
HEAD = """
<!doctype html><html lang="en"><head><meta charset="utf-8">
<meta property="og:title" content="Salt &amp; Tin: &quot;What Next&quot;   After the Thaw | Daily Ledger">
<title>Salt and Tin After the Thaw | Daily Ledger</title>
<meta name="primary_tickers" content="PEAT,TINW">
<meta name="tickers" content="TINW,TINW, ryef,FLAX,HAYA">
<meta name="description" content="Ore &lt;and&gt; ice."><META name="Description" content="Later words.">
<meta name="author" content="Ida Quill">
</head><body><p>text</p><meta name="tickers" content="BODY"></body></html>
"""


def universe(spark):
    return spark.createDataFrame(
        [(t,) for t in ["TINW", "RYEF", "HAY.A", "HAY.B", "FLAX", "OATS", "MOSS"]], "ticker string")


def test_listing_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(
        "Symbol|Security Name|Test Issue|ETF\n"
        "AAA|Alpha One|N|N\nAAA|Alpha Two|N|Y\nTEST|A Test|Y|N\nBAD5|Digits|N|N\n"
        "BR.B|Share Class|N|N\nSHORT\nEMPTY||N|N\nDUP|First File|N|N\n"
        "File Creation Time: 1234|||\n")
    (tmp_path / "b.txt").write_text(
        "ACT Symbol|Security Name|Exchange|ETF|Test Issue\n"
        "DUP|Second File|N|N|N\nbbb|Beta \"Quoted| P |Y|N\n")
    got = {r["ticker"]: (r["name"], r["exchange"], r["is_etf"]) for r in listings.read_universe(
        spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).collect()}
    assert got == {
        "AAA": ("Alpha Two", "NASDAQ", True), "BR.B": ("Share Class", "NASDAQ", False),
        "EMPTY": ("", "NASDAQ", False), "DUP": ("Second File", "N", False),
        "BBB": ('Beta "Quoted', "P", True)}


def test_chart_files(spark, tmp_path):
    def doc(ts, close, volume, offset=-18000):
        return json.dumps({"chart": {"result": [{
            "meta": {"gmtoffset": offset, "currency": "USD"}, "timestamp": ts,
            "indicators": {"quote": [{"close": close, "volume": volume, "open": [1]}]}}]}})

    evening = int(datetime(2026, 9, 24, 2).timestamp()) - int(datetime(1970, 1, 1).timestamp())
    (tmp_path / "HAY-B.json").write_text(doc(
        [evening, evening + 86400, evening + 2 * 86400], [10.123456, None, 12.0], [5, 6]))
    (tmp_path / "NONE.json").write_text(json.dumps({"chart": {"result": None}}))
    (tmp_path / "BARE.json").write_text(json.dumps({"chart": {"result": [
        {"timestamp": [0], "indicators": {"quote": [{"close": [1.5]}]}}]}}))
    landed = charts.read_chart_files(spark, str(tmp_path))
    assert sorted(rows(charts.parse_charts(landed))) == [
        ("BARE", date(1970, 1, 1), 1.5, 0),
        ("HAY-B", date(2026, 9, 23), 10.1235, 5), ("HAY-B", date(2026, 9, 25), 12.0, 0)]
    assert rows(charts.symbols_without_data(landed)) == [("NONE",)]


def test_sitemap_files(spark, tmp_path):
    (tmp_path / "m.xml").write_text(
        "<urlset>\n<url><loc>https://h/a</loc></url>\n<url><loc>https://h/sitemap/2026/08</loc>"
        "</url><url><loc>https://h/sitemap/2025/12/</loc><loc>https://h/sitemap/2026/08</loc>"
        "</url></urlset>")
    pages = sitemaps.read_sitemap_files(spark, str(tmp_path))
    assert [r["url"] for r in sitemaps.sitemap_urls(pages).orderBy("pos").collect()] == [
        "https://h/a", "https://h/sitemap/2026/08", "https://h/sitemap/2025/12/",
        "https://h/sitemap/2026/08"]
    assert rows(sitemaps.available_months(pages)) == [("2025/12",), ("2026/08",)]
    counts = sitemaps.month_url_counts(pages.withColumn("month", F.lit("2026/08")))
    assert rows(counts) == [("2026/08", 4)]


def parsed(spark, head=HEAD):
    landed = spark.createDataFrame([("/markets/2027/02/03/salt-and-tin/", head)],
                                   "path string, html string")
    return A.parse_heads(landed.withColumn("html", A.head_of(F.col("html"))), SITE)


def test_head_metadata(spark):
    r = one(parsed(spark))
    assert r["title"] == 'Salt & Tin: "What Next" After the Thaw'
    assert r["author"] == "Ida Quill" and r["description"] == "Ore <and> ice."
    assert r["section"] == "markets" and r["published_day"] == date(2027, 2, 3)
    assert r["published_ts"] == datetime(2027, 2, 3)


def test_tickers_once_each_in_order_primary_last(spark):
    found = A.head_tickers(parsed(spark), universe(spark)).orderBy("pos")
    assert [(r["ticker"], r["is_primary"], r["verified"]) for r in found.collect()] == [
        ("TINW", True, True), ("RYEF", False, True), ("FLAX", False, True),
        ("HAY.A", False, True), ("PEAT", True, False)]


def test_titles(spark):
    plain = HEAD.replace('property="og:title"', 'property="other"')
    assert one(parsed(spark, plain))["title"] == "Salt and Tin After the Thaw"
    empty = HEAD.replace("Salt &amp; Tin: &quot;What Next&quot;   After the Thaw | Daily Ledger", "")
    assert one(parsed(spark, empty))["title"] == ""
    bare = one(parsed(spark, "<p>no head</p>"))
    assert (bare["title"], bare["author"], bare["raw_tickers"]) == ("", "", "")


def test_head_cut(spark):
    df = spark.createDataFrame(
        [("a</HEAD>b</head>c",), ("x" * 30_000,), (None,)], "h string")
    assert [r[0] for r in rows(df.select(A.head_of(F.col("h"))))] == [
        "a</HEAD>", "x" * 30_000, None]
