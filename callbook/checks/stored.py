"""Stored forms: tables written to a fresh folder, merged again, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callbook.checks.domain import HOST, SITE
from callbook.checks.registry import ORACLES, check, rounded
from callbook.checks.merges import _OLD, _stale
from callbook.checks.studies import _RETURNS
from callbook.functions.dates import local_day
from callbook.operators import merge as M
from callbook.plans import ingest as I
from callbook.plans import upkeep as U
from callbook.plans.outcomes import track_record, update_outcomes
from callbook.plans.reports import ticker_summary
from callbook.session import ensure_checkpoint_dir
from callbook.sources import tables as T
from callbook.sources.bucketed import read_bucketed, store_bucketed
from callbook.sources.listings import read_universe
from callbook.streaming.ingest import start_ingest
from callbook.checks import reports, sources, studies  # noqa: F401  their SQL is compared with the stored forms too
from callbook.checks.prelude import PRELUDE


def folder_of(spark: SparkSession) -> str:
    """A fresh folder that all executors reach."""
    return f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"


def sql_of(name: str) -> str:
    """The SQL of another query, without the prelude."""
    return ORACLES[name].removeprefix(PRELUDE)


def stamped(d) -> DataFrame:
    """Landed pages with the time that they landed at."""
    key = F.regexp_extract("path", r"/o(\d+)/$", 1).cast("bigint")
    return d.landed.withColumn("landed_ts", F.timestamp_seconds(1_700_000_000 + key % 1000)) \
        .withColumn("turn", (key % 3).cast("int"))


def older(pages: DataFrame) -> DataFrame:
    """Another page of each path, of a day before; its title is not the last one."""
    return pages.withColumn("landed_ts", F.col("landed_ts") - F.expr("INTERVAL 1 DAY")).withColumn(
        "html", F.regexp_replace("html", '<meta name="tickers" content="[^"]*"/>',
                                 '<meta name="tickers" content="AAAA,BBBB"/>'))


# --- Q13, ST1 -----------------------------------------------------------------------------------
@check("stored_articles", sql_of("ingest_articles"))
def stored_articles(d):
    """Pages in two batches that overlap, the first one again, then pages of the day before."""
    root, pages = folder_of(d.spark), stamped(d)
    I.store_universe(d.spark, root, d.universe)
    first, rest = pages.filter("turn < 2").drop("turn"), pages.filter("turn > 0").drop("turn")
    for name, batch in (("a", first), ("b", rest), ("a", first), ("c", first),
                        ("d", older(pages.filter("turn = 1").drop("turn")))):
        I.store_pages(d.spark, root, batch, SITE, "landed_ts", batch=name, keep_newer=True)
    return T.read_table(d.spark, root, "articles").drop("published_ts", "fetched_ts", "month")


#: Pages that one landed file holds, about.
LANDED_ROWS = 1_000_000


def land(pages: DataFrame, folder: str, files: int = 2) -> None:
    """More files of pages, which are made by all tasks before."""
    pages.repartition(files).write.mode("append").json(folder)


@check("stream_coverage", sql_of("ingest_coverage"))
def stream_coverage(d):
    """Landed files streamed in small batches, old pages before and after new ones; then all of
    them again by a stream that has forgotten what it read."""
    spark, root = d.spark, folder_of(d.spark)
    pages = stamped(d)
    I.store_universe(spark, root, d.universe)
    # Two files of each kind and three in a batch, or as many times that as many pages need.
    times = max(1, -(-d.headlines.count() // (3 * LANDED_ROWS)))
    for part in (older(pages.filter("turn = 0")), pages.filter("turn < 2"), older(pages.filter("turn = 1")),
                 pages.filter("turn = 2")):
        land(part.drop("turn"), f"{root}/landing", 2 * times)
    for run in ("once", "again"):
        start_ingest(spark, f"{root}/landing", root, SITE, checkpoint=f"{root}/{run}",
                     files_per_batch=3 * times).awaitTermination()
    return T.read_table(spark, root, "coverage").drop("month")


# --- K2, K6, K1, K9 ---------------------------------------------------------------------------------
@check("stored_results", """
, results AS (SELECT path, CASE WHEN key % 5 = 0 THEN 'ok' WHEN key % 5 = 1 THEN 'gone' WHEN key % 5 = 2 THEN 'failed'
   WHEN key % 5 = 3 THEN 'deferred' ELSE 'none' END AS kind FROM headlines)
SELECT path, CASE kind WHEN 'ok' THEN 'done' WHEN 'gone' THEN 'skipped' WHEN 'failed' THEN 'failed'
    ELSE CASE section WHEN 'investing' THEN 'pending' ELSE 'skipped' END END AS state,
  CASE kind WHEN 'failed' THEN 2 WHEN 'ok' THEN 2 WHEN 'gone' THEN 2 ELSE 0 END AS attempts,
  CASE kind WHEN 'ok' THEN 'early' WHEN 'gone' THEN 'late' WHEN 'failed' THEN 'late' WHEN 'deferred' THEN 'late'
  END AS last_error
FROM frontier JOIN results USING (path) JOIN (SELECT path, key FROM headlines) USING (path)""")
def stored_results(d):
    """An early batch, a late one, and both again in the other order."""
    root, pages = folder_of(d.spark), d.headlines
    I.store_sitemaps(d.spark, root, d.sitemap_pages, HOST)
    number = F.col("key") % 5
    kinds = F.when(number == 0, "ok").when(number == 1, "gone").when(number == 2, "failed").when(
        number == 3, "deferred")

    def batch(kind, note, hour):
        return pages.select("path", kind.alias("kind"), F.lit(note).alias("message"),
                            F.timestamp_seconds(F.lit(hour * 3600)).alias("at")).filter("kind IS NOT NULL")

    early = batch(F.when(number < 3, "failed").when(number == 3, "throttled"), "early", 1)
    late = batch(kinds, "late", 2)
    for results in (early, late, late, early):
        I.store_results(d.spark, root, results, "at")
    return T.read_table(d.spark, root, "frontier").select("path", "state", "attempts", "last_error")


@check("stored_sitemaps", """
SELECT 'first' AS run, count(*) FILTER (order_state = 'F') AS added FROM headlines
UNION ALL SELECT 'second', count(*) FILTER (order_state <> 'F') FROM headlines
UNION ALL SELECT 'third', 0""")
def stored_sitemaps(d):
    """New frontier rows of each run, counted as they are written."""
    root = folder_of(d.spark)
    month = F.date_format("published_day", "yyyy/MM").alias("month")
    body = F.concat(F.lit(f"<urlset><url><loc>{HOST}"), "path", F.lit("</loc></url></urlset>")).alias("body")
    pages = d.headlines.select(month, body, "order_state")
    runs = [(name, I.store_sitemaps(d.spark, root, part.drop("order_state"), HOST).first()["added"])
            for name, part in (("first", pages.filter("order_state = 'F'")), ("second", pages), ("third", pages))]
    return d.spark.createDataFrame(runs, "run string, added bigint")


@check("stored_prices", "SELECT symbol, date, close, volume FROM prices")
def stored_prices(d):
    """Quotes in two halves that overlap, the first with other volumes."""
    root = folder_of(d.spark)
    I.store_prices(d.spark, root, d.prices.filter("date < '1996-07-01'").withColumn("volume", F.col("volume") + 1))
    I.store_prices(d.spark, root, d.prices)
    return T.read_table(d.spark, root, "prices").drop("month")


@check("stored_relabel", _OLD + """
SELECT old || ' -> ' || stance AS move, count(*) AS n FROM stale
WHERE old <> stance GROUP BY 1 ORDER BY n DESC, move LIMIT 15""")
def stored_relabel(d):
    root = folder_of(d.spark)
    T.rewrite(root, "articles", _stale(d).withColumn("month", F.date_format("published_day", "yyyy-MM")))
    return U.store_relabel(d.spark, root)


@check("stored_names", """
SELECT t.ticker, coalesce(t.name, u.name) AS name, (SELECT count(*) FROM tickers WHERE name IS NULL) AS updated
FROM tickers t LEFT JOIN universe u ON u.ticker = t.ticker""")
def stored_names(d):
    """Listings stored twice; the names that tickers lacked, and how many there were (K8)."""
    root = folder_of(d.spark)
    T.rewrite(root, "tickers", d.tickers)
    updated = I.store_universe(d.spark, root, d.universe).first()["updated"]
    I.store_universe(d.spark, root, d.universe)
    return T.read_table(d.spark, root, "tickers").select("ticker", "name", F.lit(updated).alias("updated"))


# --- ST2 ----------------------------------------------------------------------------------------------
@check("stored_outcomes", sql_of("call_outcomes"))
def stored_outcomes(d):
    """Outcomes scored as prices arrive: until the end of 1996, a quarter more, all, and nothing new."""
    spark, root = d.spark, folder_of(d.spark)
    T.rewrite(root, "coverage", d.coverage.withColumn("month", F.date_format("published_day", "yyyy-MM")))
    T.rewrite(root, "tickers", d.tickers)
    for until in ("1996-12-31", "1997-03-31", "9999-12-31"):
        I.store_prices(spark, root, d.prices.filter(F.col("date") <= until))
        update_outcomes(spark, root)
    update_outcomes(spark, root)
    return rounded(T.read_table(spark, root, "call_outcomes").drop("computed_ts", "month"), *_RETURNS)


# --- K5, K11, D3 -----------------------------------------------------------------------------------------
@check("run_log", """
SELECT kind, count(*) AS runs, CAST(sum(articles) AS BIGINT) AS articles_new FROM (
  SELECT 'daily' AS kind, count(*) FILTER (section = 'investing') AS articles FROM headlines
  UNION ALL SELECT 'backfill', count(*) FILTER (section <> 'investing') FROM headlines
  UNION ALL SELECT 'backfill', 0) GROUP BY kind""")
def run_log(d):
    """Runs logged with the counts that the writes returned."""
    spark, root = d.spark, folder_of(d.spark)
    pages = stamped(d).drop("turn")
    mine = F.col("path").startswith("/investing/")
    for kind, batch in (("daily", pages.filter(mine)), ("backfill", pages.filter(~mine)),
                        ("backfill", pages.filter(~mine))):
        stored = I.store_pages(spark, root, batch, SITE, "landed_ts", keep_newer=True)
        U.log_run(spark, root, kind, F.current_timestamp(), stored.articles, stored.coverage, "")
    return T.read_table(spark, root, "runs").groupBy("kind").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("articles_new").alias("articles_new"))


@check("csv_round_trip", """
SELECT path, nullif(CASE WHEN title = '' THEN '' ELSE title || chr(10) || '"quoted", ' || chr(92) || ';' END, '') AS title,
  nullif(author, '') AS author, published_day FROM articles""")
def csv_round_trip(d):
    """Titles with quotes, commas, backslashes and line ends; an empty text comes back as NULL."""
    path = folder_of(d.spark)
    title = F.when(F.col("title") == "", "").otherwise(F.concat("title", F.lit('\n"quoted", \\;')))
    rows = d.articles.select("path", title.alias("title"), "author", "published_day")
    T.write_csv(rows, path)
    return T.read_csv(d.spark, path, rows.schema)


@check("local_days", """
SELECT CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS new_york,
  CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS DATE) AS tokyo, count(*) AS n
FROM events GROUP BY ALL""")
def local_days(d):
    ts = F.col("ts").cast("timestamp")
    return d.table("events").groupBy(local_day(ts, "America/New_York").alias("new_york"),
                                     local_day(ts, "Asia/Tokyo").alias("tokyo")).agg(F.count(F.lit(1)).alias("n"))


# --- S1-S3, S5 as files -------------------------------------------------------------------------------------
@check("listing_files", sql_of("listing_scan"))
def listing_files(d):
    """The two listing files written and read back, each with its header and footer."""
    spark, root = d.spark, folder_of(d.spark)
    footer = "File Creation Time: 0101"
    flag = F.when(F.col("is_etf"), "Y").otherwise("N")
    test = F.when(F.col("name").endswith("7"), "Y").otherwise("N")
    first = d.universe.filter(F.col("exchange") == "NASDAQ").select(
        F.concat_ws("|", F.lower("ticker"), F.concat(F.lit(" "), "name"), test, flag).alias("value"))
    other = d.universe.select(F.concat_ws("|", "ticker", "name", "exchange", F.lit("N")).alias("value"))
    for name, header, lines in (("first", "Symbol|Security Name|Test Issue|ETF", first),
                                ("other", "ACT Symbol|Security Name|Exchange|ETF", other)):
        ordered = lines.withColumn("n", F.lit(1)).unionByName(spark.createDataFrame(
            [(header, 0), (footer + "|||", 2)], "value string, n int")).coalesce(1).sortWithinPartitions("n")
        ordered.select("value").write.text(f"{root}/{name}")
    return read_universe(spark, f"{root}/first", f"{root}/other")


#: Chart files that one task writes; a file takes the same time however small it is.
TASK_FILES = 100


def write_charts(d, days, folder) -> None:
    """A chart document for each symbol, in a file of its name."""
    parts = max(d.spark.sparkContext.defaultParallelism, -(-days.select("symbol").distinct().count() // TASK_FILES))
    open_ts = F.unix_timestamp(F.col("date").cast("timestamp")) + 5 * 3600 + 34_200
    quotes = days.repartition(parts, "symbol").groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(
        open_ts.alias("ts"), "close", "volume"))).alias("q"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(
        F.struct(F.lit(-18_000).alias("gmtoffset")).alias("meta"), F.col("q.ts").alias("timestamp"),
        F.struct(F.array(F.struct(F.col("q.close").alias("close"), F.col("q.volume").alias("volume")))
                 .alias("quote")).alias("indicators"))).alias("result")).alias("chart")),
        {"ignoreNullFields": "false"})
    quotes.select("symbol", body.alias("body")).write.mode("append").partitionBy("symbol").text(folder)


def folder_value(column: str):
    """The value of a column that files are filed under, from their path."""
    return F.url_decode(F.url_decode(F.regexp_extract("file", f"/{column}=([^/]+)/", 1)))


@check("chart_files", """
, halves AS (SELECT symbol, date < DATE '1996-01-01' AS early FROM prices),
runs AS (SELECT 'first' AS run, count(DISTINCT symbol) AS files FROM halves WHERE early
  UNION ALL SELECT 'second', count(DISTINCT symbol) FROM halves WHERE NOT early UNION ALL SELECT 'third', 0)
SELECT run, files, (SELECT count(*) FROM prices WHERE close IS NOT NULL) AS stored FROM runs""")
def chart_files(d):
    """Chart files that land in two goes; each run reads only the new ones."""
    spark, root = d.spark, folder_of(d.spark)
    runs, early = [], F.col("date") < "1996-01-01"
    for run, part in (("first", early), ("second", ~early), ("third", None)):
        if part is not None:
            write_charts(d, d.prices.filter(part), f"{root}/charts")
        runs.append((run, I.store_chart_files(
            spark, root, f"{root}/charts", "*.txt", folder_value("symbol")).first()["files"]))
    return spark.createDataFrame(runs, "run string, files bigint").withColumn(
        "stored", F.lit(T.read_table(spark, root, "prices").count()).cast("bigint"))


@check("chart_file_prices", sql_of("chart_scan"))
def chart_file_prices(d):
    root = folder_of(d.spark)
    write_charts(d, d.prices, f"{root}/charts")
    I.store_chart_files(d.spark, root, f"{root}/charts", "*.txt", folder_value("symbol"))
    return T.read_table(d.spark, root, "prices").drop("month")


@check("sitemap_files", """
SELECT path, CASE section WHEN 'investing' THEN 'pending' ELSE 'skipped' END AS state,
  strftime(published_day, '%Y-%m') AS month,
  count(*) OVER (PARTITION BY strftime(published_day, '%Y-%m')) AS urls_found
FROM headlines""")
def sitemap_files(d):
    """Month sitemaps written as files, read twice; the queue next to the months' counts."""
    spark, root = d.spark, folder_of(d.spark)
    pages = d.headlines.groupBy(F.date_format("published_day", "yyyy-MM").alias("filed")).agg(F.concat_ws(
        "", F.collect_list(F.concat(F.lit(f"<url><loc>{HOST}"), "path", F.lit("</loc></url>")))).alias("body"))
    pages.write.partitionBy("filed").text(f"{root}/maps")
    month = F.replace(folder_value("filed"), F.lit("-"), F.lit("/"))
    for _ in range(2):
        I.store_sitemap_files(spark, root, f"{root}/maps", HOST, "*.txt", month)
    found = T.read_table(spark, root, "archive_months").select(
        F.replace("month", F.lit("/"), F.lit("-")).alias("month"), "urls_found")
    queue = T.read_table(spark, root, "frontier").select("path", "state", "published_day")
    return queue.select("path", "state", F.date_format("published_day", "yyyy-MM").alias("month")).join(found, "month")


# --- J1, J4 by bucket ---------------------------------------------------------------------------------------
@check("bucketed_track", sql_of("track_record"))
def bucketed_track(d):
    """The track record from copies of outcomes and articles in buckets of their path."""
    root = folder_of(d.spark)
    parts = [store_bucketed(df, root, name, buckets=8) for name, df in (("outcomes", d.outcomes), ("articles", d.articles))]
    columns = ("path", "ticker", "stance", "bucket", *studies._TRACK_COLS, *studies._HITS)
    return rounded(track_record(*parts).select(*columns), *studies._TRACK_COLS)


@check("bucketed_summary", sql_of("ticker_summary"))
def bucketed_summary(d):
    root = folder_of(d.spark)
    for name, df in (("coverage", d.coverage), ("articles", d.articles)):
        store_bucketed(df, root, name, buckets=8)
    return rounded(ticker_summary(read_bucketed(d.spark, root, "coverage"), read_bucketed(d.spark, root, "articles"),
                                  primary_only=True, verified_only=True), "avg_stance")
