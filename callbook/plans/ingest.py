"""Landed sitemaps and pages to tables (Q13, Q14)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callbook.functions import text as X
from callbook.functions.stance import with_stance
from callbook.operators import merge as M
from callbook.session import settle, settle_counted
from callbook.sources import discovery, tables
from callbook.sources.articles import head_of, head_ticker_days, head_tickers, parse_heads
from callbook.sources.charts import parse_charts
from callbook.sources.sitemaps import month_url_counts, sitemap_urls

# Fixed value: the sections whose articles are fetched.
SECTIONS = ["investing"]


def frontier_rows(urls: DataFrame, host: str, sections: list[str] = SECTIONS) -> DataFrame:
    """(path, section, published_day, state, ...) of every dated url."""
    path = X.path_of(F.col("url"), host)
    return (
        urls.select(path.alias("path")).filter(F.col("path").rlike(X.DATED_PATH))
        .select(
            "path", X.path_section(F.col("path")).alias("section"),
            X.path_day(F.col("path")).alias("published_day"),
            F.current_timestamp().alias("discovered_ts"),
            F.when(X.section_ok(F.col("path"), sections), M.PENDING).otherwise(M.SKIPPED)
            .alias("state"),
            F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"),
            F.lit(None).cast("timestamp").alias("result_ts"),
            X.path_month(F.col("path")).alias("month"))
    )


def new_frontier_rows(frontier: DataFrame, urls: DataFrame, host: str,
                      sections: list[str] = SECTIONS) -> DataFrame:
    """Frontier rows of urls whose path is not known yet."""
    return M.insert_ignore(frontier, frontier_rows(urls, host, sections), ["path"])


def read_heads(landed: DataFrame, site_name: str, order: str | None = None) -> DataFrame:
    """Parsed heads of landed (path, html) pages.

    With ``order``, the time of landing, a path landed several times keeps its last page
    and that page's time as ``fetched_ts``.
    """
    if order is not None:
        return parse_heads(last_pages(landed, order), site_name)
    return parse_heads(landed.withColumn("html", head_of(F.col("html"))), site_name)


def last_pages(landed: DataFrame, order: str) -> DataFrame:
    """The head of the last page of each path, with the time of landing as ``fetched_ts``.

    Pages are cut before they are shuffled; of two heads the greater belongs to the greater page.
    """
    heads = landed.withColumn("html", head_of(F.col("html")))
    return M.last_per_key(heads, ["path"], order).withColumn(
        "fetched_ts", F.col(order).cast("timestamp")).drop(*({order} - {"fetched_ts"}))


def coverage_rows(heads: DataFrame, universe: DataFrame) -> DataFrame:
    """One row per article and ticker."""
    return head_tickers(heads, universe).select(
        "ticker", "path", "published_day", "is_primary",
        X.source_tag(F.col("is_primary")).alias("source"), "verified",
        X.day_month(F.col("published_day")).alias("month"))


def article_rows(heads: DataFrame, coverage: DataFrame) -> DataFrame:
    """One labelled row per article with the number of its coverage rows."""
    fetched = F.col("fetched_ts") if "fetched_ts" in heads.columns else F.current_timestamp()
    counts = coverage.groupBy("path").agg(F.count(F.lit(1)).alias("ticker_count"))
    return with_stance(heads).join(counts, "path", "left").select(
        "path", "title", "author", "published_day", "published_ts", "section", "stance",
        "stance_score", F.coalesce("ticker_count", F.lit(0)).cast("bigint").alias("ticker_count"),
        fetched.alias("fetched_ts"), X.day_month(F.col("published_day")).alias("month"))


@dataclass(frozen=True)
class Stored:
    """Rows that a write merged, counted while they were written."""
    articles: int = 0
    coverage: int = 0


def seen_batch(spark: SparkSession, root: str, batch: str | None) -> bool:
    """Whether a batch of this name was merged to the end before."""
    ledger = tables.read_table(spark, root, "batches")
    return batch is not None and not ledger.filter(F.col("batch") == batch).isEmpty()


def note_batch(spark: SparkSession, root: str, batch: str | None, kind: str, merged: int) -> None:
    if batch is not None:
        tables.append(spark.range(1).select(
            F.lit(batch).alias("batch"), F.lit(kind).alias("kind"),
            F.current_timestamp().alias("applied_ts"), F.lit(merged).alias("rows")), root, "batches")


def store_pages(spark: SparkSession, root: str, landed: DataFrame, site_name: str,
                order: str, batch: str | None = None, keep_newer: bool = False) -> Stored:
    """Parse landed pages and upsert articles, coverage, tickers and the frontier.

    ``order``, the time of landing, says which page of a path is its last. Every write is keyed, so
    storing the same pages again changes nothing: a batch that is repeated after a failure is safe.
    ``keep_newer`` leaves out pages that are not later than the stored one of their path, for batches
    that may come out of order. ``batch`` names the batch in a ledger; one that stands there is skipped.
    """
    if seen_batch(spark, root, batch):
        return Stored()
    month, universe = F.col("month"), tables.read_table(spark, root, "universe")
    pages = settle(last_pages(landed, order).withColumn("month", X.path_month(F.col("path"))))
    months = [r[0] for r in pages.select("month").distinct().collect()]
    held = tables.within(tables.read_table(spark, root, "articles"), months, "month")
    # What is not later than the stored page of its path is only read for its tickers.
    marked = _marked(pages, held, "fetched_ts") if keep_newer else pages.withColumn("fresh", F.lit(True))
    kept = [F.when(F.col("fresh"), F.col(c)).alias(c) for c in ("title", "author")]
    read = settle(parse_heads(marked, site_name).select(
        "path", "fetched_ts", "month", "fresh", *kept, "section", "published_day", "published_ts", "raw_tickers", "raw_primary"))
    heads, others = read.filter("fresh"), read.filter("NOT fresh")

    seen = coverage_rows(heads, universe)
    cov, n_coverage = settle_counted(seen.filter("path IS NOT NULL") if keep_newer else seen)
    arts, n_articles = settle_counted(article_rows(heads, cov))
    new = [r[0] for r in heads.select("month").distinct().collect()]
    if new:
        old = tables.within(tables.read_table(spark, root, "coverage"), new, "month")
        # Only a month without a new row may be left without any.
        bare = set(new) - {r[0] for r in cov.select("month").distinct().collect()}
        tables.rewrite(root, "coverage", M.replace_coverage(old, cov, arts), covering=arts if bare else None)
        tables.rewrite(root, "articles", M.upsert_replace(held.filter(month.isin(new)), arts, ["path"]))
    days = cov.select("ticker", "published_day")
    if keep_newer:
        unpathed = heads.filter("path IS NULL")
        days = days.unionByName(head_ticker_days(others.unionByName(unpathed), universe))
    tables.rewrite(root, "tickers", M.upsert_first_seen(tables.read_table(spark, root, "tickers"), days))

    results = read.select("path", F.lit("ok").alias("kind"),
                          F.lit(None).cast("string").alias("message"), "fetched_ts")
    waiting = tables.within(tables.read_table(spark, root, "frontier"), months, "month")
    tables.rewrite(root, "frontier", M.apply_fetch_results(waiting, results, "fetched_ts"))
    note_batch(spark, root, batch, "pages", n_articles)
    return Stored(n_articles, n_coverage)


def _marked(pages: DataFrame, held: DataFrame, order: str) -> DataFrame:
    """The pages with whether they are ``fresh``: the table lacks the path or holds it with a lower ``order``."""
    last = held.groupBy("path").agg(F.max(order).alias("_held"))
    later = F.coalesce(F.col("_held") < F.col(order), F.lit(True))
    return pages.join(last, "path", "left").withColumn("fresh", later).drop("_held")


def store_sitemaps(spark: SparkSession, root: str, pages: DataFrame, host: str,
                   sections: list[str] = SECTIONS) -> DataFrame:
    """Queue the urls of landed (month, body) sitemap pages and note the months.

    Unknown paths are appended; no stored row is written again. Returns one row
    with their number.
    """
    urls = sitemap_urls(pages)
    frontier = tables.read_table(spark, root, "frontier")
    rows = settle(frontier_rows(urls, host, sections))
    near = tables.touched(frontier, rows, "month")
    added = tables.append(M.insert_ignore(near, rows, ["path"]), root, "frontier")
    ledger = month_url_counts(pages.filter(F.col("month").isNotNull())).withColumn(
        "enumerated_ts", F.current_timestamp())
    tables.rewrite(root, "archive_months", M.upsert_replace(
        tables.read_table(spark, root, "archive_months"), ledger, ["month"]))
    return spark.range(1).select(F.lit(added).cast("bigint").alias("added"))


def store_results(spark: SparkSession, root: str, results: DataFrame,
                  order: str | None = None, batch: str | None = None) -> int:
    """Apply (path, kind, message) fetch results to the frontier; the rows of the months written.

    With ``order``, the time of a result, a batch may come twice, or after a later one. ``batch``
    names it in a ledger, as for pages; without either a repeated failure counts again.
    """
    if seen_batch(spark, root, batch):
        return 0
    keyed = settle(results.withColumn("month", X.path_month(F.col("path"))))
    waiting = tables.touched(tables.read_table(spark, root, "frontier"), keyed, "month")
    written = tables.rewrite(root, "frontier", M.apply_fetch_results(waiting, keyed, order))
    note_batch(spark, root, batch, "results", written)
    return written


def store_prices(spark: SparkSession, root: str, quotes: DataFrame,
                 order: str | None = None) -> int:
    """Upsert (symbol, date, close, volume) rows; their number.

    Of several quotes for a key the last by ``order`` counts; without it the one
    with the highest volume, then close.
    """
    keys = ["symbol", "date"]
    if order is not None:
        quotes = M.last_per_key(quotes, keys, order).drop(order)
    else:
        best = F.max(F.struct("volume", "close")).alias("_q")
        quotes = quotes.groupBy(*keys).agg(best).select(*keys, "_q.close", "_q.volume")
    new, n = settle_counted(quotes.withColumn("month", F.date_format("date", "yyyy-MM")))
    old = tables.touched(tables.read_table(spark, root, "prices"), new, "month")
    tables.rewrite(root, "prices", M.upsert_replace(old, new, ["symbol", "date"]))
    return n


def store_universe(spark: SparkSession, root: str, listings: DataFrame) -> DataFrame:
    """Upsert the listings and fill missing ticker names from them.

    Returns one row with the number of tickers that had no name.
    """
    unnamed = settle(M.backfill_count(tables.read_table(spark, root, "tickers")))
    merged = M.upsert_replace(tables.read_table(spark, root, "universe"), listings, ["ticker"])
    tables.rewrite(root, "universe", merged)
    tables.rewrite(root, "tickers", M.backfill_names(
        tables.read_table(spark, root, "tickers"), tables.read_table(spark, root, "universe")))
    return unnamed


def store_chart_files(spark: SparkSession, root: str, folder: str, glob: str = "*.json",
                      symbol: Column | None = None) -> DataFrame:
    """Prices of the chart files (one symbol each) that have landed since the last run.

    ``symbol`` is read from ``file``, its path; by default it is the file's name. Returns one row
    with the number of files and of quotes.
    """
    found = discovery.listed(spark, folder, glob)
    files = discovery.new_files(spark, root, "charts", folder, glob, found)
    named = discovery.name_of(F.col("file"), ".json") if symbol is None else symbol
    bodies = discovery.texts_of(spark, folder, files, glob, found).select(named.alias("symbol"), "body")
    quotes = store_prices(spark, root, parse_charts(bodies))
    read = discovery.note_files(spark, root, "charts", files)
    return spark.range(1).select(F.lit(read).cast("bigint").alias("files"),
                                 F.lit(quotes).cast("bigint").alias("quotes"))


def store_sitemap_files(spark: SparkSession, root: str, folder: str, host: str, glob: str = "*.xml",
                        month: Column | None = None, sections: list[str] = SECTIONS) -> DataFrame:
    """Queue the urls of the month sitemaps that have landed since the last run.

    ``month`` is read from ``file``; by default a file is named ``YYYY-MM.xml``. Returns one row
    with the number of files and of new frontier rows.
    """
    found = discovery.listed(spark, folder, glob)
    files = discovery.new_files(spark, root, "sitemaps", folder, glob, found)
    if month is None:
        month = F.replace(discovery.name_of(F.col("file"), ".xml"), F.lit("-"), F.lit("/"))
    pages = settle(discovery.texts_of(spark, folder, files, glob, found).select(month.alias("month"), "body"))
    added = store_sitemaps(spark, root, pages, host, sections)
    read = discovery.note_files(spark, root, "sitemaps", files)
    return added.select(F.lit(read).cast("bigint").alias("files"), "added")
