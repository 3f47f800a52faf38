"""Scans, text functions and the classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from callbook.checks.domain import HOST, SITE
from callbook.checks.prelude import bucket, collapsed, label, plain_code, score, text, ticker_code
from callbook.checks.registry import check
from callbook.functions import stance as S
from callbook.functions import text as X
from callbook.operators.sessions import latest_close, next_session, price_book
from callbook.plans.ingest import (
    article_rows,
    coverage_rows,
    frontier_rows,
    new_frontier_rows,
    read_heads,
)
from callbook.session import settle
from callbook.sources.articles import head_of
from callbook.sources.charts import parse_charts
from callbook.sources.listings import parse_listing, union_listings
from callbook.sources.sitemaps import available_months, month_url_counts, sitemap_urls
from callbook.sources.tables import day_bounds, query


# --- S1 -----------------------------------------------------------------------
@check("listing_scan", """
, rows AS (
 SELECT upper(trim(ticker)) AS ticker, trim(name) AS name, 'NASDAQ' AS exchange, is_etf, 0 AS f
 FROM universe WHERE exchange = 'NASDAQ' AND NOT ends_with(name, '7')
 UNION ALL
 SELECT ticker, trim(name), exchange, FALSE, 1 FROM universe)
SELECT ticker, arg_max(name, f) AS name, arg_max(exchange, f) AS exchange,
  arg_max(is_etf, f) AS is_etf
FROM rows WHERE regexp_full_match(ticker, '[A-Z]{1,5}(\\.[A-Z]{1,2})?') GROUP BY ticker""")
def listing_scan(d):
    flag = F.when(F.col("is_etf"), "Y").otherwise("N")
    test = F.when(F.col("name").endswith("7"), "Y").otherwise("N")
    first = d.universe.filter(F.col("exchange") == "NASDAQ").select(
        F.lower("ticker").alias("Symbol"), F.concat(F.lit(" "), "name").alias("Security Name"),
        test.alias("Test Issue"), flag.alias("ETF"))
    other = d.universe.select(
        F.col("ticker").alias("ACT Symbol"), F.col("name").alias("Security Name"),
        F.col("exchange").alias("Exchange"), F.lit("N").alias("ETF"))
    return union_listings(parse_listing(first, "NASDAQ"), parse_listing(other))


# --- S2 -----------------------------------------------------------------------
@check("chart_scan", """
SELECT symbol, date, CAST(round(CAST(CAST(close AS VARCHAR) AS DECIMAL(38, 15)), 4) AS DOUBLE) AS close, volume
FROM prices WHERE close IS NOT NULL""")
def chart_scan(d):
    # One chart document per symbol and year, as a price API would answer.
    open_ts = F.unix_timestamp(F.col("date").cast("timestamp")) + 5 * 3600 + 34_200
    quotes = d.prices.select("symbol", F.year("date").alias("y"), F.struct(
        open_ts.alias("ts"), "close", "volume").alias("q"))
    docs = quotes.groupBy("symbol", "y").agg(F.sort_array(F.collect_list("q")).alias("q"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(
        F.struct(F.lit(-18_000).alias("gmtoffset")).alias("meta"),
        F.col("q.ts").alias("timestamp"),
        F.struct(F.array(F.struct(F.col("q.close").alias("close"),
                                  F.col("q.volume").alias("volume")))
                 .alias("quote")).alias("indicators"))).alias("result")).alias("chart")),
        {"ignoreNullFields": "false"})
    return parse_charts(docs.select("symbol", body.alias("body")))


# --- S3-S5 ----------------------------------------------------------------------
_LOCS = f"""
, locs AS (
 SELECT strftime(published_day, '%Y/%m') AS month, key, unnest([
   '{HOST}' || path || '?from=map#top', '{HOST}/' || section || '/about/',
   '{HOST}/sitemap/' || strftime(published_day, '%Y/%m') || '/']) AS url FROM headlines)"""


@check("sitemap_urls", _LOCS + " SELECT month, url FROM locs")
def sitemap_url_rows(d):
    return sitemap_urls(d.sitemap_pages, "month").select("month", "url")


@check("month_url_counts", _LOCS + " SELECT month, count(*) AS urls_found FROM locs GROUP BY 1")
def month_counts(d):
    return month_url_counts(d.sitemap_pages)


@check("available_months", "SELECT DISTINCT strftime(published_day, '%Y/%m') AS month FROM headlines")
def months_offered(d):
    return available_months(d.sitemap_pages)


# --- S6, F4-F10, Q13 --------------------------------------------------------------
_TAGS = f"""
, raw AS (
 SELECT path, cust % n + 1 AS a, key % n + 1 AS b, (cust + key) % n + 1 AS c, key
 FROM headlines, (SELECT max(s_suppkey) AS n FROM supplier)),
listed AS (
 SELECT path, unnest([{plain_code('a')}, upper({plain_code('b')}),
   replace(replace({ticker_code('b')}, '.', '-'), '-', '.')]) AS t, FALSE AS p FROM raw
 UNION ALL
 SELECT path, CASE WHEN key % 4 = 0 THEN {ticker_code('c')} ELSE {plain_code('a')} END, TRUE
 FROM raw),
fitting AS (
 SELECT *, left(t, length(t) - 1) || '.' || right(t, 1) AS dotted FROM listed
 WHERE regexp_full_match(t, '[A-Z][A-Z.]{{0,6}}') AND length(split_part(t, '.', 1)) BETWEEN 1 AND 5),
resolved AS (
 SELECT path, p, CASE WHEN strpos(t, '.') = 0 AND length(t) >= 3
   AND t NOT IN (SELECT ticker FROM universe) AND dotted IN (SELECT ticker FROM universe)
   THEN dotted ELSE t END AS ticker FROM fitting),
cov AS (
 SELECT r.path, r.ticker, bool_or(p) AS is_primary,
   bool_or(r.ticker IN (SELECT ticker FROM universe)) AS verified
 FROM resolved r GROUP BY ALL)"""


@check("ingest_articles", _TAGS + f"""
, parsed AS (
 SELECT h.*, {collapsed("CASE WHEN key % 3 <> 0 THEN coalesce(title, '') ELSE 'Page ' || coalesce(title, '') END")} AS t
 FROM headlines h),
named AS (SELECT *, {label('t')} AS s FROM parsed)
SELECT n.path, n.t AS title, coalesce(n.author, '') AS author, n.published_day, n.section,
  n.s AS stance, CAST({score('n.s')} AS INTEGER) AS stance_score,
  coalesce(c.n, 0) AS ticker_count
FROM named n LEFT JOIN (SELECT path, count(*) AS n FROM cov GROUP BY 1) c ON c.path = n.path""")
def ingest_articles(d):
    heads = settle(read_heads(d.landed, SITE))
    return article_rows(heads, coverage_rows(heads, d.universe)).drop(
        "published_ts", "fetched_ts", "month")


@check("ingest_coverage", _TAGS + """
SELECT c.ticker, c.path, h.published_day, c.is_primary,
  CASE WHEN c.is_primary THEN 'primary_meta' ELSE 'meta' END AS source, c.verified
FROM cov c JOIN headlines h ON h.path = c.path""")
def ingest_coverage(d):
    return coverage_rows(read_heads(d.landed, SITE), d.universe).drop("month")


@check("meta_tags", """
SELECT path, coalesce(author, '') AS author, 3 AS tags FROM headlines""")
def meta_tags(d):
    tags = X.meta_map(F.col("html"))
    return d.landed.select("path", tags["author"].alias("author"), F.size(tags).alias("tags"))


# --- S7, F1, F6, F7 on the given pages ---------------------------------------------
@check("head_truncation", """
SELECT page_id, CASE WHEN regexp_matches(html, '(?i)</head>')
  THEN strpos(lower(html), '</head>') + 6 ELSE length(html) END AS head_chars
FROM pages""")
def head_truncation(d):
    return d.table("pages").select(
        "page_id", F.length(head_of(F.col("html"))).cast("bigint").alias("head_chars"))


_TITLE = "regexp_extract(html, '(?i)<title>([^<]*)</title>', 1)"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
    _TITLE = f"regexp_replace({_TITLE}, '&{_name};?', '{_char}', 'g')"


@check("page_titles", f"SELECT page_id, {collapsed(_TITLE)} AS title FROM pages")
def page_titles(d):
    raw = X.raw_title(F.col("html"))
    return d.table("pages").select(
        "page_id", X.clean_title(X.html_unescape(raw), SITE).alias("title"))


@check("page_paths", """
SELECT page_id, split_part(split_part(replace(url, 'https://', ''), '?', 1), '#', 1) AS path,
  nullif(regexp_extract(split_part(split_part(replace(url, 'https://', ''), '?', 1), '#', 1),
    '^/([a-z0-9\\-]+)/(\\d{4})/(\\d{2})/(\\d{2})/[^/]+/?$', 1), '') AS section
FROM pages""")
def page_paths(d):
    path = X.path_of(F.col("url"), "https://")
    return d.table("pages").select("page_id", path.alias("path"),
                                   X.path_section(path).alias("section"))


# --- F2, F3, Q14, K2 ------------------------------------------------------------------
@check("frontier_build", """
SELECT path, section, published_day,
  CASE section WHEN 'investing' THEN 'pending' ELSE 'skipped' END AS state, 0 AS attempts
FROM headlines""")
def frontier_build(d):
    urls = sitemap_urls(d.sitemap_pages, "month")
    return frontier_rows(urls, HOST).select(
        "path", "section", "published_day", "state", "attempts")


@check("frontier_insert", """
SELECT path, CASE section WHEN 'investing' THEN 'pending' ELSE 'skipped' END AS state
FROM headlines WHERE order_state <> 'F'""")
def frontier_insert(d):
    known = d.frontier.filter(F.col("state") == "failed")
    urls = sitemap_urls(d.sitemap_pages, "month")
    return new_frontier_rows(known, urls, HOST).select("path", "state")


# --- S8-S10, T7 ------------------------------------------------------------------------
@check("parameter_scan", """
SELECT path, title, published_day FROM articles
WHERE published_day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND stance = 'buy'""")
def parameter_scan(d):
    return query(d.spark, """
        SELECT path, title, published_day FROM {articles}
        WHERE published_day BETWEEN :first AND :last AND stance = :stance""",
                 {"first": "1996-01-01", "last": "1998-12-31", "stance": "buy"},
                 articles=d.articles)


@check("price_book", """
SELECT symbol, date, close, idx FROM book
WHERE symbol IN (SELECT price_symbol FROM tickers)""")
def price_book_rows(d):
    symbols = d.tickers.select(F.col("price_symbol").alias("symbol"))
    return price_book(d.prices, symbols)


@check("day_bounds",
       "SELECT min(published_day) AS first_day, max(published_day) AS last_day FROM articles")
def article_bounds(d):
    return day_bounds(d.articles)


@check("close_on_or_after", """
, days AS (SELECT DISTINCT t.price_symbol AS symbol, c.published_day AS day
 FROM coverage c JOIN tickers t ON t.ticker = c.ticker WHERE t.price_symbol IS NOT NULL)
SELECT d.symbol, d.day, p.date AS entry_date, p.close AS entry_close
FROM days d ASOF LEFT JOIN prices p ON d.symbol = p.symbol AND d.day <= p.date""")
def closes_after(d):
    symbols = d.tickers.filter(F.col("price_symbol").isNotNull()).select(
        "ticker", F.col("price_symbol").alias("symbol"))
    days = d.coverage.join(symbols, "ticker").select(
        "symbol", F.col("published_day").alias("day")).distinct()
    return next_session(days, d.prices)


@check("latest_close", """
SELECT symbol, max(date) AS last_date, arg_max_null(close, date) AS last_close
FROM prices GROUP BY symbol""")
def last_closes(d):
    return latest_close(d.prices)


# --- C1-C15 ------------------------------------------------------------------------------
@check("stance_labels", "SELECT path, stance, stance_score FROM articles")
def stance_labels(d):
    return d.articles.select("path", "stance", "stance_score")


@check("stance_buckets", f"""
SELECT stance, {bucket('stance')} AS bucket, count(*) AS n,
  CAST(list_position([{', '.join(text(x) for x in S.LABELS)}], stance) AS INTEGER) AS position
FROM articles GROUP BY stance""")
def stance_buckets(d):
    return d.articles.groupBy("stance").agg(F.count(F.lit(1)).alias("n")).select(
        "stance", S.stance_bucket(F.col("stance")).alias("bucket"), "n",
        S.order_key(F.col("stance"), S.LABELS).alias("position"))


@check("document_stance", f"""
SELECT doc_id, {label('text')} AS stance FROM documents""")
def document_stance(d):
    return d.table("documents").select("doc_id", S.stance_label(F.col("text")).alias("stance"))
