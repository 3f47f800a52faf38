"""Url, path, ticker and html text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callbook.functions.entities import html_unescape
from callbook.functions.stance import collapse_spaces

# The shapes of a dated path, a ticker and a listed symbol.
DATED_PATH = r"^/([a-z0-9\-]+)/(\d{4})/(\d{2})/(\d{2})/[^/]+/?$"
DATED_PATH_DAY = r"^/[a-z0-9\-]+/(\d{4}/\d{2}/\d{2})/[^/]+/?$"
TICKER = r"^[A-Z][A-Z.]{0,6}$"
LISTED_SYMBOL = r"^[A-Z]{1,5}(\.[A-Z]{1,2})?$"
META_TAG = r'(?iU)<meta\s+name="([a-z_]+)"\s+content="([^"]*)"'
OG_TITLE = r'(?iU)<meta\s+property="og:title"\s+content="([^"]*)"'
TITLE_TAG = r"(?iU)<title>([^<]*)</title>"
#: The ASCII characters that count as white space.
ASCII_SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f "


def path_of(url: Column, host: str) -> Column:
    """Url without its host, query and fragment."""
    bare = F.replace(url, F.lit(host), F.lit("")) if host else url
    return F.substring_index(F.substring_index(bare, "?", 1), "#", 1)


def path_section(path: Column) -> Column:
    """Section of a dated path, else NULL."""
    return F.nullif(F.regexp_extract(path, DATED_PATH, 1), F.lit(""))


def path_day(path: Column) -> Column:
    """Day of a dated path; NULL when undated or not a calendar day."""
    return F.try_to_date(F.regexp_extract(path, DATED_PATH_DAY, 1), "yyyy/MM/dd")


def path_month(path: Column) -> Column:
    """``YYYY-MM`` of a dated path; the partition value of path-keyed tables."""
    return day_month(path_day(path))


def day_month(day: Column) -> Column:
    """:func:`path_month` of a path whose day is known."""
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("undated"))


def day_start(day: Column) -> Column:
    """Midnight UTC of a day."""
    return day.cast("timestamp")


def section_ok(path: Column, sections: list[str]) -> Column:
    """Whether the first path part is wanted; an empty list wants everything."""
    if not sections:
        return F.lit(True)
    return F.substring_index(F.ltrim(path, F.lit("/")), "/", 1).isin(sections)


def strip_spaces(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    def bare(t: Column) -> Column:
        return F.when(F.octet_length(t) == F.length(t), F.trim(t, F.lit(ASCII_SPACES))).otherwise(
            F.regexp_replace(t, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return named(text, bare)


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def _quoted(tag: Column, first: int, last: int) -> Column:
    """A text between quotes of a tag, which is cut at the quote of number ``first`` and then at that of number ``last``."""
    return F.substring_index(F.substring_index(tag, '"', first), '"', last)


def meta_tags(head: Column) -> Column:
    """All meta tags as (name in lower case, raw content), in order; one search of the head."""
    return F.transform(F.regexp_extract_all(head, F.lit(META_TAG), 0), lambda tag: F.struct(
        F.lower(_quoted(tag, 2, -1)).alias("name"), _quoted(tag, -2, 1).alias("content")))


def tag_content(tags: Column, name: str) -> Column:
    """Raw content of the first of :func:`meta_tags` with that name, '' if none; NULL without tags."""
    found = F.get(F.filter(tags, lambda t: t["name"] == name), F.lit(0))["content"]
    return F.when(tags.isNotNull(), F.coalesce(found, F.lit("")))


def meta_map(head: Column) -> Column:
    """All meta tags as a map of lower-case name to raw content, first tag wins."""
    return F.transform(F.array(meta_tags(head)), lambda tags: F.map_from_entries(F.filter(
        tags, lambda tag, i: F.array_position(F.transform(tags, lambda t: t["name"]), tag["name"]) == i + 1)))[0]


def raw_title(head: Column) -> Column:
    """Social title if the tag is there (even empty), else the title tag, else ''."""
    return named(F.regexp_extract(head, OG_TITLE, 0), lambda tag: F.when(tag != "", _quoted(tag, -2, 1)).otherwise(
        F.regexp_extract(head, TITLE_TAG, 1)))


def clean_title(unescaped: Column, site_name: str) -> Column:
    """Collapse white space and drop the ``| site`` suffix."""
    quoted = r"\Q" + site_name + r"\E"
    return F.regexp_replace(collapse_spaces(unescaped), rf"(?iU)\s*\|\s*{quoted}\s*$", "")


def ticker_shape(raw: Column) -> Column:
    """Upper-case dotted ticker, NULL when it cannot be one."""
    return named(F.replace(F.upper(collapse_spaces(raw)), F.lit("-"), F.lit(".")), lambda t: F.when(
        t.rlike(TICKER) & F.length(F.substring_index(t, ".", 1)).between(1, 5), t))


def ticker_resolver(universe: DataFrame) -> DataFrame:
    """(raw, resolved) for every spelling that ends at a listed ticker.

    A listed ticker resolves to itself. A share class written without its dot
    (ABCD for ABC.D, at least three letters) resolves to the dotted listing
    unless the undotted text is listed too. Anything absent stays as it is and
    is not verified, so one left join both normalises and verifies.
    """
    listed = universe.select(F.col("ticker").alias("resolved"), F.col("ticker").alias("raw"),
                             F.lit(0).alias("rank"))
    # Exactly one dot, directly before the last letter.
    class_share = r"^[A-Z]+\.[A-Z]$"
    undotted = (
        universe.filter(F.col("ticker").rlike(class_share) & (F.length("ticker") >= 4))
        .select(F.col("ticker").alias("resolved"),
                F.replace("ticker", F.lit("."), F.lit("")).alias("raw"), F.lit(1).alias("rank"))
    )
    return (listed.unionByName(undotted).groupBy("raw")
            .agg(F.min_by("resolved", F.struct("rank", "resolved")).alias("resolved")))


def normalise_tickers(df: DataFrame, universe: DataFrame, column: str = "raw") -> DataFrame:
    """Replace ``column`` by ``ticker`` and ``verified``; non-tickers become NULL."""
    return resolve_tickers(df.withColumn(column, ticker_shape(F.col(column))), universe, column)


def resolve_tickers(shaped: DataFrame, universe: DataFrame, column: str = "raw") -> DataFrame:
    """:func:`normalise_tickers` of what has the shape of a ticker already."""
    resolver = ticker_resolver(universe)
    return (
        shaped.join(resolver.withColumnRenamed("raw", column), column, "left")
        .withColumn("ticker", F.coalesce("resolved", column))
        .withColumn("verified", F.col("resolved").isNotNull())
        .drop("resolved", column)
    )


def source_tag(is_primary: Column) -> Column:
    return F.when(is_primary, "primary_meta").otherwise("meta")


def article_url(base: str, path: Column) -> Column:
    return F.concat(F.lit(base), path)


def picker_label(ticker: Column, name: Column, n: Column) -> Column:
    """``TICKER — name  (n articles)``; the name is left out when unknown."""
    counted = F.concat(F.lit("  ("), n.cast("string"), F.lit(" articles)"))
    named = F.concat(ticker, F.lit(" — "), name, counted)
    return F.when(F.coalesce(name, F.lit("")) != "", named).otherwise(F.concat(ticker, counted))
