"""Landed sitemaps: month archives, the news list and the archive index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Where a url and an archive month stand in a sitemap.
LOC = r"<loc>([^<]+)</loc>"
MONTH_LINK = r"/sitemap/(\d{4})/(\d{2})"


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its path and whole text."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def sitemap_urls(pages: DataFrame, *keep: str, body: str = "body") -> DataFrame:
    """Every ``<loc>`` value with its place in the page; ``keep`` columns come along."""
    urls = F.regexp_extract_all(F.col(body), F.lit(LOC), 1)
    return pages.select(*keep, F.posexplode(urls).alias("pos", "url"))


def month_url_counts(pages: DataFrame) -> DataFrame:
    """(month, urls_found): the ledger row of each enumerated month page."""
    found = F.size(F.regexp_extract_all(F.col("body"), F.lit(LOC), 1)).cast("bigint")
    return pages.groupBy("month").agg(F.sum(found).alias("urls_found"))


def available_months(index: DataFrame) -> DataFrame:
    """Distinct ``YYYY/MM`` months the archive index links to, oldest first."""
    link = F.concat_ws("/", F.regexp_extract("url", MONTH_LINK, 1),
                       F.regexp_extract("url", MONTH_LINK, 2))
    return (sitemap_urls(index).filter(F.col("url").rlike(MONTH_LINK))
            .select(link.alias("month")).distinct().orderBy("month"))
