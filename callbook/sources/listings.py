"""Exchange listing files: '|'-separated, header-driven."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callbook.functions.text import LISTED_SYMBOL

# Column names of the two files and the footer line.
SYMBOL_COLUMNS = ("Symbol", "ACT Symbol")
NAME_COLUMN, ETF_COLUMN, TEST_COLUMN = "Security Name", "ETF", "Test Issue"
EXCHANGE_COLUMN = "Exchange"
FOOTER = "File Creation Time"


def read_listing_file(spark: SparkSession, path: str) -> DataFrame:
    """The raw file, all columns text, with its line order in ``_line``.

    Split here rather than by the CSV reader, which reads an empty field and a
    field a short row lacks as the same NULL.
    """
    header = spark.read.option("sep", "|").option("header", True).option("quote", "").csv(
        path).columns
    fields = F.split("value", r"\|", -1)
    line = F.struct(F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))
    return (spark.read.text(path).withColumn("_line", line)
            .filter(F.col("value") != "|".join(header))
            .select(*[F.get(fields, i).alias(c) for i, c in enumerate(header)], "_line"))


def parse_listing(raw: DataFrame, exchange: str | None = None) -> DataFrame:
    """(ticker, name, exchange, is_etf) of the real listings in one file.

    ``exchange`` names a file that covers a single exchange; without it the
    file's own Exchange column counts.
    """
    have = set(raw.columns)
    symbol_col = next((c for c in SYMBOL_COLUMNS if c in have), raw.columns[0])

    def flag(column: str):
        if column not in have:
            return F.lit(False)
        return F.coalesce(F.trim(F.col(f"`{column}`")) == "Y", F.lit(False))

    symbol = F.upper(F.trim(F.col(f"`{symbol_col}`")))
    where = (F.lit(exchange) if exchange is not None
             else F.trim(F.col(f"`{EXCHANGE_COLUMN if EXCHANGE_COLUMN in have else raw.columns[0]}`")))
    return (
        raw.filter(~F.col(f"`{raw.columns[0]}`").startswith(FOOTER)
                   & F.col(f"`{NAME_COLUMN}`").isNotNull()
                   & symbol.rlike(LISTED_SYMBOL) & ~flag(TEST_COLUMN))
        .select(symbol.alias("ticker"), F.trim(F.col(f"`{NAME_COLUMN}`")).alias("name"),
                where.alias("exchange"), flag(ETF_COLUMN).alias("is_etf"),
                (F.col("_line") if "_line" in have else F.lit(None).cast(
                    "struct<block:bigint,row:bigint>")).alias("_line"))
    )


def union_listings(*listings: DataFrame) -> DataFrame:
    """All files as one universe: the later line, and the later file, wins."""
    numbered = None
    for i, listing in enumerate(listings):
        part = listing.withColumn("_file", F.lit(i))
        numbered = part if numbered is None else numbered.unionByName(part)
    row = F.struct("name", "exchange", "is_etf")
    return (numbered.groupBy("ticker").agg(F.max_by(row, F.struct("_file", "_line", row)).alias("_row"))
            .select("ticker", "_row.*"))


def read_universe(spark: SparkSession, first_file: str, other_file: str,
                  first_exchange: str = "NASDAQ") -> DataFrame:
    return union_listings(
        parse_listing(read_listing_file(spark, first_file), first_exchange),
        parse_listing(read_listing_file(spark, other_file)))
