"""Upkeep: relabelling, status, freshness, run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callbook.functions.dates import local_day
from callbook.functions.stance import stance_label, stance_score
from callbook.session import settle
from callbook.sources import tables

# Fixed values.
TOP_MOVES = 15
FRESH_SECONDS = 6 * 3600


def relabel(articles: DataFrame) -> DataFrame:
    """Articles with today's label next to the stored one and a ``changed`` flag."""
    relabelled = articles.withColumn("new_stance", stance_label(F.col("title"))).withColumn(
        "new_score", stance_score(F.col("new_stance")))
    same = F.col("stance").eqNullSafe(F.col("new_stance")) & F.col("stance_score").eqNullSafe(
        F.col("new_score"))
    return relabelled.withColumn("changed", ~same)


def relabel_moves(relabelled: DataFrame, n: int = TOP_MOVES) -> DataFrame:
    """The most frequent ``old -> new`` moves."""
    move = F.concat_ws(" -> ", F.coalesce("stance", F.lit("none")), "new_stance")
    return (relabelled.filter("changed").groupBy(move.alias("move"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "move").limit(n))


def apply_relabel(relabelled: DataFrame) -> DataFrame:
    return relabelled.withColumn("stance", F.col("new_stance")).withColumn(
        "stance_score", F.col("new_score")).drop("new_stance", "new_score", "changed")


def store_relabel(spark: SparkSession, root: str) -> DataFrame:
    """Relabel the stored articles; only months with a change are read whole and rewritten."""
    articles = tables.read_table(spark, root, "articles")
    stale = settle(relabel(articles.select("path", "month", "title", "stance", "stance_score"))
                   .filter("changed").drop("title"))
    old = tables.touched(articles, stale, "month")
    merged = old.join(stale.select("path", "new_stance", "new_score"), "path", "left")
    tables.rewrite(root, "articles", merged.withColumn(
        "stance", F.coalesce("new_stance", "stance")).withColumn(
        "stance_score", F.coalesce("new_score", "stance_score")).select(*articles.columns))
    return relabel_moves(stale)


def log_run(spark: SparkSession, root: str, kind: str, started: Column, articles: int,
            coverage: int, notes: str) -> None:
    """Append one finished run; the counts are those that ``store_pages`` returns."""
    row = spark.range(1).select(
        F.lit(kind).alias("kind"), started.alias("started_ts"),
        F.current_timestamp().alias("finished_ts"), F.lit(articles).alias("articles_new"),
        F.lit(coverage).alias("coverage_new"), F.lit(notes).alias("notes"))
    tables.append(row, root, "runs")


def last_daily_day(runs: DataFrame, zone: str) -> DataFrame:
    """Local day of the last finished daily run, NULL without one."""
    return runs.filter(F.col("kind") == "daily").agg(
        local_day(F.max("finished_ts"), zone).alias("day"))


def freshness(runs: DataFrame, now: Column, within: int = FRESH_SECONDS) -> DataFrame:
    """Whether the last run finished recently; true while no run exists yet."""
    last = F.max("finished_ts")
    age = F.unix_timestamp(now) - F.unix_timestamp(last)
    return runs.agg(last.alias("last_run"), F.coalesce(age <= within, F.lit(True)).alias("fresh"))


def _metrics(df: DataFrame, **values: Column) -> DataFrame:
    """One aggregation as (metric, value) rows."""
    agg = df.agg(*[v.cast("string").alias(k) for k, v in values.items()])
    return agg.unpivot([], list(values), "metric", "value")


def _per_value(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("c")).select(
        F.concat(F.lit(prefix), F.coalesce(column, F.lit(""))).alias("metric"),
        F.col("c").cast("string").alias("value"))


def status(articles: DataFrame, coverage: DataFrame, prices: DataFrame, universe: DataFrame,
           archive_months: DataFrame, frontier: DataFrame) -> DataFrame:
    """Table counts, day range, queue states and stance mix as (metric, value)."""
    rows = F.count(F.lit(1))
    primary = F.when(F.col("is_primary"), F.col("ticker"))
    parts = [
        _metrics(articles, articles=rows, first_day=F.min("published_day"),
                 last_day=F.max("published_day"), authors=F.count_distinct("author")),
        _metrics(coverage, coverage_rows=rows, tickers=F.count_distinct("ticker"),
                 primary_tickers=F.count_distinct(primary)),
        _metrics(prices, price_rows=rows, price_symbols=F.count_distinct("symbol")),
        _metrics(universe, universe=rows),
        _metrics(archive_months, months=rows),
        _per_value(frontier, "state", "queue "),
        _per_value(articles, "stance", "stance "),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
