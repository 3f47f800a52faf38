"""Keyed merges of tables (K1-K4, K6-K8, K10, K12) as joins and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callbook.session import empty_table


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the highest ``order``; of equal ones the greatest in the
    order of the other columns, so that a rerun takes the same row.

    An aggregation, not a window: copies of a hot key are reduced before the
    shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    return (df.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(order), row)).alias("_row"))
            .select(*keys, "_row.*").select(*df.columns))


def newer_than(new: DataFrame, target: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of ``new`` whose key the target lacks or holds with a lower ``order``."""
    held = target.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(order).alias("_held"))
    same = F.col("_held") >= F.col(order)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return new.join(held, same, "left_anti")


def upsert_replace(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace target rows with the same key; ``new`` is unique by key
    (see :func:`last_per_key`)."""
    kept = target.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new.select(*target.columns))


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str],
                  order: str | None = None) -> DataFrame:
    """The rows of ``new`` whose key the target lacks, first row per key."""
    rest = [c for c in new.columns if c not in keys]
    first = F.min_by(F.struct(*rest), order) if order else F.min(F.struct(*rest))
    unique = new.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*")
    return unique.join(target.select(*keys), keys, "left_anti").select(*new.columns)


def upsert_first_seen(tickers: DataFrame, seen: DataFrame) -> DataFrame:
    """Lower ``first_seen_day`` to the earliest of old and new; add unknown tickers.

    A missing day is ignored rather than making the result NULL.
    """
    firsts = seen.groupBy("ticker").agg(F.min("published_day").alias("_first"))
    merged = tickers.join(firsts, "ticker", "full_outer")
    return merged.withColumn(
        "first_seen_day", F.least("first_seen_day", "_first")
    ).withColumn("price_failed", F.coalesce("price_failed", F.lit(False))).select(*tickers.columns)


def replace_coverage(coverage: DataFrame, new: DataFrame, articles: DataFrame) -> DataFrame:
    """Cascade of a re-stored article set: also drops coverage of articles that
    come back with no ticker at all."""
    kept = coverage.join(articles.select("path"), "path", "left_anti")
    return kept.unionByName(new.select(*coverage.columns))


# The states of a frontier row and the failed-fetch limit.
PENDING, DONE, SKIPPED, FAILED = "pending", "done", "skipped", "failed"
MAX_ATTEMPTS = 5


def apply_fetch_results(frontier: DataFrame, results: DataFrame,
                        order: str | None = None) -> DataFrame:
    """Move frontier rows on by fetch result (path, kind, message).

    ``ok`` is done, ``gone`` is skipped, ``failed`` is failed, each one attempt
    more; ``deferred`` and ``throttled`` stay pending and only note the message.
    A path with several results takes one of them: the last by ``order``, or,
    without it, the best (``ok`` before the others). What is done stays done.

    ``order`` is the time of a result. Where the frontier keeps it (``result_ts``), a
    result counts only if it is later than the last one that its row has seen: a
    batch that comes again changes nothing, nor does an older one that comes late.
    """
    result = F.struct("kind", "message")
    last = F.max_by(result, F.struct(F.col(order), result)) if order else F.max(
        F.struct((F.col("kind") == "ok").alias("best"), "kind", "message"))
    timed = order is not None and "result_ts" in frontier.columns
    at = F.max(F.col(order).cast("timestamp")) if timed else F.lit(None).cast("timestamp")
    keyed = results.groupBy("path").agg(last.alias("_r"), at.alias("_at")).select(
        "path", F.col("_r.kind").alias("_kind"), F.col("_r.message").alias("_msg"), "_at")
    kind = F.col("_kind")
    moved = F.when(kind == "ok", DONE).when(kind == "gone", SKIPPED).when(kind == "failed", FAILED)
    late = F.col("state") == DONE
    if timed:
        late = late | F.coalesce(F.col("_at") <= F.col("result_ts"), F.lit(False))
    out = (
        frontier.join(keyed, "path", "left").withColumn("_kind", F.when(~late, kind))
        .withColumn("state", F.coalesce(moved, "state"))
        .withColumn("attempts", F.col("attempts") + F.when(moved.isNotNull(), 1).otherwise(0))
        .withColumn("last_error", F.when(kind.isNull() | (kind == "ok"), F.col("last_error"))
                    .otherwise(F.col("_msg"))))
    if timed:
        out = out.withColumn("result_ts", F.when(kind.isNotNull(), F.col("_at")).otherwise(F.col("result_ts")))
    return out.select(*frontier.columns)


def _retryable(max_attempts: int) -> Column:
    return (F.col("state") == FAILED) & (F.col("attempts") < max_attempts)


def requeue_failed(frontier: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Failed rows with attempts left become pending again."""
    return frontier.withColumn(
        "state", F.when(_retryable(max_attempts), PENDING).otherwise(F.col("state")))


def requeue_count(frontier: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    return frontier.agg(F.count_if(_retryable(max_attempts)).alias("requeued"))


def backfill_names(tickers: DataFrame, universe: DataFrame) -> DataFrame:
    """Fill missing company names from the listings."""
    listed = universe.select("ticker", F.col("name").alias("_listed"))
    return (tickers.join(listed, "ticker", "left")
            .withColumn("name", F.coalesce("name", "_listed")).select(*tickers.columns))


def backfill_count(tickers: DataFrame) -> DataFrame:
    """How many rows a name backfill touches: every unnamed one, found or not."""
    return tickers.agg(F.count_if(F.col("name").isNull()).alias("updated"))


def mark_history(tickers: DataFrame, asked: DataFrame) -> DataFrame:
    """Set ``history_from`` to the day history was asked for (ticker, need)."""
    marks = asked.groupBy("ticker").agg(F.min("need").alias("_need"))
    return (tickers.join(marks, "ticker", "left")
            .withColumn("history_from", F.coalesce("_need", "history_from"))
            .select(*tickers.columns))


def to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring an older table up to the schema: missing columns arrive as NULL."""
    empty = empty_table(df.sparkSession, schema)
    return (empty.unionByName(df, allowMissingColumns=True)
            .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]))
