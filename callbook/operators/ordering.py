"""Position and predecessor within a key, for keys and days of any size.

A plain window over the key would sort a hot key in one task. The operators work in two
levels instead: day totals per key (bounded by the calendar) give the offset or the
predecessor across days, and rows are only ordered within their (key, day).

A single day may be hot too, such as the day that an archive was imported under. Days
with more than HOT_ROWS rows are dealt out by ranges of (key, day, tie) and scanned part by
part; what a part needs of those before it, a count or a last row, is found on one
row per part and day and joined back. The parts are settled, so they stay the same however
often they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callbook.session import settle

#: Rows of one (key, day) that a single task puts in order.
HOT_ROWS = 1_000_000
#: Hot days that are broadcast; there is at most one for every HOT_ROWS rows.
FEW_DAYS = 100_000


def day_totals(df: DataFrame, key: str, day: str) -> DataFrame:
    """(key, day) with n rows, rows ``before`` that day, ``total`` and ``first_day``."""
    daily = df.groupBy(key, day).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(key)
    earlier = whole.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(
        "*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("total"), F.min(day).over(whole).alias("first_day"))


def _same_day(key: str, day: str) -> Column:
    """Equal key and day, NULL days included; the other side has them with an underscore."""
    return (F.col(key) == F.col("_key")) & F.col(day).eqNullSafe(F.col("_day"))


def _split(df: DataFrame, by_day: DataFrame, key: str, day: str, hot_rows: int
           ) -> tuple[DataFrame, DataFrame | None]:
    """Rows of usual and of hot days; ``by_day`` has n rows of each (key, day) and should be stored."""
    hot = by_day.filter(F.col("n") > hot_rows).select(F.col(key).alias("_key"), F.col(day).alias("_day"))
    found = hot.count()
    if not found:
        return df, None
    if found <= FEW_DAYS:
        hot = F.broadcast(hot)
    same = _same_day(key, day)
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def range_parts(df: DataFrame, key: str, day: str, tie: list[str]) -> DataFrame:
    """The rows in ranges of (key, day, tie), with the number of their range as ``_part``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(parts, key, day, *tie).withColumn("_part", F.spark_partition_id()))


def _carried(parts: DataFrame, carry: DataFrame, key: str, day: str) -> DataFrame:
    """Rows of ``parts`` with the other columns of their part and day."""
    other = carry.withColumnsRenamed({key: "_key", day: "_day", "_part": "_other"})
    return parts.join(other, _same_day(key, day) & (F.col("_part") == F.col("_other"))).drop(
        "_key", "_day", "_other")


def _earlier_parts(key: str, day: str):
    return Window.partitionBy(key, day).orderBy("_part")


def with_rank_in_day(df: DataFrame, by_day: DataFrame, key: str, day: str, tie: list[str],
                     hot_rows: int = HOT_ROWS, name: str = "rank") -> DataFrame:
    """Add the place of a row within its (key, day): 1, 2, ...

    ``by_day`` holds the number n of rows of each (key, day). Rows of one key, day and tie
    share no place, and which of them comes first is arbitrary.
    """
    usual, hot = _split(df, by_day, key, day, hot_rows)
    ranked = usual.withColumn(name, F.row_number().over(Window.partitionBy(key, day).orderBy(*tie)))
    if hot is None:
        return ranked
    parts = range_parts(hot, key, day, tie)
    earlier = _earlier_parts(key, day).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.groupBy("_part", key, day).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", key, day, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part", key, day).orderBy(*tie))
    scanned = _carried(parts.withColumn("_within", within), carry, key, day)
    return ranked.unionByName(scanned.withColumn(
        name, (F.col("_before") + F.col("_within")).cast("int")).select(*ranked.columns))


def with_ordinal(df: DataFrame, key: str, day: str, tie: list[str],
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``ordinal``, ``total`` and ``first_day`` of each row's key."""
    totals = settle(day_totals(df, key, day))
    ranked = with_rank_in_day(df, totals, key, day, tie, hot_rows, "_rank")
    return (
        _on_day(ranked, totals.drop("n"), key, day)
        .withColumn("ordinal", F.col("before") + F.col("_rank"))
        .drop("before", "_rank")
    )


def _on_day(df: DataFrame, by_day: DataFrame, key: str, day: str) -> DataFrame:
    """Rows with the other columns of their (key, day); rows without a day share one, the first."""
    other = by_day.withColumnsRenamed({key: "_key", day: "_day"})
    return df.join(other, _same_day(key, day)).drop("_key", "_day")


def with_previous(df: DataFrame, key: str, day: str, tie: str, columns: list[str],
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``prev``, a struct of ``columns`` of the row before in (day, tie) order."""
    record = F.struct(*columns)
    last_of_day = df.groupBy(key, day).agg(F.count(F.lit(1)).alias("n"), F.max_by(record, tie).alias("_last"))
    across = settle(last_of_day.select(
        key, day, "n", F.lag("_last").over(Window.partitionBy(key).orderBy(day)).alias("_across")))
    usual, hot = _split(df, across, key, day, hot_rows)
    linked = usual.withColumn("_within", F.lag(record).over(Window.partitionBy(key, day).orderBy(tie)))
    if hot is not None:
        parts = range_parts(hot, key, day, [tie])
        carry = parts.groupBy("_part", key, day).agg(F.max_by(record, tie).alias("_last")).select(
            "_part", key, day, F.lag("_last").over(_earlier_parts(key, day)).alias("_before"))
        within = F.lag(record).over(Window.partitionBy("_part", key, day).orderBy(tie))
        scanned = _carried(parts.withColumn("_in_part", within), carry, key, day)
        linked = linked.unionByName(scanned.withColumn(
            "_within", F.coalesce("_in_part", "_before")).select(*linked.columns))
    return (
        _on_day(linked, across.drop("n"), key, day)
        .withColumn("prev", F.coalesce("_within", "_across"))
        .drop("_across", "_within")
    )


def newest_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark limits each key before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)
