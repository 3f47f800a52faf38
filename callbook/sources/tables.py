"""Stored tables (S8, S10) and their keyed writes.

A table with a month is a folder of month partitions. A keyed table without one is a folder of
versions: a write makes a new version next to the one in use, and an empty file inside it,
made at the very end, puts it in use. A job that dies before leaves the old rows as they
were. What was written once is noted beside the tables, so that a table that is gone is an
error and not an empty table. One writer at a time is assumed, as for the partitions.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callbook.operators.merge import to_schema
from callbook.schemas import TABLES
from callbook.session import counted, empty_table, settle_counted

#: Name of a version's folder, of the file that puts it in use, and of the folder of notes.
VERSION, IN_USE, NOTES = "version={:010d}", "_IN_USE", "_written"
#: Versions that stay besides the one in use, for readers that started before the last write.
OLDER_VERSIONS = 1


class LostTable(RuntimeError):
    """A table that has been written is no longer there."""


def _place(spark: SparkSession, path: str):
    """The store that a path lies in, and the path in its terms."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    store, place = _place(spark, path)
    return store.exists(place)


def _touch(spark: SparkSession, path: str) -> None:
    store, place = _place(spark, path)
    store.create(place, True).close()


def _versioned(name: str) -> bool:
    _, keys, part = TABLES[name]
    return part is None and bool(keys)


def _versions(spark: SparkSession, folder: str) -> list[tuple[int, bool]]:
    """(number, whether it is or was in use) of all versions, in order."""
    store, place = _place(spark, folder)
    if not store.exists(place):
        return []
    prefix = VERSION.partition("=")[0] + "="
    names = [s.getPath().getName() for s in store.listStatus(place) if s.isDirectory()]
    return sorted((int(n[len(prefix):]), _exists(spark, f"{folder}/{n}/{IN_USE}"))
                  for n in names if n.startswith(prefix))


def _current(spark: SparkSession, root: str, name: str) -> str:
    """The folder that holds a table's rows now."""
    folder = f"{root}/{name}"
    if _versioned(name):
        used = [n for n, whole in _versions(spark, folder) if whole]
        if used:
            return f"{folder}/{VERSION.format(used[-1])}"
    return folder       # one that was written before there were versions holds its rows itself


def _lost(spark: SparkSession, root: str, name: str) -> bool:
    return _exists(spark, f"{root}/{NOTES}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table in today's schema; empty when it was never written.

    Columns that older files lack read as NULL, which is all an additive
    migration takes (K12). A table that was written and is gone raises LostTable.
    """
    schema, keys, _ = TABLES[name]
    folder = _current(spark, root, name)
    unfinished = _versioned(name) and folder == f"{root}/{name}" and _versions(spark, folder)
    stored = None       # never written, or its first write was cut off
    if not unfinished and _exists(spark, folder):
        stored = spark.read.schema(schema).parquet(folder)
    if stored is None:
        if _lost(spark, root, name):
            raise LostTable(f"table {name} under {root} was written and is gone")
        return empty_table(spark, schema)
    return stored.dropna(subset=keys) if keys else stored


def _replace(df: DataFrame, root: str, name: str) -> int:
    """A new version, in use from the moment that all of it is written; its number of rows."""
    spark, folder = df.sparkSession, f"{root}/{name}"
    before = _versions(spark, folder)
    number = before[-1][0] + 1 if before else 1
    version = f"{folder}/{VERSION.format(number)}"
    rows, count = counted(df.hint("rebalance"))
    rows.write.parquet(version)
    _touch(spark, f"{version}/{IN_USE}")
    kept = [n for n, whole in before if whole][-OLDER_VERSIONS:]
    for old, _ in before:
        if old not in kept:
            store, place = _place(spark, f"{folder}/{VERSION.format(old)}")
            store.delete(place, True)
    return count.get["rows"]


def rewrite(root: str, name: str, merged: DataFrame, covering: DataFrame | None = None) -> int:
    """Replace (the touched partitions of) a table by rows derived from it; the rows written.

    A partition is only replaced when there is a row for it. Where a merge may
    leave a partition empty, ``covering`` names the partitions it covers: those
    without a row left get one without a key, which reads skip.
    """
    schema, _, part = TABLES[name]
    rows = to_schema(merged, schema)
    if part is None:
        written = _replace(rows, root, name)    # the rows in use stay, so they can be read meanwhile
    else:
        count = None
        if covering is not None:
            rows, written = settle_counted(rows)
            emptied = covering.select(part).distinct().join(
                rows.select(part).distinct(), part, "left_anti")
            rows = rows.unionByName(to_schema(emptied, schema))
        # Few files per partition, yet a big partition is split over many tasks.
        rows = rows.hint("rebalance", part)
        if covering is None:
            rows, count = counted(rows)
        # Only the partitions that occur in the rows are replaced, when all of them are written,
        # so the rows may be read from those partitions meanwhile.
        (rows.write.mode("overwrite").partitionBy(part)
         .option("partitionOverwriteMode", "dynamic").parquet(f"{root}/{name}"))
        if count is not None:
            written = count.get["rows"]
    _touch(merged.sparkSession, f"{root}/{NOTES}/{name}")
    return written


def touched(table: DataFrame, new: DataFrame, part: str) -> DataFrame:
    """The partitions of a table that a settled batch falls into.

    The values are looked up first, at most one per calendar month, so that the
    scan lists and reads only their folders.
    """
    return within(table, [r[0] for r in new.select(part).distinct().collect()], part)


def within(table: DataFrame, values: list[str], part: str) -> DataFrame:
    """Some partitions of a table."""
    return table.filter(F.col(part).isin(values))


def partitions(spark: SparkSession, root: str, name: str) -> list[str]:
    """The partition values of a stored table, in order; at most one per calendar month."""
    store, place = _place(spark, f"{root}/{name}")
    prefix = f"{TABLES[name][2]}="
    names = [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []
    return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))


def drop_partitions(spark: SparkSession, root: str, name: str, values: list[str]) -> None:
    for value in values:
        store, place = _place(spark, f"{root}/{name}/{TABLES[name][2]}={value}")
        store.delete(place, True)


def append(df: DataFrame, root: str, name: str) -> int:
    """Append rows (the run log, new frontier rows); their number."""
    schema, _, part = TABLES[name]
    rows, count = counted(to_schema(df, schema))
    writer = rows.write.mode("append")
    (writer.partitionBy(part) if part else writer).parquet(f"{root}/{name}")
    _touch(df.sparkSession, f"{root}/{NOTES}/{name}")
    return count.get["rows"]


CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str) -> int:
    """Export as CSV files with a header (K11); the rows written.

    Quotes are doubled, as spreadsheets read them. CSV cannot tell NULL from an empty text.
    """
    rows, count = counted(df)
    rows.write.mode("overwrite").options(**CSV).csv(path)
    return count.get["rows"]


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """An export read back; texts may hold line ends, and empty ones are NULL."""
    return spark.read.schema(schema).options(multiLine=True, **CSV).csv(path)


def query(spark: SparkSession, sql: str, args: dict | None = None, **frames) -> DataFrame:
    """Parameterised SQL over named DataFrames and stored tables."""
    return spark.sql(sql, args=args, **frames)


def day_bounds(articles: DataFrame, first: date = date(2020, 1, 1)) -> DataFrame:
    """(first_day, last_day) of the articles; fixed start to today when empty."""
    return articles.agg(
        F.coalesce(F.min("published_day"), F.lit(first)).alias("first_day"),
        F.coalesce(F.max("published_day"), F.current_date()).alias("last_day"))
