"""Copies of stored tables in buckets of a key, so that joins on it need no shuffle.

Coverage, articles and outcomes meet on ``path`` in most reports. Their copies are written
once after a load, hashed and sorted into the same number of files, and every later
join reads bucket by bucket. A copy can be made again from its table at any time.

The session's catalog holds the tables' definitions; a session that does not know a copy yet
defines it from its folder, whose name carries the number of buckets.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession

from callbook.sources.tables import LostTable, _place

#: Rows that a bucket holds at most when the number of buckets is left open.
BUCKET_ROWS = 2_000_000


def buckets_for(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    """A power of two, so that tables of different sizes still have buckets that match."""
    return 1 << max(0, -(-rows // per_bucket) - 1).bit_length()


def _table(root: str, name: str, key: str) -> str:
    return f"{name}_by_{key}_{zlib.crc32(root.encode()):08x}"


def _folders(spark: SparkSession, base: str) -> list[tuple[str, int]]:
    """(folder, buckets) of the finished copies, the last one last."""
    store, place = _place(spark, base)
    if not store.exists(place):
        return []
    done = []
    for status in store.listStatus(place):
        parts = status.getPath().getName().split("-")      # time, buckets, a name of its own
        marker = _place(spark, f"{base}/{status.getPath().getName()}/_DONE")[1]
        if len(parts) == 3 and store.exists(marker):
            done.append((int(parts[0]), status.getPath().getName(), int(parts[1])))
    return [(f"{base}/{folder}", buckets) for _, folder, buckets in sorted(done)]


def store_bucketed(df: DataFrame, root: str, name: str, key: str = "path", buckets: int = 64) -> DataFrame:
    """Write a copy of ``df`` in buckets of ``key``, sorted by it within each, and read it.

    The copy before it stays until this one is complete and is then deleted.
    """
    spark, base = df.sparkSession, f"{root}/by_{key}/{name}"
    before = _folders(spark, base)
    turn = int(before[-1][0].rsplit("/", 1)[1].split("-")[0]) + 1 if before else 1
    folder = f"{base}/{turn}-{buckets}-{uuid.uuid4().hex[:8]}"
    spark.sql(f"DROP TABLE IF EXISTS {_table(root, name, key)}")
    (df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", folder).saveAsTable(_table(root, name, key)))
    store, marker = _place(spark, f"{folder}/_DONE")
    store.create(marker, True).close()
    for old, _ in before:
        store.delete(_place(spark, old)[1], True)
    return spark.table(_table(root, name, key))


def read_bucketed(spark: SparkSession, root: str, name: str, key: str = "path") -> DataFrame:
    """The last complete copy, in this or in a new session."""
    found = _folders(spark, f"{root}/by_{key}/{name}")
    if not found:
        raise LostTable(f"{name} under {root} has no copy by {key}")
    folder, buckets = found[-1]
    table = _table(root, name, key)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
                  f"INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(table)
