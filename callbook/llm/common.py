"""What the operators share: Arrow batches of bounded size, splits by id, short folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callbook.session import ensure_checkpoint_dir, settle, unsettle

__all__ = ["chunks", "long_rows", "map_batches", "remainder", "settle", "settle_by", "spare_name", "table", "unsettle"]

#: Bytes of text that one step of a Python worker holds; one longer text is a step of its own.
CHUNK_BYTES = 8 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle_by(df: DataFrame, key: str) -> DataFrame:
    """Write the rows in buckets of a column, as many as shuffles have partitions, and read that.

    Grouping by the column then needs no shuffle of these rows, only of what they meet.
    """
    spark, name = df.sparkSession, f"by_{key}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.format("parquet").bucketBy(buckets, key)
     .option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


#: Documents are long rows; so many go to a Python worker at once, or fewer if the session says so.
BATCH_ROWS = 1000


def long_rows(spark) -> None:
    """Let the session hand documents to Python in batches that fit in little memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def spare_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def chunks(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in slices of at most `limit` bytes of `column`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def map_batches(df: DataFrame, schema: str, column: str,
                make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]],
                limit: int = CHUNK_BYTES) -> DataFrame:
    """Run one function per slice of rows, next to the data and without a shuffle.

    `make()` runs once a task and returns the function; it gets a slice of about `limit` bytes
    of `column` and returns the columns of `schema` by name, as lists or Arrow arrays.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    long_rows(df.sparkSession)

    def run(batches):
        step = make()
        for part in chunks(batches, column, limit):
            out = step(part)
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) and v.type == f.type else
                 (v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type))
                 for f in arrow for v in [out[f.name]]], schema=arrow)
        pa.default_memory_pool().release_unused()       # workers live on for other tasks

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
