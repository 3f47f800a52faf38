"""Session settings shared by the tests, the bench and batch jobs."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def local_session(cores: str = "8", app: str = "callbook", **conf) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder: on a cluster the executors could not read
    it, and a lost executor would take the data with it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        wanted = tempfile.mkdtemp(prefix="callbook-ck-")
    sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir()


def empty_table(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows of a schema, which the optimizer knows: what joins or unites with them costs nothing."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(0).select(*columns).filter(F.lit(False))


def settle(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and read that.

    For rows that several later steps read, so that their joins run once, and
    before a table is overwritten with rows read from it. Runs a job; the rows
    outlive lost executors, and later steps get column pruning, pushed filters
    and real sizes to choose joins by.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsettle(df: DataFrame) -> None:
    """Delete the files of a settled table. Nothing that reads them may be used after it."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_scopes = threading.local()


@contextmanager
def settled_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables settled inside, at its end. Nothing that reads them may be used after it.

    For jobs that go on for long, such as a stream; others may leave the folder to the cluster.
    """
    paths: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), paths]
    try:
        yield
    finally:
        _scopes.open = _scopes.open[:-1]
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """Rows that are counted while they are written; the count is ``rows`` of the observation.

    Nothing may shuffle them again before they are written: only tasks of the last stage
    count each row once when executors are lost.
    """
    count = Observation()
    return df.observe(count, F.count(F.lit(1)).alias("rows")), count


def settle_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A settled table and its number of rows, without another scan."""
    rows, count = counted(df)
    return settle(rows), count.get["rows"]
