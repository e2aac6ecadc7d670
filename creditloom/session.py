"""Session settings and the shared folder that job results go through."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. All are runtime settings, so they can be
# applied to a session somebody else created.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session, for tests and the benchmark only."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("creditloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="creditloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_OWNED: ContextVar[str | None] = ContextVar("scratch", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table or model, below the shared folder or the scratch folder that a job owns."""
    folder = _OWNED.get() or f"{shared_folder(spark).rstrip('/')}/creditloom"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def own_scratch(spark: SparkSession) -> Iterator[str]:
    """A scratch folder for what is settled inside, removed at the end.

    For jobs that write all of their results elsewhere; a DataFrame that is read
    after the end must not depend on it.
    """
    folder = scratch_path(spark, "owned")
    token = _OWNED.set(folder)
    try:
        yield folder
    finally:
        _OWNED.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Compute once and read back from a table in the shared folder.

    Lineage ends there, later plans read only the columns they use, and the size
    of the files tells Spark whether a side is small enough to broadcast.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_in_place(df: DataFrame) -> DataFrame:
    """Compute once, keeping every row in the partition and position it has now."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
