"""Reading the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def files_mark(spark: SparkSession, folder: str, *names: str) -> tuple:
    """Lengths and times of the files of some tables, which change when a table is written again under its path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.parquet")
        for f in path.getFileSystem(conf).listStatus(path):
            out.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
    return tuple(out)
