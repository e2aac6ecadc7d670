"""The application log as a stream: files of events in, an append-only log and daily counts out.

Every run takes what is new since the last one (`availableNow`) and stops; the
checkpoint makes a rerun after a lost executor or driver write nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.sources.requests import APPLICATION_SCHEMA, as_applications


def application_stream(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """New files of `folder` whose name matches `files`."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    return as_applications(spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder))


def append_log(spark: SparkSession, source: str, log: str, state: str) -> DataFrame:
    """Appends the new applications to the Parquet log and returns the whole log."""
    (application_stream(spark, source).writeStream.format("parquet").outputMode("append")
     .option("checkpointLocation", state).trigger(availableNow=True).start(log).awaitTermination())
    return spark.read.schema(APPLICATION_SCHEMA).parquet(log)


def _daily(stream: DataFrame) -> DataFrame:
    return stream.groupBy(F.window("submitted_at", "1 day").alias("w")).agg(F.count("*").alias("n_applications")).select(
        F.to_date("w.start").cast("string").alias("day"), "n_applications")


def daily_counts(spark: SparkSession, source: str, target: str, state: str) -> DataFrame:
    """Applications per day, all days, kept up to date: each batch replaces the small result table."""
    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    (_daily(application_stream(spark, source)).writeStream.outputMode("complete").foreachBatch(replace)
     .option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("day string, n_applications bigint").parquet(target)


def daily_upserts(spark: SparkSession, source: str, target: str, state: str) -> DataFrame:
    """Applications per day, each day in a folder of its own; a batch rewrites the days it changes alone.

    A batch carries the whole count of each of its days, so one that is played
    again, or that brings a late row, leaves the right count and no second row.
    """
    def upsert(batch: DataFrame, _: int) -> None:
        (batch.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target))

    (_daily(application_stream(spark, source)).writeStream.outputMode("update").foreachBatch(upsert)
     .option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("n_applications bigint, day string").parquet(target).select("day", "n_applications")


def closed_days(spark: SparkSession, source: str, target: str, state: str, late: str = "1 day") -> DataFrame:
    """Only the days the watermark has passed; a day is written once and never again."""
    stream = application_stream(spark, source).withWatermark("submitted_at", late)
    (_daily(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
     .trigger(availableNow=True).start(target).awaitTermination())
    return spark.read.schema("day string, n_applications bigint").parquet(target)
