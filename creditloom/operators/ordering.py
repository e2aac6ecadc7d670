"""Positions and running totals over a global order, without a one-task window.

Rows are range-partitioned and kept in the shared folder, so the partition a
row sits in is fixed from then on. One small total per partition gives every
partition its starting point; within a partition the work is local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.session import settle_in_place

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    return settle_in_place(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn(
        "_part", F.spark_partition_id())


def _starts(totals: DataFrame, columns: list[str]) -> DataFrame:
    # One row per partition: the window runs over as many rows as there are tasks.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_start_{c}") for c in columns])


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number the distinct values of `key` 0..n-1 in ascending order."""
    ranged = _ranged(df.select(key).distinct(), [F.col(key)])
    starts = _starts(ranged.groupBy("_part").agg(F.count("*").alias("n")), ["n"])
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (ranged.withColumn("_within", within)
            .join(F.broadcast(starts), "_part")
            .select(key, (F.col("_start_n") + F.col("_within")).cast("int").alias(name)))


def running_totals(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Adds `<column>_before`: the total of `column` over all rows that sort earlier.

    `order` has to be unique per row; aggregate ties away first.
    """
    ranged = _ranged(df, [F.col(order)])
    starts = _starts(ranged.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns]), columns)
    local = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "_part")
    for c in columns:
        out = out.withColumn(f"{c}_before", F.col(f"_start_{c}") + F.coalesce(F.sum(c).over(local), F.lit(0)))
    return out.drop("_part", *[f"_start_{c}" for c in columns])


def highest_before(df: DataFrame, order: str, column: str) -> DataFrame:
    """Adds `<column>_before`: the highest `column` over all rows that sort earlier, null for the first.

    `order` has to be unique per row; aggregate ties away first.
    """
    ranged = _ranged(df, [F.col(order)])
    # One row per partition, as in `_starts`.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.max(column).alias("_high")).select("_part", F.max("_high").over(earlier).alias("_start"))
    local = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(starts), "_part").withColumn(
        f"{column}_before", F.greatest("_start", F.max(column).over(local))).drop("_part", "_start")
