"""Joining with a side that is usually small.

A side is broadcast only after its rows were counted and their width taken into
account. Past the bound the join is a plain equi-join; only keys that were
counted to be hot are split over several tasks, and only their lookup rows repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.session import settle

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000
TASK_BYTES = 128_000_000  # of one key, beyond which its rows are dealt to several tasks


def row_bytes(df: DataFrame) -> int:
    """Width of the widest row, array elements and text counted by their length."""
    return df.agg(F.coalesce(F.max(_width(df)), F.lit(0))).first()[0]


def _width(df: DataFrame):
    def size(c: str, kind: T.DataType):
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.coalesce(F.size(c), F.lit(0)) * F.lit(24 if isinstance(kind, T.MapType) else 16)
        return F.coalesce(F.length(c), F.lit(0)) if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(16)

    return sum((size(f"`{f.name}`", f.dataType) for f in df.schema), F.lit(16)).cast("long")


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    rows = df.limit(max_rows + 1).count()
    return rows <= max_rows and rows * row_bytes(df) <= max_bytes


def join_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner",
                max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join `rows` with a lookup side that has been settled (computed once)."""
    if is_small(lookup, max_rows):
        return rows.join(F.broadcast(lookup), keys, how)
    return hot_key_join(rows, lookup, keys, how)


def hot_key_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Equi-join that deals the rows of each hot key to several tasks and repeats the lookup for those keys alone.

    Hot are keys whose rows take more than `task_bytes`; each is dealt to as many
    parts as that fits into its bytes.
    """
    rows = settle(rows)
    parts = F.ceil(F.sum(_width(rows)) / F.lit(task_bytes)).cast("int")
    hot = settle(rows.groupBy(*keys).agg(parts.alias("_salts")).filter("_salts > 1"))
    if is_small(hot):
        hot = F.broadcast(hot)
    parts = F.coalesce("_salts", F.lit(1))
    left = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), parts).cast("int")).drop("_salts")
    right = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
