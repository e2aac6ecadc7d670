"""Vector arithmetic over array columns, kept inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(
        F.transform(a, lambda x: x.cast("double")))


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def fm_second_order(fields: list[Column]) -> Column:
    """Half of (squared length of the sum minus sum of squared lengths) over field vectors."""
    total = fields[0]
    for field in fields[1:]:
        total = F.zip_with(total, field, lambda x, y: x.cast("double") + y.cast("double"))
    squares = sum((dot(f, f) for f in fields[1:]), dot(fields[0], fields[0]))
    return F.lit(0.5) * (dot(total, total) - squares)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
