"""Exact interpolated quantiles over columns of any size.

A sketch gives an interval that holds the wanted rank; the rows inside it are
counted by value. If too many distinct values are left, the interval is
narrowed the same way again. Each step shrinks it about a thousandfold, so a
few aggregate passes settle it and no task ever holds a whole column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
MAX_DISTINCT = 100_000


@dataclass
class _Search:
    column: str
    q: float
    low: float | None = None     # inclusive bounds of the interval still open
    high: float | None = None
    below: int = 0               # rows before the interval
    total: int = 0               # rows of the whole column

    def rank(self) -> float:
        return self.q * (self.total - 1)

    def inside(self):
        c = F.col(self.column)
        keep = c.isNotNull()
        if self.low is not None:
            keep = keep & (c >= F.lit(self.low))
        if self.high is not None:
            keep = keep & (c <= F.lit(self.high))
        return keep


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    sizes = df.agg(*[F.count_if(s.inside()).alias(f"n{i}") for i, s in enumerate(searches)]).first()
    marks = []
    for i, s in enumerate(searches):
        n = sizes[f"n{i}"]
        position = s.rank() - s.below
        slack = 3.0 / ACCURACY
        marks.append(F.percentile_approx(
            F.when(s.inside(), F.col(s.column)),
            [max(0.0, (position - 1) / n - slack), min(1.0, (position + 2) / n + slack)],
            ACCURACY).alias(f"m{i}"))
    found = df.agg(*marks).first()
    counts = df.agg(*[
        F.struct(F.count_if(F.col(s.column) < F.lit(found[f"m{i}"][0])),
                 F.count_if(F.col(s.column) <= F.lit(found[f"m{i}"][1]))).alias(f"c{i}")
        for i, s in enumerate(searches)]).first()
    for i, s in enumerate(searches):
        low, high = found[f"m{i}"]
        before, through = counts[f"c{i}"]
        if before <= int(s.rank()):
            s.low, s.below = low, before
        if through > int(s.rank()) + 1:
            s.high = high


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with a column per entry of `wanted` (name -> (column, q)), linearly interpolated."""
    names = list(wanted)
    columns = sorted({c for c, _ in wanted.values()})
    df = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    totals = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    searches = [_Search(c, q, total=totals[c]) for c, q in wanted.values()]
    open_searches = [s for s in searches if s.total > MAX_DISTINCT]
    while open_searches:
        before = [(s.low, s.high) for s in open_searches]
        _narrow(df, open_searches)
        held = df.agg(*[F.approx_count_distinct(F.when(s.inside(), F.col(s.column))).alias(f"d{i}")
                        for i, s in enumerate(open_searches)]).first()
        open_searches = [s for i, s in enumerate(open_searches)
                         if held[f"d{i}"] > MAX_DISTINCT and before[i] != (s.low, s.high)]
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("which"), F.when(s.inside(), F.col(s.column)).alias("value"))
        for i, s in enumerate(searches)])).alias("e")).select("e.*").filter("value IS NOT NULL")
    counted = stacked.groupBy("which", "value").agg(F.count("*").alias("n"))
    picks = []
    for i, (name, s) in enumerate(zip(names, searches)):
        if s.total == 0:
            picks.append(F.lit(None).cast("double").alias(name))
            continue
        at = int(s.rank())
        fraction = s.rank() - at
        first = F.min(F.when((F.col("which") == i) & (F.col("through") > at), F.col("value")))
        second = F.min(F.when((F.col("which") == i) & (F.col("through") > min(at + 1, s.total - 1)), F.col("value")))
        picks.append((first + (second - first) * F.lit(fraction)).alias(name))
    upto = Window.partitionBy("which").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(searches) for x in (i, s.below)]),
                          F.col("which"))
    return counted.withColumn("through", F.sum("n").over(upto) + starts).agg(*picks)
