"""Feature vectors of users and products.

Fitting is a handful of aggregates; what is kept is as small as the number of
features. Applying is a projection of built-in expressions, so the transform
runs inside the scan stage of whatever reads it.

The median interpolates between the two middle values and the spread is the
population one, with a constant column scaled by one.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.constants import (
    ITEM_CATEGORICAL, ITEM_NUMERIC, MISSING_CATEGORY, RARE_CATEGORY, USER_CATEGORICAL, USER_NUMERIC,
)
from creditloom.operators.preparation import collapse_states, top_states
from creditloom.operators.quantiles import exact_quantiles

MAX_CATEGORIES = 1000


@dataclass(frozen=True)
class FeatureSpec:
    """What a fit leaves behind: fill values, centre and spread, and category lists."""

    median: dict[str, float]
    mean: dict[str, float]
    spread: dict[str, float]
    categories: dict[str, list[str]]

    def names(self) -> list[str]:
        return [*self.median, *[f"{c}={v}" for c, vs in self.categories.items() for v in vs]]

    def fields(self) -> list[str]:
        """The source field of each feature, in vector order."""
        return [*self.median, *[c for c, vs in self.categories.items() for _ in vs]]

    def columns(self) -> list[Column]:
        out = []
        for c in self.median:
            filled = F.coalesce(F.col(c).cast("double"), F.lit(self.median[c]))
            out.append((filled - F.lit(self.mean[c])) / F.lit(self.spread[c]))
        for c, values in self.categories.items():
            filled = F.coalesce(F.col(c), F.lit(MISSING_CATEGORY))
            out += [(filled == F.lit(v)).cast("double") for v in values]
        return out

    def vector(self) -> Column:
        """All features as array<double>; a category never seen gives zeros."""
        return F.array(*self.columns())

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "spec string").write.json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureSpec:
        return cls(**json.loads(spark.read.schema("spec string").json(path).first().spec))


def category_values(rows: DataFrame, column: str, most: int = MAX_CATEGORIES) -> list[str]:
    """The categories of a column. Each is a feature of its own, so beyond `most` this is an error, never a cut."""
    values = [r[0] for r in rows.select(F.coalesce(F.col(column), F.lit(MISSING_CATEGORY)).alias("v")).distinct()
              .limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} categories; collapse rare ones first")
    return sorted(values)


def fit_features(rows: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...],
                 max_categories: int = MAX_CATEGORIES) -> FeatureSpec:
    numbers = rows.select(*[F.col(c).cast("double").alias(c) for c in numeric])
    medians = exact_quantiles(numbers, {c: (c, 0.5) for c in numeric}).first().asDict()
    medians = {c: (0.0 if medians[c] is None else medians[c]) for c in numeric}
    filled = numbers.fillna(medians)
    stats = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in numeric],
                       *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]).first()
    return FeatureSpec(
        medians, {c: stats[f"m_{c}"] for c in numeric}, {c: stats[f"s_{c}"] or 1.0 for c in numeric},
        {c: category_values(rows, c, max_categories) for c in categorical})


def user_rows(profiles: DataFrame) -> DataFrame:
    """Profiles with the rare states collapsed, ready to fit or transform."""
    return collapse_states(profiles, top_states(profiles))


def fit_user_features(profiles: DataFrame) -> FeatureSpec:
    return fit_features(user_rows(profiles), USER_NUMERIC, USER_CATEGORICAL)


def fit_item_features(catalog: DataFrame) -> FeatureSpec:
    return fit_features(catalog, ITEM_NUMERIC, ITEM_CATEGORICAL)


def known_state(spec: FeatureSpec, state: Column) -> Column:
    """A state as the fitted list knows it: unlisted and missing ones are `other`."""
    listed = [v for v in spec.categories["addr_state"] if v != RARE_CATEGORY]
    return F.when(state.isin(*listed), state).otherwise(RARE_CATEGORY)


def long_form(rows: DataFrame, key: str, spec: FeatureSpec) -> DataFrame:
    """(key, feature, value), one row per feature."""
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("value"))
                      for n, c in zip(spec.names(), spec.columns())])
    return rows.select(key, F.explode(cells).alias("cell")).select(key, "cell.feature", "cell.value")
