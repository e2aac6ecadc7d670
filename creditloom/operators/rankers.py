"""Ranking models that score a user and a product from one vector each.

A factorisation machine scores a pair by the dot product of its vectors. A
perceptron's first layer is a sum of a part of the user, a part of the product
and one of the product of their collaborative factors: the vectors carry the
first two and the factors, and only what is behind them is worked out per pair,
as matrix products over a block of users and a block of products. So either
model ranks a whole catalog without a table of pairs.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.constants import SEED
from creditloom.functions.vectors import dot, hadamard, sigmoid
from creditloom.operators import passes
from creditloom.operators.models import FactorRanker, fit_factor_ranker, fit_perceptron
from creditloom.operators.sizing import join_lookup
from creditloom.session import settle

__all__ = ["FactorRanker", "PerceptronRanker", "fit_factor_ranker", "fit_perceptron_ranker", "load", "save", "score_candidates"]

_HELD = 4_000_000  # hidden values held at once in a task


def _squash(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


@dataclass(frozen=True)
class PerceptronRanker:
    """A multilayer perceptron over factor products, factors and features of user and product.

    `layers` are the widths, `weights` those of the fitted network in its own
    order. Without collaborative factors a side counts as zeros.
    """

    layers: list[int]
    weights: list[float]
    factors: int
    user_dim: int
    item_dim: int

    def _matrices(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per layer the weights (out, in) and offsets (out,)."""
        flat, out, at = np.array(self.weights), [], 0
        for wide, narrow in zip(self.layers, self.layers[1:]):
            matrix = flat[at:at + wide * narrow].reshape(wide, narrow).T
            out.append((matrix, flat[at + wide * narrow:at + (wide + 1) * narrow]))
            at += (wide + 1) * narrow
        return out

    def _first(self) -> tuple[np.ndarray, ...]:
        """The first layer's weights of factor products, user and item factors, user and item features, and its offsets."""
        matrix, offsets = self._matrices()[0]
        d, u = self.factors, self.user_dim
        return (*np.split(matrix, [d, 2 * d, 3 * d, 3 * d + u], axis=1), offsets)

    def _side(self, rows: DataFrame, key: str, side: str):
        meet, user, item, user_features, item_features, offsets = self._first()
        by_factor, by_feature, constant = (user, user_features, 0.0 * offsets) if side == "user" else (item, item_features, offsets)
        missing, d = np.zeros(self.factors), self.factors

        @F.pandas_udf("array<double>")
        def vector(factors: pd.Series, features: pd.Series) -> pd.Series:
            known = np.stack([missing if f is None else np.asarray(f, float) for f in factors])
            return pd.Series(list(np.hstack([known, known @ by_factor.T + np.stack(features.to_numpy()) @ by_feature.T + constant])))

        return rows.select(key, vector(f"{side}_factors", f"{side}_features").alias("vector"))

    def user_vectors(self, users: DataFrame) -> DataFrame:
        """(member_id, vector) out of (member_id, user_factors, user_features)."""
        return self._side(users, "member_id", "user")

    def item_vectors(self, items: DataFrame) -> DataFrame:
        """(item_id, vector) out of (item_id, item_factors, item_features)."""
        return self._side(items, "item_id", "item")

    def _behind(self, first: np.ndarray) -> np.ndarray:
        """Log-odds from the sums of the first layer; the last axis is that layer."""
        held = _squash(first)
        *inner, (last, offsets) = self._matrices()[1:]
        for matrix, offset in inner:
            held = _squash(held @ matrix.T + offset)
        return held @ (last[1] - last[0]) + (offsets[1] - offsets[0])

    def pair_scores(self, users: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Log-odds of row i of both."""
        d = self.factors
        return self._behind((users[:, :d] * items[:, :d]) @ self._first()[0].T + users[:, d:] + items[:, d:])

    def block_scores(self, users: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Log-odds of every user with every item, (users, items)."""
        d, meet = self.factors, self._first()[0]
        out = np.empty((len(users), len(items)))
        many = max(1, _HELD // max(1, self.layers[1]))
        for b in range(0, len(items), many):
            part = items[b:b + many]
            step = max(1, many // max(1, len(part)))
            for a in range(0, len(users), step):
                some = users[a:a + step]
                first = np.matmul(part[None, :, :d], (some[:, None, :d] * meet[None]).transpose(0, 2, 1))
                out[a:a + step, b:b + many] = self._behind(first + some[:, None, d:] + part[None, :, d:])
        return out


def fit_perceptron_ranker(pairs: DataFrame, users: DataFrame, items: DataFrame, hidden: tuple[int, ...] = (128, 64, 32),
                          iterations: int = 40, start: PerceptronRanker | None = None) -> PerceptronRanker:
    """Fits on (member_id, item_id, label); `users` and `items` carry their factors, or null, and their features.

    `start` is a network of the same layers to go on from. A catalog that fits
    into the tasks is fitted by passes, a larger one by Spark's own fit.
    """
    shapes = users.agg(F.max(F.size("user_factors")).alias("d"), F.max(F.size("user_features")).alias("u")).first()
    items = settle(items.select("item_id", "item_factors", "item_features"))
    item_dim = items.agg(F.max(F.size("item_features"))).first()[0]
    zeros = F.array_repeat(F.lit(0.0), max(0, shapes.d))
    side = lambda c: F.coalesce(F.transform(c, lambda x: x.cast("double")), zeros)
    layers = [3 * shapes.d + shapes.u + item_dim, *hidden, 2]
    weights = start.weights if start is not None and start.layers == layers else None
    if passes.few_products(items, hidden[0]):
        catalog = items.select("item_id", side("item_factors").alias("v"), "item_features").orderBy("item_id").collect()  # bounded above
        known = users.select("member_id", side("user_factors").alias("user_factors"), "user_features")
        blocks = passes.pair_blocks(pairs, known, ["user_factors", "user_features"], [r.item_id for r in catalog], passes.NETWORK_PAIRS)
        fitted = passes.fit_network(blocks, layers, np.array([r.v for r in catalog], float), np.array([r.item_features for r in catalog], float),
                                    iterations, SEED, pairs.sparkSession, weights)
        blocks.release()
    else:
        joined = join_lookup(pairs.join(users, "member_id"), items, ["item_id"])
        u, v = side("user_factors"), side("item_factors")
        data = joined.select("label", array_to_vector(F.concat(hadamard(u, v), u, v, "user_features", "item_features")).alias("features"))
        fitted = fit_perceptron(data, hidden, iterations, weights).weights.toArray()
    return PerceptronRanker(layers, [float(w) for w in fitted], shapes.d, shapes.u, item_dim)


def save(spark: SparkSession, ranker: FactorRanker | PerceptronRanker, path: str) -> None:
    text = json.dumps({"kind": type(ranker).__name__, **asdict(ranker)})
    spark.createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> FactorRanker | PerceptronRanker:
    stored = json.loads(spark.read.schema("model string").json(path).first().model)
    return {c.__name__: c for c in (FactorRanker, PerceptronRanker)}[stored.pop("kind")](**stored)


def score_candidates(candidates: DataFrame, ranker: FactorRanker | PerceptronRanker, user_vectors: DataFrame,
                     item_vectors: DataFrame) -> DataFrame:
    """Adds `score`, the ranker's probability, to (member_id, item_id) rows; the item vectors are settled."""
    joined = join_lookup(candidates.join(user_vectors.withColumnRenamed("vector", "_u"), "member_id"),
                         item_vectors.withColumnRenamed("vector", "_v"), ["item_id"])
    if isinstance(ranker, FactorRanker):
        return joined.withColumn("score", sigmoid(dot(F.col("_u"), F.col("_v")))).drop("_u", "_v")

    @F.pandas_udf("double")
    def score(users: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series(_squash(ranker.pair_scores(np.stack(users.to_numpy()), np.stack(items.to_numpy()))))

    return joined.withColumn("score", score("_u", "_v")).drop("_u", "_v")
