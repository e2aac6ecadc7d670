"""Repayment and ranking models on pyspark.ml, and scoring of pairs.

Tree boosting stands for the repayment model, a factorisation machine and a
multilayer perceptron for the ranking models. All of them read features joined
to pairs by key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml.classification import (
    FMClassifier, GBTClassificationModel, GBTClassifier, MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.constants import GBT_DEPTH, GBT_ROUNDS, GBT_STEP, GBT_SUBSAMPLE, SEED
from creditloom.functions.vectors import hadamard
from creditloom.operators import passes
from creditloom.operators.sizing import join_lookup
from creditloom.operators.trees import boxes_of
from creditloom.session import settle


def pair_features(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Adds `features`, the user's followed by the product's.

    `users` is (member_id, user_features), `items` the settled (item_id,
    item_features).
    """
    joined = join_lookup(pairs.join(users.select("member_id", "user_features"), "member_id"),
                         items.select("item_id", "item_features"), ["item_id"])
    return joined.withColumn("features", array_to_vector(F.concat("user_features", "item_features"))).drop(
        "user_features", "item_features")


def for_training(data: DataFrame) -> DataFrame:
    """Settled rows in at least as many partitions as the cluster has cores.

    Adaptive execution merges small shuffle partitions, which suits one pass but
    leaves cores idle in a fit that reads the rows many times.
    """
    data = settle(data)
    cores = data.sparkSession.sparkContext.defaultParallelism
    return data if data.rdd.getNumPartitions() >= cores else data.repartition(cores)


# --- repayment ---------------------------------------------------------------

def _booster(rounds: int, depth: int) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=GBT_STEP, subsamplingRate=GBT_SUBSAMPLE,
                         featureSubsetStrategy="0.8", minInstancesPerNode=5, seed=SEED, checkpointInterval=10)


def _best_round(model, val: DataFrame) -> int:
    """Rounds after which the AUC on `val` was highest.

    Scores are counted in 10,000 equal cells per round, so one aggregate holds
    every round's curve.
    """
    cells = boxes_of(model).staged_cells(val)
    order = Window.partitionBy("round").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.groupBy("round", "cell").agg(F.sum(F.col("label") * F.col("n")).alias("pos"), F.sum((1 - F.col("label")) * F.col("n")).alias("neg"))
    won = F.sum(F.col("pos") * (F.coalesce(F.col("below"), F.lit(0)) + F.col("neg") / F.lit(2.0)))
    curve = counted.withColumn("below", F.sum("neg").over(order)).groupBy("round").agg(
        (won / F.nullif((F.sum("pos") * F.sum("neg")).cast("double"), F.lit(0.0))).alias("auc"))
    return curve.orderBy(F.col("auc").desc_nulls_last(), "round").first()["round"]


def fit_repay_model(train: DataFrame, val: DataFrame, rounds: int = GBT_ROUNDS, depth: int = GBT_DEPTH,
                    patience: int = 20):
    """Boosted trees on (features, label), stopped once `patience` rounds brought no better AUC on `val`.

    The number of rounds doubles until the best one lies far enough back; the
    same seed grows the same first trees again. What was grown beyond the best
    round and its patience is cut off.
    """
    train, fitted = for_training(train), min(rounds, 2 * patience)
    while True:
        model = _booster(fitted, depth).fit(train)
        best = _best_round(model, val)
        if fitted >= rounds or best + patience <= fitted:
            return first_trees(model, min(fitted, best + patience))
        fitted = min(rounds, 2 * fitted)


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The ensemble after its first `n` rounds."""
    if n >= model.getNumTrees:
        return model
    context = SparkContext._active_spark_context
    gateway, jvm = context._gateway, context._jvm
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    for i, (tree, weight) in enumerate(zip(model._call_java("trees"), model.treeWeights[:n])):
        if i < n:
            trees[i], weights[i] = tree, float(weight)
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, trees, weights, model.numFeatures, model.numClasses)
    return GBTClassificationModel(cut)


def probability() -> Column:
    return vector_to_array("probability")[1]


def with_raw_repay(pairs: DataFrame, model) -> DataFrame:
    """Adds `raw_prob`."""
    scored = model.transform(pairs)
    return scored.withColumn("raw_prob", probability()).drop("rawPrediction", "probability", "prediction")


def fit_calibrator(scored: DataFrame) -> IsotonicRegressionModel:
    """Monotone map from raw to observed probability, on (raw_prob, label).

    Equal scores are merged into one weighted row first.
    """
    merged = scored.groupBy("raw_prob").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="raw_prob", labelCol="label", weightCol="weight").fit(merged)


def with_repay(pairs: DataFrame, model, calibrator: IsotonicRegressionModel | None) -> DataFrame:
    """Adds `raw_prob` and `repay_prob`, the calibrated one if there is a calibrator."""
    scored = with_raw_repay(pairs, model)
    if calibrator is None:
        return scored.withColumn("repay_prob", F.col("raw_prob"))
    return (calibrator.transform(scored)
            .withColumn("repay_prob", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction")))).drop("prediction"))


def calibrated(calibrator: IsotonicRegressionModel, values: DataFrame, column: str) -> DataFrame:
    """Reads the calibration curve at the values of `column`."""
    return calibrator.transform(values.withColumnRenamed(column, "raw_prob")).select(
        F.col("raw_prob").alias(column), F.col("prediction").alias("calibrated"))


# --- ranking by factorisation machine ----------------------------------------

@dataclass(frozen=True)
class FactorRanker:
    """A factorisation machine over user features, product features and the product itself.

    Its score of a pair splits into a dot product of a user vector and an item
    vector, so ranking a whole catalog is the same vector search as retrieval
    and no pair table is made.
    """

    intercept: float
    linear: list[float]
    factors: list[list[float]]
    user_dim: int
    item_dim: int

    def _side(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.linear[start:stop]), np.array(self.factors[start:stop])

    @staticmethod
    def _project(x: np.ndarray, linear: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own part of the score, and the factor that meets the other side."""
        meet = x @ factors
        own = x @ linear + 0.5 * ((meet ** 2).sum(axis=1) - (x ** 2) @ (factors ** 2).sum(axis=1))
        return own, meet

    def user_vectors(self, users: DataFrame) -> DataFrame:
        """(member_id, vector) out of (member_id, user_features)."""
        linear, factors = self._side(0, self.user_dim)
        project = self._project

        @F.pandas_udf("array<double>")
        def vector(features: pd.Series) -> pd.Series:
            own, meet = project(np.stack(features.to_numpy()), linear, factors)
            return pd.Series(list(np.column_stack([meet, own, np.ones(len(own))])))

        return users.select("member_id", vector("user_features").alias("vector"))

    def item_vectors(self, items: DataFrame) -> DataFrame:
        """(item_id, vector) out of (item_id, item_idx, item_features); a product that was not fitted has a null item_idx."""
        linear, factors = self._side(self.user_dim, self.user_dim + self.item_dim)
        own_linear, own_factors = self._side(self.user_dim + self.item_dim, len(self.linear))
        intercept, project = self.intercept, self._project

        @F.pandas_udf("array<double>")
        def vector(item: pd.Series, features: pd.Series) -> pd.Series:
            # Of the product's own weights one row is looked up, no one-hot matrix is made.
            own, meet = project(np.stack(features.to_numpy()), linear, factors)
            at = item.fillna(-1).to_numpy().astype(int)
            fitted = (at >= 0) & (at < len(own_linear))
            own[fitted] += own_linear[at[fitted]] + (meet[fitted] * own_factors[at[fitted]]).sum(axis=1)
            meet[fitted] += own_factors[at[fitted]]
            return pd.Series(list(np.column_stack([meet, np.ones(len(own)), own + intercept])))

        return items.select("item_id", vector("item_idx", "item_features").alias("vector"))


_REGULARISATION = 0.001  # of the factorisation machine


def fit_factor_ranker(pairs: DataFrame, users: DataFrame, items: DataFrame, factors: int = 16,
                      iterations: int = 100, step: float = 0.05) -> FactorRanker:
    """Fits on (member_id, item_id, label); `items` numbers the products from 0 in item_idx, however many there are.

    A catalog that fits into the tasks is fitted by passes, a larger one by Spark's own fit.
    """
    items = settle(items.select("item_id", "item_idx", "item_features"))
    if not passes.few_products(items, factors + 1):
        return fit_factor_ranker_by_rows(pairs, users, items, factors, iterations, step)
    catalog = items.orderBy("item_idx", "item_id").collect()  # bounded above
    features = np.array([r.item_features for r in catalog], float)
    blocks = passes.pair_blocks(pairs, users, ["user_features"], [r.item_id for r in catalog])
    user_dim = len(users.select("user_features").first()[0])
    intercept, linear, weights = passes.fit_machine(blocks, user_dim, features, np.array([r.item_idx for r in catalog], int), factors,
                                                    iterations, step, _REGULARISATION, SEED, pairs.sparkSession)
    blocks.release()
    return FactorRanker(intercept, linear.tolist(), weights.tolist(), user_dim, features.shape[1])


def fit_factor_ranker_by_rows(pairs: DataFrame, users: DataFrame, items: DataFrame, factors: int, iterations: int, step: float) -> FactorRanker:
    """The same by Spark's fit, on a row of features for each pair; the items are settled."""
    encoder = OneHotEncoder(inputCol="item_idx", outputCol="own", dropLast=False).fit(items)
    joined = join_lookup(pairs.join(users.select("member_id", "user_features"), "member_id"), items, ["item_id"])
    dense = encoder.transform(joined.select("label", "item_idx", array_to_vector(F.concat("user_features", "item_features")).alias("dense")))
    # Most entries are zeros of one-hot columns; the assembler stores such rows sparsely.
    data = for_training(VectorAssembler(inputCols=["dense", "own"], outputCol="features").transform(dense).select("label", "features"))
    model = FMClassifier(factorSize=factors, maxIter=iterations, stepSize=step, regParam=_REGULARISATION, seed=SEED).fit(data)
    user_dim = len(users.select("user_features").first()[0])
    weights = model.factors.toArray()
    return FactorRanker(float(model.intercept), [float(w) for w in model.linear.toArray()], weights.tolist(),
                        user_dim, len(model.linear) - user_dim - encoder.categorySizes[0])


# --- ranking by perceptron ----------------------------------------------------

def perceptron_features(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame) -> DataFrame:
    """`features` = product of the collaborative factors, both factors, pair features and repayment probability.

    `pairs` carries features (user and product) and repay_prob.
    """
    joined = join_lookup(pairs.join(user_factors.withColumnRenamed("vector", "_u"), "member_id"),
                         item_factors.withColumnRenamed("vector", "_v"), ["item_id"])
    double = lambda c: F.transform(F.col(c), lambda x: x.cast("double"))
    return joined.withColumn("features", array_to_vector(F.concat(
        hadamard(F.col("_u"), F.col("_v")), double("_u"), double("_v"), vector_to_array("features"), F.array("repay_prob")))).drop("_u", "_v")


def fit_perceptron(data: DataFrame, hidden: tuple[int, ...] = (128, 64, 32), iterations: int = 40, weights: list[float] | None = None):
    """Multilayer perceptron on (features, label), from the given weights if there are any."""
    data = for_training(data.select("features", "label"))
    width = len(data.select("features").first()[0])
    network = MultilayerPerceptronClassifier(layers=[width, *hidden, 2], maxIter=iterations, seed=SEED)
    if weights is not None:
        network = network.setInitialWeights(Vectors.dense(weights))
    return network.fit(data)
