"""Fits by passes over users' pairs against Spark's own fits on a row a pair."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from creditloom.operators import models, passes, rankers
from creditloom.session import settle

N_USERS, N_ITEMS = 90, 7


@pytest.fixture(scope="module")
def sides(spark):
    """Users and products, two of each without factors, and pairs with repeats, one user and one product unknown."""
    rng = np.random.default_rng(3)
    some = lambda n, missing: None if missing else [float(x) for x in rng.normal(size=n)]
    users = [(str(i), some(3, i % 40 == 1), some(4, False)) for i in range(N_USERS)]
    items = [(f"p{i}", i, some(3, i in (2, 5)), some(2, False)) for i in range(N_ITEMS)]
    pairs = [(str(rng.integers(N_USERS)), f"p{rng.integers(N_ITEMS)}", int(rng.random() < 0.4)) for _ in range(1000)]
    pairs += [(None, "p1", 1), ("0", None, 0), ("unknown", "p1", 1), ("1", "unknown", 1), *pairs[:20]]
    return (spark.createDataFrame(pairs, "member_id string, item_id string, label int"),
            spark.createDataFrame(users, "member_id string, user_factors array<float>, user_features array<double>"),
            spark.createDataFrame(items, "item_id string, item_idx int, item_factors array<float>, item_features array<double>"))


@pytest.mark.parametrize("iterations", [1, 25])
def test_machine_is_that_of_sparks_fit(sides, iterations):
    pairs, users, items = sides
    got = models.fit_factor_ranker(pairs, users, items, 5, iterations)
    want = models.fit_factor_ranker_by_rows(pairs, users, settle(items.select("item_id", "item_idx", "item_features")), 5, iterations, 0.05)
    assert (got.user_dim, got.item_dim) == (want.user_dim, want.item_dim) == (4, 2)
    assert got.intercept == pytest.approx(want.intercept, abs=1e-9)
    assert np.allclose(got.linear, want.linear, atol=1e-9) and np.allclose(got.factors, want.factors, atol=1e-9)


@pytest.mark.parametrize("iterations", [1, 12])
def test_network_is_that_of_sparks_fit(sides, iterations):
    """Spark takes the mean of the means of its blocks, so all rows are in one here."""
    pairs, users, items = sides
    items = items.drop("item_idx")
    got = rankers.fit_perceptron_ranker(pairs, users, items, (6, 4), iterations)
    zeros = F.array_repeat(F.lit(0.0), 3)
    side = lambda c: F.coalesce(F.transform(c, lambda x: x.cast("double")), zeros)
    u, v = side("user_factors"), side("item_factors")
    data = pairs.join(users, "member_id").join(items, "item_id").select("label", models.array_to_vector(
        F.concat(F.zip_with(u, v, lambda a, b: a * b), u, v, "user_features", "item_features")).alias("features")).coalesce(1)
    network = MultilayerPerceptronClassifier(layers=got.layers, maxIter=iterations, seed=models.SEED, blockSize=5000)
    assert np.allclose(got.weights, network.fit(data).weights.toArray(), atol=1e-6)
    on = rankers.fit_perceptron_ranker(pairs, users, items, (6, 4), 2, got)
    want = network.copy({network.maxIter: 2}).setInitialWeights(models.Vectors.dense(got.weights)).fit(data).weights.toArray()
    assert np.allclose(on.weights, want, atol=1e-6)


def test_past_the_bound_sparks_fits_are_used(sides, monkeypatch):
    pairs, users, items = sides
    by_passes = models.fit_factor_ranker(pairs, users, items, 3, 4)
    monkeypatch.setattr(passes, "PRODUCT_BYTES", 8 * 4 * (N_ITEMS - 1))
    monkeypatch.setattr(passes, "pair_blocks", None)
    by_rows = models.fit_factor_ranker(pairs, users, items, 3, 4)
    assert np.allclose(by_passes.factors, by_rows.factors, atol=1e-9)
    assert len(rankers.fit_perceptron_ranker(pairs, users, items, (6, 4), 2).weights) > 0


def test_sums_are_the_same_in_a_tree_and_in_small_blocks(sides, monkeypatch):
    pairs, users, items = sides
    once = models.fit_factor_ranker(pairs, users, items, 3, 4)
    monkeypatch.setattr(passes, "DRIVER_BYTES", 0)
    monkeypatch.setattr(passes, "BLOCK_PAIRS", 3)
    assert np.allclose(once.factors, models.fit_factor_ranker(pairs, users, items, 3, 4).factors, atol=1e-9)
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        models.fit_factor_ranker(pairs.withColumn("label", F.lit(2)), users, items, 3, 1)


def test_few_pairs_are_dealt_to_all_cores(spark, sides):
    pairs, users, _ = sides
    blocks = passes.pair_blocks(pairs, users, ["user_features"], [f"p{i}" for i in range(N_ITEMS)])
    held = blocks.blocks.glom().map(len).collect()
    blocks.release()
    assert len(held) == spark.sparkContext.defaultParallelism and sum(n > 0 for n in held) > len(held) / 2
