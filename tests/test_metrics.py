"""Hand values of the ranking metrics and of the test statistics."""

import math

import numpy as np
import pytest

from creditloom.operators import metrics


def per_user(spark, ranked, truth, k):
    rankings = spark.createDataFrame([("u", "s", str(i), r) for r, i in enumerate(ranked, 1)] or [("x", "s", "x", 1)],
                                     "member_id string, stage string, item_id string, rank int")
    pairs = spark.createDataFrame([("u", str(i)) for i in truth], "member_id string, item_id string")
    users = spark.createDataFrame([("u",)], "member_id string")
    return metrics.user_metrics(rankings, pairs, users, ["s"], k).first()


@pytest.mark.parametrize("metric, ranked, truth, k, expected", [
    ("recall", [1, 2, 3], {1, 2, 3}, 3, 1.0),
    ("recall", [4, 5, 6], {1, 2, 3}, 3, 0.0),
    ("recall", [1, 4, 5], {1, 2}, 3, 0.5),
    ("recall", [1, 2, 3], set(), 3, 0.0),
    ("recall", [1, 2], {1, 2}, 10, 1.0),
    ("recall", [1, 2, 3], {1, 2}, 2, 1.0),
    ("recall", [1, 2], {1, 2, 3, 4}, 2, 1.0),
    ("recall_full", [1, 2], {1, 2, 3, 4}, 2, 0.5),
    ("precision", [1, 4], {1, 2}, 2, 0.5),
    ("precision", [1, 2], {1, 2}, 0, 0.0),
    ("ndcg", [1, 2], {1, 2}, 2, 1.0),
    ("ndcg", [3, 4], {1, 2}, 2, 0.0),
    ("ndcg", [99, 1], {1}, 2, 1 / math.log2(3)),
    ("hit_rate", [1, 2, 3, 4], {4}, 3, 0.0),
    ("mrr", [2, 1, 3], {1}, 10, 0.5),
    ("mrr", [1, 2, 3], {5}, 10, 0.0),
])
def test_hand_values(spark, metric, ranked, truth, k, expected):
    assert per_user(spark, ranked, truth, k)[metric] == pytest.approx(expected, abs=1e-12)


def test_batch_hit_rate(spark):
    lists = {"a": [1, 2], "b": [3, 4], "c": [5, 6]}
    truth = {"a": 1, "b": 9, "c": 5}
    rankings = spark.createDataFrame([(u, "s", str(i), r) for u, l in lists.items() for r, i in enumerate(l, 1)],
                                     "member_id string, stage string, item_id string, rank int")
    pairs = spark.createDataFrame([(u, str(i)) for u, i in truth.items()], "member_id string, item_id string")
    means = metrics.macro_means(metrics.user_metrics(rankings, pairs, pairs.select("member_id"), ["s"], 2), "stage").first()
    assert means.hit_rate == pytest.approx(2 / 3)


@pytest.mark.parametrize("t, df", [(2.0, 10), (0.0, 5), (1.0, 1), (2.5, 30), (0.3, 4), (6.0, 200)])
def test_t_tail(t, df):
    """Against the density of Student's t, integrated between -t and t."""
    x = np.linspace(-t, t, 400_001)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    middle = np.trapezoid(scale * (1 + x * x / df) ** (-(df + 1) / 2), x)
    assert metrics.t_tail(t, df) == pytest.approx(1 - middle, abs=1e-8)


@pytest.mark.parametrize("df", [4, 10, 1e3, 1e6, 1e7, 1e8, 1e9])
@pytest.mark.parametrize("t", [0.5, 1.7, 1.96, 2.0, 4.0])
def test_t_tail_for_any_number_of_users(t, df):
    """Against the integrated density, its constant by Stirling's series where the gammas cancel."""
    x = np.linspace(-t, t, 400_001)
    log_ratio = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) if df < 100 else math.log(df / 2) / 2 - 1 / (4 * df) + 1 / (24 * df**3)
    middle = np.trapezoid(np.exp(log_ratio - math.log(math.pi * df) / 2 - (df + 1) / 2 * np.log1p(x * x / df)), x)
    assert metrics.t_tail(t, df) == pytest.approx(1 - middle, abs=1e-8)


def test_auc_with_ties(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.4, 0), (0.8, 1), (0.9, 1), (0.2, 1)]
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for a, y in rows if y for b, z in rows if not z]
    got = metrics.roc_auc(spark.createDataFrame(rows, "score double, label int")).first()
    assert got.auc == pytest.approx(sum(wins) / len(wins))
