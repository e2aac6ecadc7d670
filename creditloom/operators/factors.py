"""Implicit-feedback factors of many users and few products, without moving the users.

Spark's ALS sends the factors of a user to every block of products that the user
meets, twenty times. With few products their sums are much smaller than the users:
a pass reads the users where they lie, solves each from the products' factors and
adds it to the normal equations of its products; only one sum a product and task
leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.session import settle

HELD = 4_000_000  # numbers of a block of users held at once in a task


@dataclass(frozen=True)
class Factors:
    """(id, features) of users and products, named as in Spark's model."""

    userFactors: DataFrame
    itemFactors: DataFrame


def solve_users(items: np.ndarray, lists: list[np.ndarray], weights: list[np.ndarray], regularisation: float) -> np.ndarray:
    """The least-squares factors of users from those of the products in their `lists`, whose confidence is 1 + weight.

    The matrix of a user is that of all products plus one term a product of its
    own, so for short lists a system of their length is solved.
    """
    rank = items.shape[1]
    gram = items.T @ items
    values, basis = np.linalg.eigh(gram)
    values, turned = np.maximum(values, 0.0), items @ basis
    out = np.empty((len(lists), rank))
    lengths = np.array([len(x) for x in lists])
    for m in np.unique(lengths):
        alike = np.flatnonzero(lengths == m)
        step = max(1, HELD // (max(m, rank) * rank))
        for start in range(0, len(alike), step):
            some = alike[start:start + step]
            own, c = np.stack([lists[i] for i in some]), np.stack([weights[i] for i in some])
            if 2 * m < rank:
                z, inverse = turned[own], 1.0 / (values + regularisation * m)
                first = ((1.0 + c)[:, None, :] @ z)[:, 0] * inverse
                inner = (z * inverse) @ z.transpose(0, 2, 1)
                inner[:, np.arange(m), np.arange(m)] += 1.0 / c
                rest = np.linalg.solve(inner, z @ first[:, :, None])
                out[some] = (first - inverse * (z.transpose(0, 2, 1) @ rest)[:, :, 0]) @ basis.T
            else:
                y = items[own]
                matrix = gram + regularisation * m * np.eye(rank) + (y * c[:, :, None]).transpose(0, 2, 1) @ y
                out[some] = np.linalg.solve(matrix, ((1.0 + c)[:, None, :] @ y).transpose(0, 2, 1))[:, :, 0]
    return out


def fit_by_passes(interactions: DataFrame, n_items: int, rank: int, iterations: int, regularisation: float, alpha: float,
                  seed: int) -> Factors:
    """Factors of (user_idx, item_idx, r) with r above 0 and products numbered below `n_items`, as many rounds as Spark's ALS makes."""
    spark = interactions.sparkSession
    cores = spark.sparkContext.defaultParallelism
    pairs = F.collect_list(F.struct(F.col("item_idx").cast("int").alias("item_idx"), (F.abs("r") * F.lit(float(alpha))).alias("c")))
    lists = interactions.groupBy("user_idx").agg(pairs.alias("p")).select("user_idx", F.col("p.item_idx").alias("items"), F.col("p.c").alias("weights"))
    lists = settle(lists.repartition(max(cores, spark.sparkContext.defaultMinPartitions), "user_idx"))
    found = sorted(r.item_idx for r in interactions.select(F.col("item_idx").cast("int").alias("item_idx")).distinct().collect())
    items = np.zeros((n_items, rank))
    items[found] = np.random.default_rng(seed).normal(size=(len(found), rank))
    items[found] /= np.linalg.norm(items[found], axis=1, keepdims=True)
    upper = np.triu_indices(rank)

    def solved(batches: Iterator[pd.DataFrame], vectors: np.ndarray):
        for batch in batches:
            own, c = [np.asarray(x) for x in batch["items"]], [np.asarray(x, float) for x in batch["weights"]]
            if len(own):
                yield batch["user_idx"].to_numpy(), own, c, solve_users(vectors, own, c, regularisation)

    def sums_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per product the upper half of its matrix, its right side and its users; under -1 the matrix of all users."""
        matrix, right, n, gram = np.zeros((n_items, rank, rank)), np.zeros((n_items, rank)), np.zeros(n_items), np.zeros((rank, rank))
        for _, own, c, users in solved(batches, shared.value):
            gram += users.T @ users
            rows, cols, weights = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own), np.concatenate(c)
            order = np.argsort(cols, kind="stable")
            starts = np.flatnonzero(np.diff(cols[order], prepend=-1))
            for part in np.split(order, starts[1:]):
                item, mine, w = cols[part[0]], users[rows[part]], weights[part][:, None]
                matrix[item] += (mine * w).T @ mine
                right[item] += ((1.0 + w) * mine).sum(axis=0)
                n[item] += len(part)
        met = np.flatnonzero(n)
        sums = [np.concatenate([gram[upper], np.zeros(rank + 1)]), *(np.concatenate([matrix[i][upper], right[i], [n[i]]]) for i in met)]
        yield pd.DataFrame({"item_idx": [-1, *met], "sums": sums})

    def total(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"item_idx": part["item_idx"].iloc[:1], "sums": [np.sum(np.stack(part["sums"].to_numpy()), axis=0)]})

    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(items)
        added = lists.mapInPandas(sums_of, "item_idx int, sums array<double>").groupBy("item_idx").applyInPandas(total, "item_idx int, sums array<double>")
        sums = {r.item_idx: np.array(r.sums) for r in added.collect()}  # one row a product, of which there are few
        shared.unpersist()
        square = lambda half: (lambda a: a + a.T - np.diag(np.diag(a)))(_filled(half, rank, upper))
        gram = square(sums.pop(-1)[:len(upper[0])])
        items = np.zeros((n_items, rank))
        for item, s in sums.items():
            half, right, n = np.split(s, [len(upper[0]), len(s) - 1])
            items[item] = np.linalg.solve(gram + square(half) + regularisation * n[0] * np.eye(rank), right)
    last = spark.sparkContext.broadcast(items)

    def users_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, _, _, users in solved(batches, last.value):
            yield pd.DataFrame({"id": ids, "features": list(users.astype(np.float32))})

    kinds = "id int, features array<float>"
    return Factors(lists.mapInPandas(users_of, kinds),
                   spark.createDataFrame([(i, [float(x) for x in items[i]]) for i in found], kinds))


def _filled(half: np.ndarray, rank: int, upper: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros((rank, rank))
    out[upper] = half
    return out
