"""What a fitted tree ensemble says about single rows: contributions and response curves.

An ensemble is a sum over leaves, and a leaf applies to a row when each feature
on its path lies in an interval. Keeping that table of intervals - at most
rounds * 2^depth leaves - is enough for

* the Shapley value of each feature: within one leaf the game is a product of
  one factor per feature, so the average over orderings is an integral of a
  product of lines over [0,1], which Gauss-Legendre points give exactly;
* the exact response to one feature with the others held: a step function
  whose steps are the interval ends.

Both are matrix work per batch of rows inside mapInPandas; the rows stay
distributed and only the leaf table is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.session import scratch_path

CELLS = 10_000
BATCH_VALUES = 4_000_000
_BITS = 64


@dataclass(frozen=True)
class LeafTable:
    """Per leaf: log-odds value, tree number, and per path feature its interval (low, high] and cover share."""

    value: np.ndarray      # (leaves,)
    tree: np.ndarray       # (leaves,)
    feature: np.ndarray    # (leaves, depth), -1 where the path is shorter
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    def base(self) -> float:
        """Expected log-odds over the training rows."""
        return float((self.value * self.share.prod(axis=1)).sum())

    def inside(self, x: np.ndarray) -> np.ndarray:
        """(rows, leaves, depth): whether each path condition holds."""
        at = x[:, np.maximum(self.feature, 0)]
        return ((at > self.low) & (at <= self.high)) | (self.feature < 0)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.inside(x).all(axis=2) @ self.value

    def contributions(self, x: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        """(rows, groups): Shapley values summed over the features of each group."""
        depth = self.feature.shape[1]
        points, weights = np.polynomial.legendre.leggauss((depth + 1) // 2)
        holds = self.inside(x).astype(float)
        others = np.zeros_like(holds)
        for t, w in zip((points + 1) / 2, weights / 2):
            line = t * holds + (1 - t) * self.share
            before = np.cumprod(np.concatenate([np.ones_like(line[..., :1]), line[..., :-1]], axis=2), axis=2)
            after = np.cumprod(np.concatenate([np.ones_like(line[..., :1]), line[..., :0:-1]], axis=2), axis=2)[..., ::-1]
            others += w * before * after
        part = self.value[None, :, None] * (holds - self.share) * others
        owner = np.where(self.feature >= 0, group[np.maximum(self.feature, 0)], -1)
        return np.stack([part[:, owner == g].sum(axis=1) for g in range(groups)], axis=1)

    def response(self, x: np.ndarray, feature: int) -> tuple[np.ndarray, np.ndarray]:
        """Steps of one feature: inner ends (m,) and log-odds per step (rows, m+1), step s being (end[s-1], end[s]]."""
        on_path = self.feature == feature
        low = np.where(on_path, self.low, -np.inf).max(axis=1)
        high = np.where(on_path, self.high, np.inf).min(axis=1)
        ends = np.unique(np.concatenate([low, high]))
        ends = ends[np.isfinite(ends)]
        starts = np.concatenate([[-np.inf], ends])
        covers = (starts[None, :] >= low[:, None]) & (np.concatenate([ends, [np.inf]])[None, :] <= high[:, None])
        rest = (self.inside(x) | on_path[None]).all(axis=2)
        return ends, (rest * self.value) @ covers.astype(float)

    def batches(self, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        step = max(1, BATCH_VALUES // max(1, self.feature.size))
        for start in range(0, len(frame), step):
            yield frame.iloc[start:start + step]

    def tree_values(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from (rows, features) to (rows, trees), the value of the leaf each row falls into.

        The leaves of a tree are the bits of a number. Each step of a feature has a
        number per tree, of the leaves that allow it; a row's leaf is the bit that
        all its features have in common. A tree of more than 64 leaves has its
        leaves tried one by one.
        """
        rounds = int(self.tree.max()) + 1
        sizes = np.bincount(self.tree, minlength=rounds)
        if sizes.max() > _BITS:
            by_tree = self.value[:, None] * (self.tree[:, None] == np.arange(rounds)[None, :])
            n = max(1, BATCH_VALUES // max(1, self.feature.size))
            return lambda x: np.concatenate([self.inside(x[a:a + n]).all(axis=2) @ by_tree for a in range(0, len(x), n)])
        order = np.argsort(self.tree, kind="stable")
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        bits = np.left_shift(np.uint64(1), place.astype(np.uint64))
        values, full = np.zeros((rounds, _BITS + 1)), np.zeros(rounds, np.uint64)  # the last value is that of no leaf
        values[self.tree, place] = self.value
        np.bitwise_or.at(full, self.tree, bits)
        steps = []
        for feature in np.unique(self.feature[self.feature >= 0]):
            leaf, slot = np.nonzero(self.feature == feature)
            low, high = self.low[leaf, slot], self.high[leaf, slot]
            ends = np.unique(np.concatenate([low, high]))
            ends = ends[np.isfinite(ends)]
            # One step more, allowed by no leaf with the feature, is that of no number.
            starts, stops = np.concatenate([[-np.inf], ends, [-np.inf]]), np.concatenate([ends, [np.inf, np.inf]])
            allowed = np.tile(full, (len(starts), 1))
            for i, a, b in zip(leaf, low, high):
                out = (starts < a) | (stops > b)
                out[-1] = True
                allowed[out, self.tree[i]] &= ~bits[i]
            steps.append((feature, ends, allowed))

        def read(x: np.ndarray) -> np.ndarray:
            held = np.tile(full, (len(x), 1))
            for feature, ends, allowed in steps:
                column = x[:, feature]
                held &= allowed[np.where(np.isnan(column), len(ends) + 1, np.searchsorted(ends, column))]
            return values[np.arange(rounds), np.frexp(held.astype(float))[1] - 1]

        return read

    def staged_cells(self, rows: DataFrame) -> DataFrame:
        """(round, cell, label, n): how many rows of a task score in each of 10,000 equal cells after each round."""
        table = rows.sparkSession.sparkContext.broadcast(self)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            leaves = table.value
            rounds = int(leaves.tree.max()) + 1
            read, step = leaves.tree_values(), max(1, BATCH_VALUES // rounds)
            # Counted for the whole task, so what leaves it does not grow with its rows.
            counts = np.zeros(2 * rounds * CELLS, np.int64)
            for frame in frames:
                for start in range(0, len(frame), step):
                    part = frame.iloc[start:start + step]
                    margins = np.cumsum(read(np.stack(part["x"].to_numpy())), axis=1)
                    cell = np.minimum((CELLS / (1 + np.exp(-margins))).astype(np.int64), CELLS - 1)
                    place = (part["label"].to_numpy()[:, None] * rounds + np.arange(rounds)) * CELLS + cell
                    counts += np.bincount(place.ravel(), minlength=len(counts))
            found = np.flatnonzero(counts)
            yield pd.DataFrame({"round": (found // CELLS % rounds + 1).astype(np.int32), "cell": (found % CELLS).astype(np.int32),
                                "label": (found // CELLS // rounds).astype(np.int32), "n": counts[found]})

        return rows.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label")).mapInPandas(
            run, "round int, cell int, label int, n long")


def _paths(nodes: dict[int, tuple]) -> Iterator[tuple[float, dict[int, list[float]]]]:
    """(leaf prediction, feature -> [low, high, cover share]) for each leaf under the root."""
    stack = [(0, {})]
    while stack:
        number, path = stack.pop()
        prediction, cover, left, right, feature, threshold = nodes[number]
        if left < 0:
            yield prediction, path
            continue
        for child, is_left in ((left, True), (right, False)):
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            bounds = (low, min(high, threshold)) if is_left else (max(low, threshold), high)
            stack.append((child, {**path, feature: (*bounds, share * nodes[child][1] / cover)}))


def boxes_of(model) -> LeafTable:
    """The leaf table of a fitted boosted-tree classifier, read from its saved nodes.

    Log-odds are twice the ensemble's margin, because its probability is the
    logistic function of twice the margin.
    """
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"], node["prediction"], node["rawCount"], node["leftChild"], node["rightChild"],
        node["split"]["featureIndex"], F.try_element_at(node["split"]["leftCategoriesOrThreshold"], F.lit(1))).collect()
    trees: dict[int, dict[int, tuple]] = {}
    for tree, number, *rest in rows:
        trees.setdefault(tree, {})[number] = tuple(rest)
    leaves = [(2 * model.treeWeights[t] * prediction, t, path)
              for t in sorted(trees) for prediction, path in _paths(trees[t])]
    depth = max(1, max(len(path) for _, _, path in leaves))
    shape = (len(leaves), depth)
    feature, low, high, share = np.full(shape, -1), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape)
    for i, (_, _, path) in enumerate(leaves):
        for j, (f, (lo, hi, s)) in enumerate(path.items()):
            feature[i, j], low[i, j], high[i, j], share[i, j] = f, lo, hi, s
    return LeafTable(np.array([v for v, _, _ in leaves]), np.array([t for _, t, _ in leaves]), feature, low, high, share)
