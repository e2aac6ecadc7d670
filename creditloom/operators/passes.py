"""Fits of the ranking models by passes over a user's pairs, from the start and by the steps of Spark's own fits.

Spark's factorisation machine makes a gradient of all weights for each pair, and its
perceptron multiplies each pair's whole vector with the first layer. Here a block
holds some users with their products: what belongs to a user or to a product alone is
worked out once for it, and a pass gives the same gradient as a few matrix products.
The products' vectors are sent to every task and each task returns a sum per product,
so the products have to be few (`few_products`).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import FMClassifier, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.operators.sizing import is_small

PRODUCT_BYTES = 32_000_000  # of the products' vectors, and of a task's sums per product
BLOCK_PAIRS = 8192
NETWORK_PAIRS = 512  # of a block for a perceptron, whose hidden values then stay in a core's cache
TASK_PAIRS = 1_000_000  # beyond which there are more tasks than cores
DRIVER_BYTES = 32_000_000  # of the tasks' sums; past it they are added up in a tree
TOLERANCE = 1e-6  # Spark's, of both fits


def few_products(items: DataFrame, sums: int) -> bool:
    """Whether settled products can be sent to every task, and `sums` numbers for each of them come back."""
    return is_small(items, PRODUCT_BYTES // (8 * sums), PRODUCT_BYTES)


@dataclass(frozen=True)
class Block:
    """Users with their pairs; `order` sorts the pairs by product, whose first ones are at `firsts`."""

    users: list[np.ndarray]
    starts: np.ndarray
    rows: np.ndarray
    items: np.ndarray
    labels: np.ndarray
    order: np.ndarray
    met: np.ndarray
    firsts: np.ndarray

    @staticmethod
    def of(users: list[np.ndarray], lengths: np.ndarray, items: np.ndarray, labels: np.ndarray) -> Block:
        order = np.argsort(items, kind="stable")
        met, firsts = np.unique(items[order], return_index=True)
        return Block(users, np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths), items, labels, order, met, firsts)

    def per_user(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, axis=0)

    def add_per_item(self, sums: np.ndarray, values: np.ndarray) -> None:
        sums[self.met] += np.add.reduceat(values[self.order], self.firsts, axis=0)


@dataclass(frozen=True)
class Pairs:
    """Pickled blocks, kept for many passes, and the number of pairs in them."""

    blocks: RDD
    n: int

    def summed(self, total: Callable[[Iterator[Block]], np.ndarray], width: int) -> np.ndarray:
        """The sum over all tasks of what `total` makes of a task's blocks, a vector of that width."""
        parts = self.blocks.mapPartitions(lambda blocks: [total(map(pickle.loads, blocks))])
        if 8 * width * parts.getNumPartitions() <= DRIVER_BYTES:
            return np.sum(parts.collect(), axis=0)
        return parts.treeReduce(np.add)

    def release(self) -> None:
        self.blocks.unpersist()


def pair_blocks(pairs: DataFrame, users: DataFrame, user_columns: list[str], items: list, block_pairs: int | None = None) -> Pairs:
    """Blocks of (member_id, item_id, label) with the users' number arrays; `items` are the product ids in their order.

    Users are put together up to `block_pairs` or BLOCK_PAIRS pairs, whichever is less.

    As in a join, pairs without their user or product go, and ids that are there
    twice count twice.
    """
    spark, block_pairs = pairs.sparkSession, min(BLOCK_PAIRS, block_pairs or BLOCK_PAIRS)
    kind = T.StructType([T.StructField("item_id", pairs.schema["item_id"].dataType), T.StructField("_at", T.IntegerType())])
    places = spark.createDataFrame([(item, i) for i, item in enumerate(items)], kind)
    met = pairs.select("member_id", "item_id", F.col("label").cast("double").alias("label")).join(F.broadcast(places), "item_id")
    lists = met.groupBy("member_id", F.floor(F.col("_at") / BLOCK_PAIRS).alias("_part")).agg(
        F.array_sort(F.collect_list(F.struct("_at", "label"))).alias("p"))
    known = users.select("member_id", *[F.transform(c, lambda x: x.cast("double")).alias(c) for c in user_columns])
    rows = lists.join(known, "member_id").select("member_id", "_part", F.col("p._at").alias("at"), F.col("p.label").alias("label"), *user_columns)
    tasks = max(spark.sparkContext.defaultParallelism, -(-pairs.count() // TASK_PAIRS))
    # Dealt by a hash of its own: dealt by the keys of the grouping, Spark may take its partitions instead and merge small ones.
    dealt = rows.repartition(tasks, F.xxhash64("member_id", "_part")).sortWithinPartitions("member_id", "_part")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.names.index(c))
            lengths = column("at").value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            cuts = np.flatnonzero(np.diff(ends // block_pairs)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ends)]):
                if a == b:
                    continue
                flat = lambda c: column(c).slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                labels = flat("label")
                if not np.isin(labels, (0.0, 1.0)).all():
                    raise ValueError("labels must be 0 or 1")
                if any(column(c).null_count for c in user_columns):
                    raise ValueError("a user without features")
                sides = [np.array(flat(c), float).reshape(b - a, -1) for c in user_columns]
                block = Block.of(sides, np.array(lengths[a:b], int), np.array(flat("at"), np.int32), np.array(labels, float))
                yield pa.RecordBatch.from_pydict({"block": [pickle.dumps(block)]})

    blocks = dealt.mapInArrow(packed, "block binary").rdd.map(lambda r: bytes(r.block)).persist(StorageLevel.MEMORY_AND_DISK)
    n = blocks.map(lambda b: len(pickle.loads(b).labels)).sum()
    if not n:
        raise ValueError("no pairs to fit on")
    return Pairs(blocks, n)


def _squash(x: np.ndarray) -> np.ndarray:
    """The logistic function, written over its argument."""
    np.negative(np.clip(x, -700, 700, out=x), out=x)
    np.add(np.exp(x, out=x), 1.0, out=x)
    return np.reciprocal(x, out=x)


# --- factorisation machine ----------------------------------------------------

def fit_machine(pairs: Pairs, user_dim: int, item_features: np.ndarray, item_idx: np.ndarray, factors: int, iterations: int,
                step: float, shrink: float, seed: int, spark: SparkSession) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, linear weights and factors over user features, product features and the product itself, by AdamW.

    `item_idx` says which of the products' own weights a product has.
    """
    context, n_items, item_dim = spark.sparkContext, *item_features.shape
    width = user_dim + item_dim + int(item_idx.max()) + 1
    sides = context.broadcast((item_features, item_idx))
    shapes = [(user_dim, factors), (user_dim,), (user_dim,), (n_items, factors), (n_items,)]

    def split(flat: np.ndarray) -> tuple[np.ndarray, ...]:
        v, linear = flat[:width * factors].reshape(width, factors), flat[width * factors:-1]
        at = [user_dim, user_dim + item_dim]
        return (*np.split(v, at), *np.split(linear, at), flat[-1])

    def gradient(flat: np.ndarray) -> np.ndarray:
        sent = context.broadcast(flat)

        def total(blocks: Iterator[Block]) -> np.ndarray:
            (features, idx), (vu, vi, vo, lu, li, lo, intercept) = sides.value, split(sent.value)
            item_meet = features @ vi + vo[idx]
            item_own = features @ li + lo[idx] + intercept - 0.5 * (features ** 2 @ (vi ** 2).sum(axis=1) + (vo[idx] ** 2).sum(axis=1))
            sums = [np.zeros(s) for s in shapes]
            for b in blocks:
                x, = b.users
                both = (x @ vu)[b.rows] + item_meet[b.items]
                user_own = x @ lu - 0.5 * (x ** 2 @ (vu ** 2).sum(axis=1))
                off = _squash(user_own[b.rows] + item_own[b.items] + 0.5 * np.einsum("ij,ij->i", both, both)) - b.labels
                both *= off[:, None]
                of_user = b.per_user(off)
                sums[0] += x.T @ b.per_user(both)
                sums[1] += (x ** 2).T @ of_user
                sums[2] += x.T @ of_user
                b.add_per_item(sums[3], both)
                b.add_per_item(sums[4], off)
            return np.concatenate([s.ravel() for s in sums])

        found = pairs.summed(total, sum(int(np.prod(s)) for s in shapes))
        sent.destroy()
        by_user, squares, user_linear, by_item, of_item = (
            part.reshape(s) for part, s in zip(np.split(found, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]), shapes))
        vu, vi, vo, *_ = split(flat)
        own_factors, own_linear = np.zeros(vo.shape), np.zeros(len(vo))
        np.add.at(own_factors, item_idx, by_item - vo[item_idx] * of_item[:, None])
        np.add.at(own_linear, item_idx, of_item)
        return np.concatenate([(by_user - vu * squares[:, None]).ravel(),
                               (item_features.T @ by_item - vi * ((item_features ** 2).T @ of_item)[:, None]).ravel(), own_factors.ravel(),
                               user_linear, item_features.T @ of_item, own_linear, [of_item.sum()]]) / pairs.n

    weights = adam(gradient, _start_of_machine(spark, width, factors, seed), iterations, step, shrink)
    sides.destroy()
    return float(weights[-1]), weights[width * factors:-1], weights[:width * factors].reshape(width, factors)


def _start_of_machine(spark: SparkSession, width: int, factors: int, seed: int) -> np.ndarray:
    """The weights Spark's fit begins with: what it returns after no iteration."""
    rows = spark.createDataFrame([(y, Vectors.sparse(width, {})) for y in (0.0, 1.0)], ["label", "features"])
    model = FMClassifier(factorSize=factors, maxIter=0, seed=seed).fit(rows)
    return np.concatenate([model.factors.toArray().ravel(), model.linear.toArray(), [model.intercept]])


def adam(gradient: Callable[[np.ndarray], np.ndarray], weights: np.ndarray, iterations: int, step: float, shrink: float) -> np.ndarray:
    """Adam with the decay apart from the gradient; ends early once a step is short, as Spark's does."""
    first, second, before = np.zeros(len(weights)), np.zeros(len(weights)), None
    for i in range(1, iterations + 1):
        g = gradient(weights)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        moved = step * (first / (1 - 0.9 ** i)) / (np.sqrt(second / (1 - 0.999 ** i)) + 1e-8) + shrink * weights
        weights = weights - moved
        if before is not None and np.linalg.norm(before - weights) < TOLERANCE * max(np.linalg.norm(weights), 1.0):
            break
        before = weights
    return weights


# --- perceptron -----------------------------------------------------------------

def fit_network(pairs: Pairs, layers: list[int], item_factors: np.ndarray, item_features: np.ndarray, iterations: int, seed: int,
                spark: SparkSession, start: list[float] | None = None) -> np.ndarray:
    """Weights, in Spark's order, of a perceptron over (factor products, user and item factors, user and item features), by L-BFGS.

    The users of a block carry their factors and their features.
    """
    context, (n_items, d), hidden = spark.sparkContext, item_factors.shape, layers[1]
    if start is None:
        rows = spark.createDataFrame([(0.0, Vectors.sparse(layers[0], {}))], ["label", "features"])
        start = MultilayerPerceptronClassifier(layers=layers, maxIter=0, seed=seed).fit(rows).weights.toArray()
    sides = context.broadcast((item_factors, item_features))
    user_dim = layers[0] - 3 * d - item_features.shape[1]
    at = np.cumsum([d, d, d, user_dim])
    behind = sum((a + 1) * b for a, b in zip(layers[1:], layers[2:]))
    shapes = [(hidden, d), (hidden, d), (hidden, user_dim), (n_items, hidden), (behind,), (1,)]

    def matrices(flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, a = [], 0
        for wide, narrow in zip(layers, layers[1:]):
            out.append((flat[a:a + wide * narrow].reshape(wide, narrow), flat[a + wide * narrow:a + (wide + 1) * narrow]))
            a += (wide + 1) * narrow
        return out

    def objective(flat: np.ndarray) -> tuple[float, np.ndarray]:
        sent = context.broadcast(flat)

        def total(blocks: Iterator[Block]) -> np.ndarray:
            (v, features), ((first, offsets), *rest) = sides.value, matrices(sent.value)
            meet, of_user, of_item, by_user, by_item = np.split(first, at)
            item_part = v @ of_item + features @ by_item + offsets
            sums = [np.zeros(s) for s in shapes]
            for b in blocks:
                u, x = b.users
                products = u[b.rows]
                products *= v[b.items]
                sent_on = products @ meet
                sent_on += (u @ of_user + x @ by_user)[b.rows]
                sent_on += item_part[b.items]
                held = [_squash(sent_on)]
                for matrix, offset in rest[:-1]:
                    sent_on = held[-1] @ matrix
                    sent_on += offset
                    held.append(_squash(sent_on))
                raw = held[-1] @ rest[-1][0] + rest[-1][1]
                raw -= raw.max(axis=1, keepdims=True)
                logs = raw - np.log(np.exp(raw).sum(axis=1, keepdims=True))
                truth = np.column_stack([1.0 - b.labels, b.labels])
                sums[5] -= (truth * logs).sum()
                delta, grads = np.exp(logs) - truth, []
                for (matrix, _), inner in zip(rest[::-1], held[::-1]):
                    grads = [(inner.T @ delta).ravel(), delta.sum(axis=0), *grads]
                    delta = delta @ matrix.T
                    delta *= inner
                    delta *= np.subtract(1.0, inner, out=inner)
                sums[4] += np.concatenate(grads)
                users = b.per_user(delta)
                sums[0] += delta.T @ products
                sums[1] += users.T @ u
                sums[2] += users.T @ x
                b.add_per_item(sums[3], delta)
            return np.concatenate([s.ravel() for s in sums])

        found = pairs.summed(total, sum(int(np.prod(s)) for s in shapes))
        sent.destroy()
        meet, of_user, by_user, items, deeper, loss = (
            part.reshape(s) for part, s in zip(np.split(found, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]), shapes))
        first = np.vstack([meet.T, of_user.T, item_factors.T @ items, by_user.T, item_features.T @ items])
        return loss[0] / pairs.n, np.concatenate([first.ravel(), items.sum(axis=0), deeper]) / pairs.n

    weights = lbfgs(objective, np.asarray(start, float), iterations)
    sides.destroy()
    return weights


class _Stuck(Exception):
    pass


def lbfgs(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, iterations: int, memory: int = 10) -> np.ndarray:
    """Minimises by L-BFGS with a search for the strong Wolfe conditions; a step that fails forgets what was learned, once."""
    value, grad = objective(x)
    scale, values, known, failed, i = value, [np.inf], [], False, 0
    while i < iterations:
        if np.linalg.norm(grad) <= max(TOLERANCE * abs(value), 1e-8):
            break
        try:
            direction = _descent(grad, known)
            step, new_value, new_grad = _wolfe(objective, x, value, grad, direction, 1.0 if i else 1.0 / np.linalg.norm(direction))
            if step * np.linalg.norm(grad) < 1e-10:
                raise _Stuck
        except _Stuck:
            if failed:
                break
            known, failed = [], True
            continue
        known = [(step * direction, new_grad - grad), *known][:memory]
        x, value, grad, failed, i = x + step * direction, new_value, new_grad, False, i + 1
        values = [*values, value][-20:]
        if abs(value - max(values)) <= TOLERANCE * scale:
            break
    return x


def _descent(grad: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out, shares = grad.copy(), []
    for s, y in known:
        shares.append((s @ out) / (s @ y))
        out -= shares[-1] * y
    if known:
        s, y = known[0]
        if not s @ y >= 0:
            raise _Stuck
        out *= (s @ y) / (y @ y)
    for (s, y), share in zip(known[::-1], shares[::-1]):
        out += (share - (y @ out) / (s @ y)) * s
    return -out


def _wolfe(objective, x: np.ndarray, value: float, grad: np.ndarray, direction: np.ndarray, step: float) -> tuple[float, float, np.ndarray]:
    """A step with enough decrease and a slope flat enough, its value and its gradient (Nocedal and Wright, 3.5 and 3.6)."""
    slope = grad @ direction
    if slope > 0:
        raise _Stuck

    def at(t: float) -> tuple[float, float, float, np.ndarray]:
        v, g = objective(x + t * direction)
        return t, v, g @ direction, g

    def between(a, b) -> float:
        l, r = sorted((a, b), key=lambda p: p[0])
        d1 = l[2] + r[2] - 3 * (l[1] - r[1]) / (l[0] - r[0])
        d2 = np.sqrt(d1 * d1 - l[2] * r[2])
        wide = r[0] - l[0]
        t = r[0] - wide * (r[2] + d2 - d1) / (r[2] - l[2] + 2 * d2)
        return float(min(max(t, l[0] + 0.1 * wide), l[0] + 0.9 * wide))

    def zoom(low, high) -> tuple[float, float, np.ndarray]:
        for _ in range(10):
            c = at(between(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope):
                return c[0], c[1], c[3]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise _Stuck

    low = (0.0, value, slope, grad)
    for i in range(10):
        c = at(step)
        if not np.isfinite(c[1]):
            step /= 2.0
            continue
        if c[1] > value + 1e-4 * step * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return c[0], c[1], c[3]
        if c[2] >= 0:
            return zoom(c, low)
        low, step = c, 1.5 * step
    raise _Stuck
