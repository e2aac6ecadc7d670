"""Vector retrieval: exact top-k, cell-based approximate top-k, collaborative factors.

Pairs are never written out. Each task multiplies a block of queries with a
block of items and keeps only the k best per query.

* Few items (size checked): the item matrix is broadcast and queries are scored
  where they lie, with no shuffle.
* More items: queries and items are cut into blocks of bounded size, each pair
  of blocks is one task group, and the k best per block are merged. A cell that
  holds a large share of the rows is simply cut into more blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.constants import (
    ALS_CONFIDENCE, ALS_FACTORS, ALS_ITERATIONS, ALS_REGULARISATION, IVF_MAX_CELLS, IVF_MIN_CELLS,
    IVF_PROBE_DIVISOR, SEED,
)
from creditloom.functions.vectors import l2_normalise
from creditloom.operators.factors import fit_by_passes
from creditloom.session import settle

BROADCAST_VALUES = 4_000_000      # item matrix entries, 32 MB as doubles
SCORE_CELLS = 2_000_000           # scores held at once in a task
ITEM_CHUNK = 4096                 # items scored at once in a task
LEAST_BLOCK, MOST_BLOCK = 8192, 65_536  # rows of a block; a sixteenth of all rows in between
SENT_ROWS = 4096                  # queries that leave a task at once
ALS_LEAST_ROWS, ALS_MOST_ROWS = 10_000, 2_000_000  # interactions of a block
PASS_LEAST_ROWS = 200_000         # interactions from which passes are worth their start
PASS_VALUES = 4_000_000           # entries of the products' normal equations, 32 MB, that a pass may hold
SCORE_DIGITS = 9                  # ties are decided after rounding, then by id


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]  # (queries, d), (items, d) -> (queries, items)


def dot_products(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    return queries @ items.T


class _Best:
    """The best items so far of a batch of queries, `keep` of them each; ties by the place of an item's id."""

    def __init__(self, keep: np.ndarray, place: np.ndarray):
        self.keep, self.place = keep, place
        self.bar = np.where(keep > 0, -np.inf, np.inf)  # the rounded score of the last one, once all are held
        self.rows, self.cols, self.scores = np.empty(0, int), np.empty(0, int), np.empty(0)
        # What was added is merged once it is as much as can be held, so many small chunks are not a sort each.
        self.room = int(np.clip(keep, 0, len(place)).sum())
        self.waiting, self.n_waiting = [], 0

    def add(self, rows: np.ndarray, start: int, scores: np.ndarray) -> None:
        """Scores of the queries `rows` with the items from `start`; only those that reach a query's bar are kept."""
        least, width = self.bar[rows], scores.shape[1]
        most = min(width, max(1, int(self.keep[rows].max(initial=0))))
        open_rows = np.flatnonzero(least == -np.inf)
        if len(open_rows) and width > most:
            least[open_rows] = np.partition(scores[open_rows], width - most, axis=1)[:, width - most]
        at, col = np.nonzero((scores >= (least - 10.0 ** -SCORE_DIGITS)[:, None]) & (scores > -np.inf))
        if not len(at):
            return
        self.waiting.append((rows[at], start + col, scores[at, col]))
        self.n_waiting += len(at)
        if self.n_waiting >= self.room:
            self.merge()

    def merge(self) -> None:
        """Sorts what is waiting into what is held and raises the bars."""
        if not self.waiting:
            return
        rows, cols, scores = (np.concatenate(x) for x in zip((self.rows, self.cols, self.scores), *self.waiting))
        self.waiting, self.n_waiting = [], 0
        rounded = np.round(scores, SCORE_DIGITS)
        order = np.lexsort((self.place[cols], -rounded, rows))
        rows, cols, scores, rounded = rows[order], cols[order], scores[order], rounded[order]
        turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
        chosen, last = turn < self.keep[rows], turn == self.keep[rows] - 1
        self.bar[rows[last]] = rounded[last]
        self.rows, self.cols, self.scores = rows[chosen], cols[chosen], scores[chosen]


def _score_block(queries: pd.DataFrame, item_ids: np.ndarray, items: np.ndarray, scorer: Scorer = dot_products,
                 item_cells: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """Best matches of a batch of queries (query_id, vector, keep[, own][, seen][, cells]) among the items, sorted by id.

    With `item_cells` the items are sorted by cell and then by id, and a query
    meets those of its `cells` only.
    """
    ids = np.arange(len(item_ids))
    if item_cells is None:
        edges = [0, len(item_ids)]
    else:
        edges = [*np.flatnonzero(np.diff(item_cells, prepend=item_cells[0] - 1)), len(item_ids)] if len(item_ids) else [0, 0]
        ids[np.argsort(item_ids, kind="stable")] = np.arange(len(item_ids))
    chunks = [(i, min(i + ITEM_CHUNK, b)) for a, b in zip(edges, edges[1:]) for i in range(a, b, ITEM_CHUNK)]
    step = max(1, SCORE_CELLS // max([1, *(b - a for a, b in chunks)]))
    for start in range(0, len(queries), step):
        part = queries.iloc[start:start + step]
        vectors, everyone = _matrix(part["vector"]), np.arange(len(part))
        best = _Best(part["keep"].to_numpy(), ids)
        own = part["own"].to_numpy() if "own" in part else None
        seen = _pairs(part["seen"]) if "seen" in part else None
        asked = _pairs(part["cells"]) if item_cells is not None else None
        for a, b in chunks:
            rows, times = (everyone, None) if asked is None else np.unique(asked[0][asked[1] == item_cells[a]], return_counts=True)
            if not len(rows):
                continue
            scores = scorer(vectors[rows], items[a:b])
            if own is not None:
                scores[own[rows][:, None] == item_ids[None, a:b]] = -np.inf
            if seen is not None:
                _mask(scores, rows, *seen, item_ids[a:b])
            if times is not None and times.max() > 1:  # a cell that was named twice counts twice
                rows, scores = np.repeat(rows, times), np.repeat(scores, times, axis=0)
            best.add(rows, a, scores)
        best.merge()
        yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[best.rows], "match_id": item_ids[best.cols], "score": best.scores})


def _pairs(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a column of arrays, or nulls."""
    lists = [x if x is not None else () for x in lists]
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return rows, np.concatenate([x for x in lists if len(x)]) if len(rows) else np.empty(0, int)


def _mask(scores: np.ndarray, rows: np.ndarray, owners: np.ndarray, ids: np.ndarray, item_ids: np.ndarray) -> None:
    """Takes the `ids` that their owners have seen out of the scores of `rows`; `rows` and `item_ids` are sorted."""
    if not len(owners):
        return
    ids = ids.astype(item_ids.dtype)
    at, row = np.minimum(np.searchsorted(item_ids, ids), len(item_ids) - 1), np.minimum(np.searchsorted(rows, owners), len(rows) - 1)
    here = (item_ids[at] == ids) & (rows[row] == owners)
    scores[row[here], at[here]] = -np.inf


def result_schema(queries: DataFrame, items: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                         T.StructField("match_id", items.schema["match_id"].dataType),
                         T.StructField("score", T.DoubleType())])


def _most(own_keep: DataFrame | None, k: int) -> int:
    return k if own_keep is None else 2**31 - 1


def with_keep(queries: DataFrame, k: int) -> DataFrame:
    return queries if "keep" in queries.columns else queries.withColumn("keep", F.lit(k))


def top_matches(queries: DataFrame, items: DataFrame, k: int, broadcast_values: int = BROADCAST_VALUES,
                scorer: Scorer = dot_products) -> DataFrame:
    """Exact k best items by dot product, or by `scorer`, per query: (query_id, match_id, score, rank).

    `queries` has query_id and vector, optionally `keep` (a number of matches per
    row, in place of k), `own` (an item id to leave out) and `seen` (an array of
    them); `items` has match_id and vector.
    """
    own_keep = queries.select("query_id", "keep") if "keep" in queries.columns else None
    queries = with_keep(queries, k)
    shape = items.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    if shape.n * (shape.d or 0) <= broadcast_values:
        # Every query sits in one task, so what comes back is already the k (or `keep`) best.
        return ranked(_broadcast_matches(queries, items, scorer), None, _most(own_keep, k))
    found = blocked_matches(queries.withColumn("cell", F.lit(0)), items.withColumn("cell", F.lit(0)), scorer=scorer)
    return ranked(found, own_keep, k)


def _best_first():
    return Window.partitionBy("query_id").orderBy(F.round("score", SCORE_DIGITS).desc(), "match_id")


def ranked(found: DataFrame, own_keep: DataFrame | None, k: int) -> DataFrame:
    """Merges what the blocks found; a query with its own `keep` gets that many."""
    ranked = found.withColumn("rank", F.row_number().over(_best_first()))
    if own_keep is None:
        return ranked.filter(F.col("rank") <= k)
    return ranked.join(own_keep, "query_id").filter(F.col("rank") <= F.col("keep")).drop("keep")


def _broadcast_matches(queries: DataFrame, items: DataFrame, scorer: Scorer) -> DataFrame:
    rows = items.select("match_id", "vector").toPandas().sort_values("match_id")
    spark = queries.sparkSession
    if rows.empty:
        return spark.createDataFrame([], result_schema(queries, items))
    shared = spark.sparkContext.broadcast((rows["match_id"].to_numpy(), _matrix(rows["vector"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        for batch in batches:
            yield from _score_block(batch, ids, matrix, scorer)

    return queries.mapInPandas(run, result_schema(queries, items))


def block_rows(n: int) -> int:
    return max(LEAST_BLOCK, min(MOST_BLOCK, n // 16))


def blocked_matches(queries: DataFrame, items: DataFrame, query_block: int | None = None,
                    item_block: int | None = None, scorer: Scorer = dot_products) -> DataFrame:
    """Best matches per query among the items of its cells: `queries` carry a `cell` or an array of `cells`, `items` a `cell`.

    Small cells share a block and large ones are cut, so a query is sent once to
    each block of items that it meets, however many of its cells lie there.
    """
    spark, schema = queries.sparkSession, result_schema(queries, items)
    if "cells" not in queries.columns:
        queries = queries.withColumn("cells", F.array("cell")).drop("cell")
    # One row a cell, of which there are at most IVF_MAX_CELLS.
    sizes = items.where("cell IS NOT NULL").groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    n_items, n_queries = sum(r.n for r in sizes), queries.count()
    item_block, query_block = item_block or block_rows(n_items), query_block or block_rows(n_queries)
    query_parts = max(1, -(-n_queries // query_block))
    placed, block, used = [], -1, item_block
    for number, r in enumerate(sizes):
        parts = -(-r.n // item_block)
        if used + r.n > item_block:
            block, used = block + 1, 0
        placed.append((r.cell, number, block, parts))
        block, used = block + parts - 1, used + r.n if parts == 1 else item_block
    shared = spark.sparkContext.broadcast({c: (number, range(b, b + parts)) for c, number, b, parts in placed})
    placed = spark.createDataFrame(placed, T.StructType([
        items.schema["cell"], *[T.StructField(c, T.IntegerType()) for c in ("_number", "_block", "_parts")]]))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = shared.value
        for batch in batches:
            rows, blocks, cells = [], [], []
            for i, asked in enumerate(batch["cells"]):
                meets = {}
                for number, where in (places[c] for c in asked if c in places):
                    for b in where:
                        meets.setdefault(b, []).append(number)
                rows += [i] * len(meets)
                blocks += meets
                cells += meets.values()
                if len(rows) >= SENT_ROWS:
                    yield batch.iloc[rows].assign(block=blocks, cells=cells)
                    rows, blocks, cells = [], [], []
            if rows:
                yield batch.iloc[rows].assign(block=blocks, cells=cells)

    kept = [f for f in queries.schema if f.name in ("query_id", "vector", "keep", "own", "seen")]
    sent = queries.select(*[f.name for f in kept], "cells").mapInPandas(send, T.StructType([
        *kept, T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("block", T.IntegerType())]))
    q = sent.withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int"))
    i = (items.select("match_id", "vector", "cell").join(F.broadcast(placed), "cell")
         .select("match_id", "vector", F.col("_number").alias("cell"),
                 (F.col("_block") + F.pmod(F.xxhash64("match_id"), F.col("_parts"))).cast("int").alias("block"),
                 F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("query_part")))
    names = schema.names

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        right = right.sort_values(["cell", "match_id"])
        return pd.concat(_score_block(left, right["match_id"].to_numpy(), _matrix(right["vector"]), scorer, right["cell"].to_numpy()))

    return q.groupBy("query_part", "block").cogroup(i.groupBy("query_part", "block")).applyInPandas(run, schema)


def top_unseen(queries: DataFrame, items: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """k best items per query that are not among its `seen` (query_id, match_id) pairs.

    A query carries its seen ids, which are masked where it is scored, so every
    block returns k at most however much somebody has seen.
    """
    lists = seen.groupBy("query_id").agg(F.collect_set("match_id").alias("seen"))
    return top_matches(queries.join(lists, "query_id", "left"), items, k)


def normalised(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vector", l2_normalise(F.col("vector")))


def cell_count(n_items: int) -> int:
    return int(min(IVF_MAX_CELLS, max(IVF_MIN_CELLS, int(n_items ** 0.5))))


def fit_cells(items: DataFrame, cells: int, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Clusters the item vectors by angle. Returns the items with their cell and the cell centres."""
    data = items.withColumn("features", array_to_vector("vector"))
    model = KMeans(k=cells, distanceMeasure="cosine", seed=seed, maxIter=20, predictionCol="cell").fit(data)
    centres = items.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "match_id int, vector array<double>")
    return model.transform(data).drop("features"), centres


def top_matches_by_cell(queries: DataFrame, items: DataFrame, centres: DataFrame, k: int, probes: int) -> DataFrame:
    """Approximate k best items: only the `probes` cells nearest to a query are searched."""
    nearest = top_matches(queries, normalised(centres), probes)
    probing = with_keep(queries, k).join(cells_of(nearest), "query_id")
    own_keep = queries.select("query_id", "keep") if "keep" in queries.columns else None
    return ranked(blocked_matches(settle(probing), items), own_keep, k)


def cells_of(nearest: DataFrame) -> DataFrame:
    """query_id, `cells`: the cells found for each query as one array."""
    return nearest.groupBy("query_id").agg(F.collect_list(F.col("match_id").cast("int")).alias("cells"))


def default_probes(cells: int) -> int:
    return max(1, cells // IVF_PROBE_DIVISOR)


def fit_factors(interactions: DataFrame, factors: int = ALS_FACTORS, iterations: int = ALS_ITERATIONS,
                alpha: float = ALS_CONFIDENCE, seed: int = SEED):
    """Implicit-feedback factorisation of (user_idx, item_idx, r).

    Past PASS_LEAST_ROWS and with few products it goes by passes over the users
    (see `factors`), else by Spark's ALS.
    """
    cores = interactions.sparkSession.sparkContext.defaultParallelism
    rows, last, least = interactions.agg(F.count("*"), F.max("item_idx"), F.min("r")).first()
    if rows > min(PASS_LEAST_ROWS, ALS_MOST_ROWS) and least > 0 and (last + 1) * factors ** 2 <= PASS_VALUES:
        return fit_by_passes(interactions, last + 1, factors, iterations, ALS_REGULARISATION, alpha, seed)
    # As many blocks as cores, and more where a block would hold too many rows; small tables need none.
    blocks = max(1, min(cores, rows // ALS_LEAST_ROWS), rows // ALS_MOST_ROWS)
    als = ALS(rank=factors, maxIter=iterations, regParam=ALS_REGULARISATION, alpha=alpha, implicitPrefs=True, numUserBlocks=blocks,
              numItemBlocks=blocks, userCol="user_idx", itemCol="item_idx", ratingCol="r", seed=seed, checkpointInterval=5)
    return als.fit(interactions)
