"""A kept index of item vectors: an inverted file, searched approximately or exactly.

The items lie in Parquet, partitioned by the cell of their direction; a search
reads only the folders of the cells that its queries probe.
Beside them lie the cell centres and, per cell, the widest angle to the centre
and the least and greatest length. An item at an angle of at most r from a
centre that is t away from the query is at least t - r away from it, so these
bound the best score that a cell can hold. The exact search visits cells best
bound first and stops where a query's k-th score beats the next bound.

Items can be added without a new fit; they go to the nearest cell. A batch of
items has a name, and adding it again replaces it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.constants import SEED
from creditloom.functions.vectors import dot, norm
from creditloom.operators import retrieval
from creditloom.session import settle

FILE_ROWS = 1_000_000   # items of a cell in one file
SLACK = 1e-9            # by which bounds are widened, for rounding
BOUNDS_HELD = 500_000   # bounds of queries and cells held at once in a task
RECALL_QUERIES = 10_000  # queries, chosen by hash, whose recall is measured when an index is built


@dataclass(frozen=True)
class CellIndex:
    spark: SparkSession
    path: str

    # --- building ---------------------------------------------------------

    @classmethod
    def build(cls, items: DataFrame, path: str, cells: int | None = None, seed: int = SEED) -> CellIndex:
        """Cells fitted on (match_id, vector), and the items in them as the batch named `first`."""
        index = cls(items.sparkSession, path)
        items = settle(items.select("match_id", "vector"))
        pointing = items.where(norm(F.col("vector")) > 0)
        n = pointing.count()
        _, centres = retrieval.fit_cells(pointing, min(n, cells or retrieval.cell_count(n)), seed)
        retrieval.normalised(centres).withColumnRenamed("match_id", "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        index.add(items, "first")
        return index

    def centres(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centres")

    def add(self, items: DataFrame, batch: str) -> None:
        """Puts (match_id, vector) into their nearest cells; a batch of the same name is replaced."""
        items = settle(items.select("match_id", "vector"))
        centres = settle(self.centres())
        nearest = retrieval.top_matches(items.withColumnRenamed("match_id", "query_id"),
                                        centres.withColumnRenamed("cell", "match_id"), 1)
        placed = settle(items.join(nearest.select(F.col("query_id").alias("match_id"), F.col("match_id").alias("cell")), "match_id"))
        # One row a cell, of which there are few thousand.
        beside = placed.join(F.broadcast(centres.withColumnRenamed("vector", "centre")), "cell")
        length = norm(F.col("vector"))
        angle = F.when(length > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("vector"), F.col("centre")) / length))))
        stats = beside.groupBy("cell").agg(F.count("*").alias("n"), F.coalesce(F.max(angle), F.lit(0.0)).alias("radius"),
                                           F.min(length).alias("shortest"), F.max(length).alias("longest"))
        parts = settle(stats).select("cell", F.expr(f"int((n - 1) div {FILE_ROWS} + 1)").alias("parts"))
        dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("match_id"), F.col("parts")))
        self._replace(dealt.repartition("cell", "part").drop("part", "parts"), batch, "items", "cell")
        self._replace(stats.coalesce(1), batch, "stats")

    def _replace(self, rows: DataFrame, batch: str, name: str, *by: str) -> None:
        (rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch", *by).parquet(f"{self.path}/{name}"))

    def items(self) -> DataFrame:
        """match_id, vector, cell."""
        return self.spark.read.parquet(f"{self.path}/items").drop("batch")

    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/stats").groupBy("cell").agg(
            F.sum("n").alias("n"), F.max("radius").alias("radius"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))

    # --- searching --------------------------------------------------------

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """The k best among the items of each query's `probes` nearest cells: (query_id, match_id, score, rank).

        `queries` are those of `retrieval.top_matches`.
        """
        probes = probes or self.default_probes()
        nearest = retrieval.top_matches(queries.select("query_id", "vector"),
                                        self.centres().withColumnRenamed("cell", "match_id"), probes)
        probing = settle(retrieval.with_keep(queries, k).join(retrieval.cells_of(nearest), "query_id"))
        found = retrieval.blocked_matches(probing, self._probed(probing.select(F.explode("cells").alias("cell"))))
        own_keep = queries.select("query_id", "keep") if "keep" in queries.columns else None
        return retrieval.ranked(found, own_keep, k)

    def _probed(self, probing: DataFrame) -> DataFrame:
        """The items of the cells that any query probes; as cells are folders, no others are read."""
        # At most IVF_MAX_CELLS numbers.
        wanted = sorted(r.cell for r in probing.select("cell").distinct().collect())
        return self.items().filter(F.col("cell").isin(wanted))

    def search_exact(self, queries: DataFrame, k: int, first: int | None = None) -> DataFrame:
        """The exact k best, and `cells_visited`, of how many `cells` there are: (query_id, match_id, score, rank, ...).

        Each round visits twice as many cells as the one before, for those queries
        whose next bound may still hold a better item.
        """
        own_keep = queries.select("query_id", "keep") if "keep" in queries.columns else None
        asked = settle(retrieval.with_keep(queries, k))
        cells, n = self.stats().agg(F.count("*"), F.sum("n")).first()
        # No bar is known before k items are, so the first round visits the cells that hold k on average.
        most = asked.agg(F.max("keep")).first()[0] or 0
        step = first or min(cells, max(retrieval.default_probes(cells), -(-most * cells // max(1, n or 0))))
        done, waiting, best, visits = 0, asked.withColumn("bar", F.lit(None).cast("double")), None, None
        while done < cells:
            probing = settle(self._next_cells(waiting, done, step))
            if probing.isEmpty():
                break
            seen = probing.select("query_id", F.size("cells").alias("n"))
            visits = seen if visits is None else visits.unionByName(seen)
            found = retrieval.blocked_matches(probing.drop("bar"), self._probed(probing.select(F.explode("cells").alias("cell"))))
            best = settle(retrieval.ranked(found if best is None else best.drop("rank").unionByName(found), own_keep, k))
            held = best.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
            bar = F.when(F.coalesce("_n", F.lit(0)) >= F.col("keep"), F.col("_least"))
            waiting = asked.join(held, "query_id", "left").withColumn("bar", bar).drop("_n", "_least")
            done, step = done + step, 2 * step
        if best is None:
            return retrieval.ranked(self.spark.createDataFrame([], retrieval.result_schema(queries, self.items())), None, k).withColumns(
                {"cells_visited": F.lit(0).cast("long"), "cells": F.lit(cells)})
        total = settle(visits.groupBy("query_id").agg(F.sum("n").alias("cells_visited")))
        return best.join(total, "query_id").withColumn("cells", F.lit(cells))

    def _next_cells(self, waiting: DataFrame, done: int, step: int) -> DataFrame:
        """The rows of `waiting` with their `cells` at places done to done + step by bound whose bound reaches the bar, if any."""
        rows = self.centres().join(self.stats(), "cell").select("cell", "vector", "radius", "shortest", "longest").toPandas().sort_values("cell")
        # At most IVF_MAX_CELLS rows.
        shared = self.spark.sparkContext.broadcast((rows["cell"].to_numpy(np.int32), np.stack(rows["vector"].to_numpy()), *[
            rows[c].to_numpy() for c in ("radius", "shortest", "longest")]))
        schema = T.StructType([*waiting.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cell, centres, *sizes = shared.value
            many = max(1, BOUNDS_HELD // len(cell))
            for batch in batches:
                for start in range(0, len(batch), many):
                    part = batch.iloc[start:start + many]
                    top = bounds(np.stack(part["vector"].to_numpy()).astype(float), centres, *sizes)
                    order = np.lexsort((np.broadcast_to(cell, top.shape), -top), axis=1)[:, done:done + step]
                    bar = part["bar"].to_numpy(float, na_value=-np.inf)
                    near = np.take_along_axis(top, order, axis=1) >= bar[:, None] - 10.0 ** -retrieval.SCORE_DIGITS
                    rows = np.flatnonzero(near.any(axis=1))
                    if len(rows):
                        yield part.iloc[rows].assign(cells=[cell[order[i, near[i]]] for i in rows])

        return waiting.mapInPandas(run, schema)

    # --- quality ----------------------------------------------------------

    def measure(self, queries: DataFrame, k: int, probes: int | None = None, n_queries: int = RECALL_QUERIES,
                least: float = 0.0) -> None:
        """Keeps the share of the exact k best that the search finds, over `n_queries` queries chosen by hash.

        Cells are doubled until that share is `least`; the search then probes so many.
        Which number that is shows from where the cells of the exact best lie, so
        the search itself runs but once, or on where it finds less than that says.
        """
        cells = self.centres().count()
        probes = min(cells, probes or retrieval.default_probes(cells))
        some = settle(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(n_queries))
        exact = settle(self.search_exact(some, k).select("query_id", "match_id"))
        tried = [probes]
        while tried[-1] < cells:
            tried.append(min(cells, 2 * tried[-1]))
        if len(tried) > 1:
            shares = self._places(some, exact).agg(*[F.avg((F.col("place") <= p).cast("int")).alias(str(p)) for p in tried]).first()
            probes = next(p for p, share in zip(tried, shares) if share is None or share >= least or p == cells)
        while True:
            found = self.search(some, k, probes).select("query_id", "match_id", F.lit(1).alias("found"))
            row = settle(exact.join(found, ["query_id", "match_id"], "left").agg(
                F.lit(k).alias("k"), F.lit(probes).alias("probes"), F.countDistinct("query_id").alias("n_queries"),
                F.count("*").alias("n_exact"), F.count("found").alias("n_found"),
                F.coalesce(F.count("found") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("recall")))
            if probes >= cells or row.first().recall >= least:
                break
            probes = min(cells, 2 * probes)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/quality")

    def _places(self, queries: DataFrame, found: DataFrame) -> DataFrame:
        """For each of the `found` (query_id, match_id) the `place` of its cell among those nearest to the query, from 1."""
        lists = found.join(self.items().select("match_id", "cell"), "match_id").groupBy("query_id").agg(F.collect_list("cell").alias("cells"))
        rows = self.centres().toPandas().sort_values("cell")  # at most IVF_MAX_CELLS
        shared = self.spark.sparkContext.broadcast((rows["cell"].to_numpy(), np.stack(rows["vector"].to_numpy())))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cell, centres = shared.value
            many = max(1, BOUNDS_HELD // len(cell))
            for batch in batches:
                for start in range(0, len(batch), many):
                    part = batch.iloc[start:start + many]
                    scores = np.round(np.stack(part["vector"].to_numpy()).astype(float) @ centres.T, retrieval.SCORE_DIGITS)
                    place = np.empty(scores.shape, int)
                    np.put_along_axis(place, np.argsort(-scores, axis=1, kind="stable"), np.arange(1, len(cell) + 1)[None], axis=1)
                    yield pd.DataFrame({"place": np.concatenate([place[i, np.searchsorted(cell, c)] for i, c in enumerate(part["cells"])])})

        return queries.select("query_id", "vector").join(lists, "query_id").select("vector", "cells").mapInPandas(run, "place long")

    def default_probes(self) -> int:
        """The cells that were measured to be enough, or a fixed part of all."""
        try:
            return self.quality().first().probes
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        return retrieval.default_probes(self.centres().count())

    def quality(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/quality")


def bounds(queries: np.ndarray, centres: np.ndarray, radius: np.ndarray, shortest: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """The greatest dot product that an item of each cell can have with each query, (queries, cells)."""
    length = np.linalg.norm(queries, axis=1)
    cosine = np.divide(queries @ centres.T, length[:, None], out=np.zeros((len(queries), len(centres))), where=length[:, None] > 0)
    nearest = np.cos(np.maximum(0.0, np.arccos(np.clip(cosine, -1, 1)) - radius - SLACK)) + SLACK
    return length[:, None] * np.where(nearest > 0, nearest * longest, nearest * shortest)
