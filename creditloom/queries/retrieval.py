"""Vector arithmetic and retrieval over the given embeddings, and collaborative factors over the loans."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from creditloom.functions import vectors as vec
from creditloom.operators import retrieval
from creditloom.operators.cells import CellIndex
from creditloom.operators.ordering import dense_index
from creditloom.operators.sizing import join_lookup
from creditloom.queries.preparation import train_positives
from creditloom.queries.registry import query
from creditloom.session import scratch_path, settle
from creditloom.sources.tables import table

K = 10


def embedding_vectors(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))


def _queries_and_items(spark, folder):
    unit = settle(retrieval.normalised(embedding_vectors(spark, folder)))
    return (unit.select(F.col("vec_id").alias("query_id"), "vector"),
            unit.select(F.col("vec_id").alias("match_id"), "vector"), unit)


_UNIT = """
unit AS (SELECT vec_id, label, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS vector
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings))"""
_CENTROIDS = """
components AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS c FROM embeddings CROSS JOIN range(1, 65) t(i) GROUP BY label, i),
centroids AS (SELECT label, list(c ORDER BY i) AS centroid FROM components GROUP BY label)"""


@query("l2_normalised_vectors", sql=f"""WITH {_UNIT}
SELECT vec_id, round(list_sum(vector), 6) + 0.0 AS component_sum, round(sqrt(list_dot_product(vector, vector)), 6) AS length FROM unit""")
def l2_normalised_vectors(spark, folder):
    unit = retrieval.normalised(embedding_vectors(spark, folder))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return unit.select("vec_id", (F.round(total, 6) + F.lit(0.0)).alias("component_sum"),
                       F.round(vec.norm(F.col("vector")), 6).alias("length"))


def _centroids(spark, folder):
    parts = embedding_vectors(spark, folder).select("label", F.posexplode("vector").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s.c).alias("centroid"))


@query("vector_products", sql=f"""WITH {_CENTROIDS}
SELECT vec_id, round(list_dot_product(v, centroid), 6) + 0.0 AS dot,
  round(list_cosine_similarity(v, centroid), 6) + 0.0 AS cosine,
  round(list_sum(list_transform(range(1, 65), lambda i: v[i] * centroid[i] * v[i])), 6) + 0.0 AS hadamard_dot,
  round(0.5::DOUBLE * (list_sum(list_transform(range(1, 65), lambda i: (v[i] + centroid[i]) * (v[i] + centroid[i])))
    - list_dot_product(v, v) - list_dot_product(centroid, centroid)), 6) + 0.0 AS fm_term,
  round(1.0::DOUBLE / (1.0::DOUBLE + exp(-list_dot_product(v, centroid))), 6) AS squashed
FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) JOIN centroids USING (label)""")
def vector_products(spark, folder):
    rows = join_lookup(embedding_vectors(spark, folder), settle(_centroids(spark, folder)), ["label"])
    v, c = F.col("vector"), F.col("centroid")
    tidy = lambda x, name: (F.round(x, 6) + F.lit(0.0)).alias(name)
    return rows.select("vec_id", tidy(vec.dot(v, c), "dot"), tidy(vec.dot(vec.l2_normalise(v), vec.l2_normalise(c)), "cosine"),
                       tidy(vec.dot(vec.hadamard(v, c), v), "hadamard_dot"), tidy(vec.fm_second_order([v, c]), "fm_term"),
                       tidy(vec.sigmoid(vec.dot(v, c)), "squashed"))


@query("embedding_centroids", sql=f"""WITH {_CENTROIDS}
SELECT label, i::INTEGER AS dimension, round(c, 6) + 0.0 AS centre FROM components""")
def embedding_centroids(spark, folder):
    return _centroids(spark, folder).select("label", F.posexplode("centroid").alias("p", "c")).select(
        "label", (F.col("p") + 1).alias("dimension"), (F.round("c", 6) + F.lit(0.0)).alias("centre"))


_TOPK = """
SELECT query_id, match_id, round(score, 6) + 0.0 AS score, rank::INTEGER AS rank FROM (
  SELECT q.vec_id AS query_id, i.vec_id AS match_id, list_dot_product(q.vector, i.vector) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.vector, i.vector), 9) DESC, i.vec_id) AS rank
  FROM unit q JOIN unit i ON {on}) WHERE rank <= 10"""


@query("topk_cosine", sql=f"WITH {_UNIT}" + _TOPK.format(on="q.vec_id <> i.vec_id"))
def topk_cosine(spark, folder):
    """Every vector against all others."""
    queries, items, _ = _queries_and_items(spark, folder)
    return retrieval.top_matches(queries.withColumn("own", F.col("query_id")), items, K).withColumn(
        "score", F.round("score", 6) + F.lit(0.0))


@query("topk_unseen", sql=f"WITH {_UNIT}," + """
seen AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
scored AS (SELECT q.vec_id AS query_id, i.vec_id AS match_id, list_dot_product(q.vector, i.vector) AS score
  FROM unit q JOIN customer ON c_custkey = q.vec_id CROSS JOIN unit i JOIN part ON p_partkey = i.vec_id
    ANTI JOIN seen s ON s.o_custkey = q.vec_id AND s.l_partkey = i.vec_id)
SELECT query_id, match_id, round(score, 6) + 0.0 AS score, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, match_id) AS rank FROM scored)
WHERE rank <= 10""")
def topk_unseen(spark, folder):
    """For every customer with a vector, the best parts with one that the customer never bought."""
    queries, items, _ = _queries_and_items(spark, folder)
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("query_id"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("match_id"))
    seen = (table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("match_id"))
            .join(table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("query_id")),
                  F.col("l_orderkey") == F.col("o_orderkey")).select("query_id", "match_id"))
    seen = seen.join(queries.select("query_id"), "query_id", "left_semi").join(
        items.select("match_id"), "match_id", "left_semi")
    return retrieval.top_unseen(queries.join(customers, "query_id"), items.join(parts, "match_id"), seen, K).withColumn(
        "score", F.round("score", 6) + F.lit(0.0))


@query("topk_by_cell")
def topk_by_cell(spark, folder):
    queries, items, _ = _queries_and_items(spark, folder)
    cells = retrieval.cell_count(items.count())
    placed, centres = retrieval.fit_cells(items, cells)
    return retrieval.top_matches_by_cell(queries, settle(placed), centres, K, retrieval.default_probes(cells))


@query("cell_recall")
def cell_recall(spark, folder):
    """Share of the exact ten best that the cell search finds."""
    queries, items, _ = _queries_and_items(spark, folder)
    cells = retrieval.cell_count(items.count())
    placed, centres = retrieval.fit_cells(items, cells)
    near = retrieval.top_matches_by_cell(queries, settle(placed), centres, K, retrieval.default_probes(cells))
    exact = retrieval.top_matches(queries, items, K)
    return exact.join(near.select("query_id", "match_id", F.lit(1).alias("found")), ["query_id", "match_id"], "left").agg(
        F.count("*").alias("n_exact"), F.count("found").alias("n_found"),
        (F.count("found") / F.count("*").cast("double")).alias("recall"))


def _kept_index(spark, folder, items) -> CellIndex:
    """An index fitted on the even ids, to which the odd ones are added in a batch that is then sent again."""
    even, odd = items.filter("match_id % 2 = 0"), items.filter("match_id % 2 <> 0")
    index = CellIndex.build(even, scratch_path(spark, "index"))
    index.add(odd.filter("match_id % 3 = 0"), "odd")
    index.add(odd, "odd")
    return index


@query("topk_kept_index", sql=f"WITH {_UNIT}" + _TOPK.format(on="TRUE"))
def topk_kept_index(spark, folder):
    """A kept index finds the exact best if every cell is probed, items that were added later included."""
    queries, items, _ = _queries_and_items(spark, folder)
    index = _kept_index(spark, folder, items)
    return index.search(queries, K, probes=retrieval.IVF_MAX_CELLS).withColumn("score", F.round("score", 6) + F.lit(0.0))


@query("topk_pruned", sql=f"WITH {_UNIT}" + _TOPK.format(on="q.vec_id <> i.vec_id"))
def topk_pruned(spark, folder):
    """Every vector against all others, cells that cannot hold a better one left out."""
    queries, items, _ = _queries_and_items(spark, folder)
    index = _kept_index(spark, folder, items)
    return index.search_exact(queries.withColumn("own", F.col("query_id")), K).select(
        "query_id", "match_id", (F.round("score", 6) + F.lit(0.0)).alias("score"), "rank")


@query("pruned_cells", sql="SELECT vec_id AS query_id, TRUE AS counted FROM embeddings")
def pruned_cells(spark, folder):
    """Per query the share of cells that the exact search did not have to visit lies between 0 and 1."""
    queries, items, _ = _queries_and_items(spark, folder)
    found = _kept_index(spark, folder, items).search_exact(queries, K)
    share = F.lit(1.0) - F.max("cells_visited") / F.max("cells")
    return found.groupBy("query_id").agg(((share >= 0) & (share < 1)).alias("counted"))


@query("kept_index_recall", sql="SELECT 10 * least(10000, count(*)) AS n_exact, TRUE AS enough FROM embeddings")
def kept_index_recall(spark, folder):
    """The recall that is kept beside an index, for the cells it then probes, is 0.9 at least."""
    queries, items, _ = _queries_and_items(spark, folder)
    index = _kept_index(spark, folder, items)
    index.measure(queries, K, least=0.9)
    return index.quality().select("n_exact", (F.col("recall") >= 0.9).alias("enough"))


@query("retrieval_guards", sql="""
SELECT CASE WHEN e.vec_id IS NULL THEN 'unknown' WHEN len(embedding) <> 64 THEN 'wrong size' ELSE 'ready' END AS state, count(*) AS n_requests
FROM customer LEFT JOIN embeddings e ON vec_id = c_custkey GROUP BY state""")
def retrieval_guards(spark, folder):
    """Which customers have a usable vector; the rest take the popular list."""
    known = embedding_vectors(spark, folder).select("vec_id", F.size("vector").alias("d"))
    state = F.when(F.col("vec_id").isNull(), "unknown").when(F.col("d") != 64, "wrong size").otherwise("ready")
    return (table(spark, folder, "customer").select("c_custkey").join(known, F.col("c_custkey") == F.col("vec_id"), "left")
            .groupBy(state.alias("state")).agg(F.count("*").alias("n_requests")))


@query("embedding_plane")
def embedding_plane(spark, folder):
    """Mean position per label in the plane of the two main components."""
    data = embedding_vectors(spark, folder).withColumn("features", array_to_vector("vector"))
    model = PCA(k=2, inputCol="features", outputCol="plane").fit(data)
    share = [float(x) for x in model.explainedVariance]
    place = vector_to_array("plane")
    return model.transform(data).select("label", place[0].alias("x"), place[1].alias("y")).groupBy("label").agg(
        F.avg("x").alias("mean_pc1"), F.avg("y").alias("mean_pc2"), F.count("*").alias("n_vectors")).withColumns(
        {"pc1_share": F.lit(share[0]), "pc2_share": F.lit(share[1])})


def numbered_interactions(spark, folder):
    positives = settle(train_positives(spark, folder))
    users, items = dense_index(positives, "member_id", "user_idx"), settle(dense_index(positives, "item_id", "item_idx"))
    return settle(join_lookup(positives.join(users, "member_id"), items, ["item_id"]))


@query("collaborative_top_items")
def collaborative_top_items(spark, folder):
    """Ten best unseen products per user by collaborative factors."""
    pairs = numbered_interactions(spark, folder)
    model = retrieval.fit_factors(pairs)
    queries = model.userFactors.select(F.col("id").alias("query_id"), F.col("features").alias("vector"))
    items = model.itemFactors.select(F.col("id").alias("match_id"), F.col("features").alias("vector"))
    seen = pairs.select(F.col("user_idx").alias("query_id"), F.col("item_idx").alias("match_id"))
    return retrieval.top_unseen(queries, items, seen, K)


@query("reconstruction_error")
def reconstruction_error(spark, folder):
    """Mean squared distance of the factor product from 1 over all positives."""
    pairs = numbered_interactions(spark, folder)
    model = retrieval.fit_factors(pairs)
    users = model.userFactors.select(F.col("id").alias("user_idx"), F.col("features").alias("u"))
    items = settle(model.itemFactors.select(F.col("id").alias("item_idx"), F.col("features").alias("v")))
    gap = vec.dot(F.col("u"), F.col("v")) - F.lit(1.0)
    return join_lookup(pairs.join(users, "user_idx"), items, ["item_idx"]).agg(
        F.count("*").alias("n_pairs"), F.avg(gap * gap).alias("mse"))
