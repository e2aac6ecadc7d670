"""What must hold for the jobs that go through trained models, whatever the fit gives.

Each query runs its job over all rows and states facts about the result, one row
per user, request or table; the SQL says from the given tables alone what they
have to be.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from creditloom.constants import APPROVAL_THRESHOLD, IMPROVEMENT_FIELDS
from creditloom.operators import explain, models, preparation as prep, retrieval
from creditloom.operators.features import USER_NUMERIC
from creditloom.operators.ordering import highest_before
from creditloom.plans import recommend
from creditloom.queries.common import with_catalog, with_loans
from creditloom.queries.decisions import _sql
from creditloom.queries.modelled import (
    approval_scores, catalog_ranking, home_suggestions, perceptron_recommendations, perceptron_scores, purpose_replies, ranking_scores,
    ranking_training_set, recommendations, recommendations_by_cells, reordered_recommendations, trained,
)
from creditloom.queries.preparation import NEGATIVES, POPULARITY, POSITIVES
from creditloom.queries.registry import query
from creditloom.queries.retrieval import K, _TOPK, _UNIT, _queries_and_items, collaborative_top_items
from creditloom.session import settle
from creditloom.sources.loans import loans
from creditloom.sources.requests import requests

_PAIRS = """
SELECT member_id, item_id, 1 AS label, TRUE AS scored FROM positives
UNION ALL SELECT member_id, neg_item_id, 0, TRUE FROM negatives"""


def _scored(rows, score):
    return rows.select("member_id", "item_id", F.col("label").cast("int").alias("label"),
                       F.coalesce(F.col(score).between(0, 1), F.lit(False)).alias("scored"))


@query("ranking_set_keys", sql=with_loans(_PAIRS, POSITIVES, POPULARITY, NEGATIVES))
def ranking_set_keys(spark, folder):
    """Every positive and negative is in the ranking set once, with a probability."""
    return _scored(ranking_training_set(spark, folder), "repay_prob")


@query("ranking_score_keys", sql=with_loans(_PAIRS, POSITIVES, POPULARITY, NEGATIVES))
def ranking_score_keys(spark, folder):
    return _scored(ranking_scores(spark, folder), "score")


@query("perceptron_score_keys", sql=with_loans(f"SELECT * FROM ({_PAIRS})", POSITIVES, POPULARITY, NEGATIVES))
def perceptron_score_keys(spark, folder):
    return _scored(perceptron_scores(spark, folder), "score")


@query("evaluation_positives", sql=with_loans("""
SELECT split, member_id, item_id, 1 AS label, TRUE AS scored FROM (
  SELECT DISTINCT split, member_id, item_id FROM loans WHERE label = 1 AND split <> 'train')"""))
def evaluation_positives(spark, folder):
    """The validation and test ranking sets: positives only, with features and probability."""
    art = trained(spark, folder)
    pairs = art.table("positives").filter("split <> 'train'").select("split", "member_id", "item_id", F.lit(1).alias("label"))
    rows = models.pair_features(pairs, art.table("users"), settle(art.table("items")))
    scored = models.with_repay(rows, art.repay_model(), art.calibrator())
    return scored.select("split", "member_id", "item_id", "label", F.col("repay_prob").between(0, 1).alias("scored"))


@query("popularity_catalog", sql=with_catalog("""
SELECT item_id, n_loans, row_number() OVER (ORDER BY n_loans DESC, item_id)::INTEGER AS position FROM catalog"""))
def popularity_catalog(spark, folder):
    """The whole catalog by popularity, with positions."""
    return prep.by_popularity(prep.item_catalog(
        loans(spark, folder, "item_id", "int_rate", "loan_amnt", "grade", "purpose", "term", "label"))).select("item_id", "n_loans", "position")


@query("topk_all_cells", sql=f"WITH {_UNIT}" + _TOPK.format(on="TRUE"))
def topk_all_cells(spark, folder):
    """The cell search finds the exact best if it looks into every cell."""
    queries, items, _ = _queries_and_items(spark, folder)
    cells = retrieval.cell_count(items.count())
    placed, centres = retrieval.fit_cells(items, cells)
    return retrieval.top_matches_by_cell(queries, settle(placed), centres, K, cells).withColumn("score", F.round("score", 6) + F.lit(0.0))


@query("collaborative_facts", sql=with_loans("""
SELECT user_idx, least(10, n_items - n_seen) AS n_items, 1 AS first_rank, least(10, n_items - n_seen)::INTEGER AS last_rank, 0 AS n_seen FROM (
  SELECT row_number() OVER (ORDER BY member_id) - 1 AS user_idx, count(*) AS n_seen, (SELECT count(DISTINCT item_id) FROM positives) AS n_items
  FROM positives GROUP BY member_id) WHERE n_seen < n_items""", POSITIVES))
def collaborative_facts(spark, folder):
    """Per user: as many products as there are unseen ones, ten at most, ranks without gaps, none of them seen."""
    from creditloom.queries.retrieval import numbered_interactions
    found = settle(collaborative_top_items(spark, folder))
    seen = numbered_interactions(spark, folder).select(
        F.col("user_idx").alias("query_id"), F.col("item_idx").alias("match_id"), F.lit(1).alias("had"))
    return found.join(seen, ["query_id", "match_id"], "left").groupBy(F.col("query_id").cast("long").alias("user_idx")).agg(
        F.countDistinct("match_id").alias("n_items"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"),
        F.count("had").cast("int").alias("n_seen"))


@query("catalog_ranking_facts", sql=with_catalog("""
SELECT member_id, least(10, (SELECT count(*) FROM catalog)) AS n_items, 1 AS first_rank, least(10, (SELECT count(*) FROM catalog))::INTEGER AS last_rank
FROM (SELECT DISTINCT member_id FROM loans WHERE split = 'train')"""))
def catalog_ranking_facts(spark, folder):
    """Per known user: ten different products, ranks without gaps."""
    return catalog_ranking(spark, folder).groupBy("member_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))


@query("calibration_facts", sql=with_loans("""
SELECT count(*) AS n_loans, round(avg(label), 6) AS mean_calibrated, 0 AS n_outside, 0 AS n_falling FROM loans WHERE split = 'val'"""))
def calibration_facts(spark, folder):
    """Calibration keeps the mean of the outcomes, stays in [0, 1] and never falls as the raw score rises.

    Every raw score is held against all lower ones; a loan without a calibrated
    probability counts as outside.
    """
    art = trained(spark, folder)
    scored = settle(art.calibrator().transform(art.table("val_scores")).select("raw_prob", "prediction"))
    levels = scored.groupBy("raw_prob").agg(F.min("prediction").alias("low"), F.max("prediction").alias("high"))
    falling = highest_before(levels, "raw_prob", "high").agg(
        F.count_if(F.col("high_before") > F.col("low") + 1e-12).cast("int").alias("n_falling"))
    inside = F.coalesce(F.col("prediction").between(0, 1), F.lit(False))
    return scored.agg(F.count("*").alias("n_loans"), F.round(F.avg("prediction"), 6).alias("mean_calibrated"),
                      F.count_if(~inside).cast("int").alias("n_outside")).join(F.broadcast(falling))


_ASKED = """FROM requests WHERE loan_amnt_request IS NOT NULL
  AND (annual_inc IS NOT NULL OR user_id IN (SELECT member_id FROM train_users))"""


@query("contribution_facts", sql=_sql(f"SELECT request_id, TRUE AS adds_up {_ASKED}"))
def contribution_facts(spark, folder):
    """The contributions of all fields and what is left of the product add up to the log-odds, less their mean."""
    art = trained(spark, folder)
    rows, leaves = settle(recommend.application_rows(art, requests(spark, folder))), art.leaves()
    mean = float((leaves.value * leaves.share.prod(axis=1)).sum())
    parts = explain.contribution_table(rows, leaves, art.user_spec().fields()).groupBy("request_id").agg(F.sum("contribution").alias("total"))
    scored = models.with_raw_repay(rows.select("request_id", array_to_vector("x").alias("features")), art.repay_model())
    odds = F.log(F.col("raw_prob") / (F.lit(1.0) - F.col("raw_prob")))
    return scored.join(parts, "request_id").select("request_id", (F.abs(odds - F.col("total") - F.lit(mean)) < 1e-6).alias("adds_up"))


@query("improvement_facts", sql=_sql(f"SELECT request_id, 0 AS n_wrong {_ASKED}"))
def improvement_facts(spark, folder):
    """Each named value passes and one a cent nearer does not; who passes already keeps all values."""
    art = trained(spark, folder)
    user_spec, item_spec, model, calibrator = art.user_spec(), art.item_spec(), art.repay_model(), art.calibrator()
    rows = settle(recommend.application_rows(art, requests(spark, folder)))
    named = settle(explain.improvements(rows, art.leaves(), calibrator, user_spec, item_spec).filter("achievable").select(
        "request_id", F.col("field").alias("changed"), "current_value", "min_required"))

    def passes(changed):
        features = array_to_vector(F.concat(user_spec.vector(), item_spec.vector()))
        return models.with_repay(changed.withColumn("features", features), model, calibrator).withColumn(
            "passes", F.col("repay_prob") >= APPROVAL_THRESHOLD)

    already = settle(passes(rows).select("request_id", F.col("passes").alias("passed")))
    towards = F.coalesce(*[F.when(F.col("changed") == f, F.lit(d)) for f, (d, _, _) in IMPROVEMENT_FIELDS.items()])
    trials = rows.join(named, "request_id").join(already, "request_id").withColumn("nearer", F.explode(F.array(F.lit(False), F.lit(True))))
    value = F.when(F.col("nearer"), F.round(F.col("min_required") - towards * F.lit(0.01), 2)).otherwise(F.col("min_required"))
    # The value is fixed before any field changes, as the fields are named alike.
    trials = trials.filter("NOT passed").withColumn("_value", value)
    for f in IMPROVEMENT_FIELDS:
        trials = trials.withColumn(f, F.when(F.col("changed") == f, F.col("_value")).otherwise(F.col(f)))
    wrong = passes(trials).filter(F.col("passes") == F.col("nearer")).select("request_id")
    moved = named.join(already.filter("passed"), "request_id").filter("min_required <> current_value").select("request_id")
    counted = wrong.unionByName(moved).groupBy("request_id").agg(F.count("*").cast("int").alias("n"))
    return rows.select("request_id").join(counted, "request_id", "left").select("request_id", F.coalesce("n", F.lit(0)).alias("n_wrong"))


@query("home_facts", sql=_sql(f"SELECT request_id, 0 AS n_wrong {_ASKED}"))
def home_facts(spark, folder):
    """A suggested home category scores as said, strictly above the current one, and no other one scores higher."""
    art = trained(spark, folder)
    rows = settle(recommend.application_rows(art, requests(spark, folder)))
    named = home_suggestions(spark, folder)
    user_spec, item_spec = art.user_spec(), art.item_spec()
    options = rows.select("request_id", F.coalesce("home_ownership", F.lit("Unknown")).alias("now"), *[
        c for c in rows.columns if c not in ("request_id", "home_ownership", "x")]).withColumn(
        "home_ownership", F.explode(F.array_distinct(F.concat(F.array(*[F.lit(h) for h in explain.HOME_OPTIONS]), F.array("now")))))
    scored = models.with_repay(options.withColumn("features", array_to_vector(F.concat(user_spec.vector(), item_spec.vector()))),
                               art.repay_model(), art.calibrator())
    best = scored.groupBy("request_id").agg(F.max("repay_prob").alias("best"), F.max(
        F.when(F.col("home_ownership") == F.col("now"), F.col("repay_prob"))).alias("own"))
    better = F.col("best") > F.col("own")
    right = F.when(better, F.coalesce(F.round("best", 4) == F.col("score_with_recommended"), F.lit(False))).otherwise(F.col("recommended").isNull())
    return best.join(named, "request_id", "left").select("request_id", F.when(right, 0).otherwise(1).alias("n_wrong"))


@query("approval_facts", sql=_sql(f"""
SELECT request_id, request_id IN (SELECT request_id {_ASKED}) AS scored, TRUE AS consistent FROM requests"""))
def approval_facts(spark, folder):
    """Every request has a decision; it is scored if profile and product are there, and approved from 0.65 up."""
    score = F.col("approval_score")
    return approval_scores(spark, folder).select(
        "request_id", (score > 0).alias("scored"), (score.between(0, 1) & (F.col("approved") == (score >= APPROVAL_THRESHOLD))).alias("consistent"))


_VALID = """(SELECT *, coalesce(top_k, 10) AS k, coalesce(retrieval_pool, 100) AS pool FROM requests
  WHERE coalesce(top_k, 10) BETWEEN 1 AND 100 AND coalesce(rerank_pool, 20) BETWEEN 1 AND 100 AND coalesce(retrieval_pool, 100) BETWEEN 10 AND 500)"""


def _list_facts(rows):
    passing = F.col("repay_prob") >= APPROVAL_THRESHOLD
    return rows.groupBy("request_id").agg(
        F.max("cold_start").alias("cold_start"), (F.countDistinct("item_id") == F.count("*")).alias("all_different"),
        ((F.min("rank") == 1) & (F.max("rank") == F.count("*"))).alias("no_gaps"), (F.count("*") <= F.max("top_k")).alias("short_enough"),
        (F.bool_and(passing) | ~F.bool_or(passing)).alias("filtered"))


_LIST_SQL = _sql(f"""SELECT request_id, user_id NOT IN (SELECT member_id FROM train_payers) AS cold_start, TRUE AS all_different, TRUE AS no_gaps,
  TRUE AS short_enough, TRUE AS filtered FROM {_VALID}""",
                 "train_payers AS (SELECT DISTINCT member_id FROM loans WHERE split = 'train' AND label = 1)")


@query("recommendation_facts", sql=_LIST_SQL)
def recommendation_facts(spark, folder):
    """Every valid request gets a list: different products, ranks without gaps, no more than asked for, all likely repaid or none."""
    return _list_facts(recommendations(spark, folder))


@query("perceptron_recommendation_facts", sql=_LIST_SQL)
def perceptron_recommendation_facts(spark, folder):
    return _list_facts(perceptron_recommendations(spark, folder))


@query("cell_recommendation_facts", sql=_LIST_SQL)
def cell_recommendation_facts(spark, folder):
    return _list_facts(recommendations_by_cells(spark, folder))


@query("reordered_facts", sql=_sql(f"""SELECT request_id, TRUE AS all_different, TRUE AS no_gaps, TRUE AS short_enough FROM {_VALID}"""))
def reordered_facts(spark, folder):
    return _list_facts(reordered_recommendations(spark, folder)).select("request_id", "all_different", "no_gaps", "short_enough")


@query("unprofiled_recommendations", sql=_sql(f"""
SELECT request_id, item_id, position AS rank, 0.0::DOUBLE AS score FROM {_VALID} r
  JOIN (SELECT item_id, row_number() OVER (ORDER BY n_loans DESC, item_id)::INTEGER AS position FROM catalog) ON position <= least(k, pool)
WHERE annual_inc IS NULL AND user_id NOT IN (SELECT member_id FROM train_users)"""))
def unprofiled_recommendations(spark, folder):
    """Who is unknown and states nothing gets the popular list."""
    rows = recommendations(spark, folder).filter("cold_start")
    stated = F.coalesce(*[F.col(c) for c in USER_NUMERIC]).isNotNull()
    known = trained(spark, folder).table("profiles").filter("known").select(F.col("member_id").alias("user_id"))
    silent = requests(spark, folder).filter(~stated).join(known, "user_id", "left_anti").select("request_id")
    return rows.join(silent, "request_id").select("request_id", "item_id", "rank", "score")


@query("answer_facts", sql=_sql(f"""
SELECT request_id, request_id IN (SELECT request_id {_ASKED}) AS scored,
  CASE WHEN user_id IN (SELECT member_id FROM train_users) THEN 'stored' WHEN annual_inc IS NOT NULL THEN 'request' ELSE 'none' END AS profile_source,
  CASE WHEN request_id IN (SELECT request_id {_ASKED}) THEN 6 ELSE 0 END AS n_contributions,
  concat_ws(',', CASE WHEN payer THEN 'retrieval' ELSE 'popularity' END,
    CASE WHEN payer OR annual_inc IS NOT NULL OR user_id IN (SELECT member_id FROM train_users) THEN 'repay_prediction' END,
    CASE WHEN payer THEN 'ranking' END,
    CASE WHEN payer AND coalesce(use_rerank, FALSE) AND purpose_request IN (SELECT purpose FROM catalog) THEN 'reordering' END) AS stages
FROM (SELECT *, user_id IN (SELECT member_id FROM train_payers) AS payer FROM {_VALID})""",
                            "train_payers AS (SELECT DISTINCT member_id FROM loans WHERE split = 'train' AND label = 1)"))
def answer_facts(spark, folder):
    """Every valid request has one whole answer: its true stages, its profile, and reasons where it is scored."""
    art, asked = trained(spark, folder), requests(spark, folder)
    rows = recommend.answers(art, asked, purpose_replies(art, asked))
    return rows.select("request_id", (F.col("approval_score") > 0).alias("scored"), F.col("profile.profile_source").alias("profile_source"),
                       F.coalesce(F.size("contributions"), F.lit(0)).alias("n_contributions"), F.array_join("stages", ",").alias("stages"))
