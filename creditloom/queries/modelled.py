"""Jobs that go through trained models. Their numbers depend on the fit; what must hold of them is in `checks`."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from creditloom.operators import explain, metrics, models, rerank
from creditloom.operators.sizing import join_lookup
from creditloom.plans import choose, evaluate, offline, recommend
from creditloom.queries.common import with_loans
from creditloom.queries.preparation import NEGATIVES, POPULARITY, POSITIVES
from creditloom.queries.registry import query
from creditloom.session import settle
from creditloom.sources.loans import loans
from creditloom.sources.requests import requests
from creditloom.sources.tables import files_mark

_TRAINED: dict[tuple, offline.Artefacts] = {}
_READ = ("lineitem", "orders", "customer", "nation", "part")  # what the loans are made of


def trained(spark, folder) -> offline.Artefacts:
    """The offline job over the whole loan table, once per session and state of its files; train users are the known ones.

    All of the data, and the library's default rounds.
    """
    key = (spark.sparkContext.applicationId, folder, files_mark(spark, folder, *_READ))
    if key not in _TRAINED:
        _TRAINED[key] = offline.run(loans(spark, folder, *offline.LOAN_COLUMNS), profile_split="train", choose=True)
    return _TRAINED[key]


@query("offline_run", sql=with_loans("""
SELECT 'loans' AS table_name, count(*) AS n_rows FROM loans
UNION ALL SELECT 'positives', count(*) FROM (SELECT DISTINCT split, member_id, item_id FROM loans WHERE label = 1)
UNION ALL SELECT t, (SELECT count(DISTINCT item_id) FROM loans) FROM (VALUES ('catalog'), ('items')) x(t)
UNION ALL SELECT t, (SELECT count(DISTINCT member_id) FROM loans) FROM (VALUES ('profiles'), ('users')) x(t)
UNION ALL SELECT 'user_factors', count(DISTINCT member_id) FROM positives
UNION ALL SELECT 'item_factors', count(DISTINCT item_id) FROM positives
UNION ALL SELECT 'val_scores', count(*) FROM loans WHERE split = 'val'
UNION ALL SELECT 'training_pairs', (SELECT count(*) FROM positives) + (SELECT count(*) FROM negatives)""", POSITIVES, POPULARITY, NEGATIVES))
def offline_run(spark, folder):
    """Rows of every table the offline job leaves behind."""
    art = trained(spark, folder)
    names = ["loans", "positives", "catalog", "profiles", "users", "items", "user_factors", "item_factors", "val_scores", "training_pairs"]
    out = None
    for n in names:
        row = art.table(n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows"))
        out = row if out is None else out.unionByName(row)
    return out


@query("repayment_model_quality")
def repayment_model_quality(spark, folder):
    art = trained(spark, folder)
    scored = art.calibrator().transform(art.table("val_scores")).withColumnRenamed("prediction", "calibrated")
    auc = metrics.roc_auc(scored.withColumnRenamed("raw_prob", "score")).select("auc").scalar()
    return scored.agg(F.count("*").alias("n_loans"), metrics.brier(scored, "raw_prob").alias("brier_raw"),
                      metrics.brier(scored, "calibrated").alias("brier_calibrated")).withColumn("auc", auc)


@query("model_quality_floors", sql=with_loans("""
SELECT count(*) AS n_loans, TRUE AS auc_above_chance, TRUE AS brier_below_constant, TRUE AS calibration_helps FROM loans WHERE split = 'val'"""))
def model_quality_floors(spark, folder):
    """On validation loans the model orders better than chance, and calibrated it is better than the share of repaid loans and than raw."""
    rows = repayment_model_quality(spark, folder)
    share = trained(spark, folder).table("val_scores").agg((F.avg("label") * (1 - F.avg("label"))).alias("b")).select("b").scalar()
    return rows.select("n_loans", (F.col("auc") > 0.5).alias("auc_above_chance"), (F.col("brier_calibrated") <= share + 1e-12).alias("brier_below_constant"),
                       (F.col("brier_calibrated") <= F.col("brier_raw") + 1e-12).alias("calibration_helps"))


@query("calibration_points", sql="SELECT raw, TRUE AS inside, TRUE AS rising FROM (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) t(raw)")
def calibration_points(spark, folder):
    """The calibration curve read at three raw scores lies in [0, 1] and does not fall from one to the next."""
    points = spark.createDataFrame([(0.2,), (0.5,), (0.8,)], "raw double")
    read = models.calibrated(trained(spark, folder).calibrator(), points, "raw")
    before = F.lag("calibrated").over(Window.orderBy("raw"))  # of three rows
    return read.select("raw", F.col("calibrated").between(0, 1).alias("inside"),
                       F.coalesce(before <= F.col("calibrated") + 1e-12, F.lit(True)).alias("rising"))


@query("calibration_curve")
def calibration_curve(spark, folder):
    """Observed repayment and calibrated probability in ten equal bands of the raw score, over all validation loans."""
    art = trained(spark, folder)
    scored = art.calibrator().transform(art.table("val_scores"))
    band = F.least(F.floor(F.col("raw_prob") * 10), F.lit(9)).cast("int")
    return scored.groupBy(band.alias("band")).agg(
        F.count("*").alias("n_loans"), F.avg("raw_prob").alias("raw"), F.avg("prediction").alias("calibrated"),
        F.avg("label").alias("observed"))


@query("pair_repay_keys", sql=with_loans("""
SELECT count(*) AS n_pairs, count(DISTINCT member_id) AS n_users, count(DISTINCT item_id) AS n_items, 0::BIGINT AS n_bad
FROM (SELECT DISTINCT member_id, item_id FROM loans WHERE split = 'test')"""))
def pair_repay_keys(spark, folder):
    """Every test pair has both probabilities, between 0 and 1."""
    rows = pair_repay_probabilities(spark, folder)
    bad = ~(F.col("raw_prob").between(0, 1) & F.col("repay_prob").between(0, 1))
    return rows.agg(F.count("*").alias("n_pairs"), F.countDistinct("member_id").alias("n_users"),
                    F.countDistinct("item_id").alias("n_items"), F.count_if(F.coalesce(bad, F.lit(True))).alias("n_bad"))


@query("ablation_users", sql=with_loans("""
, users AS (SELECT member_id, bool_or(split = 'train') AS warm FROM loans WHERE label = 1 AND split IN ('train', 'test')
  GROUP BY member_id HAVING bool_or(split = 'test'))
SELECT stage, CASE WHEN warm THEN 'Warm Start' ELSE 'Cold Start' END AS user_type, count(*) AS n_users
FROM users, (VALUES ('retrieval'), ('ranking'), ('replies')) s(stage) GROUP BY ALL"""))
def ablation_users(spark, folder):
    """Every test user, warm or cold, is scored in every stage."""
    return evaluate.ablation(trained(spark, folder)).groupBy("stage", "user_type").agg(F.countDistinct("member_id").alias("n_users"))


@query("pair_repay_probabilities")
def pair_repay_probabilities(spark, folder):
    """Calibrated probability of every pair of user and product with a test loan."""
    art = trained(spark, folder)
    pairs = art.table("loans").filter("split = 'test'").select("member_id", "item_id").distinct()
    rows = models.pair_features(pairs, art.table("users"), settle(art.table("items")))
    return models.with_repay(rows, art.repay_model(), art.calibrator()).select("member_id", "item_id", "raw_prob", "repay_prob")


@query("ranking_scores")
def ranking_scores(spark, folder):
    """Ranking score of every training pair."""
    art = trained(spark, folder)
    return recommend.scored(art.ranking(), art.table("training_pairs"))


@query("ranking_training_set")
def ranking_training_set(spark, folder):
    """Positives and negatives with features and repayment probability."""
    art = trained(spark, folder)
    rows = models.pair_features(art.table("training_pairs"), art.table("users"), settle(art.table("items")))
    return models.with_repay(rows, art.repay_model(), art.calibrator()).select(
        "member_id", "item_id", "label", F.size(vector_to_array("features")).alias("n_features"), "repay_prob")


@query("perceptron_scores")
def perceptron_scores(spark, folder):
    """Pairs scored by the perceptron over factors, features and repayment probability."""
    art = trained(spark, folder)
    rows = models.pair_features(art.table("training_pairs"), art.table("users"), settle(art.table("items")))
    rows = models.with_repay(rows, art.repay_model(), art.calibrator()).select("member_id", "item_id", "label", "features", "repay_prob")
    data = settle(models.perceptron_features(rows, art.table("user_factors"), settle(art.table("item_factors"))))
    model = models.fit_perceptron(data)
    return model.transform(data).select("member_id", "item_id", "label", models.probability().alias("score"))


@query("catalog_ranking")
def catalog_ranking(spark, folder):
    """Ten best products of the whole catalog for every known user."""
    art = trained(spark, folder)
    return recommend.rank_catalog(art.ranking(), art.table("users").filter("known"), 10)


@query("recommendations")
def recommendations(spark, folder):
    return recommend.recommend(trained(spark, folder), requests(spark, folder))


@query("recommendation_responses")
def recommendation_responses(spark, folder):
    art = trained(spark, folder)
    asked = settle(recommend.split_requests(art, requests(spark, folder)))
    rows = recommend.responses(recommend.recommend(art, requests(spark, folder)), recommend.requester_features(art, asked))
    return rows.select("request_id", "user_id", "n_returned", F.array_join("stages", ",").alias("stages"),
                       F.to_json("recommendations").alias("recommendations"))


@query("reordered_recommendations")
def reordered_recommendations(spark, folder):
    """With replies that list the products of the requested purpose."""
    art, asked = trained(spark, folder), requests(spark, folder)
    return recommend.recommend(art, asked, purpose_replies(art, asked))


def purpose_replies(art, asked):
    """Stand-in replies that name the products of the requested purpose, the cheapest first."""
    catalog = art.table("catalog").select("purpose", F.concat(F.lit('"'), F.col("item_id"), F.lit('"')).alias("q"), "int_rate")
    lists = settle(catalog.groupBy("purpose").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("int_rate", "q"))), lambda s: s.q), ", ").alias("l")))
    return join_lookup(asked.select("request_id", F.col("purpose_request").alias("purpose")), lists, ["purpose"]).select(
        "request_id", F.concat(F.lit("["), F.col("l"), F.lit("]")).alias("reply"))


@query("whole_answers")
def whole_answers(spark, folder):
    """One row per valid request with everything it is answered."""
    art, asked = trained(spark, folder), requests(spark, folder)
    rows = recommend.answers(art, asked, purpose_replies(art, asked))
    return rows.select("request_id", "user_id", "n_returned", F.array_join("stages", ",").alias("stages"), "approved", "approval_score",
                       *[F.to_json(c).alias(c) for c in ("recommendations", "profile", "contributions", "improvements", "home")])


@query("approval_scores")
def approval_scores(spark, folder):
    return recommend.approvals(trained(spark, folder), requests(spark, folder))


@query("score_contributions")
def score_contributions(spark, folder):
    art = trained(spark, folder)
    return explain.contributions(recommend.application_rows(art, requests(spark, folder)), art.leaves(), art.user_spec())


@query("improvement_suggestions")
def improvement_suggestions(spark, folder):
    art = trained(spark, folder)
    return explain.improvements(recommend.application_rows(art, requests(spark, folder)), art.leaves(), art.calibrator(),
                                art.user_spec(), art.item_spec())


@query("home_suggestions")
def home_suggestions(spark, folder):
    art = trained(spark, folder)
    return explain.home_suggestions(recommend.application_rows(art, requests(spark, folder)), art.repay_model(),
                                    art.calibrator(), art.user_spec(), art.item_spec())


@query("advice_prompts")
def advice_prompts(spark, folder):
    art, asked = trained(spark, folder), requests(spark, folder)
    rows = settle(recommend.application_rows(art, asked))
    leaves = art.leaves()
    decided = asked.join(recommend.approvals(art, asked, calibrated=True), "request_id")
    return rerank.advice_prompts(
        decided, explain.contributions(rows, leaves, art.user_spec()),
        explain.improvements(rows, leaves, art.calibrator(), art.user_spec(), art.item_spec()))


@query("evaluate_recommendations")
def evaluate_recommendations(spark, folder):
    return evaluate.evaluate(trained(spark, folder))


@query("ablation_by_subset")
def ablation_by_subset(spark, folder):
    return metrics.subset_means(evaluate.ablation(trained(spark, folder)))


@query("ablation_lists")
def ablation_lists(spark, folder):
    lists = evaluate.top_ids_per_stage(trained(spark, folder))
    return lists.select("member_id", *[F.array_join(c, "|").alias(c) for c in lists.columns if c != "member_id"])


@query("compare_rankers")
def compare_rankers(spark, folder):
    """Every ranking model that was tried, with its validation score and the one in use."""
    return trained(spark, folder).trials().select("name", "kind", "settings", "split", "n_users", "ndcg", "chosen")


@query("item_plane_by_grade")
def item_plane_by_grade(spark, folder):
    """Collaborative factors of the products in the plane of their two main components, averaged per grade."""
    art = trained(spark, folder)
    data = art.table("item_factors").withColumn("features", array_to_vector("vector"))
    model = PCA(k=2, inputCol="features", outputCol="plane").fit(data)
    place = vector_to_array("plane")
    placed = model.transform(data).select("item_id", place[0].alias("x"), place[1].alias("y"))
    return placed.join(art.table("catalog").select("item_id", "grade"), "item_id").groupBy("grade").agg(
        F.avg("x").alias("mean_pc1"), F.avg("y").alias("mean_pc2"), F.count("*").alias("n_items"))


@query("chosen_ranker", sql=with_loans("""
SELECT 5 AS n_tried, 1 AS n_chosen, TRUE AS is_best, count(DISTINCT member_id) AS n_users FROM loans WHERE split = 'val' AND label = 1"""))
def chosen_ranker(spark, folder):
    """One ranking model is in use, and no tried one has a higher validation NDCG."""
    trials = trained(spark, folder).trials()
    return trials.agg(F.count("*").cast("int").alias("n_tried"), F.count_if("chosen").cast("int").alias("n_chosen"),
                      (F.max(F.when(F.col("chosen"), F.col("ndcg"))) == F.max("ndcg")).alias("is_best"), F.min("n_users").alias("n_users"))


@query("ranker_against_popularity")
def ranker_against_popularity(spark, folder):
    """Validation NDCG of the ranker in use and of the popular list."""
    art = trained(spark, folder)
    n, floor = choose.popularity_score(art)
    return art.trials().where("chosen").select("name", "ndcg", F.lit(floor).alias("popularity_ndcg"), F.lit(n).alias("n_users"))


@query("perceptron_recommendations")
def perceptron_recommendations(spark, folder):
    """The recommendations of a ranking model asked for by name."""
    return recommend.recommend(trained(spark, folder), requests(spark, folder), ranker="perceptron_40")


@query("recommendations_by_cells")
def recommendations_by_cells(spark, folder):
    """Recommendations whose candidates come out of the kept index."""
    return recommend.recommend(trained(spark, folder), requests(spark, folder), search="cells")
