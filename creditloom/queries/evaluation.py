"""Ranking metrics and their summaries, over rankings derived from the loan table.

Three stages are ranked for every user with a repaid test loan: the most popular
products, the user's own train products by count, and the same by recency.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.constants import SIGNIFICANCE_LEVEL
from creditloom.operators import metrics, preparation as prep
from creditloom.operators.sizing import join_lookup
from creditloom.queries.common import with_loans
from creditloom.queries.preparation import POSITIVES, USER_TYPES
from creditloom.queries.registry import query
from creditloom.session import scratch_path, settle
from creditloom.sources.files import write_csv, write_json
from creditloom.sources.loans import loans

STAGES = ["popular", "recent", "repeated"]
DEPTH = 10

_SQL = ["""
users AS (SELECT member_id, CASE WHEN warm THEN 'Warm Start' ELSE 'Cold Start' END AS user_type FROM user_types WHERE tested),
truth AS (SELECT DISTINCT member_id, item_id FROM loans WHERE label = 1 AND split = 'test'),
history AS (SELECT member_id, item_id, count(*) AS r, max(issue_d) AS last_d FROM loans WHERE label = 1 AND split = 'train' GROUP BY ALL),
rankings AS (
  SELECT member_id, 'popular' AS stage, item_id, rank FROM users CROSS JOIN (
    SELECT item_id, row_number() OVER (ORDER BY sum(r) DESC, item_id) AS rank FROM history GROUP BY item_id QUALIFY rank <= 10)
  UNION ALL SELECT member_id, 'repeated', item_id, row_number() OVER (PARTITION BY member_id ORDER BY r DESC, item_id) AS rank
    FROM history JOIN users USING (member_id) QUALIFY rank <= 10
  UNION ALL SELECT member_id, 'recent', item_id, row_number() OVER (PARTITION BY member_id ORDER BY last_d DESC, item_id) AS rank
    FROM history JOIN users USING (member_id) QUALIFY rank <= 10),
stages AS (SELECT unnest(['popular', 'recent', 'repeated']) AS stage),
hits AS (SELECT r.member_id, stage, rank FROM rankings r JOIN truth t ON r.member_id = t.member_id AND r.item_id = t.item_id),
relevant AS (SELECT member_id, count(*) AS n FROM truth GROUP BY member_id),
gains AS (SELECT k, sum(1 / log2(p + 1.0::DOUBLE)) AS ideal FROM range(1, 6) a(k) JOIN range(1, 6) b(p) ON p <= k GROUP BY k),
per_user AS (
  SELECT u.member_id, u.user_type, s.stage,
    count(h.rank) FILTER (h.rank <= 5)::DOUBLE / least(any_value(n), 5) AS recall,
    count(h.rank) FILTER (h.rank <= 5)::DOUBLE / any_value(n) AS recall_full,
    count(h.rank) FILTER (h.rank <= 5)::DOUBLE / 5 AS precision,
    coalesce(sum(1 / log2(h.rank + 1.0::DOUBLE)) FILTER (h.rank <= 5), 0.0) / any_value(ideal) AS ndcg,
    CASE WHEN count(h.rank) FILTER (h.rank <= 5) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate,
    coalesce(1.0::DOUBLE / min(h.rank), 0.0) AS mrr
  FROM users u CROSS JOIN stages s JOIN relevant USING (member_id) JOIN gains ON k = least(n, 5)
    LEFT JOIN hits h ON h.member_id = u.member_id AND h.stage = s.stage
  GROUP BY u.member_id, u.user_type, s.stage)"""]


def _sql(body: str) -> str:
    return with_loans(body, POSITIVES, USER_TYPES, *_SQL)


def _rounded(columns) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def round_columns(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def evaluation_tables(spark, folder):
    """Users with a type, truth pairs and the three rankings."""
    positives = settle(loans(spark, folder, "member_id", "item_id", "label", "split", "issue_d")
                       .filter("label = 1 AND split <> 'val'")
                       .groupBy("member_id", "item_id", "split")
                       .agg(F.count("*").alias("r"), F.max("issue_d").alias("last_d")))
    history = positives.filter("split = 'train'")
    truth = positives.filter("split = 'test'").select("member_id", "item_id")
    users = settle(positives.groupBy("member_id").agg(
        F.max(F.when(F.col("split") == "train", "Warm Start").otherwise("Cold Start")).alias("user_type"),
        F.bool_or(F.col("split") == "test").alias("tested")).filter("tested").drop("tested"))
    popular = history.groupBy("item_id").agg(F.sum("r").alias("n")).orderBy(F.desc("n"), "item_id").limit(DEPTH)
    # The popular list is ten products: one array value, repeated for each user.
    listed = popular.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "item_id"))).alias("l")).select(
        F.transform("l", lambda x: x.item_id).alias("l")).scalar()
    everyone = users.select("member_id", F.posexplode(listed).alias("pos", "item_id")).select(
        "member_id", "item_id", (F.col("pos") + 1).alias("rank"), F.lit("popular").alias("stage"))
    own = history.join(users.select("member_id"), "member_id")
    stages = [everyone,
              metrics.keep_top(own, "member_id", "last_d", "item_id", DEPTH).withColumn("stage", F.lit("recent")),
              metrics.keep_top(own, "member_id", "r", "item_id", DEPTH).withColumn("stage", F.lit("repeated"))]
    rankings = reduce(DataFrame.unionByName, [s.select("member_id", "stage", "item_id", "rank") for s in stages])
    return users, truth, rankings


def per_user_metrics(spark, folder):
    users, truth, rankings = evaluation_tables(spark, folder)
    return metrics.user_metrics(rankings, truth, users, STAGES, 5)


@query("top_items_per_user", sql=_sql("SELECT member_id, stage, item_id, rank::INTEGER AS rank FROM rankings"))
def top_items_per_user(spark, folder):
    return evaluation_tables(spark, folder)[2]


@query("ground_truth_hits", sql=_sql("SELECT member_id, stage, rank::INTEGER AS rank FROM hits"))
def ground_truth_hits(spark, folder):
    _, truth, rankings = evaluation_tables(spark, folder)
    return metrics.mark_hits(rankings, truth).filter("hit = 1").select("member_id", "stage", "rank")


def _metric(name: str, column: str) -> None:
    @query(name, sql=_sql(f"SELECT member_id, stage, round({column}, 6) AS {column} FROM per_user"))
    def run(spark, folder):
        return round_columns(per_user_metrics(spark, folder).select("member_id", "stage", column), column)


for _name, _column in {"recall_at_k": "recall", "recall_at_k_full_divisor": "recall_full", "precision_at_k": "precision",
                       "ndcg_at_k": "ndcg", "hit_rate_at_k": "hit_rate", "mean_reciprocal_rank": "mrr"}.items():
    _metric(_name, _column)


@query("metric_means", sql=_sql(f"""SELECT stage, count(*) AS n_users, {", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics.METRICS)}
FROM per_user GROUP BY stage"""))
def metric_means(spark, folder):
    return round_columns(metrics.macro_means(per_user_metrics(spark, folder), "stage"), *metrics.METRICS)


@query("metrics_by_subset", sql=_sql(f"""SELECT CASE WHEN grouping(user_type) = 1 THEN 'All' ELSE user_type END AS subset, stage,
  count(*) AS n_users, {", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics.METRICS)}
FROM per_user GROUP BY GROUPING SETS ((user_type, stage), (stage))"""))
def metrics_by_subset(spark, folder):
    means = round_columns(metrics.subset_means(per_user_metrics(spark, folder)), *metrics.METRICS)
    path = scratch_path(spark, "metrics")
    write_json(means, path)
    return spark.read.schema(means.schema).json(path)


@query("ablation_table", sql=_sql(f"""SELECT CASE WHEN grouping(user_type) = 1 THEN 'All' ELSE user_type END AS subset,
  {", ".join(f"round(avg({c}) FILTER (stage = '{s}'), 6) AS {s}_{m}" for s in STAGES for m, c in (("ndcg", "ndcg"), ("recall", "recall_full")))}
FROM per_user GROUP BY GROUPING SETS ((user_type), ())"""))
def ablation_table(spark, folder):
    table = metrics.ablation_table(metrics.subset_means(per_user_metrics(spark, folder)), STAGES)
    table = round_columns(table, *[c for c in table.columns if c != "subset"])
    path = scratch_path(spark, "ablation")
    write_csv(table, path)
    return spark.read.schema(table.schema).csv(path, header=True)


_UPLIFT = ["ndcg", "recall", "ndcg_change", "recall_change"]


@query("stage_uplift", sql=_sql("""
SELECT p.stage, count(*) AS n_users, round(avg(p.ndcg), 6) AS ndcg, round(avg(p.recall_full), 6) AS recall,
  round(avg(p.ndcg - b.ndcg), 6) + 0.0 AS ndcg_change, round(avg(p.recall_full - b.recall_full), 6) + 0.0 AS recall_change,
  count(*) FILTER (p.ndcg > b.ndcg) AS ndcg_wins, count(*) FILTER (p.recall_full > b.recall_full) AS recall_wins
FROM per_user p JOIN per_user b ON b.member_id = p.member_id AND b.stage = 'popular' GROUP BY p.stage"""))
def stage_uplift(spark, folder):
    return round_columns(metrics.uplift(settle(per_user_metrics(spark, folder)), "popular"), *_UPLIFT)


@query("best_stage", sql=_sql("""
SELECT stage, round(avg(ndcg) + avg(recall_full), 6) AS combined FROM per_user GROUP BY stage
ORDER BY round(avg(ndcg) + avg(recall_full), 9) DESC, stage LIMIT 1"""))
def best_stage(spark, folder):
    return round_columns(metrics.best_stage(per_user_metrics(spark, folder)), "combined")


@query("standard_errors", sql=_sql("""
SELECT stage, count(*) AS n_users, round(stddev_samp(ndcg) / sqrt(count(*)), 6) AS ndcg_sem,
  round(stddev_samp(recall_full) / sqrt(count(*)), 6) AS recall_full_sem FROM per_user GROUP BY stage"""))
def standard_errors(spark, folder):
    return round_columns(metrics.standard_errors(per_user_metrics(spark, folder)), "ndcg_sem", "recall_full_sem")


@query("paired_t_statistic", sql=_sql("""
SELECT metric, count(*) AS n_users, round(avg(change), 6) AS lift, count(*) - 1 AS df,
  round(CASE WHEN count(*) >= 5 THEN avg(change) / (stddev_samp(change) / sqrt(count(*))) END, 4) AS t, count(*) < 30 AS low_power
FROM (SELECT 'ndcg' AS metric, a.ndcg - b.ndcg AS change FROM per_user a JOIN per_user b USING (member_id)
      WHERE a.stage = 'repeated' AND b.stage = 'popular' AND a.user_type = 'Warm Start'
      UNION ALL SELECT 'recall_full', a.recall_full - b.recall_full FROM per_user a JOIN per_user b USING (member_id)
      WHERE a.stage = 'repeated' AND b.stage = 'popular' AND a.user_type = 'Warm Start')
GROUP BY metric"""))
def paired_t_statistic(spark, folder):
    warm = per_user_metrics(spark, folder).filter("user_type = 'Warm Start'")
    return round_columns(round_columns(metrics.paired_t(warm, "repeated", "popular"), "lift"), "t", digits=4)


@query("paired_t_test", sql=_sql("""
SELECT metric, n_users, round(lift, 6) AS lift, df, round(t, 4) AS t, low_power, round(greatest(p, 0.0), 6) AS p, p < 0.05 AS significant
FROM (SELECT metric, n_users, lift, df, t, low_power, 1 - 2 * middle AS p FROM (
  SELECT metric, any_value(n_users) AS n_users, any_value(lift) AS lift, any_value(df) AS df, any_value(t) AS t, any_value(low_power) AS low_power,
    sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0) - 0.5 * ln(df * pi()) - (df + 1) / 2.0 * ln(1 + (abs(t) * i / 20000.0) ** 2 / df)))
      * abs(any_value(t)) / 60000.0 AS middle
  FROM (SELECT metric, count(*) AS n_users, avg(change) AS lift, count(*) - 1 AS df,
      CASE WHEN count(*) >= 5 THEN avg(change) / (stddev_samp(change) / sqrt(count(*))) END AS t, count(*) < 30 AS low_power
    FROM (SELECT 'ndcg' AS metric, a.ndcg - b.ndcg AS change FROM per_user a JOIN per_user b USING (member_id)
          WHERE a.stage = 'repeated' AND b.stage = 'popular' AND a.user_type = 'Warm Start'
          UNION ALL SELECT 'recall_full', a.recall_full - b.recall_full FROM per_user a JOIN per_user b USING (member_id)
          WHERE a.stage = 'repeated' AND b.stage = 'popular' AND a.user_type = 'Warm Start')
    GROUP BY metric), range(20001) r(i) GROUP BY metric))"""))
def paired_t_test(spark, folder):
    warm = per_user_metrics(spark, folder).filter("user_type = 'Warm Start'")
    tests = metrics.with_p_value(metrics.paired_t(warm, "repeated", "popular")).withColumn("significant", F.col("p") < F.lit(SIGNIFICANCE_LEVEL))
    return round_columns(round_columns(tests, "lift", "p"), "t", digits=4)


_SCORED = """
rates AS (SELECT item_id, avg(label) AS rate FROM loans WHERE split = 'train' GROUP BY item_id),
scored AS (SELECT coalesce(rate, 0.0) AS score, label, item_id FROM loans LEFT JOIN rates USING (item_id) WHERE split = 'val')"""


def catalog_scored(spark, folder):
    """Validation loans scored by the train repayment rate of their product."""
    rows = settle(loans(spark, folder, "item_id", "label", "split").filter("split <> 'test'")
                  .groupBy("split", "item_id", "label").agg(F.count("*").alias("n")))
    rates = rows.filter("split = 'train'").groupBy("item_id").agg(
        (F.sum(F.col("label") * F.col("n")) / F.sum("n").cast("double")).alias("score"))
    return rows.filter("split = 'val'").join(rates, "item_id", "left").fillna(0.0, ["score"])


@query("roc_auc", sql=with_loans("""
SELECT count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative,
  round((sum(CASE WHEN label = 1 THEN r END) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
    / (count(*) FILTER (label = 1) * (count(*) FILTER (label = 0))::DOUBLE), 6) AS auc
FROM (SELECT label, avg(rn) OVER (PARTITION BY score) AS r FROM (SELECT label, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9)) AS rn FROM scored))""", _SCORED))
def roc_auc(spark, folder):
    rows = loans(spark, folder, "item_id", "label", "split")
    rates = settle(rows.filter("split = 'train'").groupBy("item_id").agg(F.round(F.avg("label"), 9).alias("score")))
    scored = join_lookup(rows.filter("split = 'val'"), rates, ["item_id"], "left").fillna(0.0, ["score"])
    return round_columns(metrics.roc_auc(scored), "auc")


@query("brier_score", sql=with_loans("""
SELECT count(*) AS n_loans, round(avg((score - label) * (score - label)), 6) AS brier,
  round(avg((0.75::DOUBLE - label) * (0.75::DOUBLE - label)), 6) AS brier_constant FROM scored""", _SCORED))
def brier_score(spark, folder):
    rows = catalog_scored(spark, folder)
    # Rows are already counted per (product, label); weight by the count.
    square = lambda p: (p - F.col("label")) * (p - F.col("label"))
    mean = lambda p: F.sum(square(p) * F.col("n")) / F.sum("n").cast("double")
    return rows.agg(F.sum("n").alias("n_loans"), F.round(mean(F.col("score")), 6).alias("brier"),
                    F.round(mean(F.lit(0.75)), 6).alias("brier_constant"))
