"""Ranking metrics per user, and their summaries.

Rankings are rows (member_id, stage, item_id, rank); truth is the distinct
(member_id, item_id) pairs. A user's hits are found with one join on the pair,
so a user or product with very many rows is spread over tasks by the other half
of the key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.constants import LOW_POWER_USERS, MIN_PAIRED_USERS
from creditloom.operators.ordering import running_totals

METRICS = ("recall", "recall_full", "precision", "ndcg", "hit_rate", "mrr")


def discount(rank: Column) -> Column:
    """1/log2(rank+1) for 1-based ranks."""
    return F.lit(1.0) / F.log2(rank.cast("double") + F.lit(1.0))


def _ideal_gain(n: Column, k: int) -> Column:
    """Gain of a list whose first min(n, k) places are all hits."""
    totals, running = [0.0], 0.0
    for place in range(1, k + 1):
        running += 1.0 / math.log2(place + 1)
        totals.append(running)
    return F.element_at(F.array(*[F.lit(t) for t in totals]), (F.least(n, F.lit(k)) + 1).cast("int"))


def mark_hits(rankings: DataFrame, truth: DataFrame) -> DataFrame:
    return rankings.join(truth.select("member_id", "item_id", F.lit(1).alias("hit")),
                         ["member_id", "item_id"], "left").fillna(0, subset=["hit"])


def user_metrics(rankings: DataFrame, truth: DataFrame, users: DataFrame, stages: list[str], k: int) -> DataFrame:
    """All metrics for every user of `users` and every stage; no list and no truth both give 0.

    Recall comes with both divisors: min(relevant, k) as `recall` and relevant
    as `recall_full`. MRR looks at the whole list, the others at the first k.
    """
    in_top = (F.col("hit") == 1) & (F.col("rank") <= k)
    hits = mark_hits(rankings, truth).groupBy("member_id", "stage").agg(
        F.count_if(in_top).alias("hits"), F.sum(F.when(in_top, discount(F.col("rank")))).alias("gain"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"))
    relevant = truth.groupBy("member_id").agg(F.count("*").alias("relevant"))
    base = users.join(relevant, "member_id", "left").select(
        *users.columns, F.coalesce("relevant", F.lit(0)).alias("relevant"),
        F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"))
    n, found = F.col("relevant"), F.coalesce(F.col("hits"), F.lit(0))

    def share(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top.cast("double") / bottom).otherwise(0.0)

    return base.join(hits, ["member_id", "stage"], "left").select(
        *users.columns, "stage",
        share(found, F.least(n, F.lit(k))).alias("recall"),
        share(found, n).alias("recall_full"),
        (found.cast("double") / k if k > 0 else F.lit(0.0)).alias("precision"),
        share(F.coalesce(F.col("gain"), F.lit(0.0)), _ideal_gain(n, k)).alias("ndcg"),
        F.when(found > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0)).alias("mrr"))


def macro_means(per_user: DataFrame, *by: str) -> DataFrame:
    return per_user.groupBy(*by).agg(F.count("*").alias("n_users"), *[F.avg(m).alias(m) for m in METRICS])


def subset_means(per_user: DataFrame) -> DataFrame:
    """Means per stage over all users and per user type, in one pass."""
    subset = F.when(F.grouping("user_type") == 1, "All").otherwise(F.col("user_type")).alias("subset")
    sets = [[F.col("user_type"), F.col("stage")], [F.col("stage")]]
    return (per_user.groupingSets(sets, "user_type", "stage")
            .agg(subset, F.count("*").alias("n_users"), *[F.avg(m).alias(m) for m in METRICS])
            .drop("user_type"))


def ablation_table(subsets: DataFrame, stages: list[str]) -> DataFrame:
    """One row per subset, one NDCG and one Recall column per stage."""
    return (subsets.groupBy("subset").pivot("stage", stages)
            .agg(F.first("ndcg").alias("ndcg"), F.first("recall_full").alias("recall")))


def uplift(per_user: DataFrame, baseline: str) -> DataFrame:
    """Mean NDCG and Recall per stage, change against the baseline and users who gained."""
    base = per_user.filter(F.col("stage") == baseline).select(
        "member_id", F.col("ndcg").alias("base_ndcg"), F.col("recall_full").alias("base_recall"))
    return per_user.join(base, "member_id").groupBy("stage").agg(
        F.count("*").alias("n_users"), F.avg("ndcg").alias("ndcg"), F.avg("recall_full").alias("recall"),
        F.avg(F.col("ndcg") - F.col("base_ndcg")).alias("ndcg_change"),
        F.avg(F.col("recall_full") - F.col("base_recall")).alias("recall_change"),
        F.count_if(F.col("ndcg") > F.col("base_ndcg")).alias("ndcg_wins"),
        F.count_if(F.col("recall_full") > F.col("base_recall")).alias("recall_wins"))


def best_stage(per_user: DataFrame) -> DataFrame:
    """The stage with the highest mean NDCG plus mean Recall; the first by name among equals."""
    return (per_user.groupBy("stage").agg((F.avg("ndcg") + F.avg("recall_full")).alias("combined"))
            .orderBy(F.round("combined", 9).desc(), "stage").limit(1))


def standard_errors(per_user: DataFrame) -> DataFrame:
    def error(m: str) -> Column:
        return (F.stddev_samp(m) / F.sqrt(F.count(m).cast("double"))).alias(f"{m}_sem")

    return per_user.groupBy("stage").agg(F.count("*").alias("n_users"), error("ndcg"), error("recall_full"))


def paired_t(per_user: DataFrame, stage: str, baseline: str, metrics: tuple[str, ...] = ("ndcg", "recall_full")) -> DataFrame:
    """Paired t statistic, lift and degrees of freedom per metric; null below five users."""
    long = per_user.filter(F.col("stage").isin(stage, baseline)).select(
        "member_id", "stage", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                                  for m in metrics])).alias("m")).select("member_id", "stage", "m.*")
    pairs = long.groupBy("member_id", "metric").agg(
        (F.max(F.when(F.col("stage") == stage, F.col("value")))
         - F.max(F.when(F.col("stage") == baseline, F.col("value")))).alias("change"))
    n, spread = F.col("n_users"), F.col("spread")
    enough = (n >= MIN_PAIRED_USERS) & (spread > 0)
    return (pairs.groupBy("metric").agg(F.count("change").alias("n_users"), F.avg("change").alias("lift"),
                                        F.stddev_samp("change").alias("spread"))
            .select("metric", "n_users", "lift", (n - 1).alias("df"),
                    F.when(enough, F.col("lift") / (spread / F.sqrt(n.cast("double")))).alias("t"),
                    (n < LOW_POWER_USERS).alias("low_power")))


def _gamma_ratio(a: float) -> float:
    """log of gamma(a + 1/2) / gamma(a); for large `a` by its series, as the two logarithms cancel."""
    if a < 100:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)


def _beta_fraction(a: float, b: float, x: float, depth: int = 2000) -> float:
    """The continued fraction of the incomplete beta function, worked out from its far end."""
    out = 1.0
    for m in range(depth, 0, -1):
        out = 1.0 + m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) / out
        out = 1.0 - (a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1)) / out
    return 1.0 / out


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta at df / (df + t * t).

    The factor before the fraction is put together from logarithms that stay
    accurate for any number of degrees of freedom.
    """
    if t == 0:
        return 1.0
    a, b = df / 2.0, 0.5
    x, rest = df / (df + t * t), t * t / (df + t * t)
    front = math.exp(_gamma_ratio(a) - 0.5 * math.log(math.pi) - a * math.log1p(t * t / df) + b * math.log(rest))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, rest) / b


def with_p_value(tests: DataFrame) -> DataFrame:
    """Adds p to the one aggregated row per metric."""
    p_value = F.udf(lambda t, df: None if t is None else t_tail(float(t), float(df)), "double")
    return tests.withColumn("p", p_value("t", "df"))


def brier(scored: DataFrame, score: str, label: str = "label") -> Column:
    return F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label)))


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs in the right order, ties half.

    Rows are first counted per distinct score, so a score shared by many rows is
    one row; negatives below each score come from range-partitioned running totals.
    """
    counted = scored.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    placed = running_totals(counted, score, ["neg"])
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    return placed.agg(F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"),
                      (won / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def keep_top(scored: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per group with 1-based ranks; Spark prunes to k before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
