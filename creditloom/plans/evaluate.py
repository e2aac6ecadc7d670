"""Scoring the trained stages on test users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.constants import SEED
from creditloom.operators import metrics, rerank
from creditloom.operators.sampling import smallest_by_hash
from creditloom.plans.artefacts import Artefacts
from creditloom.plans.recommend import popular_list, rank_pool, retrieve
from creditloom.session import settle

RETRIEVAL, RANKING, REPLIES = "retrieval", "ranking", "replies"


def test_users(art: Artefacts, n_users: int | None = None, warm_first: bool = False) -> DataFrame:
    """Users with a repaid test loan, typed by whether they have a repaid train loan."""
    users = art.table("positives").groupBy("member_id").agg(
        F.bool_or(F.col("split") == "train").alias("warm"), F.bool_or(F.col("split") == "test").alias("tested"))
    users = users.filter("tested").select("member_id", "warm", F.when(F.col("warm"), "Warm Start").otherwise("Cold Start").alias("user_type"))
    if n_users is not None:
        users = smallest_by_hash(users, "member_id", n_users, SEED, first=F.desc("warm") if warm_first else None)
    return settle(users.drop("warm"))


def truth_of(art: Artefacts, split: str = "test") -> DataFrame:
    return art.table("positives").filter(F.col("split") == split).select("member_id", "item_id")


def stage_rankings(art: Artefacts, users: DataFrame, pool: int, depth: int, replies: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Rankings after retrieval, after ranking and, with replies (request_id = member_id), after reordering.

    Users without factors get the popular products, as a request of theirs would,
    and keep that order when the others are ranked.
    """
    found = settle(retrieve(art, users.select("member_id", F.lit(pool).alias("keep"))))
    cold = users.select("member_id").join(art.table("user_factors").select("member_id"), "member_id", "left_anti")
    popular = settle(cold.select("member_id", F.posexplode(F.slice(popular_list(art), 1, depth)).alias("p", "item_id")).select(
        "member_id", "item_id", (F.col("p") + 1).alias("rank")))
    first = found.filter(F.col("retrieval_rank") <= depth).select(
        "member_id", "item_id", F.col("retrieval_rank").alias("rank")).unionByName(popular)
    second = settle(rank_pool(art.ranking(), found, depth).select("member_id", "item_id", "rank").unionByName(popular))
    stages = [first.withColumn("stage", F.lit(RETRIEVAL)), second.withColumn("stage", F.lit(RANKING))]
    if replies is not None:
        third = rerank.apply_replies(second.withColumnRenamed("member_id", "request_id"), replies)
        stages.append(third.withColumnRenamed("request_id", "member_id").withColumn("stage", F.lit(REPLIES)))
    names = [RETRIEVAL, RANKING, REPLIES][:len(stages)]
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out, names


def evaluate(art: Artefacts, k: int = 10, n_users: int | None = None, pool: int = 100) -> DataFrame:
    """Mean metrics of the full chain over all test users, or a sample of `n_users`."""
    users = test_users(art, n_users)
    rankings, _ = stage_rankings(art, users, pool, k)
    per_user = metrics.user_metrics(rankings.filter(F.col("stage") == RANKING), truth_of(art), users, [RANKING], k)
    return metrics.macro_means(per_user, "stage")


def history_replies(art: Artefacts, ranked: DataFrame) -> DataFrame:
    """Stand-in replies that put the products a borrower took before first, as the behaviour rules ask."""
    before = art.table("positives").filter("split = 'train'").select("member_id", "item_id", "r")
    quoted = F.concat(F.lit('"'), F.col("item_id"), F.lit('"'))
    named = ranked.join(before, ["member_id", "item_id"]).groupBy("member_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("k"), "rank", quoted.alias("q")))), lambda s: s.q), ", ").alias("l"))
    return named.select(F.col("member_id").alias("request_id"), F.concat(F.lit("["), F.col("l"), F.lit("]")).alias("reply"))


def ablation(art: Artefacts, k: int = 5, n_users: int | None = None, pool: int = 50, depth: int = 10) -> DataFrame:
    """Per-user metrics of every stage over all test users; in a sample of `n_users`, warm ones come first."""
    users = test_users(art, n_users, warm_first=True)
    found = settle(retrieve(art, users.select("member_id", F.lit(pool).alias("keep"))))
    replies = history_replies(art, settle(rank_pool(art.ranking(), found, depth)))
    rankings, names = stage_rankings(art, users, pool, depth, replies)
    return metrics.user_metrics(rankings, truth_of(art), users, names, k)


def top_ids_per_stage(art: Artefacts, n_users: int | None = None, pool: int = 50, depth: int = 5) -> DataFrame:
    """One row per user with the first products of each stage as arrays, reordering by past products included."""
    users = test_users(art, n_users, warm_first=True)
    found = settle(retrieve(art, users.select("member_id", F.lit(pool).alias("keep"))))
    replies = history_replies(art, settle(rank_pool(art.ranking(), found, depth)))
    rankings, names = stage_rankings(art, users, pool, depth, replies)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda s: s.item_id)
    return rankings.groupBy("member_id").pivot("stage", names).agg(listed)
