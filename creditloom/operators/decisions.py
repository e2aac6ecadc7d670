"""Requests, profiles, thresholds and approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.constants import (
    APPROVAL_THRESHOLD, DEFAULT_PURPOSE, DEFAULT_RATE, DEFAULT_TERM, MISSING_CATEGORY, RARE_CATEGORY,
    REPAY_BAND_HIGH, REPAY_BAND_MEDIUM, RERANK_POOL_DEFAULT, RERANK_POOL_RANGE, RETRIEVAL_POOL_DEFAULT,
    RETRIEVAL_POOL_RANGE, TOP_K_DEFAULT, TOP_K_RANGE, USER_CATEGORICAL, USER_NUMERIC,
)
from creditloom.operators.sizing import join_lookup

_BOUNDED = {
    "top_k": (TOP_K_RANGE, TOP_K_DEFAULT),
    "rerank_pool": (RERANK_POOL_RANGE, RERANK_POOL_DEFAULT),
    "retrieval_pool": (RETRIEVAL_POOL_RANGE, RETRIEVAL_POOL_DEFAULT),
}


def validate_requests(requests: DataFrame) -> DataFrame:
    """Fills the defaults and adds `reject_reasons` (empty when the request is fine) and `valid`."""
    out = requests.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, (_, d) in _BOUNDED.items()})
    out = out.withColumn("use_rerank", F.coalesce("use_rerank", F.lit(False)))
    reasons = [F.when(F.col("user_id").isNull(), "user_id missing")]
    reasons += [F.when(~F.col(c).between(low, high), f"{c} not in [{low},{high}]") for c, ((low, high), _) in _BOUNDED.items()]
    out = out.withColumn("reject_reasons", F.array_compact(F.array(*reasons)))
    return out.withColumn("valid", F.size("reject_reasons") == 0)


def with_user_flags(requests: DataFrame, known_users: DataFrame) -> DataFrame:
    """known / cold_start per request; `known_users` has one row per member_id."""
    marked = known_users.select(F.col("member_id").alias("user_id"), F.lit(True).alias("known"))
    return (requests.join(marked, "user_id", "left")
            .withColumn("known", F.coalesce("known", F.lit(False)))
            .withColumn("cold_start", ~F.col("known")))


def requested_product(requests: DataFrame) -> DataFrame:
    """The product a request asks for; all null when it names no amount. Its grade is unknown."""
    asked = F.col("loan_amnt_request").isNotNull()
    return requests.select(
        "request_id",
        F.when(asked, F.coalesce("int_rate_request", F.lit(DEFAULT_RATE))).alias("int_rate"),
        F.col("loan_amnt_request").alias("loan_amnt"),
        F.when(asked, F.lit(MISSING_CATEGORY)).alias("grade"),
        F.when(asked, F.coalesce("purpose_request", F.lit(DEFAULT_PURPOSE))).alias("purpose"),
        F.when(asked, F.coalesce("term_request", F.lit(DEFAULT_TERM))).alias("term"))


def requester_profile(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Stored profile if there is one, else what the request states, else nothing.

    `profile_source` says which: stored, request or none (no numeric value stated).
    """
    columns = [*USER_NUMERIC, *USER_CATEGORICAL]
    stored = profiles.select(F.col("member_id").alias("user_id"), F.struct(*columns).alias("_stored"))
    joined = requests.join(stored, "user_id", "left")
    has_stored = F.col("_stored").isNotNull()
    stated = F.coalesce(*[F.col(c) for c in USER_NUMERIC]).isNotNull()
    source = F.when(has_stored, "stored").when(stated, "request").otherwise("none")
    fallback = {"home_ownership": MISSING_CATEGORY, "addr_state": RARE_CATEGORY}

    def value(c: str) -> Column:
        own = F.coalesce(F.col(c), F.lit(fallback[c])) if c in fallback else F.col(c)
        return F.when(has_stored, F.col(f"_stored.{c}")).when(stated, own).alias(c)

    return joined.select("request_id", "user_id", source.alias("profile_source"), *[value(c) for c in columns])


def keep_passing(candidates: DataFrame, score: Column, by: str = "request_id",
                 threshold: float = APPROVAL_THRESHOLD) -> DataFrame:
    """Candidates at or above the threshold; a request where none is keeps all of its candidates."""
    marked = candidates.withColumn("_pass", F.coalesce(score >= threshold, F.lit(False)))
    any_pass = F.max("_pass").over(Window.partitionBy(by))
    return marked.withColumn("_any", any_pass).filter(F.col("_pass") | ~F.col("_any")).drop("_pass", "_any")


def keep_by_catalog_rate(candidates: DataFrame, catalog: DataFrame, threshold: float = APPROVAL_THRESHOLD) -> DataFrame:
    """The same with the product's past repayment rate; a product without one counts as 0."""
    rated = join_lookup(candidates, catalog.select("item_id", "positive_rate"), ["item_id"], "left")
    return keep_passing(rated.fillna(0.0, ["positive_rate"]), F.col("positive_rate"), threshold=threshold)


def repay_band(probability: Column) -> Column:
    """high / medium / low on whole percent, cut down."""
    whole = F.floor(probability * 100)
    return F.when(whole >= REPAY_BAND_HIGH, "high").when(whole >= REPAY_BAND_MEDIUM, "medium").otherwise("low")


def approved(score: Column, threshold: float = APPROVAL_THRESHOLD) -> Column:
    """A missing score counts as 0."""
    return F.coalesce(score, F.lit(0.0)) >= threshold


def best_home(scored: DataFrame) -> DataFrame:
    """Per request the home category with the highest score, where it beats the current one.

    `scored` has request_id, home_ownership, score and `current` (whether the row
    is the request's own category).
    """
    best = scored.groupBy("request_id").agg(
        F.max(F.struct("score", (F.col("current")).cast("int").alias("stay"), "home_ownership")).alias("b"),
        F.max(F.when(F.col("current"), F.struct("score", "home_ownership"))).alias("c"))
    return best.filter(F.col("c").isNull() | (F.col("b.score") > F.col("c.score"))).select(
        "request_id", F.col("c.home_ownership").alias("current_value"), F.col("b.home_ownership").alias("recommended"),
        F.round("b.score", 4).alias("score_with_recommended"))
