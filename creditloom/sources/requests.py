"""Recommendation requests and the application log.

The test tables hold neither, so both are views: one request per customer, with
the first thing the customer wrote as free text, and one application per event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.sources.tables import table

REQUEST_COLUMNS = [
    "request_id", "user_id", "top_k", "use_rerank", "rerank_pool", "retrieval_pool", "user_prompt",
    "annual_inc", "dti", "fico_range_low", "fico_range_high", "home_ownership", "addr_state",
    "loan_amnt_request", "int_rate_request", "purpose_request", "term_request",
]

_HOMES = {"BUILDING": "OWN", "HOUSEHOLD": "MORTGAGE", "AUTOMOBILE": "RENT", "FURNITURE": "OTHER"}
_PURPOSES = ("large", "economy", "standard", "small", "medium", "promo", "other", None)
_TERMS = ("36 months", "60 months", None)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    spoken = (table(spark, folder, "conversations").filter("role = 'user'").groupBy("conv_id")
              .agg(F.min_by("text", "turn").alias("user_prompt")))
    people = (table(spark, folder, "customer")
              .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
              .join(spoken, key == F.col("conv_id"), "left"))
    given = F.col("c_mktsegment") != "MACHINERY"
    home = F.coalesce(*[F.when(F.col("c_mktsegment") == s, h) for s, h in _HOMES.items()])
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    return people.select(
        key.cast("string").alias("request_id"), key.cast("string").alias("user_id"),
        F.when(key % 10 == 0, None).when(key % 10 == 1, 0).when(key % 10 == 2, 200).otherwise(1 + key % 12).cast("int").alias("top_k"),
        F.when(F.col("c_nationkey") != 3, F.col("c_nationkey") % 2 == 0).alias("use_rerank"),
        F.when(key % 6 != 0, 5 + key % 20).cast("int").alias("rerank_pool"),
        F.when(key % 8 == 0, None).when(key % 8 == 1, 5).otherwise(10 + key % 40).cast("int").alias("retrieval_pool"),
        "user_prompt",
        F.when(given, F.lit(20000.0) + F.col("c_acctbal") * 10).alias("annual_inc"),
        F.when(given, (key % 400) / F.lit(10.0)).alias("dti"),
        F.when(given, (600 + 5 * (key % 50)).cast("double")).alias("fico_range_low"),
        F.when(given, (604 + 5 * (key % 50)).cast("double")).alias("fico_range_high"),
        home.alias("home_ownership"), F.when(key % 9 != 0, F.col("n_name")).alias("addr_state"),
        F.when(F.col("c_acctbal") >= 0, F.lit(5000.0) + F.col("c_acctbal") * 3).alias("loan_amnt_request"),
        F.when(key % 5 != 0, F.lit(6.0) + (key % 38) / F.lit(2.0)).alias("int_rate_request"),
        pick(_PURPOSES, key % 8).alias("purpose_request"), pick(_TERMS, key % 3).alias("term_request"))


APPLICATION_SCHEMA = T.StructType([
    T.StructField("application_id", T.StringType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("loan_amount", T.DoubleType()),
    T.StructField("expected_interest_rate", T.DoubleType()),
    T.StructField("purpose", T.StringType()),
    T.StructField("term", T.StringType()),
    T.StructField("estimated_repay_score", T.DoubleType()),
    T.StructField("submitted_at", T.TimestampType()),
])


def as_applications(events: DataFrame) -> DataFrame:
    """Application rows out of event rows, batch or stream alike; name and term are not known."""
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("event_id").cast("string").alias("application_id"), F.lit(None).cast("string").alias("full_name"),
        F.col("value").alias("loan_amount"), k.alias("expected_interest_rate"), F.col("event_type").alias("purpose"),
        F.lit(None).cast("string").alias("term"), (k / F.lit(100.0)).alias("estimated_repay_score"),
        F.col("ts").cast("timestamp").alias("submitted_at"))


def applications(spark: SparkSession, folder: str) -> DataFrame:
    return as_applications(table(spark, folder, "events"))
