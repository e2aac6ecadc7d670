"""Lookups past the broadcast bound, and the search that leaves seen items out."""

from pyspark.sql import functions as F

from creditloom.operators import retrieval, sizing


def test_hot_keys_are_split_and_all_rows_kept(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, 7).when(F.col("id") < 1010, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("r"))
    lookup = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).union(spark.createDataFrame([(7, 70)], "k long, v long"))
    for how in ("inner", "left"):
        got = sizing.join_lookup(rows, lookup, ["k"], how, max_rows=0)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(lookup, ["k"], how).select(got.columns).collect()))


def test_hot_means_more_bytes_than_a_task_takes(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("r"))
    lookup = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = sizing.hot_key_join(rows, lookup, ["k"], task_bytes=10_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(lookup, "k").collect()))
    salted = sizing.hot_key_join(rows, lookup, ["k"], task_bytes=10_000)._jdf.queryExecution().analyzed().toString()
    assert "_salt" in salted


def test_wide_rows_are_not_small(spark):
    wide = spark.range(100).select("id", F.array_repeat(F.lit(1.0), 1000).alias("vector"))
    assert sizing.is_small(wide) and not sizing.is_small(wide, max_bytes=1_000_000)
    assert sizing.is_small(wide.limit(0))


def test_unseen_for_who_has_seen_nearly_everything(spark):
    items = spark.range(50).select(F.col("id").alias("match_id"), F.array(F.col("id").cast("double")).alias("vector"))
    queries = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "query_id long, vector array<double>")
    seen = spark.range(1, 50).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("match_id"))
    seen = seen.union(spark.createDataFrame([(1, 99)], "query_id long, match_id long"))
    for broadcast in (retrieval.BROADCAST_VALUES, 0):
        lists = seen.groupBy("query_id").agg(F.collect_set("match_id").alias("seen"))
        got = retrieval.top_matches(queries.join(lists, "query_id", "left"), items, 3, broadcast)
        assert {(r.query_id, r.match_id, r["rank"]) for r in got.collect()} == {(1, 0, 1), (2, 49, 1), (2, 48, 2), (2, 47, 3)}
    assert retrieval.top_unseen(queries, items, seen, 3).count() == 4
