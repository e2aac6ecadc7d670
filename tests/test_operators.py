"""Properties of single operators, most of them against brute force on small rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creditloom.functions.text import merge_order, reply_items
from creditloom.operators import decisions, ordering, preparation as prep, quantiles, reports, rerank, retrieval, sampling, sizing


def test_dense_index_is_sorted_and_gapless(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 1301).cast("string").alias("k")).repartition(16)
    got = {r.k: r.i for r in ordering.dense_index(rows, "k", "i").collect()}
    assert got == {k: i for i, k in enumerate(sorted({str(n * 7919 % 1301) for n in range(5000)}))}


def test_running_totals(spark):
    rng = np.random.default_rng(0)
    values = [(int(k), int(v)) for k, v in zip(rng.permutation(3000), rng.integers(0, 9, 3000))]
    got = {r.k: r.v_before for r in ordering.running_totals(
        spark.createDataFrame(values, "k int, v int").repartition(9), "k", ["v"]).collect()}
    before = 0
    for k, v in sorted(values):
        assert got[k] == before
        before += v


@pytest.mark.parametrize("limit", [100_000, 50])
def test_exact_quantiles(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "MAX_DISTINCT", limit)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25)])
    frame = spark.createDataFrame([(float(v), None if i % 7 == 0 else float(i % 13)) for i, v in enumerate(x)], "x double, y double")
    got = quantiles.exact_quantiles(frame, {"a": ("x", 0.5), "b": ("x", 0.99), "c": ("y", 0.5), "d": ("x", 0.0), "e": ("x", 1.0)}).first()
    y = np.array([i % 13 for i in range(len(x)) if i % 7], float)
    assert [got.a, got.b, got.c, got.d, got.e] == pytest.approx(
        [np.quantile(x, 0.5), np.quantile(x, 0.99), np.median(y), x.min(), x.max()], abs=1e-12)


def test_quantiles_of_nothing(spark):
    frame = spark.createDataFrame([(None,)], "x double")
    assert quantiles.exact_quantiles(frame, {"m": ("x", 0.5)}).first().m is None


def test_sample_sizes_with_a_dominant_group(spark):
    rows = spark.range(9000).select(F.col("id").cast("string").alias("id"),
                                    F.when(F.col("id") % 10 < 7, "big").when(F.col("id") < 40, "tiny").otherwise("mid").alias("g"))
    counts = rows.groupBy("g").agg(F.count("*").alias("n"))
    sizes = lambda n: sampling.floored_sizes(n, "g", 0.07, 30)
    want = {r.g: r.wanted for r in sizes(counts).collect()}
    taken = sampling.sample_groups(rows, "g", "id", sizes, 42)
    assert {r.g: r["count"] for r in taken.groupBy("g").count().collect()} == want
    assert taken.select("id").distinct().count() == taken.count()
    again = sampling.sample_groups(rows.repartition(17), "g", "id", sizes, 42)
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in taken.collect())


def test_proportional_sizes_sum_to_the_rate(spark):
    counts = spark.createDataFrame([("a", 101), ("b", 57), ("c", 3)], "g string, n long")
    got = {r.g: r.wanted for r in sampling.proportional_sizes(counts, "g", 0.07).collect()}
    assert sum(got.values()) == int(161 * 0.07) and got["a"] == 7


def test_lookup_join_beyond_the_bound_is_the_same(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        small = sizing.join_lookup(rows, lookup, ["k"], how)
        large = sizing.join_lookup(rows, lookup, ["k"], how, max_rows=5)
        assert sorted(map(tuple, small.select("id", "v").fillna(-1).collect())) == sorted(
            map(tuple, large.select("id", "v").fillna(-1).collect()))


def test_negatives_are_unseen_distinct_and_enough(spark):
    rng = np.random.default_rng(2)
    # One user has almost every product, so the short second pass is exercised.
    pairs = {("hog", f"i{j}") for j in range(58)} | {(f"u{u}", f"i{int(rng.zipf(1.6)) % 60}") for u in range(300) for _ in range(4)}
    rows = spark.createDataFrame([(u, i, 1) for u, i in pairs], "member_id string, item_id string, r int")
    got = prep.sample_negatives(rows).collect()
    assert all((r.member_id, r.neg_item_id) not in pairs for r in got)
    per = {}
    for r in got:
        per.setdefault((r.member_id, r.item_id), []).append(r.neg_item_id)
    assert all(len(v) == len(set(v)) <= 4 for v in per.values())
    assert all(len(per[p]) == 4 for p in pairs if p[0] != "hog")
    assert max(len(v) for p, v in per.items() if p[0] == "hog") <= 60 - 58


def test_negatives_are_cut_into_parts_of_bounded_size(spark, monkeypatch):
    """However many draws there are, no more than so many go to a task, and the rows stay the same, also without ids."""
    rng = np.random.default_rng(4)
    pairs = {("hog", f"i{j}") for j in range(38)} | {(f"u{u}", f"i{int(rng.zipf(1.6)) % 40}") for u in range(200) for _ in range(4)}
    rows = spark.createDataFrame([(u, i, 1) for u, i in pairs | {(None, "i1"), (None, None)}], "member_id string, item_id string, r int")
    whole = sorted(prep.sample_negatives(rows).collect(), key=repr)
    parts, cut = [], prep._parts
    monkeypatch.setattr(prep, "_parts", lambda positives, n: (parts.append(cut(positives, n)), cut(positives, n))[1])
    monkeypatch.setattr(prep, "DRAWS_PER_TASK", 200)
    assert sorted(prep.sample_negatives(rows).collect(), key=repr) == whole
    n = len(pairs) + 2
    assert parts[0] == (-(-n * 8 // 200),) and parts[1] and cut(rows, 200) == ()
    assert max(sum(1 for r in whole if r[:2] == key) for key in {r[:2] for r in whole}) == 4


def _vectors(spark, n, d, name, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2:] = x[: n - n // 2]          # exact copies, so ties have to be decided by id
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} int, vector array<double>")


def _brute(q, m, k):
    out = set()
    for i, row in enumerate(np.round(q @ m.T, 9)):
        for rank, j in enumerate(sorted(range(len(m)), key=lambda j: (-row[j], j))[:k], 1):
            out.add((i, j, rank))
    return out


def test_top_matches_both_ways(spark, monkeypatch):
    q, queries = _vectors(spark, 50, 16, "query_id", 3)
    m, items = _vectors(spark, 30, 16, "match_id", 4)
    got = retrieval.top_matches(queries, items, 7)
    assert {(r.query_id, r.match_id, r["rank"]) for r in got.collect()} == _brute(q, m, 7)
    cell = lambda df: df.withColumn("cell", F.lit(0))
    blocked = retrieval.ranked(retrieval.blocked_matches(cell(queries.withColumn("keep", F.lit(7))), cell(items), 20, 8), None, 7)
    assert {(r.query_id, r.match_id, r["rank"]) for r in blocked.collect()} == _brute(q, m, 7)
    forced = retrieval.top_matches(queries, items, 7, broadcast_values=1)
    assert {(r.query_id, r.match_id, r["rank"]) for r in forced.collect()} == _brute(q, m, 7)


def test_top_unseen_returns_k_unseen(spark):
    q, queries = _vectors(spark, 20, 8, "query_id", 5)
    m, items = _vectors(spark, 25, 8, "match_id", 6)
    seen = [(i, j) for i in range(20) for j in range(25) if (i * j) % 3 == 0]
    got = retrieval.top_unseen(queries, items, spark.createDataFrame(seen, "query_id int, match_id int"), 5).collect()
    want = set()
    for i, row in enumerate(np.round(q @ m.T, 9)):
        left = [j for j in range(25) if (i, j) not in set(seen)]
        want |= {(i, j, r) for r, j in enumerate(sorted(left, key=lambda j: (-row[j], j))[:5], 1)}
    assert {(r.query_id, r.match_id, r["rank"]) for r in got} == want


def test_empty_queries_and_items(spark):
    _, items = _vectors(spark, 4, 3, "match_id", 0)
    _, queries = _vectors(spark, 4, 3, "query_id", 0)
    assert retrieval.top_matches(queries.filter("false"), items, 3).count() == 0
    assert retrieval.top_matches(queries, items.filter("false"), 3).count() == 0


def test_cells_find_most_of_the_exact_matches(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16)) * 3
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(600, 16)) * 0.3
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, vector array<double>")
    unit = retrieval.normalised(rows)
    queries, items = unit.withColumnRenamed("id", "query_id"), unit.withColumnRenamed("id", "match_id")
    placed, middle = retrieval.fit_cells(items, 12)
    near = retrieval.top_matches_by_cell(queries, placed, middle, 10, 3).select("query_id", "match_id")
    exact = retrieval.top_matches(queries, items, 10).select("query_id", "match_id")
    assert near.intersect(exact).count() >= 0.9 * exact.count()


def test_cell_count_bounds():
    assert [retrieval.cell_count(n) for n in (10, 10_000, 10**9)] == [64, 100, 4096]
    assert retrieval.default_probes(64) == 8


REPLIES = {
    "C first": ('x ["C","Z","A"] y', ["C", "A", "B"]),
    "none": ("none", ["A", "B", "C"]),
    "broken": ("[\"A\", ", ["A", "B", "C"]),
    "repeated": ('["B","B","A"]', ["B", "A", "C"]),
    "object": ('{"items": ["B","C"]}', ["B", "C", "A"]),
    "missing": (None, ["A", "B", "C"]),
}


def test_reply_merge(spark):
    rows = spark.createDataFrame([(n, r, ["A", "B", "C"]) for n, (r, _) in REPLIES.items()], "n string, reply string, o array<string>")
    got = {r.n: r.m for r in rows.select("n", merge_order(F.col("o"), reply_items(F.col("reply"))).alias("m")).collect()}
    assert got == {n: want for n, (_, want) in REPLIES.items()}


@settings(max_examples=15, deadline=None)
@given(reply=st.lists(st.sampled_from(list("ABCDEZ")), max_size=8))
def test_merge_keeps_every_item_once(spark, reply):
    original = list("ABCDE")
    row = spark.createDataFrame([(original, reply)], "o array<string>, r array<string>").select(
        merge_order(F.col("o"), F.col("r")).alias("m")).first()
    assert sorted(row.m) == original
    named = [x for x in dict.fromkeys(reply) if x in original]
    assert row.m[:len(named)] == named


def test_request_bounds(spark):
    rows = spark.createDataFrame([("a", 0, None), ("b", 200, None), ("c", 1, 10), ("d", 100, 500), ("e", None, 9), ("f", None, None)],
                                 "user_id string, top_k int, retrieval_pool int")
    rows = rows.withColumns({"rerank_pool": F.lit(None).cast("int"), "use_rerank": F.lit(None).cast("boolean")})
    got = {r.user_id: r for r in decisions.validate_requests(rows).collect()}
    assert [got[u].valid for u in "abcdef"] == [False, False, True, True, False, True]
    assert (got["f"].top_k, got["f"].use_rerank, got["f"].retrieval_pool, got["f"].rerank_pool) == (10, False, 100, 20)


def test_keep_all_when_none_pass(spark):
    rows = spark.createDataFrame([("a", 0.7), ("a", 0.6), ("b", 0.1), ("b", 0.2), ("c", 0.65)], "request_id string, p double")
    got = sorted(map(tuple, decisions.keep_passing(rows, F.col("p")).collect()))
    assert got == [("a", 0.7), ("b", 0.1), ("b", 0.2), ("c", 0.65)]


def test_ranks_follow_scores(spark):
    rows = spark.createDataFrame(list(zip("r" * 5, [3, 1, 2, 4, 0], [.1, .9, .5, .3, .7])), "request_id string, item int, score double")
    got = rerank.rank_again(rows, F.desc("score")).orderBy("rank").collect()
    assert [r["item"] for r in got] == [1, 0, 2, 4, 3]


def test_user_flags(spark):
    asked = spark.createDataFrame([("5",), ("GHOST_USER",)], "user_id string")
    known = spark.createDataFrame([("5",)], "member_id string")
    got = {r.user_id: (r.known, r.cold_start) for r in decisions.with_user_flags(asked, known).collect()}
    assert got == {"5": (True, False), "GHOST_USER": (False, True)}


def test_best_home_needs_a_strict_gain(spark):
    rows = spark.createDataFrame([("a", "OWN", .5, False), ("a", "RENT", .5, True), ("b", "OWN", .6, False), ("b", "RENT", .5, True)],
                                 "request_id string, home_ownership string, score double, current boolean")
    got = decisions.best_home(rows).collect()
    assert [(r.request_id, r.current_value, r.recommended) for r in got] == [("b", "RENT", "OWN")]


def test_user_id_kept_when_present(spark):
    rows = spark.createDataFrame([(" 7 ", "x"), (None, "y")], "member_id string, id string")
    assert [r.member_id for r in prep.with_user_id(rows).orderBy("id").collect()] == ["7", None]


def test_bad_months_and_missing_terms_are_dropped(spark):
    good = ("1", "Fully Paid", "Jan-1997", "A", None, " 36 months")
    rows = spark.createDataFrame([good, ("2", "Current", "13-97", "A", "car", "36 months"), ("3", "Current", "Feb-1997", "A", "car", None),
                                  ("nan", "Current", "Feb-1997", "A", "car", "36 months"), ("4", "Late (16-30 days)", "Feb-1997", "A", "car", "x")],
                                 "member_id string, loan_status string, issue_d string, grade string, purpose string, term string")
    got = prep.clean_loans(rows).collect()
    assert [(r.member_id, r.item_id, r.label, r.split) for r in got] == [("1", "A_other_36 months", 1, "val")]


def test_loan_files_are_read_by_name(spark, tmp_path):
    from creditloom.sources import files
    rows = spark.createDataFrame([("7", "m1", "B2", "car", "1000.5")], "id string, member_id string, sub_grade string, purpose string, loan_amnt string")
    files.write_csv(rows, str(tmp_path / "accepted_a.csv"))
    files.write_csv(rows.drop("member_id"), str(tmp_path / "accepted_b.csv"))
    files.write_csv(rows, str(tmp_path / "other.csv"))
    found = files.find_vintages(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in found] == ["accepted_a.csv", "accepted_b.csv"]
    got = files.scan_loan_csv(spark, found[0], "member_id", "purpose", "loan_amnt").first()
    assert (got.member_id, got.purpose, got.loan_amnt) == ("m1", "car", 1000.5)
    assert sorted(r.member_id for r in files.scan_vintages(spark, found, ["member_id", "purpose"]).collect()) == ["7", "m1"]
    with pytest.raises(ValueError, match="grade"):
        files.scan_loan_csv(spark, found[0], "grade")


def test_many_vintages_in_few_jobs(spark, tmp_path):
    """Files with three headers, an id that stands in for the user's per file, quoted names, an empty file."""
    from creditloom.sources import files
    want = []
    for i in range(60):
        header = ["id", "member_id", "purpose", "extra"] if i % 3 == 0 else ["purpose", "id", "dti"] if i % 3 == 1 else ['"member_id"', "id", "purpose"]
        values = {"id": f"{i}", "member_id": "" if i % 6 == 0 else f" m{i} ", "purpose": "car", "extra": "x", "dti": "1.5"}
        (tmp_path / f"accepted_{i:03}.csv").write_text(",".join(header) + "\n" + ",".join(values[h.strip('"')] for h in header) + "\n")
        want.append((f"{i}" if i % 3 == 1 or i % 6 == 0 else f"m{i}", "car", 1.5 if i % 3 == 1 else None))
    (tmp_path / "accepted_empty.csv").write_text("")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("vintages", "")
    got = files.scan_vintages(spark, files.find_vintages(spark, str(tmp_path)), ["member_id", "purpose", "dti"]).collect()
    jobs = len(tracker.getJobIdsForGroup("vintages"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and jobs <= 20


def test_scratch_goes_with_its_owner(spark):
    import os

    from creditloom.session import own_scratch, scratch_path, settle
    with own_scratch(spark) as folder:
        held = settle(spark.range(3))
        assert held.count() == 3 and os.listdir(folder)
        with pytest.raises(ZeroDivisionError), own_scratch(spark) as inner:
            assert inner.startswith(folder) and scratch_path(spark, "x").startswith(inner)
            raise ZeroDivisionError
    assert not os.path.exists(folder) and not scratch_path(spark, "x").startswith(folder)


def test_a_query_is_sent_once_to_a_block_of_cells(spark):
    """Many small cells share a block, a large one is cut; every cell that is asked for is searched, and no other."""
    m, items = _vectors(spark, 90, 8, "match_id", 8)
    q, queries = _vectors(spark, 12, 8, "query_id", 9)
    cell = lambda j: 5 if j >= 40 else j % 5
    placed = items.withColumn("cell", F.when(F.col("match_id") >= 40, 5).otherwise(F.col("match_id") % 5))
    asked = {i: [c for c in range(7) if (i + c) % 3] for i in range(12)}
    probing = queries.withColumns({"cells": F.filter(F.sequence(F.lit(0), F.lit(6)), lambda c: (F.col("query_id") + c) % 3 != 0),
                                   "keep": F.lit(4), "own": F.col("query_id"), "seen": F.array(F.col("query_id") + 41)})
    want = set()
    for i, row in enumerate(np.round(q @ m.T, 9)):
        left = [j for j in range(90) if cell(j) in asked[i] and j not in (i, i + 41)]
        want |= {(i, j, r) for r, j in enumerate(sorted(left, key=lambda j: (-row[j], j))[:4], 1)}
    found = retrieval.ranked(retrieval.blocked_matches(probing, placed, 5, 20), None, 4)
    assert {(r.query_id, r.match_id, r["rank"]) for r in found.collect()} == want


def test_batches_that_meet_many_cells_stay_small():
    """The best of chunks and cells, merged, are the best of all; a query that is named twice with a cell counts twice."""
    rng = np.random.default_rng(3)
    x, ids = rng.integers(-2, 3, size=(60, 3)).astype(float), rng.permutation(60)
    cells = np.sort(rng.integers(0, 4, 60))
    ids = np.concatenate([np.sort(ids[cells == c]) for c in range(4)])
    queries = pd.DataFrame({"query_id": range(5), "vector": list(rng.integers(-2, 3, size=(5, 3)).astype(float)), "keep": [0, 1, 3, 50, 7],
                            "cells": [[0, 1], [3], [0, 1, 2, 3], [2, 0], [1, 1]]})
    got = pd.concat(retrieval._score_block(queries, ids, x, item_cells=cells))
    for q in queries.itertuples():
        scores = [(-float(x[j] @ q.vector), ids[j]) for c in q.cells for j in range(60) if cells[j] == c]
        want = [(i, -s) for s, i in sorted(scores)[:q.keep]]
        mine = got[got.query_id == q.query_id]
        assert list(zip(mine.match_id, mine.score)) == want


def test_correlations_are_compiled(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 6))
    x[:, 5] = 2.0
    gone = rng.random((80, 6)) < 0.2
    names = list("abcdef")
    rows = spark.createDataFrame([[None if g else float(v) for v, g in zip(*r)] for r in zip(x, gone)], ", ".join(f"{c} double" for c in names))
    found = reports.correlations(rows, names)
    got = {(r.x, r.y): r.r for r in found.collect()}
    assert len(got) == 36
    for (a, b), r in got.items():
        i, j = names.index(a), names.index(b)
        both = ~gone[:, i] & ~gone[:, j]
        assert r is None if 5 in (i, j) else r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1])
    assert ") HashAggregate" in found._jdf.queryExecution().executedPlan().toString()
