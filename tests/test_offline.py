"""How the offline job goes through its steps, with steps that only say that they were called."""

import threading

import pytest
from pyspark.sql import functions as F

from creditloom.operators import passes, retrieval
from creditloom.plans import offline

STEPS = ("prepare", "train_retrieval", "build_index", "train_repayment", "train_ranking")


@pytest.fixture
def steps(monkeypatch):
    """Steps that write their names down; a name can be given something else to do."""
    called, does = [], {}
    for name in STEPS:
        monkeypatch.setattr(offline, name, lambda *a, _name=name, **k: (called.append(_name), does.get(_name, lambda: None)()))
    return called, does


@pytest.fixture
def rows(spark):
    return spark.range(50).select(F.col("id").cast("string").alias("id"), (F.col("id") / 3).alias("x"), F.when(F.col("id") % 2 == 0, "a").alias("c"))


def test_index_and_repayment_are_made_side_by_side(rows, steps, tmp_path):
    called, does = steps
    meet = threading.Barrier(2, timeout=60)
    does.update(build_index=meet.wait, train_repayment=meet.wait)
    offline.run(rows, str(tmp_path / "run"))
    assert called == list(STEPS)


@pytest.mark.parametrize("lost, other", [("build_index", "train_repayment"), ("train_repayment", "build_index")])
def test_one_of_them_fails(rows, steps, tmp_path, lost, other):
    """The other one counts as finished, nothing after them is begun, and the next run does what is missing."""
    called, does = steps
    does[lost] = lambda: 1 / 0
    with pytest.raises(ZeroDivisionError):
        offline.run(rows, str(tmp_path / "run"))
    assert called == list(STEPS[:4])
    does.clear(), called.clear()
    offline.run(rows, str(tmp_path / "run"))
    assert called == [lost, "train_ranking"]


def test_loans_are_worked_out_once(rows, steps, tmp_path, monkeypatch):
    """A first run marks the loans as stored, a later one as given, and both marks are the same."""
    called, _ = steps
    marked, mark = [], offline.content_mark
    monkeypatch.setattr(offline, "content_mark", lambda df: (marked.append(df), mark(df))[1])
    offline.run(rows, str(tmp_path / "run"))
    assert marked[0] is not rows and called == list(STEPS)
    offline.run(rows, str(tmp_path / "run"))
    assert marked[1] is rows and called == list(STEPS)
    offline.run(rows.limit(20), str(tmp_path / "run"))
    assert called == [*STEPS, *STEPS]
    assert mark(rows.sparkSession.read.parquet(str(tmp_path / "run/loans"))) == mark(rows.limit(20))


def test_factors_go_by_passes_before_a_block_is_full(spark, monkeypatch):
    pairs = spark.range(300).select((F.col("id") % 60).cast("int").alias("user_idx"), (F.col("id") % 7).cast("int").alias("item_idx"), F.lit(1).alias("r"))
    assert type(retrieval.fit_factors(pairs, 4, 1)).__name__ != "Factors"
    monkeypatch.setattr(retrieval, "PASS_LEAST_ROWS", 299)
    assert type(retrieval.fit_factors(pairs, 4, 1)).__name__ == "Factors"


def test_blocks_hold_no_more_pairs_than_asked_for(spark):
    pairs = spark.range(4000).select((F.col("id") % 400).cast("string").alias("member_id"), F.concat(F.lit("p"), F.floor(F.col("id") / 400)).alias("item_id"), F.lit(1).alias("label"))
    users = spark.range(400).select(F.col("id").cast("string").alias("member_id"), F.array(F.col("id") / 1.0).alias("f"))
    for asked, most in ((50, 60), (None, 4000)):
        blocks = passes.pair_blocks(pairs, users, ["f"], [f"p{i}" for i in range(10)], asked)
        sizes = blocks.blocks.map(lambda b: len(__import__("pickle").loads(b).labels)).collect()
        blocks.release()
        assert sum(sizes) == 4000 and max(sizes) <= most and (asked is None or len(sizes) > 60)
