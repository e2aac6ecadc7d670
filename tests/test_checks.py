"""The checks notice what they are there to notice, on rows that break it."""

import types

import pytest

from creditloom.operators import ordering
from creditloom.queries import checks


def judged(spark, monkeypatch, rows):
    """calibration_facts over loans whose (raw_prob, prediction) are given."""
    table = spark.createDataFrame(rows, "raw_prob double, prediction double").repartition(3)
    art = types.SimpleNamespace(table=lambda name: table, calibrator=lambda: types.SimpleNamespace(transform=lambda df: df))
    monkeypatch.setattr(checks, "trained", lambda spark, folder: art)
    return checks.calibration_facts(spark, "").first()


@pytest.mark.parametrize("rows, falling", [
    ([(0.5001, 0.7), (0.5002, 0.6)], 1),                                  # within a thousandth
    ([(0.1, 0.2), (0.2, 0.9), (0.5, 0.3), (0.7, 0.5), (0.9, 0.95)], 2),   # below an earlier one, not the one before
    ([(0.1, 0.2), (0.1, 0.2), (0.1004, 0.2), (0.1005, 0.3), (0.8, 1.0)], 0),
])
def test_any_fall_of_the_calibration_is_counted(spark, monkeypatch, rows, falling):
    found = judged(spark, monkeypatch, rows)
    assert (found.n_loans, found.n_outside, found.n_falling) == (len(rows), 0, falling)


def test_a_loan_without_a_probability_is_outside(spark, monkeypatch):
    found = judged(spark, monkeypatch, [(0.1, 0.2), (0.2, None), (0.3, 1.5), (0.4, float("nan"))])
    assert (found.n_loans, found.n_outside) == (4, 3)


def test_highest_before_is_that_of_all_earlier_rows(spark):
    rows = [(n, (n * 37) % 101) for n in range(500)]
    got = ordering.highest_before(spark.createDataFrame(rows, "n int, v int").repartition(5), "n", "v").collect()
    assert {r.n: r.v_before for r in got} == {n: max((v for m, v in rows[:n]), default=None) for n, _ in rows}
