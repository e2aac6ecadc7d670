"""Exploratory reports over loans and the application dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.constants import HISTOGRAM_BINS, SAMPLE_FLOOR, SAMPLE_RATE, SEED
from creditloom.operators import reports, sampling
from creditloom.queries.common import RAW, uniform_word, with_loans
from creditloom.queries.registry import query
from creditloom.session import scratch_path, settle
from creditloom.sources.files import append_rows, read_log
from creditloom.sources.loans import loans, raw_loans
from creditloom.sources.requests import APPLICATION_SCHEMA, applications
from creditloom.streaming import applications as streams

_AUDITED = ["member_id", "loan_amnt", "int_rate", "grade", "purpose", "dti", "home_ownership", "addr_state", "issue_d"]


@query("null_shares", sql="WITH " + RAW + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 100.0 ELSE 0.0 END), 6) AS null_percent FROM raw" for c in _AUDITED))
def null_shares(spark, folder):
    return reports.null_shares(raw_loans(spark, folder, *_AUDITED)).withColumn("null_percent", F.round("null_percent", 6))


_COUNTED = {"loan_status": None, "grade": None, "purpose": 12, "home_ownership": 5, "emp_length": None}


@query("value_counts", sql="WITH " + RAW + "\n" + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, count(*) AS n_loans, round(count(*) / sum(count(*)) OVER (), 6) AS share "
    f"FROM raw WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c}{f' LIMIT {n}' if n else ''})" for c, n in _COUNTED.items()))
def value_counts(spark, folder):
    rows = raw_loans(spark, folder, *_COUNTED)
    counted = settle(reports.value_counts(rows, list(_COUNTED)))
    parts = [reports.most_frequent(counted.filter(F.col("column_name") == c), n) for c, n in _COUNTED.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("share", F.round("share", 6))


@query("employment_lengths", sql="WITH " + RAW + """
SELECT emp_length, list_position(['< 1 year', '1 year', '2 years', '3 years', '4 years', '5 years', '6 years', '7 years', '8 years', '9 years', '10+ years', 'n/a'], emp_length)::INTEGER AS position,
  count(*) AS n_loans FROM raw GROUP BY emp_length""")
def employment_lengths(spark, folder):
    return reports.employment_lengths(raw_loans(spark, folder, "emp_length"))


def _histogram_sql(c: str, bins: int) -> str:
    return (f"SELECT '{c}' AS column_name, least(floor(({c} - lo) / ((hi - lo) / {bins}.0::DOUBLE)), {bins - 1})::INTEGER AS bin, count(*) AS n_loans "
            f"FROM raw, (SELECT min({c}) AS lo, max({c}) AS hi FROM raw) WHERE {c} IS NOT NULL GROUP BY bin")


@query("histograms", sql="WITH " + RAW + "\n" + " UNION ALL ".join(_histogram_sql(c, n) for c, n in HISTOGRAM_BINS.items()))
def histograms(spark, folder):
    return reports.histograms(settle(raw_loans(spark, folder, *HISTOGRAM_BINS)), HISTOGRAM_BINS)


@query("capped_distributions", sql="WITH " + RAW + """, caps AS (SELECT quantile_cont(annual_inc, 0.99) AS inc, quantile_cont(dti, 0.99) AS dti FROM raw)
SELECT 'annual_inc' AS column_name, round((SELECT inc FROM caps), 6) AS cap, count(*) AS n_loans, round(avg(annual_inc), 4) AS mean FROM raw WHERE annual_inc > 0 AND annual_inc < (SELECT inc FROM caps)
UNION ALL SELECT 'dti', round((SELECT dti FROM caps), 6), count(*), round(avg(dti), 4) FROM raw WHERE dti >= 0 AND dti < (SELECT dti FROM caps)""")
def capped_distributions(spark, folder):
    return reports.capped(settle(raw_loans(spark, folder, "annual_inc", "dti"))).withColumns(
        {"cap": F.round("cap", 6), "mean": F.round("mean", 4)})


@query("distribution_markers", sql="WITH " + RAW + """
SELECT round(median(loan_amnt), 6) AS median_loan_amnt, round(median(annual_inc), 6) AS median_annual_inc,
  round(median(dti), 6) AS median_dti, round(avg(fico_range_low), 6) AS mean_fico FROM raw""")
def distribution_markers(spark, folder):
    rows = settle(raw_loans(spark, folder, "loan_amnt", "annual_inc", "dti", "fico_range_low"))
    return reports.markers(rows)


_CORRELATED = ["loan_amnt", "int_rate", "annual_inc", "dti", "fico_range_low", "fico_range_high"]


@query("correlations", sql="WITH " + RAW + "\n" + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) + 0.0 AS r FROM raw" for a in _CORRELATED for b in _CORRELATED))
def correlations(spark, folder):
    return reports.correlations(raw_loans(spark, folder, *_CORRELATED), _CORRELATED).withColumn("r", F.round("r", 6) + F.lit(0.0))


@query("quarterly_volume", sql="WITH " + RAW + """
SELECT strftime(date_trunc('quarter', issue_date), '%Y-%m-%d') AS quarter, count(*) AS n_loans FROM raw GROUP BY 1""")
def quarterly_volume(spark, folder):
    return reports.quarterly_volume(raw_loans(spark, folder, "issue_date").withColumnRenamed("issue_date", "issue_d"))


_SAMPLE = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY {uniform_word("id", seed=SEED)}, id) AS turn,
  count(*) OVER (PARTITION BY grade) AS n FROM clean),
sampled AS (SELECT * FROM ranked WHERE turn <= least(n, greatest(30, floor(n * 0.07::DOUBLE))))"""


def _population_and_sample(spark, folder):
    rows = settle(loans(spark, folder, "grade", "loan_status", "id", signal_only=False))
    return rows, sampling.sample_groups(
        rows, "grade", "id", lambda n: sampling.floored_sizes(n, "grade", SAMPLE_RATE, SAMPLE_FLOOR), SEED)


def _shares_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, {c} AS value, round(100.0::DOUBLE * p / (SELECT count(*) FROM clean), 6) AS original_percent,
  round(100.0::DOUBLE * coalesce(q, 0) / (SELECT count(*) FROM sampled), 6) AS sample_percent
FROM (SELECT {c}, count(*) AS p FROM clean GROUP BY {c}) LEFT JOIN (SELECT {c}, count(*) AS q FROM sampled GROUP BY {c}) USING ({c})"""


@query("sample_shares", sql=with_loans(_shares_sql("grade") + " UNION ALL " + _shares_sql("loan_status"), _SAMPLE))
def sample_shares(spark, folder):
    population, sample = _population_and_sample(spark, folder)
    shares = reports.compare_shares(population, sample, ["grade", "loan_status"])
    return shares.select("column_name", "value", F.round(F.col("p") * 100, 6).alias("original_percent"),
                         F.round(F.col("q") * 100, 6).alias("sample_percent"))


@query("sample_divergence", sql=with_loans("""
SELECT round(sum(p * ln(p / q)), 6) + 0.0 AS kl_divergence,
  CASE WHEN sum(p * ln(p / q)) < 0.001 THEN 'Excellent' WHEN sum(p * ln(p / q)) < 0.01 THEN 'Good' ELSE 'Acceptable' END AS verdict
FROM (SELECT grade, p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM (
  SELECT grade, coalesce(p / (SELECT count(*) FROM clean)::DOUBLE, 1e-9) AS p, coalesce(q / (SELECT count(*) FROM sampled)::DOUBLE, 1e-9) AS q
  FROM (SELECT grade, count(*) AS p FROM clean GROUP BY grade) FULL JOIN (SELECT grade, count(*) AS q FROM sampled GROUP BY grade) USING (grade)))""", _SAMPLE))
def sample_divergence(spark, folder):
    population, sample = _population_and_sample(spark, folder)
    return reports.divergence(reports.compare_shares(population, sample, ["grade"])).withColumn(
        "kl_divergence", F.round("kl_divergence", 6) + F.lit(0.0))


APPLICATIONS = """
applications AS (SELECT event_id::VARCHAR AS application_id, value AS loan_amount, event_type AS purpose, ts AS submitted_at,
  json_extract_string(props, '$.k')::DOUBLE AS expected_interest_rate, json_extract_string(props, '$.k')::DOUBLE / 100.0::DOUBLE AS estimated_repay_score FROM events)"""
_DAILY = f"WITH {APPLICATIONS} SELECT strftime(submitted_at, '%Y-%m-%d') AS day, count(*) AS n_applications FROM applications GROUP BY 1"


@query("application_kpis", sql=f"""WITH {APPLICATIONS}
SELECT count(*) AS n_applications, sum(loan_amount::DECIMAL(18,2))::DOUBLE AS loan_volume, round(avg(expected_interest_rate), 6) AS mean_rate,
  round(avg(CASE WHEN estimated_repay_score > 0.60 THEN 1.0 ELSE 0.0 END), 6) AS approval_rate FROM applications""")
def application_kpis(spark, folder):
    return reports.application_kpis(applications(spark, folder))


@query("recent_applications", sql=f"""WITH {APPLICATIONS}
SELECT application_id, loan_amount, purpose, estimated_repay_score FROM applications ORDER BY submitted_at DESC, application_id LIMIT 50""")
def recent_applications(spark, folder):
    return reports.recent_applications(applications(spark, folder)).select(
        "application_id", "loan_amount", "purpose", "estimated_repay_score")


@query("daily_applications", sql=_DAILY)
def daily_applications(spark, folder):
    return reports.daily_applications(applications(spark, folder))


@query("applications_by_purpose", sql=f"""WITH {APPLICATIONS}
SELECT purpose, count(*) AS n_applications, round(avg(estimated_repay_score), 6) AS mean_repay_score FROM applications GROUP BY purpose""")
def applications_by_purpose(spark, folder):
    return reports.applications_by_purpose(applications(spark, folder))


@query("application_log_append", sql=f"""WITH {APPLICATIONS}
SELECT purpose, count(*) AS n_rows, sum(loan_amount::DECIMAL(18,2))::DOUBLE AS loan_volume FROM applications GROUP BY purpose""")
def application_log_append(spark, folder):
    """Two appends, one per half of the month, the second one run twice, read back whole."""
    path, rows = scratch_path(spark, "application-log"), applications(spark, folder)
    append_rows(rows.filter("day(submitted_at) <= 15"), path, "early")
    for _ in range(2):
        append_rows(rows.filter("day(submitted_at) > 15"), path, "late")
    return read_log(spark, path, APPLICATION_SCHEMA).groupBy("purpose").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("loan_amount").cast("decimal(18,2)")).cast("double").alias("loan_volume"))


@query("streamed_application_log", sql=f"""WITH {APPLICATIONS}
SELECT application_id, loan_amount, expected_interest_rate, purpose, estimated_repay_score, strftime(submitted_at, '%Y-%m-%d %H:%M:%S') AS submitted_at FROM applications""")
def streamed_application_log(spark, folder):
    log = streams.append_log(spark, folder, scratch_path(spark, "stream-log"), scratch_path(spark, "stream-state"))
    return log.select("application_id", "loan_amount", "expected_interest_rate", "purpose", "estimated_repay_score",
                      F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss").alias("submitted_at"))


@query("streamed_daily_applications", sql=_DAILY)
def streamed_daily_applications(spark, folder):
    return streams.daily_counts(spark, folder, scratch_path(spark, "stream-daily"), scratch_path(spark, "stream-state"))


@query("streamed_daily_upserts", sql=_DAILY)
def streamed_daily_upserts(spark, folder):
    """Days that are rewritten one by one."""
    return streams.daily_upserts(spark, folder, scratch_path(spark, "stream-days"), scratch_path(spark, "stream-state"))


@query("streamed_closed_days", sql=f"""WITH {APPLICATIONS}
SELECT strftime(submitted_at, '%Y-%m-%d') AS day, count(*) AS n_applications FROM applications
WHERE date_trunc('day', submitted_at) + INTERVAL 1 DAY <= (SELECT max(submitted_at) - INTERVAL 1 DAY FROM applications) GROUP BY day""")
def streamed_closed_days(spark, folder):
    """The days that the watermark, one day behind the last application, has passed."""
    return streams.closed_days(spark, folder, scratch_path(spark, "stream-closed"), scratch_path(spark, "stream-state"))
