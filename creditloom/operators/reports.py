"""Counts, shares, histograms and the application dashboard. Each is partial aggregates, in one pass unless it says more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.constants import (
    DIVERGENCE_REST, DIVERGENCE_VERDICTS, EMP_LENGTHS, MISSING_SHARE, QUANTILE_CAP, RECENT_APPLICATIONS, REPORT_APPROVAL_THRESHOLD,
)
from creditloom.operators.quantiles import exact_quantiles
from creditloom.session import settle

PAIRS_AT_ONCE = 7  # correlations in one aggregate


def _unpivot(row: DataFrame, parts: dict[str, list[Column]], names: list[str], key: str = "column_name") -> DataFrame:
    """One row per entry of `parts`, out of a one-row table."""
    cells = F.array(*[F.struct(F.lit(k).alias(key), *[c.alias(n) for n, c in zip(names, cs)]) for k, cs in parts.items()])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def null_shares(rows: DataFrame) -> DataFrame:
    one = rows.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in rows.columns])
    return _unpivot(one, {c: [F.col(c)] for c in rows.columns}, ["null_percent"]).orderBy(F.desc("null_percent"), "column_name")


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n_loans, share) for several columns in one scan; missing values left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    counted = (rows.select(F.explode(cells).alias("c")).select("c.*").filter("value IS NOT NULL")
               .groupBy("column_name", "value").agg(F.count("*").alias("n_loans")))
    counted = settle(counted)
    # One row a column.
    total = counted.groupBy("column_name").agg(F.sum("n_loans").cast("double").alias("_total"))
    return counted.join(F.broadcast(total), "column_name").withColumn("share", F.col("n_loans") / F.col("_total")).drop("_total")


def most_frequent(counted: DataFrame, n: int | None) -> DataFrame:
    ordered = counted.orderBy(F.desc("n_loans"), "value")
    return ordered if n is None else ordered.limit(n)


def employment_lengths(rows: DataFrame) -> DataFrame:
    """Counts in the fixed display order; lengths outside it are left out."""
    position = F.array_position(F.array(*[F.lit(e) for e in EMP_LENGTHS]), F.col("emp_length")).cast("int")
    return (rows.groupBy("emp_length").agg(F.count("*").alias("n_loans"))
            .withColumn("position", position).filter("position > 0").orderBy("position"))


def histograms(rows: DataFrame, bins: dict[str, int]) -> DataFrame:
    """Equal-width bins per column; the last bin is closed on both sides."""
    edges = rows.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in bins]).first()
    cells = []
    for c, n in bins.items():
        lo, hi = edges[c]["lo"], edges[c]["hi"]
        width = (hi - lo) / n if hi is not None and hi > lo else 1.0
        at = F.when(F.col(c).isNotNull(), F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(width)), F.lit(n - 1)).cast("int"))
        cells.append(F.struct(F.lit(c).alias("column_name"), at.alias("bin")))
    return (rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("bin IS NOT NULL")
            .groupBy("column_name", "bin").agg(F.count("*").alias("n_loans")))


def capped(rows: DataFrame) -> DataFrame:
    """Income above 0 and debt ratio from 0, both below their 99th percentile."""
    caps = exact_quantiles(rows, {"annual_inc": ("annual_inc", QUANTILE_CAP), "dti": ("dti", QUANTILE_CAP)}).first()
    kept = {"annual_inc": (F.col("annual_inc") > 0) & (F.col("annual_inc") < caps.annual_inc),
            "dti": (F.col("dti") >= 0) & (F.col("dti") < caps.dti)}
    one = rows.agg(*[F.count_if(k).alias(f"{c}_n") for c, k in kept.items()],
                   *[F.avg(F.when(k, F.col(c))).alias(f"{c}_mean") for c, k in kept.items()])
    return _unpivot(one, {c: [F.lit(caps[c]), F.col(f"{c}_n"), F.col(f"{c}_mean")] for c in kept}, ["cap", "n_loans", "mean"])


def markers(rows: DataFrame) -> DataFrame:
    medians = exact_quantiles(rows, {f"median_{c}": (c, 0.5) for c in ("loan_amnt", "annual_inc", "dti")}).first()
    return rows.agg(*[F.round(F.lit(medians[f"median_{c}"]), 6).alias(f"median_{c}") for c in ("loan_amnt", "annual_inc", "dti")],
                    F.round(F.avg("fico_range_low"), 6).alias("mean_fico"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r over the rows where both are present, in long form; null for a constant column."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = lambda a, b: F.stddev_pop(F.when(both(a, b), F.col(a)))
    # Compiled, corr() divides by zero over a constant column before the condition is looked at.
    r = lambda a, b: F.try_divide(F.covar_pop(a, b), spread(a, b) * spread(b, a))
    found = [F.when((spread(a, b) > 0) & (spread(b, a) > 0), r(a, b)).alias(f"{a}|{b}") for a, b in pairs]
    # Spark compiles an aggregate of up to 100 fields, and a pair has 10 at most; one over all pairs would be interpreted.
    rows = settle(rows.select(*columns))
    one, *more = [rows.agg(*found[i:i + PAIRS_AT_ONCE]) for i in range(0, len(found), PAIRS_AT_ONCE)]
    for part in more:
        one = one.crossJoin(part)  # of one row each
    value = lambda a, b: F.col(f"`{a}|{b}`") if (a, b) in pairs else F.col(f"`{b}|{a}`")
    cells = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), value(a, b).alias("r")) for a in columns for b in columns]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def quarterly_volume(loans: DataFrame) -> DataFrame:
    quarter = F.trunc("issue_d", "quarter").cast("string")
    return loans.filter("issue_d IS NOT NULL").groupBy(quarter.alias("quarter")).agg(F.count("*").alias("n_loans"))


def compare_shares(population: DataFrame, sample: DataFrame, columns: list[str]) -> DataFrame:
    """Share of each value before (p) and after sampling (q); 0 where a side lacks it."""
    p = value_counts(population, columns).select("column_name", "value", F.col("share").alias("p"))
    q = value_counts(sample, columns).select("column_name", "value", F.col("share").alias("q"))
    return p.join(q, ["column_name", "value"], "full").fillna(0.0, ["p", "q"])


def divergence(shares: DataFrame) -> DataFrame:
    """Kullback-Leibler divergence of the sample from the population, with a verdict."""
    filled = shares.select(*[F.when(F.col(c) > 0, F.col(c)).otherwise(MISSING_SHARE).alias(c) for c in ("p", "q")])
    totals = filled.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    tp, tq = totals.select("tp").scalar(), totals.select("tq").scalar()
    kl = filled.select((F.col("p") / tp).alias("p"), (F.col("q") / tq).alias("q")).agg(
        F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl_divergence"))
    return kl.withColumn("verdict", F.coalesce(
        *[F.when(F.col("kl_divergence") < bound, word) for bound, word in DIVERGENCE_VERDICTS], F.lit(DIVERGENCE_REST)))


def application_kpis(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("n_applications"),
        F.sum(F.col("loan_amount").cast("decimal(18,2)")).cast("double").alias("loan_volume"),
        F.round(F.avg("expected_interest_rate"), 6).alias("mean_rate"),
        F.round(F.avg((F.col("estimated_repay_score") > REPORT_APPROVAL_THRESHOLD).cast("int")), 6).alias("approval_rate"))


def recent_applications(log: DataFrame, n: int = RECENT_APPLICATIONS) -> DataFrame:
    return log.orderBy(F.desc("submitted_at"), "application_id").limit(n)


def daily_applications(log: DataFrame) -> DataFrame:
    day = F.to_date("submitted_at").cast("string")
    return log.groupBy(day.alias("day")).agg(F.count("*").alias("n_applications"))


def applications_by_purpose(log: DataFrame) -> DataFrame:
    return log.groupBy("purpose").agg(F.count("*").alias("n_applications"),
                                      F.round(F.avg("estimated_repay_score"), 6).alias("mean_repay_score"))
