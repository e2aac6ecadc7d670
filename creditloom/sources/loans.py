"""Loan records.

`raw_loans` gives the record as a loan file has it (text dates, untrimmed
terms, missing values). `loans` gives cleaned, labelled, split records and is
what almost every job reads.

The test tables hold no loans, so both are views over lineitem and its
dimension tables, one loan per line item. Dimension rows exist for every key
and are unique, so a dimension is joined only if one of the asked-for columns
comes from it: a job that needs only products never shuffles on the order key.
No join is hinted; Spark picks a broadcast by file size and a sort-merge join
with skew splitting beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.constants import EMP_LENGTHS, TEST_START, VAL_START
from creditloom.functions.text import item_id
from creditloom.sources.tables import table


def _loan_status() -> Column:
    flag, open_line = F.col("l_returnflag"), F.col("l_linestatus") == "O"
    return (F.when(flag == "A", "Fully Paid")
            .when((flag == "N") & open_line, "Current")
            .when(flag == "N", "In Grace Period")
            .when((flag == "R") & open_line, "Default")
            .when(flag == "R", "Charged Off"))


def _has_signal() -> Column:
    """A status among the positive and negative ones, in terms the Parquet reader can filter on."""
    return F.col("l_returnflag").isin("A", "R") | ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"))


def _pick(values, position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), position.cast("int") + 1)


_SEGMENT_HOME = {"BUILDING": "OWN", "HOUSEHOLD": "MORTGAGE", "AUTOMOBILE": "RENT", "FURNITURE": "OTHER"}


def _home() -> Column:
    out = None
    for segment, home in _SEGMENT_HOME.items():
        is_segment = F.col("c_mktsegment") == segment
        out = F.when(is_segment, home) if out is None else out.when(is_segment, home)
    return out


# column -> (tables it needs, expression)
def _raw_columns() -> dict[str, tuple[set[str], Column]]:
    orders, customer, part = {"orders"}, {"orders", "customer"}, {"part"}
    return {
        "id": (set(), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
        "member_id": (orders, F.col("o_custkey").cast("string")),
        "loan_amnt": (set(), F.col("l_extendedprice")),
        "int_rate": (set(), F.lit(5.0) + F.col("l_discount") * F.lit(200.0)),
        "loan_status": (set(), _loan_status()),
        "issue_date": (orders, F.trunc(F.col("o_orderdate").cast("date"), "month")),
        "dti": (orders, F.when(F.col("o_custkey") % 37 != 0, (F.col("o_orderkey") % 400) / F.lit(10.0))),
        "annual_inc": (customer, F.lit(20000.0) + F.col("c_acctbal") * F.lit(10.0)),
        "fico_range_low": (customer, (F.lit(600) + F.lit(5) * (F.col("c_custkey") % 50)).cast("double")),
        "fico_range_high": (customer, (F.lit(604) + F.lit(5) * (F.col("c_custkey") % 50)).cast("double")),
        "home_ownership": (customer, _home()),
        "emp_length": (customer, _pick(EMP_LENGTHS, F.col("c_custkey") % 12)),
        "addr_state": (customer | {"nation"}, F.col("n_name")),
        "grade": (part, F.when(F.col("p_brand") != "Brand#1", _pick("ABCDEFG", F.col("p_partkey") % 7))),
        "purpose": (part, F.when(F.col("p_brand") != "Brand#2", F.lower(F.col("p_type")))),
        "term": (part, F.when(F.col("p_size") <= 25, " 36 months").otherwise(" 60 months")),
    }


def _joined(spark: SparkSession, folder: str, needed: set[str]) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    if "orders" in needed:
        orders = table(spark, folder, "orders")
        if "customer" in needed:
            customer = table(spark, folder, "customer")
            if "nation" in needed:
                customer = customer.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "part" in needed:
        rows = rows.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows


def raw_loans(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """Uncleaned records; `issue_d` is text such as Jan-1997."""
    known = _raw_columns()
    known["issue_d"] = (known["issue_date"][0], F.date_format(known["issue_date"][1], "MMM-yyyy"))
    names = names or tuple(n for n in known if n != "issue_date")
    needed = set().union(*(known[n][0] for n in names))
    return _joined(spark, folder, needed).select(*[known[n][1].alias(n) for n in names])


def split_of(issue_date: Column, val_start: str = VAL_START, test_start: str = TEST_START) -> Column:
    return (F.when(issue_date < F.lit(val_start).cast("date"), "train")
            .when(issue_date < F.lit(test_start).cast("date"), "val")
            .otherwise("test"))


def loans(spark: SparkSession, folder: str, *names: str, signal_only: bool = True) -> DataFrame:
    """Cleaned records with the asked-for columns.

    Beyond the raw columns: `label` (1 repaid, 0 not), `item_id`, `split`,
    `issue_d` as a date, `grade`/`purpose`/`term` filled and trimmed. Rows whose
    status carries no signal are left out unless `signal_only` is off.
    """
    known = _raw_columns()
    grade, purpose, term = (known[c][1] for c in ("grade", "purpose", "term"))
    known["grade"] = ({"part"}, F.coalesce(grade, F.lit("Unknown")))
    known["purpose"] = ({"part"}, F.coalesce(purpose, F.lit("other")))
    known["term"] = ({"part"}, F.trim(term))
    known["item_id"] = ({"part"}, item_id(grade, purpose, term))
    known["issue_d"] = known["issue_date"]
    known["split"] = ({"orders"}, split_of(known["issue_date"][1]))
    known["label"] = (set(), F.col("l_returnflag").isin("A", "N").cast("int"))
    needed = set().union(*(known[n][0] for n in names))
    rows = _joined(spark, folder, needed)
    if signal_only:
        rows = rows.filter(_has_signal())
    return rows.select(*[known[n][1].alias(n) for n in names])
