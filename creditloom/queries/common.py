"""SQL preludes the oracle statements share."""

RAW = """
raw AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
    CAST(o_custkey AS VARCHAR) AS member_id,
    l_extendedprice AS loan_amnt,
    5.0::DOUBLE + l_discount * 200.0::DOUBLE AS int_rate,
    CASE WHEN l_returnflag = 'A' THEN 'Fully Paid'
         WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'Current'
         WHEN l_returnflag = 'N' THEN 'In Grace Period'
         WHEN l_linestatus = 'O' THEN 'Default' ELSE 'Charged Off' END AS loan_status,
    strftime(o_orderdate, '%b-%Y') AS issue_d,
    date_trunc('month', o_orderdate)::DATE AS issue_date,
    CASE WHEN o_custkey % 37 <> 0 THEN (o_orderkey % 400) / 10.0::DOUBLE END AS dti,
    20000.0::DOUBLE + c_acctbal * 10.0::DOUBLE AS annual_inc,
    (600 + 5 * (c_custkey % 50))::DOUBLE AS fico_range_low,
    (604 + 5 * (c_custkey % 50))::DOUBLE AS fico_range_high,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'OWN' WHEN 'HOUSEHOLD' THEN 'MORTGAGE'
         WHEN 'AUTOMOBILE' THEN 'RENT' WHEN 'FURNITURE' THEN 'OTHER' END AS home_ownership,
    (['< 1 year', '1 year', '2 years', '3 years', '4 years', '5 years', '6 years', '7 years',
      '8 years', '9 years', '10+ years', 'n/a'])[1 + c_custkey % 12] AS emp_length,
    n_name AS addr_state,
    CASE WHEN p_brand <> 'Brand#1' THEN substr('ABCDEFG', (1 + p_partkey % 7)::INT, 1) END AS grade,
    CASE WHEN p_brand <> 'Brand#2' THEN lower(p_type) END AS purpose,
    CASE WHEN p_size <= 25 THEN ' 36 months' ELSE ' 60 months' END AS term
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey
)"""

CLEAN = """
clean AS (
  SELECT * EXCLUDE (issue_d, grade, purpose, term),
    issue_date AS issue_d,
    coalesce(grade, 'Unknown') AS grade, coalesce(purpose, 'other') AS purpose, trim(term) AS term,
    coalesce(grade, 'Unknown') || '_' || coalesce(purpose, 'other') || '_' || trim(term) AS item_id,
    CASE WHEN loan_status IN ('Fully Paid', 'Current', 'In Grace Period') THEN 1 ELSE 0 END AS label,
    CASE WHEN issue_date < DATE '1997-01-01' THEN 'train'
         WHEN issue_date < DATE '1998-01-01' THEN 'val' ELSE 'test' END AS split
  FROM raw
)"""

LOANS = RAW + "," + CLEAN + """,
loans AS (
  SELECT * FROM clean WHERE loan_status IN ('Fully Paid', 'Current', 'Charged Off', 'Default')
)"""

CATALOG = """
catalog AS (
  SELECT item_id, avg(int_rate) AS int_rate, avg(loan_amnt) AS loan_amnt, min(grade) AS grade,
    min(purpose) AS purpose, min(term) AS term, count(*) AS n_loans, avg(label) AS positive_rate,
    row_number() OVER (ORDER BY item_id) - 1 AS item_idx
  FROM loans GROUP BY item_id
)"""


def with_loans(body: str, *extra: str) -> str:
    return "WITH " + ", ".join([LOANS.strip(), *[e.strip() for e in extra]]) + "\n" + body


def with_catalog(body: str, *extra: str) -> str:
    return with_loans(body, CATALOG, *extra)


def uniform_word(*keys: str, seed: int) -> str:
    """The SQL form of a keyed random whole number in [0, 2^32)."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(keys)}, '{seed}')), 1, 8))::BIGINT"
