"""Requests, thresholds, injection, rule order, prompts and replies.

The candidate list of a request is the requester's own past products; the
repayment estimate of a pair is its past repayment rate pulled towards the
product's rate. Both come from the loan table, so SQL can check every step.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.functions.text import reply_items
from creditloom.operators import decisions, preparation as prep, rerank
from creditloom.operators.sizing import join_lookup
from creditloom.queries.common import with_catalog
from creditloom.queries.preparation import PROFILES
from creditloom.queries.registry import query
from creditloom.session import settle
from creditloom.sources.loans import loans
from creditloom.sources.requests import requests

CATALOG_COLUMNS = ["item_id", "grade", "purpose", "term", "int_rate", "loan_amnt", "positive_rate", "n_loans"]


def rounded_catalog(spark, folder):
    catalog = prep.item_catalog(
        loans(spark, folder, "item_id", "int_rate", "loan_amnt", "grade", "purpose", "term", "label"))
    return settle(catalog.select("item_id", "grade", "purpose", "term", F.round("int_rate", 4).alias("int_rate"),
                                 F.round("loan_amnt", 2).alias("loan_amnt"),
                                 F.round("positive_rate", 6).alias("positive_rate"), "n_loans",
                                 F.col("positive_rate").alias("rate")))


def own_products(spark, folder, catalog):
    """(request_id, item_id, catalog columns, repay_prob) over every product the requester ever took."""
    pairs = loans(spark, folder, "member_id", "item_id", "label").groupBy("member_id", "item_id").agg(
        F.count("*").alias("r"), F.sum("label").alias("paid"))
    joined = join_lookup(pairs, catalog, ["item_id"])
    estimate = (F.col("paid") + F.lit(2.0) * F.col("rate")) / (F.col("r") + F.lit(2.0))
    return joined.select(F.col("member_id").alias("request_id"), *CATALOG_COLUMNS, "r", F.round(estimate, 6).alias("repay_prob"))


def candidate_lists(spark, folder, catalog):
    """The same, ranked by how often each was taken."""
    return rerank.rank_again(own_products(spark, folder, catalog), F.desc("r"), F.col("item_id"))


REQUESTS = """
spoken AS (SELECT conv_id, arg_min(text, turn) AS user_prompt FROM conversations WHERE role = 'user' GROUP BY conv_id),
requests AS (
  SELECT c_custkey::VARCHAR AS request_id, c_custkey::VARCHAR AS user_id,
    (CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 0 WHEN c_custkey % 10 = 2 THEN 200 ELSE 1 + c_custkey % 12 END)::INTEGER AS top_k,
    CASE WHEN c_nationkey <> 3 THEN c_nationkey % 2 = 0 END AS use_rerank,
    (CASE WHEN c_custkey % 6 <> 0 THEN 5 + c_custkey % 20 END)::INTEGER AS rerank_pool,
    (CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 8 = 1 THEN 5 ELSE 10 + c_custkey % 40 END)::INTEGER AS retrieval_pool,
    user_prompt,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN 20000.0::DOUBLE + c_acctbal * 10 END AS annual_inc,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN (c_custkey % 400) / 10.0::DOUBLE END AS dti,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN (600 + 5 * (c_custkey % 50))::DOUBLE END AS fico_range_low,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN (604 + 5 * (c_custkey % 50))::DOUBLE END AS fico_range_high,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'OWN' WHEN 'HOUSEHOLD' THEN 'MORTGAGE'
         WHEN 'AUTOMOBILE' THEN 'RENT' WHEN 'FURNITURE' THEN 'OTHER' END AS home_ownership,
    CASE WHEN c_custkey % 9 <> 0 THEN n_name END AS addr_state,
    CASE WHEN c_acctbal >= 0 THEN 5000.0::DOUBLE + c_acctbal * 3 END AS loan_amnt_request,
    CASE WHEN c_custkey % 5 <> 0 THEN 6.0::DOUBLE + (c_custkey % 38) / 2.0::DOUBLE END AS int_rate_request,
    (['large', 'economy', 'standard', 'small', 'medium', 'promo', 'other', NULL])[1 + c_custkey % 8] AS purpose_request,
    (['36 months', '60 months', NULL])[1 + c_custkey % 3] AS term_request
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN spoken ON conv_id = c_custkey
)"""
CANDIDATES = """
items AS (SELECT item_id, grade, purpose, term, round(int_rate, 4) AS int_rate, round(loan_amnt, 2) AS loan_amnt,
  round(positive_rate, 6) AS positive_rate, n_loans, positive_rate AS rate FROM catalog),
candidates AS (
  SELECT member_id AS request_id, items.*, r, round((paid + 2.0::DOUBLE * rate) / (r + 2.0::DOUBLE), 6) AS repay_prob,
    row_number() OVER (PARTITION BY member_id ORDER BY r DESC, item_id) AS rank
  FROM (SELECT member_id, item_id, count(*) AS r, sum(label) AS paid FROM loans GROUP BY ALL) JOIN items USING (item_id))"""
TRAIN_USERS = "train_users AS (SELECT DISTINCT member_id FROM loans WHERE split = 'train')"


def _sql(body: str, *extra: str) -> str:
    return with_catalog(body, REQUESTS, CANDIDATES, TRAIN_USERS, *extra)


def train_users(spark, folder):
    return loans(spark, folder, "member_id", "split").filter("split = 'train'").select("member_id").distinct()


@query("request_validation", sql=_sql("""
SELECT request_id, coalesce(top_k, 10) AS top_k, coalesce(use_rerank, false) AS use_rerank, coalesce(rerank_pool, 20) AS rerank_pool,
  coalesce(retrieval_pool, 100) AS retrieval_pool,
  concat_ws('; ', CASE WHEN coalesce(top_k, 10) NOT BETWEEN 1 AND 100 THEN 'top_k not in [1,100]' END,
    CASE WHEN coalesce(rerank_pool, 20) NOT BETWEEN 1 AND 100 THEN 'rerank_pool not in [1,100]' END,
    CASE WHEN coalesce(retrieval_pool, 100) NOT BETWEEN 10 AND 500 THEN 'retrieval_pool not in [10,500]' END) AS reasons,
  coalesce(top_k, 10) BETWEEN 1 AND 100 AND coalesce(retrieval_pool, 100) BETWEEN 10 AND 500 AS valid
FROM requests"""))
def request_validation(spark, folder):
    return decisions.validate_requests(requests(spark, folder)).select(
        "request_id", "top_k", "use_rerank", "rerank_pool", "retrieval_pool",
        F.array_join("reject_reasons", "; ").alias("reasons"), "valid")


@query("user_info", sql=_sql("""
SELECT request_id, m.member_id IS NOT NULL AS known, m.member_id IS NULL AS cold_start
FROM requests LEFT JOIN train_users m ON m.member_id = user_id"""))
def user_info(spark, folder):
    return decisions.with_user_flags(requests(spark, folder).select("request_id", "user_id"), train_users(spark, folder)).select(
        "request_id", "known", "cold_start")


@query("cold_start_requests", sql=_sql("SELECT request_id FROM requests WHERE user_id NOT IN (SELECT member_id FROM train_users)"))
def cold_start_requests(spark, folder):
    known = train_users(spark, folder).withColumnRenamed("member_id", "user_id")
    return requests(spark, folder).join(known, "user_id", "left_anti").select("request_id")


@query("requested_product", sql=_sql("""
SELECT request_id, loan_amnt_request AS loan_amnt,
  CASE WHEN loan_amnt_request IS NOT NULL THEN coalesce(int_rate_request, 12.0) END AS int_rate,
  CASE WHEN loan_amnt_request IS NOT NULL THEN 'Unknown' END AS grade,
  CASE WHEN loan_amnt_request IS NOT NULL THEN coalesce(purpose_request, 'other') END AS purpose,
  CASE WHEN loan_amnt_request IS NOT NULL THEN coalesce(term_request, 'Unknown') END AS term FROM requests"""))
def requested_product(spark, folder):
    return decisions.requested_product(requests(spark, folder))


_TRAIN_PROFILES = PROFILES.replace("FROM loans GROUP BY member_id", "FROM loans WHERE split = 'train' GROUP BY member_id")


@query("requester_profile", sql=_sql("""
SELECT request_id, r.user_id, CASE WHEN p.member_id IS NOT NULL THEN 'stored'
    WHEN coalesce(r.annual_inc, r.dti, r.fico_range_low, r.fico_range_high) IS NOT NULL THEN 'request' ELSE 'none' END AS profile_source,
  CASE WHEN p.member_id IS NOT NULL THEN p.annual_inc ELSE r.annual_inc END AS annual_inc,
  CASE WHEN p.member_id IS NOT NULL THEN p.dti ELSE r.dti END AS dti,
  CASE WHEN p.member_id IS NOT NULL THEN p.fico_range_low ELSE r.fico_range_low END AS fico_range_low,
  CASE WHEN p.member_id IS NOT NULL THEN p.fico_range_high ELSE r.fico_range_high END AS fico_range_high,
  CASE WHEN p.member_id IS NOT NULL THEN p.home_ownership
    WHEN coalesce(r.annual_inc, r.dti, r.fico_range_low, r.fico_range_high) IS NOT NULL THEN coalesce(r.home_ownership, 'Unknown') END AS home_ownership,
  CASE WHEN p.member_id IS NOT NULL THEN p.addr_state
    WHEN coalesce(r.annual_inc, r.dti, r.fico_range_low, r.fico_range_high) IS NOT NULL THEN coalesce(r.addr_state, 'other') END AS addr_state
FROM requests r LEFT JOIN profiles p ON p.member_id = r.user_id""", _TRAIN_PROFILES))
def requester_profile(spark, folder):
    columns = ["annual_inc", "dti", "fico_range_low", "fico_range_high", "home_ownership", "addr_state"]
    stored = prep.latest_profile(
        loans(spark, folder, "member_id", "issue_d", "id", "split", *columns).filter("split = 'train'"), columns)
    return decisions.requester_profile(requests(spark, folder), stored)


@query("repay_filter", sql=_sql("""
SELECT request_id, item_id, repay_prob FROM (SELECT *, bool_or(repay_prob >= 0.65) OVER (PARTITION BY request_id) AS any_pass FROM candidates)
WHERE repay_prob >= 0.65 OR NOT any_pass"""))
def repay_filter(spark, folder):
    products = own_products(spark, folder, rounded_catalog(spark, folder))
    return decisions.keep_passing(products, F.col("repay_prob")).select("request_id", "item_id", "repay_prob")


@query("catalog_rate_filter", sql=_sql("""
SELECT request_id, item_id, positive_rate FROM (SELECT *, bool_or(positive_rate >= 0.62) OVER (PARTITION BY request_id) AS any_pass FROM candidates)
WHERE positive_rate >= 0.62 OR NOT any_pass"""))
def catalog_rate_filter(spark, folder):
    """Products without a repayment model, at a threshold about half of this catalog reaches."""
    catalog = rounded_catalog(spark, folder)
    products = own_products(spark, folder, catalog).drop("positive_rate")
    return decisions.keep_by_catalog_rate(products, catalog, threshold=0.62).select("request_id", "item_id", "positive_rate")


@query("repay_bands", sql=_sql("""
SELECT grade, CASE WHEN floor(repay_prob * 100) >= 70 THEN 'high' WHEN floor(repay_prob * 100) >= 50 THEN 'medium' ELSE 'low' END AS band,
  count(*) AS n_candidates FROM candidates GROUP BY ALL"""))
def repay_bands(spark, folder):
    products = own_products(spark, folder, rounded_catalog(spark, folder))
    return products.groupBy("grade", decisions.repay_band(F.col("repay_prob")).alias("band")).agg(
        F.count("*").alias("n_candidates"))


@query("approval_decisions", sql=_sql("""
SELECT request_id, max(repay_prob) AS score, coalesce(max(repay_prob), 0.0) >= 0.65 AS approved
FROM requests r LEFT JOIN candidates c USING (request_id) GROUP BY request_id"""))
def approval_decisions(spark, folder):
    """A request is approved if the likeliest repaid product of its list reaches the bar."""
    best = own_products(spark, folder, rounded_catalog(spark, folder)).groupBy("request_id").agg(
        F.max("repay_prob").alias("score"))
    return requests(spark, folder).select("request_id").join(best, "request_id", "left").withColumn(
        "approved", decisions.approved(F.col("score")))


@query("candidate_details", sql=_sql("""
SELECT request_id, item_id, grade, purpose, term, int_rate, loan_amnt, positive_rate, repay_prob, rank::INTEGER AS rank FROM candidates"""))
def candidate_details(spark, folder):
    return candidate_lists(spark, folder, rounded_catalog(spark, folder)).select(
        "request_id", "item_id", "grade", "purpose", "term", "int_rate", "loan_amnt", "positive_rate", "repay_prob", "rank")


@query("past_products", sql=with_catalog("""
SELECT member_id, grade, purpose, term, count(*) AS n_loans FROM loans WHERE label = 1 AND split = 'train' GROUP BY ALL"""))
def past_products(spark, folder):
    history = prep.positive_interactions(
        loans(spark, folder, "split", "member_id", "item_id", "label").filter("split = 'train'"))
    return join_lookup(history, rounded_catalog(spark, folder).drop("n_loans"), ["item_id"]).select(
        "member_id", "grade", "purpose", "term", F.col("r").alias("n_loans"))


INJECTED = """
injected AS (
  SELECT r.request_id, i.* FROM requests r JOIN items i
    ON trim(coalesce(r.user_prompt, '')) <> '' OR r.purpose_request = i.purpose
  ANTI JOIN candidates c ON c.request_id = r.request_id AND c.item_id = i.item_id)"""


@query("injected_items", sql=_sql("SELECT request_id, item_id, positive_rate FROM injected WHERE positive_rate >= 0.62", INJECTED))
def injected_items(spark, folder):
    catalog = rounded_catalog(spark, folder)
    listed = own_products(spark, folder, catalog)
    fresh = rerank.injected_items(requests(spark, folder), listed, catalog).withColumn("repay_prob", F.lit(0.0))
    return rerank.passing_injection(fresh, threshold=0.62).select("request_id", "item_id", "positive_rate")


@query("appended_candidates", sql=_sql("""
SELECT request_id, item_id, row_number() OVER (PARTITION BY request_id ORDER BY late, rank, positive_rate DESC, item_id)::INTEGER AS rank
FROM (SELECT request_id, item_id, rank, positive_rate, 0 AS late FROM candidates
      UNION ALL SELECT request_id, item_id, 0, positive_rate, 1 FROM injected WHERE positive_rate >= 0.62)""", INJECTED))
def appended_candidates(spark, folder):
    catalog = rounded_catalog(spark, folder)
    listed = settle(candidate_lists(spark, folder, catalog).select("request_id", "item_id", "rank"))
    fresh = rerank.injected_items(requests(spark, folder), listed, catalog).withColumn("repay_prob", F.lit(0.0))
    late = rerank.passing_injection(fresh, threshold=0.62).select("request_id", "item_id", F.col("positive_rate").alias("score"))
    return rerank.append_after(listed.withColumn("score", F.lit(0.0)), late).select("request_id", "item_id", "rank")


_ASKED = "SELECT c.*, r.purpose_request, r.loan_amnt_request, r.int_rate_request FROM candidates c JOIN requests r USING (request_id)"
_MATCHED = f"""
matched AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY request_id ORDER BY
    CASE WHEN purpose = purpose_request THEN 0 ELSE 1 END, coalesce(abs(loan_amnt - loan_amnt_request), 'inf'::DOUBLE),
    coalesce(abs(int_rate - int_rate_request), 'inf'::DOUBLE), rank)::INTEGER AS rank FROM ({_ASKED}))"""


def _asked(spark, folder, listed):
    wanted = requests(spark, folder).select("request_id", "purpose_request", "loan_amnt_request", "int_rate_request")
    return listed.join(wanted, "request_id")


@query("rerank_by_request", sql=_sql("SELECT request_id, item_id, rank FROM matched", _MATCHED))
def rerank_by_request(spark, folder):
    return rerank.match_request(_asked(spark, folder, candidate_lists(spark, folder, rounded_catalog(spark, folder)))).select("request_id", "item_id", "rank")


@query("rerank_by_benefit", sql=_sql(f"""
SELECT request_id, item_id, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN purpose = purpose_request THEN 0 ELSE 1 END,
  int_rate, try_cast(regexp_extract(term, '(\\d+)', 1) AS INTEGER), grade, item_id)::INTEGER AS rank FROM ({_ASKED})"""))
def rerank_by_benefit(spark, folder):
    return rerank.by_benefit(_asked(spark, folder, candidate_lists(spark, folder, rounded_catalog(spark, folder)))).select("request_id", "item_id", "rank")


_CANDIDATE_TEXT = """
candidate_text AS (SELECT request_id, string_agg('  ' || rank || '. [' || item_id || '] Grade=' || grade || ', Purpose=' || purpose ||
  ', Term=' || term || ', Rate=' || round(int_rate::DECIMAL(20,6), 1)::DECIMAL(20,1) || '%, AvgAmount=$' ||
  format('{:,}', round_even(loan_amnt, 0)::BIGINT) || ', HistRepayRate=' || round((positive_rate * 100)::DECIMAL(20,6), 0)::DECIMAL(20,0) || '%',
  chr(10) ORDER BY rank) AS t FROM candidates GROUP BY request_id)"""


def _profile_text(missing: str) -> str:
    return f"""'- Annual income: ' || coalesce('$' || format('{{:,}}', round_even(annual_inc, 0)::BIGINT), '{missing}') || chr(10) ||
  '- Debt-to-income ratio: ' || coalesce(round(dti::DECIMAL(20,6), 1)::DECIMAL(20,1) || '%', '{missing}') || chr(10) ||
  '- FICO score: ' || coalesce(format('{{:,}}', round_even(fico_range_low, 0)::BIGINT) || '-' || format('{{:,}}', round_even(fico_range_high, 0)::BIGINT), '{missing}') || chr(10) ||
  '- Home ownership: ' || coalesce(home_ownership, '{missing}') || chr(10) || '- State: ' || coalesce(addr_state, '{missing}')"""


_REQUEST_TEXT = """'- Requested purpose: ' || replace(coalesce(purpose_request, 'any'), '_', ' ') ||
  coalesce(chr(10) || '- Requested loan amount: $' || format('{:,}', round_even(loan_amnt_request, 0)::BIGINT), '') ||
  coalesce(chr(10) || '- Requested interest rate: ' || round(int_rate_request::DECIMAL(20,6), 1)::DECIMAL(20,1) || '%', '')"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("request_prompts", sql=_sql(f"""
SELECT request_id, 'Loan request:' || chr(10) || {_REQUEST_TEXT} || chr(10) || chr(10) || 'Borrower:' || chr(10) || {_profile_text("unknown")} ||
  chr(10) || chr(10) || 'Products:' || chr(10) || t || chr(10) || chr(10) ||
  CASE WHEN trim(coalesce(user_prompt, '')) <> '' THEN 'Borrower''s words: ' || trim(user_prompt) || chr(10) || chr(10) || {_quoted(rerank.FREE_TEXT_RULES)}
       ELSE {_quoted(rerank.FORM_RULES)} END || chr(10) || chr(10) || {_quoted(rerank.REPLY_FORMAT)} AS prompt
FROM requests JOIN candidate_text USING (request_id)""", _CANDIDATE_TEXT))
def request_prompts(spark, folder):
    return rerank.request_prompts(requests(spark, folder), candidate_lists(spark, folder, rounded_catalog(spark, folder)))


@query("behaviour_prompts", sql=_sql(f"""
SELECT request_id, 'Borrower:' || chr(10) || {_profile_text("N/A")} || chr(10) || chr(10) || 'Accepted before:' || chr(10) ||
  coalesce(h, '  No prior loan history.') || chr(10) || chr(10) || 'Products:' || chr(10) || t || chr(10) || chr(10) ||
  {_quoted(rerank.BEHAVIOUR_RULES)} || chr(10) || chr(10) || {_quoted(rerank.REPLY_FORMAT)} AS prompt
FROM requests JOIN candidate_text USING (request_id) LEFT JOIN history USING (request_id)""", _CANDIDATE_TEXT, """
history AS (SELECT request_id, string_agg(line, chr(10) ORDER BY line) AS h FROM (
  SELECT DISTINCT member_id AS request_id, '  Grade=' || grade || ' Purpose=' || purpose || ' Term=' || term AS line
  FROM loans WHERE label = 1 AND split = 'train') GROUP BY request_id)"""))
def behaviour_prompts(spark, folder):
    catalog = rounded_catalog(spark, folder)
    past = past_products(spark, folder).withColumnRenamed("member_id", "request_id")
    return rerank.behaviour_prompts(requests(spark, folder), past, candidate_lists(spark, folder, catalog))


# A reply names the products of the requested purpose, best match first, as text
# with an array (every third as an object holding one, every fifth unreadable).
_REPLIES = _MATCHED + """,
replies AS (SELECT request_id, CASE WHEN request_id::BIGINT % 5 = 0 THEN 'no list [here'
    WHEN request_id::BIGINT % 3 = 0 THEN '{"items": [' || l || ']}' ELSE 'Sure: [' || l || ', "not a product"] done' END AS reply, wanted
  FROM (SELECT request_id, string_agg('"' || item_id || '"', ', ' ORDER BY rank) AS l, list(item_id ORDER BY rank) AS wanted
        FROM matched WHERE purpose = purpose_request GROUP BY request_id))"""


def replies_of(spark, folder, listed):
    matched = rerank.match_request(_asked(spark, folder, listed)).filter("purpose = purpose_request")
    quoted = F.concat(F.lit('"'), F.col("item_id"), F.lit('"'))
    named = matched.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", quoted.alias("q")))), lambda s: s.q), ", ").alias("l"))
    key = F.col("request_id").cast("bigint")
    return named.select("request_id", F.when(key % 5 == 0, "no list [here")
                        .when(key % 3 == 0, F.concat(F.lit('{"items": ['), F.col("l"), F.lit("]}")))
                        .otherwise(F.concat(F.lit("Sure: ["), F.col("l"), F.lit(', "not a product"] done'))).alias("reply"))


@query("reply_lists", sql=_sql("""
SELECT request_id, CASE WHEN request_id::BIGINT % 5 = 0 THEN NULL
  WHEN request_id::BIGINT % 3 = 0 THEN array_to_string(wanted, '|') ELSE array_to_string(list_append(wanted, 'not a product'), '|') END AS items
FROM replies""", _REPLIES))
def reply_lists(spark, folder):
    return replies_of(spark, folder, candidate_lists(spark, folder, rounded_catalog(spark, folder))).select(
        "request_id", F.array_join(reply_items(F.col("reply")), "|").alias("items"))


@query("apply_replies", sql=_sql("""
SELECT c.request_id, c.item_id, row_number() OVER (PARTITION BY c.request_id ORDER BY
  coalesce(CASE WHEN c.request_id::BIGINT % 5 <> 0 THEN list_position(wanted, c.item_id) END, 100000), c.rank)::INTEGER AS rank
FROM candidates c LEFT JOIN replies r ON r.request_id = c.request_id""", _REPLIES))
def apply_replies(spark, folder):
    listed = settle(candidate_lists(spark, folder, rounded_catalog(spark, folder)))
    return rerank.apply_replies(listed, replies_of(spark, folder, listed)).select("request_id", "item_id", "rank")
