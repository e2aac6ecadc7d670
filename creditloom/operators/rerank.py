"""Reordering a short candidate list: by rules, or by a reply someone wrote.

The model call itself happens elsewhere. Here the prompt table is built and a
table of replies is applied. A candidate list is at most a few hundred rows, as
the request bounds say, so it may be held as one array per request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.constants import APPROVAL_THRESHOLD
from creditloom.functions.text import (
    money, one_decimal, percent, reply_items, whole_number, words,
)
from creditloom.operators.sizing import join_lookup


def rank_again(rows: DataFrame, *order: Column, by: str = "request_id") -> DataFrame:
    """Consecutive ranks from 1 in the given order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def match_request(candidates: DataFrame) -> DataFrame:
    """Requested purpose first, then the closest amount, then the closest rate, then the earlier order."""
    far = F.lit(float("inf"))
    return rank_again(
        candidates,
        F.coalesce((F.col("purpose") == F.col("purpose_request")).cast("int"), F.lit(0)).desc(),
        F.coalesce(F.abs(F.col("loan_amnt") - F.col("loan_amnt_request")), far),
        F.coalesce(F.abs(F.col("int_rate") - F.col("int_rate_request")), far),
        F.col("rank"))


def by_benefit(candidates: DataFrame) -> DataFrame:
    """Requested purpose first, then the lowest rate, the shortest term and the best grade."""
    months = F.regexp_extract("term", r"(\d+)", 1).try_cast("int")
    return rank_again(
        candidates,
        F.coalesce((F.col("purpose") == F.col("purpose_request")).cast("int"), F.lit(0)).desc(),
        F.col("int_rate"), months, F.col("grade"), F.col("item_id"))


def injected_items(requests: DataFrame, candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Products to add to a request's list before reordering.

    A request with free text gets the whole catalog, any other the products of
    its purpose; products already listed are left out. Each product is offered
    under two scopes, its purpose and `*`, which makes this an equality join.
    """
    fresh = join_lookup(scopes(requests), scoped_catalog(catalog), ["scope"]).drop("scope")
    return fresh.join(candidates.select("request_id", "item_id"), ["request_id", "item_id"], "left_anti")


def scopes(requests: DataFrame) -> DataFrame:
    """(request_id, scope): `*` for a request with free text, else its purpose; none for one without either."""
    prompted = F.length(F.trim(F.coalesce("user_prompt", F.lit("")))) > 0
    return requests.select("request_id", F.when(prompted, "*").otherwise(F.col("purpose_request")).alias("scope")).filter("scope IS NOT NULL")


def scoped_catalog(catalog: DataFrame) -> DataFrame:
    """Each product under its purpose and under `*`, as `scope`."""
    return catalog.withColumn("scope", F.explode(F.array(F.lit("*"), F.col("purpose"))))


def named_items(requests: DataFrame, candidates: DataFrame, catalog: DataFrame, replies: DataFrame) -> DataFrame:
    """The rows of `injected_items` that a request's reply names, found from the reply by an equality join."""
    prompted = F.length(F.trim(F.coalesce("user_prompt", F.lit("")))) > 0
    scoped = requests.select("request_id", prompted.alias("_any"), F.col("purpose_request").alias("_purpose"))
    named = replies.select("request_id", F.explode(reply_items(F.col("reply"))).alias("item_id")).distinct()
    fresh = join_lookup(named.join(scoped, "request_id"), catalog, ["item_id"]).filter(
        F.col("_any") | (F.col("_purpose") == F.col("purpose"))).drop("_any", "_purpose")
    return fresh.join(candidates.select("request_id", "item_id"), ["request_id", "item_id"], "left_anti")


def passing_injection(injected: DataFrame, threshold: float = APPROVAL_THRESHOLD) -> DataFrame:
    """Repayment probability if there is one above 0, else the product's past rate, at or above the threshold."""
    check = F.when(F.col("repay_prob") > 0, F.col("repay_prob")).otherwise(F.coalesce("positive_rate", F.lit(0.0)))
    return injected.filter(check >= threshold)


def append_after(candidates: DataFrame, injected: DataFrame) -> DataFrame:
    """Injected products follow the ranked ones, by their score."""
    joined = candidates.withColumn("_late", F.lit(0)).unionByName(
        injected.withColumn("rank", F.lit(0)).withColumn("_late", F.lit(1)), allowMissingColumns=True)
    return rank_again(joined, F.col("_late"), F.col("rank"), F.col("score").desc_nulls_last(), F.col("item_id")).drop("_late")


def apply_replies(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """Candidates in the order a reply lists them; what it leaves out follows in the earlier order.

    No reply, or one without a readable list, keeps the order. Ids the list does
    not know are ignored and repeated ones count once.
    """
    wanted = replies.select("request_id", reply_items(F.col("reply")).alias("_wanted"))
    place = F.nullif(F.array_position(F.col("_wanted"), F.col("item_id")), F.lit(0))
    joined = candidates.join(wanted, "request_id", "left").withColumn("_place", place).drop("_wanted")
    return rank_again(joined, F.col("_place").asc_nulls_last(), F.col("rank")).drop("_place")


# --- prompt tables -----------------------------------------------------------

REPLY_FORMAT = "Answer with one JSON array holding every item_id, best first."
FORM_RULES = ("Order the products by: 1. same purpose as requested; 2. closest average amount; "
              "3. closest rate; 4. fit to the borrower.")
FREE_TEXT_RULES = ("Order the products by: 1. the purpose the borrower's own words imply; 2. average amount closest to "
                   "the sum they need; 3. lowest rate, then shortest term, then best grade.")
BEHAVIOUR_RULES = ("Order the products by how likely this borrower is to accept them. Prefer grades, terms and purposes "
                   "accepted before; with DTI over 20% or FICO below 680 prefer grades A and B.")


def _lines(values: Column) -> Column:
    return F.array_join(values, "\n")


def _or(value: Column, missing: str) -> Column:
    return F.coalesce(value, F.lit(missing))


def profile_lines(missing: str = "unknown") -> Column:
    return _lines(F.array(
        F.concat(F.lit("- Annual income: "), _or(money(F.col("annual_inc")), missing)),
        F.concat(F.lit("- Debt-to-income ratio: "), _or(F.concat(one_decimal(F.col("dti")), F.lit("%")), missing)),
        F.concat(F.lit("- FICO score: "), _or(F.concat(whole_number(F.col("fico_range_low")), F.lit("-"),
                                                      whole_number(F.col("fico_range_high"))), missing)),
        F.concat(F.lit("- Home ownership: "), _or(F.col("home_ownership"), missing)),
        F.concat(F.lit("- State: "), _or(F.col("addr_state"), missing))))


def request_lines() -> Column:
    return _lines(F.array_compact(F.array(
        F.concat(F.lit("- Requested purpose: "), words(_or(F.col("purpose_request"), "any"))),
        F.concat(F.lit("- Requested loan amount: "), money(F.col("loan_amnt_request"))),
        F.concat(F.lit("- Requested interest rate: "), one_decimal(F.col("int_rate_request")), F.lit("%")))))


def candidate_lines(candidates: DataFrame) -> DataFrame:
    """One text per request with a numbered line per candidate, in rank order."""
    line = F.concat(
        F.lit("  "), F.col("rank").cast("string"), F.lit(". ["), F.col("item_id"), F.lit("] Grade="), F.col("grade"),
        F.lit(", Purpose="), F.col("purpose"), F.lit(", Term="), F.col("term"),
        F.lit(", Rate="), one_decimal(F.col("int_rate")), F.lit("%, AvgAmount="), money(F.col("loan_amnt")),
        F.lit(", HistRepayRate="), percent(F.col("positive_rate")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s.line)
    return candidates.groupBy("request_id").agg(_lines(ordered).alias("candidate_text"))


def history_lines(history: DataFrame) -> DataFrame:
    """Past products per request, `No prior loan history.` being the caller's fill for none."""
    line = F.concat(F.lit("  Grade="), F.col("grade"), F.lit(" Purpose="), F.col("purpose"), F.lit(" Term="), F.col("term"))
    return history.groupBy("request_id").agg(
        _lines(F.array_sort(F.collect_set(line))).alias("history_text"))


def request_prompts(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Form or free-text prompt per request; `requests` carries the profile columns too."""
    prompted = F.length(F.trim(F.coalesce("user_prompt", F.lit("")))) > 0
    rules = F.when(prompted, F.concat(F.lit("Borrower's words: "), F.trim("user_prompt"), F.lit("\n\n" + FREE_TEXT_RULES))
                   ).otherwise(F.lit(FORM_RULES))
    text = F.concat(F.lit("Loan request:\n"), request_lines(), F.lit("\n\nBorrower:\n"), profile_lines(),
                    F.lit("\n\nProducts:\n"), F.col("candidate_text"), F.lit("\n\n"), rules, F.lit("\n\n" + REPLY_FORMAT))
    return requests.join(candidate_lines(candidates), "request_id").select("request_id", text.alias("prompt"))


def behaviour_prompts(requests: DataFrame, history: DataFrame, candidates: DataFrame) -> DataFrame:
    """Prompt that shows what the borrower accepted before."""
    text = F.concat(F.lit("Borrower:\n"), profile_lines("N/A"), F.lit("\n\nAccepted before:\n"),
                    F.coalesce("history_text", F.lit("  No prior loan history.")), F.lit("\n\nProducts:\n"),
                    F.col("candidate_text"), F.lit("\n\n" + BEHAVIOUR_RULES + "\n\n" + REPLY_FORMAT))
    return (requests.join(candidate_lines(candidates), "request_id").join(history_lines(history), "request_id", "left")
            .select("request_id", text.alias("prompt")))


def advice_prompts(decisions: DataFrame, contributions: DataFrame, improvements: DataFrame) -> DataFrame:
    """Prompt for advice on a decision: request, profile, strongest contributions and workable changes.

    `decisions` carries request and profile columns, `approval_score` and `approved`.
    """
    size = F.col("contribution")
    why = F.concat(F.lit("  - "), F.col("label"), F.lit(": "), F.when(size >= 0, "+").otherwise(""),
                   F.round(size.cast("decimal(20,6)"), 3).cast("decimal(20,3)").cast("string"))
    reasons = contributions.groupBy("request_id").agg(_lines(F.transform(F.array_sort(F.collect_list(
        F.struct((-F.abs(size)).alias("k"), "label", why.alias("line")))), lambda s: s.line)).alias("reason_text"))
    change = F.concat(F.lit("  - "), F.col("label"), F.lit(": "), F.round("current_value", 2).cast("decimal(20,2)").cast("string"),
                      F.lit(" -> "), F.round("min_required", 2).cast("decimal(20,2)").cast("string"))
    workable = improvements.filter("achievable AND min_required <> current_value")
    changes = workable.groupBy("request_id").agg(
        _lines(F.array_sort(F.collect_list(change))).alias("change_text"))
    status = F.when(F.col("approved"), "APPROVED").otherwise("NOT APPROVED")
    text = F.concat(
        F.lit("Repayment score "), percent(F.col("approval_score"), 1), F.lit(", application "), status,
        F.lit(" (threshold " + f"{APPROVAL_THRESHOLD:.0%}" + ").\n\nLoan request:\n"), request_lines(),
        F.lit("\n\nApplicant:\n"), profile_lines("?"), F.lit("\n\nContributions to the score:\n"), F.col("reason_text"),
        F.when(~F.col("approved") & F.col("change_text").isNotNull(),
               F.concat(F.lit("\n\nSmallest changes that would be approved:\n"), F.col("change_text"))).otherwise(""),
        F.lit("\n\nGive three to five sentences of practical advice."))
    return (decisions.join(reasons, "request_id").join(changes, "request_id", "left")
            .select("request_id", text.alias("prompt")))
