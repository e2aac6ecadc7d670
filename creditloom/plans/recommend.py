"""Recommendations, decisions and explanations for a table of requests."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.constants import RETRIEVAL_POOL_RANGE
from creditloom.functions.text import reply_items
from creditloom.operators import decisions, explain, models, preparation as prep, rankers, rerank, retrieval
from creditloom.operators.features import known_state
from creditloom.operators.sizing import join_lookup
from creditloom.plans.artefacts import Artefacts, Ranking
from creditloom.session import settle

DETAILS = ["item_id", "grade", "purpose", "term", "int_rate", "loan_amnt", "positive_rate"]


def unit_items(art: Artefacts) -> DataFrame:
    return retrieval.normalised(art.table("item_factors")).select(F.col("item_id").alias("match_id"), "vector")


EXACT, CELLS = "exact", "cells"


def retrieve(art: Artefacts, wanted: DataFrame, search: str = EXACT, probes: int | None = None) -> DataFrame:
    """Nearest products by angle for (member_id, keep): (member_id, item_id, retrieval_rank).

    `search` is "exact", or "cells" for the kept index, of which `probes` cells are read per user.
    """
    if search not in (EXACT, CELLS):
        raise ValueError(f"search is {EXACT!r} or {CELLS!r}")
    users = retrieval.normalised(art.table("user_factors")).select(F.col("member_id").alias("query_id"), "vector")
    asked = users.join(wanted.select(F.col("member_id").alias("query_id"), "keep"), "query_id")
    found = retrieval.top_matches(asked, unit_items(art), 0) if search == EXACT else art.item_index().search(asked, 0, probes)
    return found.select(
        F.col("query_id").alias("member_id"), F.col("match_id").alias("item_id"), F.col("rank").alias("retrieval_rank"))


def popular_list(art: Artefacts):
    """The most popular products as one array; its length is the largest pool a request may ask for."""
    top = prep.popular_items(art.table("catalog"), RETRIEVAL_POOL_RANGE[1])
    return top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n_loans")).alias("k"), "item_id"))).alias("l")).select(
        F.transform("l", lambda x: x.item_id).alias("l")).scalar()


def split_requests(art: Artefacts, requests: DataFrame) -> DataFrame:
    """Valid requests with `cold_start`: no collaborative factors for the user."""
    valid = decisions.validate_requests(requests).filter("valid")
    return decisions.with_user_flags(valid, art.table("user_factors").select("member_id"))


def requester_features(art: Artefacts, requests: DataFrame) -> DataFrame:
    """(request_id, user_features) where a profile is stored or stated."""
    spec = art.user_spec()
    profile = decisions.requester_profile(requests, art.table("profiles").filter("known")).filter("profile_source <> 'none'")
    return profile.withColumn("addr_state", known_state(spec, F.col("addr_state"))).select(
        "request_id", spec.vector().alias("user_features"))


def repay_probability(art: Artefacts, pairs: DataFrame, people: DataFrame) -> DataFrame:
    """Adds calibrated `repay_prob` to (request_id, item_id) rows; null for a request without features."""
    keyed = people.select(F.col("request_id").alias("member_id"), "user_features")
    known = pairs.select(F.col("request_id").alias("member_id"), "item_id")
    scored = models.with_repay(models.pair_features(known, keyed, settle(art.table("items"))), art.repay_model(), art.calibrator())
    return pairs.join(scored.select(F.col("member_id").alias("request_id"), "item_id", "repay_prob"),
                      ["request_id", "item_id"], "left")


def candidates(art: Artefacts, requests: DataFrame, search: str = EXACT) -> DataFrame:
    """Retrieved products of known users and popular ones of the others: (request_id, item_id, retrieval_rank)."""
    warm = requests.filter("NOT cold_start")
    # Several requests of one user share one search, as deep as the deepest of them.
    depth = warm.groupBy(F.col("user_id").alias("member_id")).agg(F.max("retrieval_pool").alias("keep"))
    found = retrieve(art, depth, search)
    near = (warm.select("request_id", F.col("user_id").alias("member_id"), "retrieval_pool").join(found, "member_id")
            .filter(F.col("retrieval_rank") <= F.col("retrieval_pool")).select("request_id", "item_id", "retrieval_rank"))
    popular = (requests.filter("cold_start")
               .select("request_id", F.posexplode(F.slice(popular_list(art), F.lit(1), F.col("retrieval_pool"))).alias("p", "item_id"))
               .select("request_id", "item_id", (F.col("p") + 1).alias("retrieval_rank")))
    return near.unionByName(popular)


def scorer_of(ranking: Ranking) -> retrieval.Scorer:
    """What scores blocks of the ranking's user and item vectors."""
    return ranking.model.block_scores if isinstance(ranking.model, rankers.PerceptronRanker) else retrieval.dot_products


def scored(ranking: Ranking, rows: DataFrame) -> DataFrame:
    """Adds `score` to (member_id, item_id) rows."""
    return rankers.score_candidates(rows, ranking.model, ranking.users, settle(ranking.items))


def recommend(art: Artefacts, requests: DataFrame, replies: DataFrame | None = None, ranker: str | None = None,
              search: str = EXACT) -> DataFrame:
    """One row per request and recommended product, with rank, score and repayment probability.

    Known users: products near their factors, kept if likely repaid (all of them
    if none is), ranked by the ranking model. Unknown users: popular products,
    ranked by repayment probability if a profile is there, else by popularity
    with score 0. A request that asks for it and has a reply is then reordered.
    `ranker` names one of the run's ranking models in place of the one in use.
    """
    ranking = art.ranking(ranker)
    requests = settle(split_requests(art, requests))
    people = settle(requester_features(art, requests))
    found = settle(candidates(art, requests, search))
    flags = requests.select("request_id", "user_id", "cold_start", "top_k", "use_rerank", "rerank_pool")
    judged = repay_probability(art, found, people).join(flags, "request_id")
    likely = decisions.keep_passing(judged, F.coalesce("repay_prob", F.lit(1.0)))
    warm = scored(ranking, likely.filter("NOT cold_start").withColumn("member_id", F.col("user_id"))).drop("member_id")
    cold = likely.filter("cold_start").withColumn("score", F.coalesce("repay_prob", F.lit(0.0)))
    deep = F.when(F.col("use_rerank"), F.greatest("top_k", "rerank_pool")).otherwise(F.col("top_k"))
    ranked = rerank.rank_again(warm.unionByName(cold), F.desc("score"), F.col("retrieval_rank")).filter(F.col("rank") <= deep)
    catalog = settle(art.table("catalog").select(*DETAILS))
    listed = join_lookup(ranked, catalog, ["item_id"]).withColumn("repay_prob", F.coalesce("repay_prob", F.lit(0.0)))
    columns = ["request_id", "user_id", "cold_start", "top_k", *DETAILS, "repay_prob", "score", "rank"]
    if replies is None:
        return listed.filter(F.col("rank") <= F.col("top_k")).select(*columns)
    listed = settle(listed)
    reordered = reorder(art, requests, people, listed, catalog, replies, ranking)
    plain = listed.filter("NOT use_rerank OR cold_start")
    return plain.select(*columns).unionByName(reordered.select(*columns)).filter(F.col("rank") <= F.col("top_k"))


def reorder(art: Artefacts, requests: DataFrame, people: DataFrame, listed: DataFrame, catalog: DataFrame,
            replies: DataFrame, ranking: Ranking) -> DataFrame:
    """Adds products of the requested purpose (or of any for free text) and applies the replies.

    Added products follow those already listed, so only two kinds can be
    returned: those that the reply names, and the best ones of lists that are
    shorter than `top_k`. No others are added.
    """
    asking = requests.filter("use_rerank AND NOT cold_start")
    current = listed.filter("use_rerank AND NOT cold_start")
    short = asking.join(current.groupBy("request_id").agg(
        F.count("*").alias("n"), F.collect_list("item_id").alias("seen")), "request_id").filter("n < top_k")
    filled = best_in_scope(art, short.withColumn("need", F.col("top_k") - F.col("n")), people, catalog, ranking)
    named = passing(art, rerank.named_items(asking, current, catalog, replies), people).join(
        filled.select("request_id", "item_id"), ["request_id", "item_id"], "left_anti")
    fresh = filled.unionByName(named).join(asking.select("request_id", "user_id", "cold_start", "top_k"), "request_id")
    joined = rerank.append_after(current, scored(ranking, fresh.withColumn("member_id", F.col("user_id"))).drop("member_id"))
    return rerank.apply_replies(settle(joined), replies)


def passing(art: Artefacts, fresh: DataFrame, people: DataFrame) -> DataFrame:
    """Rows with catalog columns that may be added, with their repayment probability."""
    judged = repay_probability(art, settle(fresh), people).withColumn("repay_prob", F.coalesce("repay_prob", F.lit(0.0)))
    return settle(rerank.passing_injection(judged))


def best_in_scope(art: Artefacts, short: DataFrame, people: DataFrame, catalog: DataFrame, ranking: Ranking) -> DataFrame:
    """At least the `need` best products in scope that may be added, for each of `short`, and not among its `seen`.

    The scopes are cells of a vector search, so no request meets products outside
    of its own and only the best of these come back. Where too few of them pass,
    four times as many are asked for, until enough do or the scope is searched through.
    """
    offered = settle(rerank.scoped_catalog(catalog.select("item_id", "purpose")).join(ranking.items, "item_id").select(
        F.col("item_id").alias("match_id"), "vector", F.col("scope").alias("cell")))
    vectors = ranking.users.select(F.col("member_id").alias("user_id"), "vector")
    waiting = settle(short.join(rerank.scopes(short), "request_id").join(vectors, "user_id").select(
        F.col("request_id").alias("query_id"), "vector", F.col("scope").alias("cell"), "seen", "need", F.col("need").cast("int").alias("keep")))
    out = passing(art, named_columns(catalog).limit(0), people)
    while not waiting.isEmpty():
        found = settle(retrieval.ranked(retrieval.blocked_matches(waiting, offered, scorer=scorer_of(ranking)), waiting.select("query_id", "keep"), 0))
        pairs = found.select(F.col("query_id").alias("request_id"), F.col("match_id").alias("item_id"))
        good = passing(art, join_lookup(pairs, catalog, ["item_id"]), people)
        counts = pairs.groupBy(F.col("request_id").alias("query_id")).agg(F.count("*").alias("n_found")).join(
            good.groupBy(F.col("request_id").alias("query_id")).agg(F.count("*").alias("n_good")), "query_id", "left")
        judged = settle(waiting.join(counts, "query_id", "left").withColumn("more", (F.coalesce("n_good", F.lit(0)) < F.col("need")) & (
            F.coalesce("n_found", F.lit(0)) >= F.col("keep"))))
        out = settle(out.unionByName(good.join(judged.filter("NOT more").select(F.col("query_id").alias("request_id")), "request_id", "left_semi")))
        waiting = settle(judged.filter("more").withColumn("keep", F.col("keep") * 4).select(*waiting.columns))
    return out


def named_columns(catalog: DataFrame) -> DataFrame:
    """The catalog's columns beside a request_id."""
    return catalog.withColumn("request_id", F.lit(None).cast("string")).select("request_id", *catalog.columns)


def responses(recommendations: DataFrame, profiled: DataFrame, reordered: DataFrame | None = None) -> DataFrame:
    """One row per request: user, number returned, the stages it went through, and the list as an array of structs.

    `profiled` and `reordered` hold the request_id of requests with features and
    of those whose reply was applied.
    """
    row = F.struct("rank", *DETAILS, "repay_prob", "score")
    out = recommendations.groupBy("request_id", "user_id", "cold_start").agg(
        F.count("*").alias("n_returned"), F.array_sort(F.collect_list(row)).alias("recommendations"))
    out = out.join(profiled.select("request_id", F.lit(True).alias("_profiled")), "request_id", "left")
    again = F.lit(False)
    if reordered is not None:
        out = out.join(reordered.select("request_id", F.lit(True).alias("_again")), "request_id", "left")
        again = F.coalesce("_again", F.lit(False)) & ~F.col("cold_start")
    stages = F.array_compact(F.array(
        F.when(F.col("cold_start"), "popularity").otherwise("retrieval"),
        F.when(~F.col("cold_start") | F.col("_profiled"), "repay_prediction"),
        F.when(~F.col("cold_start"), "ranking"), F.when(again, "reordering")))
    return out.withColumn("stages", stages).drop("_profiled", "_again")


def answers(art: Artefacts, requests: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """The whole answer to each valid request, one row: list and stages, profile, decision, contributions and advice.

    contributions, improvements and home are empty or null where the requested
    product cannot be scored.
    """
    valid = settle(decisions.validate_requests(requests).filter("valid").select(*requests.columns))
    reordered = None
    if replies is not None:
        readable = F.size(reply_items(F.col("reply"))) > 0
        reordered = valid.filter("use_rerank").join(replies.filter(readable), "request_id", "left_semi")
    listed = responses(recommend(art, valid, replies), requester_features(art, valid), reordered)
    rows, leaves = settle(application_rows(art, valid)), art.leaves()

    def gathered(df: DataFrame, name: str) -> DataFrame:
        row = F.struct("position", *[c for c in df.columns if c not in ("request_id", "position")])
        return df.groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias(name))

    why = gathered(explain.contributions(rows, leaves, art.user_spec()), "contributions")
    how = gathered(explain.improvements(rows, leaves, art.calibrator(), art.user_spec(), art.item_spec()), "improvements")
    home = explain.home_suggestions(rows, art.repay_model(), art.calibrator(), art.user_spec(), art.item_spec())
    home = home.select("request_id", F.struct(*[c for c in home.columns if c != "request_id"]).alias("home"))
    profile = decisions.requester_profile(valid, art.table("profiles").filter("known"))
    profile = profile.select("request_id", F.struct(*[c for c in profile.columns if c not in ("request_id", "user_id")]).alias("profile"))
    out = listed.join(approvals(art, valid), "request_id").join(profile, "request_id")
    for part in (why, how, home):
        out = out.join(part, "request_id", "left")
    return out


def application_rows(art: Artefacts, requests: DataFrame) -> DataFrame:
    """Raw fields and feature vector of every request with a profile and a requested product."""
    return explain.application_features(
        decisions.requester_profile(requests, art.table("profiles").filter("known")), decisions.requested_product(requests),
        art.user_spec(), art.item_spec())


def approvals(art: Artefacts, requests: DataFrame, calibrated: bool = False) -> DataFrame:
    """Approval score of the requested product, raw as decisions use it or calibrated; 0 where it cannot be scored."""
    rows = application_rows(art, requests).select("request_id", array_to_vector("x").alias("features"))
    scored = models.with_repay(rows, art.repay_model(), art.calibrator())
    score = F.col("repay_prob" if calibrated else "raw_prob")
    return requests.select("request_id").join(scored.select("request_id", score.alias("approval_score")), "request_id", "left").withColumns(
        {"approved": decisions.approved(F.col("approval_score")), "approval_score": F.coalesce("approval_score", F.lit(0.0))})


def rank_catalog(ranking: Ranking, users: DataFrame, k: int) -> DataFrame:
    """k best products of the whole catalog per user by the ranking model: (member_id, item_id, rank)."""
    vectors = ranking.users.join(users.select("member_id"), "member_id")
    items = ranking.items.select(F.col("item_id").alias("match_id"), "vector")
    found = retrieval.top_matches(vectors.select(F.col("member_id").alias("query_id"), "vector"), items, k, scorer=scorer_of(ranking))
    return found.select(F.col("query_id").alias("member_id"), F.col("match_id").alias("item_id"), "rank")


def rank_pool(ranking: Ranking, found: DataFrame, k: int) -> DataFrame:
    """k best of each user's retrieved products by the ranking model."""
    order = Window.partitionBy("member_id").orderBy(F.desc("score"), "retrieval_rank")
    return scored(ranking, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("member_id", "item_id", "rank")
