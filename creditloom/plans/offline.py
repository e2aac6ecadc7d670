"""The offline job: loan records in, feature tables, factors and models out.

Each step writes what the later ones read to the shared folder, so a step can be
rerun alone and a lost executor costs only the step it was in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Event

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.constants import GBT_ROUNDS
from creditloom.operators import features, models, preparation as prep, rankers, retrieval
from creditloom.operators.cells import CellIndex
from creditloom.operators.ordering import dense_index
from creditloom.operators.sizing import join_lookup
from creditloom.plans.artefacts import Artefacts, save_table, settings_text
from creditloom.session import own_scratch, scratch_path, settle

LOAN_COLUMNS = ("id", "member_id", "item_id", "label", "split", "issue_d", "int_rate", "loan_amnt", "grade", "purpose", "term",
                "annual_inc", "dti", "fico_range_low", "fico_range_high", "home_ownership", "addr_state")
FIRST_RANKER = "first"
PROFILE_COLUMNS = ["annual_inc", "dti", "fico_range_low", "fico_range_high", "home_ownership", "addr_state"]


def prepare(loans: DataFrame, root: str, profile_split: str | None = None) -> None:
    """Positives, catalog, profiles and feature tables.

    The feature lists are fitted on all loans unless `profile_split` names a split.
    The users of that split are then the `known` ones, with their profile of that
    time; everybody is transformed, the others with their latest profile.
    """
    spark = loans.sparkSession
    save_table(prep.positive_interactions(loans, "split"), root, "positives")
    fitted = loans if profile_split is None else loans.filter(F.col("split") == profile_split)
    catalog = save_table(prep.item_catalog(loans), root, "catalog")
    profiles = prep.latest_profile(fitted, PROFILE_COLUMNS).withColumn("known", F.lit(True))
    if profile_split is not None:
        others = loans.join(fitted.select("member_id").distinct(), "member_id", "left_anti")
        profiles = profiles.unionByName(prep.latest_profile(others, PROFILE_COLUMNS).withColumn("known", F.lit(False)))
    profiles = save_table(profiles, root, "profiles")
    known = profiles.filter("known").drop("known")
    user_spec = features.fit_features(save_table(features.user_rows(known), root, "user_rows"),
                                      features.USER_NUMERIC, features.USER_CATEGORICAL)
    item_spec = features.fit_item_features(catalog)
    user_spec.save(spark, f"{root}/user_spec")
    item_spec.save(spark, f"{root}/item_spec")
    people = profiles.withColumn("addr_state", features.known_state(user_spec, F.col("addr_state")))
    save_table(people.select("member_id", "known", user_spec.vector().alias("user_features")), root, "users")
    save_table(catalog.join(dense_index(catalog, "item_id", "item_idx"), "item_id").select(
        "item_id", "item_idx", item_spec.vector().alias("item_features")), root, "items")


def train_retrieval(art: Artefacts, factors: int, iterations: int) -> None:
    """Collaborative factors of users and products with repaid train loans, keyed by their ids."""
    pairs = art.table("positives").filter("split = 'train'").select("member_id", "item_id", "r")
    users, items = settle(dense_index(pairs, "member_id", "user_idx")), settle(dense_index(pairs, "item_id", "item_idx"))
    numbered = settle(join_lookup(pairs.join(users, "member_id"), items, ["item_id"]).select("user_idx", "item_idx", "r"))
    model = retrieval.fit_factors(numbered, factors, iterations)
    for name, key, ids, number in (("user_factors", "member_id", users, "user_idx"), ("item_factors", "item_id", items, "item_idx")):
        vectors = model.userFactors if name == "user_factors" else model.itemFactors
        save_table(vectors.join(ids, F.col("id") == F.col(number)).select(key, F.col("features").alias("vector")), art.root, name)


LEAST_RECALL = 0.9  # of the kept index, by the cells it probes


def build_index(art: Artefacts, k: int = 100) -> None:
    """Cells over the product factors, and how many a search has to probe to find nine tenths of the exact k best."""
    items = retrieval.normalised(art.table("item_factors")).select(F.col("item_id").alias("match_id"), "vector")
    index = CellIndex.build(items, f"{art.root}/item_index")
    index.measure(retrieval.normalised(art.table("user_factors")).select(F.col("member_id").alias("query_id"), "vector"), k, least=LEAST_RECALL)


def train_repayment(art: Artefacts, loans: DataFrame, rounds: int, patience: int) -> None:
    """Boosted trees on train loans, calibrated on validation loans."""
    labelled = loans.filter("split <> 'test'").select("member_id", "item_id", "label", "split")
    data = settle(models.pair_features(labelled, art.table("users"), settle(art.table("items"))))
    train, val = data.filter("split = 'train'"), data.filter("split = 'val'")
    model = models.fit_repay_model(train, val, rounds, patience=patience)
    model.write().overwrite().save(f"{art.root}/repay_model")
    scored = save_table(models.with_raw_repay(val, model).select("member_id", "item_id", "label", "raw_prob"), art.root, "val_scores")
    models.fit_calibrator(scored).write().overwrite().save(f"{art.root}/calibrator")


def train_ranking(art: Artefacts, iterations: int) -> None:
    """Factorisation machine on train positives and sampled negatives, and the vectors it gives everyone."""
    positives = settle(art.table("positives").filter("split = 'train'").select("member_id", "item_id", "r"))
    negatives = prep.sample_negatives(positives)
    pairs = save_table(prep.training_pairs(positives, negatives), art.root, "training_pairs")
    users, items = art.table("users"), art.table("items")
    ranker = rankers.fit_factor_ranker(pairs, users, items, iterations=iterations)
    art.save_ranker(FIRST_RANKER, ranker)
    art.record([(FIRST_RANKER, "factors", settings_text({"iterations": iterations}), None, None, None, f"{art.root}/rankers/{FIRST_RANKER}", True)])


def run(loans: DataFrame, root: str | None = None, factors: int = 64, als_iterations: int = 20, rounds: int = GBT_ROUNDS,
        patience: int = 20, ranker_iterations: int = 100, profile_split: str | None = None, choose: bool = False) -> Artefacts:
    """The whole offline job over a loan table with LOAN_COLUMNS.

    `choose` tries further ranking models on validation users and puts the best
    one in use.

    Every step says what it was finished for: the content of the loans and all
    settings up to it. Run again on the same `root`, a job that failed goes on at
    the first step that was not finished for the same. What a step settles on its
    way is removed at its end. The index and the repayment model read nothing of
    each other and are made side by side; both have ended before the next step.
    """
    spark = loans.sparkSession
    root = root or scratch_path(spark, "artefacts")
    art = Artefacts(spark, root)
    stored = lambda: art.table("loans")
    steps = [
        ("loans", {}, lambda: save_table(loans, root, "loans")),
        ("prepare", {"profile_split": profile_split}, lambda: prepare(stored(), root, profile_split)),
        ("retrieval", {"factors": factors, "iterations": als_iterations}, lambda: train_retrieval(art, factors, als_iterations)),
        ("index", {}, lambda: build_index(art)),
        ("repayment", {"rounds": rounds, "patience": patience}, lambda: train_repayment(art, stored(), rounds, patience)),
        ("ranking", {"iterations": ranker_iterations}, lambda: train_ranking(art, ranker_iterations)),
    ]
    if choose:
        from creditloom.plans.choose import choose_ranker  # reads artefacts through the plans that use them

        steps.append(("choice", {}, lambda: choose_ranker(art)))
    if art.committed("loans") is None:
        # Nothing is there to go on from: the loans are worked out once, and marked as they were stored.
        steps[0][2]()
        mark = content_mark(stored())
        art.commit("loans", step_mark(mark, "loans", {}))
    else:
        mark = content_mark(loans)

    def finish(name: str, mark: str, job: Callable[[], None], begun: Event) -> None:
        begun.set()
        with own_scratch(spark):
            job()
        art.commit(name, mark)

    with ThreadPoolExecutor(1) as side:  # which is waited for, whatever fails
        beside = None
        for name, settings, job in steps:
            mark, begun = step_mark(mark, name, settings), Event()
            if art.committed(name) == mark:
                continue
            if name == "index":
                beside = side.submit(inheritable_thread_target(spark)(finish), name, mark, job, begun)
                begun.wait()
                continue
            if beside is not None and name != "repayment":
                beside.result()
            finish(name, mark, job, begun)
        if beside is not None:
            beside.result()
    return art


def step_mark(before: str, name: str, settings: dict) -> str:
    """What a step is finished for: all that the step before it was, and its own settings."""
    return hashlib.sha256(f"{before} {name} {settings_text(settings)}".encode()).hexdigest()


def content_mark(rows: DataFrame) -> str:
    """A text that changes with the rows of a table, but not with their order."""
    hashed = F.xxhash64(*rows.columns, *[F.col(c).isNull() for c in rows.columns])
    found = rows.agg(F.count("*"), F.bit_xor(hashed), F.sum(F.pmod(hashed, F.lit((1 << 31) - 1)))).first()
    return " ".join(map(str, [*rows.columns, *found]))
