"""Trying ranking models on validation users and putting the best one in use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import metrics, rankers
from creditloom.plans.artefacts import Artefacts, settings_text
from creditloom.plans.evaluate import truth_of
from creditloom.plans.recommend import popular_list, rank_catalog, rank_pool, retrieve
from creditloom.session import settle

FACTORS, PERCEPTRON = "factors", "perceptron"


@dataclass(frozen=True)
class Trial:
    """One setting to try. A perceptron goes on from the best one of the same layers so far, unless it is `fresh`."""

    name: str
    kind: str = FACTORS
    iterations: int = 100
    hidden: tuple[int, ...] = (128, 64, 32)
    fresh: bool = False

    def settings(self) -> str:
        shape = {"hidden": list(self.hidden), "fresh": self.fresh} if self.kind == PERCEPTRON else {}
        return settings_text({"iterations": self.iterations, **shape})


DEFAULT_TRIALS = (Trial("factors_10", FACTORS, 10), Trial("factors_50", FACTORS, 50), Trial("perceptron_20", PERCEPTRON, 20),
                  Trial("perceptron_40", PERCEPTRON, 20))


def fit(art: Artefacts, trial: Trial, start: rankers.PerceptronRanker | None = None):
    users, items = art.rank_inputs()
    pairs = art.table("training_pairs")
    if trial.kind == FACTORS:
        return rankers.fit_factor_ranker(pairs, users, items, iterations=trial.iterations)
    return rankers.fit_perceptron_ranker(pairs, users, items, trial.hidden, trial.iterations, start)


def validation_score(art: Artefacts, name: str, k: int, pool: int | None, split: str) -> tuple[int, float]:
    """Users and mean NDCG of a saved ranker, over the whole catalog or the `pool` retrieved products."""
    truth = truth_of(art, split)
    people = settle(truth.select("member_id").distinct())
    ranking = art.ranking(name)
    if pool is None:
        ranked = rank_catalog(ranking, people, k)
    else:
        ranked = rank_pool(ranking, retrieve(art, people.withColumn("keep", F.lit(pool))), k)
    return mean_ndcg(ranked, truth, people, k)


def mean_ndcg(ranked: DataFrame, truth: DataFrame, people: DataFrame, k: int) -> tuple[int, float]:
    row = metrics.user_metrics(ranked.withColumn("stage", F.lit("")), truth, people, [""], k).agg(
        F.count("*").alias("n"), F.avg("ndcg").alias("ndcg")).first()
    return row.n, row.ndcg


def popularity_score(art: Artefacts, k: int = 10, split: str = "val") -> tuple[int, float]:
    """The same for the popular list, which any ranker has to be held against."""
    truth = truth_of(art, split)
    people = settle(truth.select("member_id").distinct())
    listed = people.select("member_id", F.posexplode(F.slice(popular_list(art), 1, k)).alias("p", "item_id"))
    return mean_ndcg(listed.select("member_id", "item_id", (F.col("p") + 1).alias("rank")), truth, people, k)


def choose_ranker(art: Artefacts, trials: tuple[Trial, ...] = DEFAULT_TRIALS, k: int = 10, pool: int | None = None,
                  split: str = "val") -> DataFrame:
    """Fits and scores each trial, and the ranker already there; the best one is from now on the one in use.

    The record is written after every trial, so a run that ends early leaves the
    best so far. Equal scores keep the earlier one. Returns the record.
    """
    done = [tuple(r[c] for c in ("name", "kind", "settings", "path")) for r in art.trials().collect()]
    scored = []
    for name, kind, settings, path in done:
        scored.append((name, kind, settings, split, *validation_score(art, name, k, pool, split), path))
    for trial in trials:
        networks = [t for t in scored if t[1] == PERCEPTRON]
        start = None
        if trial.kind == PERCEPTRON and networks and not trial.fresh:
            start = art.ranker(max(networks, key=lambda t: t[5])[0])
        path = f"{art.root}/rankers/{trial.name}"
        art.save_ranker(trial.name, fit(art, trial, start))
        scored = [t for t in scored if t[0] != trial.name]
        scored.append((trial.name, trial.kind, trial.settings(), split, *validation_score(art, trial.name, k, pool, split), path))
        best = max(scored, key=lambda t: t[5])
        art.record([(*t, t[0] == best[0]) for t in scored])
    return art.trials()
