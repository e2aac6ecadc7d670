"""Properties of models, explanations, recommendations and evaluation on one small trained run."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from creditloom.operators import explain, models, rankers, rerank, retrieval, trees
from creditloom.operators.cells import CellIndex, bounds
from creditloom.plans import choose, evaluate, offline, recommend
from creditloom.sources.loans import loans
from creditloom.sources.requests import requests


@pytest.fixture(scope="module")
def art(spark, folder):
    return offline.run(loans(spark, folder, *offline.LOAN_COLUMNS), factors=8, als_iterations=3, rounds=6, patience=3,
                       ranker_iterations=5, profile_split="train")


@pytest.fixture(scope="module")
def asked(spark, folder):
    return requests(spark, folder).cache()


@pytest.fixture(scope="module")
def applications(art, asked):
    return recommend.application_rows(art, asked).cache()


@pytest.fixture(scope="module")
def leaves(art):
    return art.leaves()


def test_leaf_table_reproduces_the_model(art, applications, leaves):
    scored = art.repay_model().transform(applications.withColumn("features", array_to_vector("x"))).select("x", "probability").collect()
    got = 1 / (1 + np.exp(-leaves.log_odds(np.array([r.x for r in scored]))))
    assert got == pytest.approx(np.array([r.probability[1] for r in scored]), abs=1e-12)


def test_contributions_add_up(art, applications, leaves):
    rows = explain.contribution_table(applications, leaves, art.user_spec().fields()).groupBy("request_id").agg(
        F.sum("contribution").alias("total"))
    got = {r.request_id: r.total for r in rows.collect()}
    base = leaves.base()
    for r in applications.select("request_id", "x").collect():
        assert base + got[r.request_id] == pytest.approx(leaves.log_odds(np.array([r.x]))[0], abs=1e-9)


def test_contributions_are_shapley_values():
    """Against the definition, on a hand-made tree: split on 0, then on 1 or again on 0."""
    inf = np.inf
    leaves = trees.LeafTable(
        np.array([1.0, -2.0, 0.5, 3.0]), np.zeros(4, int), np.array([[0, 1], [0, 1], [0, 2], [0, 2]]),
        np.array([[-inf, -inf], [-inf, 0.0], [1.0, -inf], [1.0, 5.0]]), np.array([[1.0, 0.0], [1.0, inf], [inf, 5.0], [inf, inf]]),
        np.array([[0.6, 0.3], [0.6, 0.7], [0.4, 0.25], [0.4, 0.75]]))
    for x in ([0.5, 1.0, 9.0], [2.0, -1.0, 3.0]):
        row = np.array([x])
        holds = leaves.inside(row)[0].astype(float)

        def game(known):
            factor = np.where(np.isin(leaves.feature, list(known)), holds, leaves.share)
            return float((leaves.value * factor.prod(axis=1)).sum())

        want = []
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            want.append(sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (game({*s, i}) - game(set(s)))
                            for n in range(3) for s in itertools.combinations(rest, n)))
        assert leaves.contributions(row, np.arange(3), 3)[0] == pytest.approx(want, abs=1e-12)


def test_improvements_are_smallest(art, applications, leaves):
    """The named value passes; a cent back towards the current one does not."""
    found = explain.improvements(applications, leaves, art.calibrator(), art.user_spec(), art.item_spec(), threshold=0.6).collect()
    assert found
    rows = {r.request_id: r for r in applications.collect()}
    knots = art.calibrator().boundaries.toArray(), art.calibrator().predictions.toArray()
    user, item = art.user_spec(), art.item_spec()
    place = {f: (i, user) for i, f in enumerate(user.median)} | {f: (len(user.fields()) + i, item) for i, f in enumerate(item.median)}

    def passes(request_id, field, value):
        x = np.array(rows[request_id].x)
        if value is not None:
            x[place[field][0]] = (value - place[field][1].mean[field]) / place[field][1].spread[field]
        return bool(explain._passing(leaves.log_odds(x[None, :]), knots, 0.6)[0])

    changed = 0
    for r in found:
        if r.min_required is None:
            assert not r.achievable and not passes(r.request_id, r.field, None)
        elif r.min_required == r.current_value:
            assert passes(r.request_id, r.field, None)
        else:
            changed += 1
            step = -0.01 if r.min_required > r.current_value else 0.01
            assert passes(r.request_id, r.field, r.min_required)
            assert not passes(r.request_id, r.field, round(r.min_required + step, 2))
    assert changed or all(r.min_required in (None, r.current_value) for r in found)


def test_fields_that_cannot_help_are_listed(art, applications, leaves):
    """With a threshold nobody reaches, every stated field of every application is named as not achievable."""
    found = explain.improvements(applications, leaves, art.calibrator(), art.user_spec(), art.item_spec(), threshold=1.01)
    stated = applications.select(*[F.count(c).alias(c) for c in explain.IMPROVEMENT_FIELDS]).first()
    rows = found.collect()
    assert len(rows) == sum(stated) and not any(r.achievable or r.min_required is not None for r in rows)


def test_calibration_is_monotone_and_bounded(art, spark):
    grid = spark.createDataFrame([(i / 100,) for i in range(101)], "p double")
    values = [r.calibrated for r in models.calibrated(art.calibrator(), grid, "p").orderBy("p").collect()]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1


def test_ranker_splits_into_a_dot_product(art):
    """User and item vectors give what the factorisation machine's own formula gives."""
    ranker = art.ranker()
    users, items = art.table("users").limit(5).collect(), art.table("items").limit(5).collect()
    u = {r.member_id: r.vector for r in ranker.user_vectors(art.table("users")).collect()}
    v = {r.item_id: r.vector for r in ranker.item_vectors(art.table("items")).collect()}
    w, f = np.array(ranker.linear), np.array(ranker.factors)
    for a in users:
        for b in items:
            x = np.concatenate([a.user_features, b.item_features, [float(i == b.item_idx) for i in range(len(w) - ranker.user_dim - ranker.item_dim)]])
            direct = ranker.intercept + w @ x + 0.5 * (((x @ f) ** 2) - (x ** 2) @ (f ** 2)).sum()
            assert np.dot(u[a.member_id], v[b.item_id]) == pytest.approx(direct, abs=1e-9)


def test_recommendations_have_the_promised_shape(art, asked):
    rows = recommend.recommend(art, asked).collect()
    assert rows
    by_request = {}
    for r in rows:
        by_request.setdefault(r.request_id, []).append(r)
    for got in by_request.values():
        got.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and len(got) <= got[0].top_k
        assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
        assert len({r.item_id for r in got}) == len(got)
        judged = [r.repay_prob for r in got if r.repay_prob > 0]
        assert all(p >= 0.65 for p in judged) or all(p < 0.65 for p in judged)


def test_unknown_user_without_profile_gets_popular_items_with_score_zero(art, asked):
    ghost = asked.limit(1).withColumns({
        "request_id": F.lit("ghost"), "user_id": F.lit("GHOST_USER"), "top_k": F.lit(5), "retrieval_pool": F.lit(20), "rerank_pool": F.lit(5),
        **{c: F.lit(None).cast("double") for c in ("annual_inc", "dti", "fico_range_low", "fico_range_high")}})
    got = sorted(recommend.recommend(art, ghost).collect(), key=lambda r: r["rank"])
    popular = [r.item_id for r in art.table("catalog").orderBy(F.desc("n_loans"), "item_id").limit(5).collect()]
    assert [r.item_id for r in got] == popular and all(r.score == 0.0 for r in got)


def test_replies_reorder_known_users(art, asked):
    warm = recommend.split_requests(art, asked).filter("NOT cold_start").select("request_id").first().request_id
    one = asked.filter(F.col("request_id") == warm).withColumns({
        "use_rerank": F.lit(True), "top_k": F.lit(4), "rerank_pool": F.lit(8), "retrieval_pool": F.lit(50),
        "purpose_request": F.lit(None).cast("string"), "user_prompt": F.lit(None).cast("string")})
    plain = sorted(recommend.recommend(art, one.withColumn("top_k", F.lit(8))).collect(), key=lambda r: r["rank"])
    last = plain[-1].item_id
    replies = one.select("request_id", F.lit(f'["{last}", "unknown"]').alias("reply"))
    got = sorted(recommend.recommend(art, one, replies).collect(), key=lambda r: r["rank"])
    assert [r.item_id for r in got] == [last, *[r.item_id for r in plain if r.item_id != last][:3]]


def test_evaluation_means_are_shares(art):
    row = evaluate.evaluate(art, k=10, n_users=50, pool=30).first()
    assert 0 < row.n_users <= 50 and all(0 <= row[m] <= 1 for m in ("recall", "precision", "ndcg", "hit_rate", "mrr"))


def test_search_stops_growing_the_ensemble(art, spark):
    """On labels one feature decides, later rounds bring nothing: the first round and its patience are kept."""
    rows = spark.range(400).select((F.col("id") % 2).cast("int").alias("label"),
                                   array_to_vector(F.array((F.col("id") % 2).cast("double"), F.rand(1))).alias("features"))
    assert models.fit_repay_model(rows, rows, rounds=40, depth=2, patience=3).getNumTrees == 1 + 3


def test_first_trees_are_the_shorter_fit(spark):
    rows = spark.range(300).select((F.col("id") % 3 == 0).cast("int").alias("label"),
                                   array_to_vector(F.array(F.rand(1), F.rand(2), F.col("id") % 5 / 1.0)).alias("features")).cache()
    long, short = models._booster(8, 3).fit(rows), models._booster(5, 3).fit(rows)
    score = lambda m: [r[0] for r in m.transform(rows).select(models.probability()).collect()]
    cut = models.first_trees(long, 5)
    assert cut.getNumTrees == 5 and np.allclose(score(cut), score(short))


def test_more_than_a_thousand_products_are_ranked(spark):
    n = 1500
    items = spark.range(n).select(F.col("id").cast("string").alias("item_id"), F.col("id").cast("int").alias("item_idx"), F.array(F.lit(1.0)).alias("item_features"))
    users = spark.range(3).select(F.col("id").cast("string").alias("member_id"), F.array(F.col("id") / 1.0).alias("user_features"))
    pairs = spark.range(n).select((F.col("id") % 3).cast("string").alias("member_id"), F.col("id").cast("string").alias("item_id"), (F.col("id") >= 1000).cast("int").alias("label"))
    ranker = models.fit_factor_ranker(pairs, users, items, factors=2, iterations=20)
    assert len(ranker.linear) == 1 + 1 + n
    scored = rankers.score_candidates(users.select("member_id").crossJoin(items.select("item_id")), ranker, ranker.user_vectors(users), ranker.item_vectors(items))
    means = {r[0]: r[1] for r in scored.groupBy((F.col("item_id").cast("int") >= 1000)).agg(F.avg("score")).collect()}
    assert means[True] > means[False] + 0.1


@pytest.fixture(scope="module")
def chosen(art):
    """The record after three more trials, on few iterations."""
    trials = (choose.Trial("few", choose.FACTORS, 2), choose.Trial("network", choose.PERCEPTRON, 3, (6, 4)),
              choose.Trial("network_on", choose.PERCEPTRON, 3, (6, 4)))
    return choose.choose_ranker(art, trials).collect()


def test_best_trial_is_in_use(art, chosen):
    assert [r.name for r in chosen] == ["first", "few", "network", "network_on"]
    best = max(chosen, key=lambda r: r.ndcg)
    assert [r.name for r in chosen if r.chosen] == [best.name] == [art.ranking().name]
    assert all(r.split == "val" and r.n_users > 0 and 0 <= r.ndcg <= 1 for r in chosen)


def test_record_is_read_whole_or_not_at_all(art, chosen, tmp_path):
    other = offline.Artefacts(art.spark, str(tmp_path))
    row = ("a", "factors", "{}", "val", 1, 0.5, "p", True)
    other.record([row])
    other.record([row[:5] + (0.1, "p", False), ("b",) + row[1:]])
    assert [(r.name, r.chosen) for r in other.trials().collect()] == [("a", False), ("b", True)]
    # A version that was begun and never finished does not count.
    (tmp_path / "trials" / "version=2" / "_temporary").mkdir(parents=True)
    assert other.trials().count() == 2


def test_perceptron_vectors_give_the_network(art, chosen, spark):
    """Vector scores of pairs and of blocks are those of the fitted network on the whole feature vector."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.linalg import Vectors

    ranking = art.ranking("network_on")
    net = ranking.model
    users, items = art.rank_inputs()
    pairs = users.limit(7).crossJoin(items)
    side = lambda c: F.coalesce(F.transform(c, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), net.factors))
    u, v = side("user_factors"), side("item_factors")
    rows = pairs.select("member_id", "item_id", F.lit(0).alias("label"), array_to_vector(F.concat(
        F.zip_with(u, v, lambda a, b: a * b), u, v, "user_features", "item_features")).alias("features"))
    # No steps: the network keeps the weights it starts from.
    whole = MultilayerPerceptronClassifier(layers=net.layers, maxIter=0).setInitialWeights(Vectors.dense(net.weights)).fit(
        rows.withColumn("label", F.rand(1) > 0.5).withColumn("label", F.col("label").cast("int")))
    want = {(r.member_id, r.item_id): r.p for r in whole.transform(rows).select("member_id", "item_id", models.probability().alias("p")).collect()}
    got = {(r.member_id, r.item_id): r.score for r in recommend.scored(ranking, rows.select("member_id", "item_id")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    ranked = recommend.rank_catalog(ranking, users.limit(7), 5).collect()
    for member in {m for m, _ in want}:
        order = sorted((i for m, i in want if m == member), key=lambda i: (-round(math.log(want[member, i] / (1 - want[member, i])), 9), i))
        assert [r.item_id for r in sorted((r for r in ranked if r.member_id == member), key=lambda r: r["rank"])] == order[:5]


def test_recommendations_with_a_named_ranker(art, chosen, asked):
    for name in ("few", "network"):
        rows = recommend.recommend(art, asked, ranker=name).filter("NOT cold_start")
        again = recommend.scored(art.ranking(name), rows.select("request_id", F.col("user_id").alias("member_id"), "item_id", F.col("score").alias("said")))
        assert again.agg(F.max(F.abs(F.col("score") - F.col("said")))).first()[0] < 1e-12


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(300, [0.0] * 8), (301, rows[4][1]), (302, (-centres[0]).tolist())]
    return spark.createDataFrame(rows, "match_id long, vector array<double>")


def test_kept_index(spark, vectors, tmp_path):
    index = CellIndex.build(vectors.filter("match_id < 200"), str(tmp_path / "index"), cells=12)
    index.add(vectors.filter("match_id >= 200 AND match_id < 250"), "more")
    index.add(vectors.filter("match_id >= 200"), "more")  # the batch again, longer: it is replaced
    assert sorted(r.match_id for r in index.items().collect()) == list(range(303))
    assert index.stats().agg(F.sum("n")).first()[0] == 303
    queries = vectors.withColumnRenamed("match_id", "query_id").withColumn("own", F.col("query_id"))
    rows = lambda df: sorted((r.query_id, r["rank"], r.match_id, round(r.score, 9)) for r in df.collect())
    want = rows(retrieval.top_matches(queries, vectors, 5))
    assert rows(index.search(queries, 5, probes=12)) == want
    pruned = index.search_exact(queries, 5, first=1)
    assert rows(pruned) == want
    assert pruned.agg(F.min("cells_visited")).first()[0] < 12
    keep = queries.withColumn("keep", (F.col("query_id") % 3 + 1).cast("int"))
    assert rows(index.search_exact(keep, 0, first=2)) == [r for r in want if r[1] <= r[0] % 3 + 1]
    assert index.search_exact(queries.limit(0), 5).count() == 0
    index.measure(queries.drop("own"), 5, probes=4)
    assert 0.5 < index.quality().first().recall <= 1 and index.default_probes() == 4
    index.measure(queries.drop("own"), 5, probes=1, least=0.99)
    assert index.quality().first().recall >= 0.99 and index.default_probes() > 1


def test_search_reads_probed_cells_only(spark, vectors, tmp_path):
    index = CellIndex.build(vectors, str(tmp_path / "index"), cells=12)
    probing = spark.createDataFrame([(1,), (3,), (1,)], "cell int")
    plan = index._probed(probing)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert {r.cell for r in index._probed(probing).select("cell").distinct().collect()} == {1, 3}


def test_bounds_hold():
    rng = np.random.default_rng(8)
    items, queries = rng.normal(size=(400, 5)) * rng.uniform(0.1, 3, (400, 1)), rng.normal(size=(30, 5))
    centres = rng.normal(size=(7, 5))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    length = np.linalg.norm(items, axis=1)
    cosine = np.clip(items @ centres.T / length[:, None], -1, 1)
    cell = cosine.argmax(axis=1)
    angle = np.arccos(cosine[np.arange(400), cell])
    stats = [np.array([f(x[cell == c]) for c in range(7)]) for f, x in ((np.max, angle), (np.min, length), (np.max, length))]
    top = bounds(queries, centres, *stats)
    best = np.array([[(queries[q] @ items[cell == c].T).max() for c in range(7)] for q in range(30)])
    assert (top >= best - 1e-9).all()


def test_search_kind_is_checked(art):
    with pytest.raises(ValueError):
        recommend.retrieve(art, art.table("users").select("member_id", F.lit(3).alias("keep")), search="fast")
    wanted = art.table("user_factors").select("member_id", F.lit(5).alias("keep"))
    every = art.item_index().centres().count()
    key = lambda df: sorted((r.member_id, r.retrieval_rank, r.item_id) for r in df.collect())
    assert key(recommend.retrieve(art, wanted, search="cells", probes=every)) == key(recommend.retrieve(art, wanted))


def brute_isotonic(rows):
    """Weighted pool-adjacent-violators over (score, label) pairs, equal scores as one."""
    blocks = []
    for score in sorted({s for s, _ in rows}):
        labels = [y for s, y in rows if s == score]
        blocks.append([sum(labels), len(labels), [score]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, weight, scores = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += weight
            blocks[-1][2] += scores
    return {s: total / weight for total, weight, scores in blocks for s in scores}


@pytest.mark.parametrize("kind", ["ties", "distinct", "constant", "falling"])
def test_calibrator_is_pool_adjacent_violators(spark, kind):
    rng = np.random.default_rng(6)
    score = {"ties": lambda i: round(float(rng.random()), 1), "distinct": lambda i: float(rng.random())}.get(kind, lambda i: i / 400)
    rows = [(s := score(i), {"constant": 1, "falling": int(i < 200)}.get(kind, int(rng.random() < s))) for i in range(400)]
    data = spark.createDataFrame(rows, "raw_prob double, label int").repartition(6)
    fitted = models.fit_calibrator(data)
    want = brute_isotonic(rows)
    got = models.calibrated(fitted, data.select("raw_prob").distinct(), "raw_prob").collect()
    assert len(got) == len(want) and all(r.calibrated == pytest.approx(want[r.raw_prob], abs=1e-9) for r in got)
    assert len(fitted.boundaries) <= 2 * len(set(want.values()))


def test_staged_counts_are_the_scores_of_every_round(spark):
    rows = spark.range(500).select((F.col("id") % 3 == 0).cast("int").alias("label"),
                                   array_to_vector(F.array(F.rand(1), F.rand(2), F.col("id") % 5 / 1.0)).alias("features")).cache()
    model = models._booster(4, 3).fit(rows)
    got = {}
    for r in trees.boxes_of(model).staged_cells(rows.repartition(3)).collect():
        got[r["round"], r.cell, r.label] = got.get((r["round"], r.cell, r.label), 0) + r.n
    want = {}
    for n in range(1, 5):
        for p, label in models.first_trees(model, n).transform(rows).select(models.probability(), "label").collect():
            key = (n, min(int(p * trees.CELLS), trees.CELLS - 1), label)
            want[key] = want.get(key, 0) + 1
    assert sum(got.values()) == 2000 and sum(abs(got.get(k, 0) - want.get(k, 0)) for k in got.keys() | want.keys()) <= 4  # at cell edges


def test_failed_run_goes_on_where_it_stopped(spark, folder, tmp_path, monkeypatch):
    rows = loans(spark, folder, *offline.LOAN_COLUMNS)
    settings = dict(root=str(tmp_path / "run"), factors=4, als_iterations=1, rounds=2, patience=1, ranker_iterations=1)
    calls = []
    for name in ("prepare", "train_retrieval", "build_index", "train_repayment", "train_ranking"):
        job = getattr(offline, name)
        monkeypatch.setattr(offline, name, lambda *a, _name=name, _job=job, **k: (calls.append(_name), _job(*a, **k))[1])
    whole = offline.train_repayment

    def fails(*args):
        whole(*args)
        raise RuntimeError("lost")

    from creditloom import session
    kept = set(os.listdir(f"{session.shared_folder(spark)}/creditloom"))
    monkeypatch.setattr(offline, "train_repayment", fails)
    with pytest.raises(RuntimeError):
        offline.run(rows, **settings)
    assert calls == ["prepare", "train_retrieval", "build_index", "train_repayment"]
    monkeypatch.setattr(offline, "train_repayment", whole)
    calls.clear()
    art = offline.run(rows, **settings)
    assert calls == ["train_repayment", "train_ranking"]
    # Only named artefacts are left, and another setting does its own steps again.
    assert {n for n in os.listdir(f"{session.shared_folder(spark)}/creditloom") if n.startswith("owned")} <= kept
    assert {"loans", "positives", "catalog", "item_index", "repay_model", "calibrator", "rankers", "trials", "steps"} <= set(os.listdir(art.root))
    calls.clear()
    offline.run(rows, **settings)
    assert calls == []
    offline.run(rows, **{**settings, "rounds": 3})
    assert calls == ["train_repayment", "train_ranking"]
    assert offline.content_mark(rows) == offline.content_mark(rows.repartition(3)) != offline.content_mark(rows.limit(5))


def test_short_lists_are_filled_with_the_best_in_scope(art, asked):
    """What the scoped search adds is the head of what all products in scope, judged one by one, would give."""
    wide = asked.withColumns({"use_rerank": F.lit(True), "top_k": F.lit(12), "rerank_pool": F.lit(12), "retrieval_pool": F.lit(10)})
    requests_ = recommend.settle(recommend.split_requests(art, wide))
    people, ranking = recommend.settle(recommend.requester_features(art, requests_)), art.ranking()
    catalog = recommend.settle(art.table("catalog").select(*recommend.DETAILS))
    listed = recommend.settle(recommend.recommend(art, wide).filter("rank <= 3"))
    current, asking = listed, requests_.filter("use_rerank AND NOT cold_start")
    short = asking.join(current.groupBy("request_id").agg(F.collect_list("item_id").alias("seen")), "request_id").withColumn("need", F.lit(9))
    got = recommend.best_in_scope(art, short, people, catalog, ranking)
    every = recommend.passing(art, rerank.injected_items(short, current, catalog), people)

    def best(rows):
        marked = recommend.scored(ranking, rows.join(asking.select("request_id", "user_id"), "request_id").withColumn("member_id", F.col("user_id")))
        out = {}
        for r in marked.collect():
            out.setdefault(r.request_id, []).append((-round(r.score, 9), r.item_id))
        return {k: sorted(v)[:9] for k, v in out.items()}

    assert best(got) == best(every) and best(got)


def test_small_cells_are_not_a_sort_each(spark, vectors, tmp_path, monkeypatch):
    """A query that meets 120 items in chunks of three is sorted a few times, and gets the same items."""
    rng = np.random.default_rng(1)
    queries, items = rng.normal(size=(40, 8)), np.round(rng.normal(size=(120, 8)), 1)
    merges, merge = [], retrieval._Best.merge
    monkeypatch.setattr(retrieval._Best, "merge", lambda self: (merges.append(1), merge(self))[1])
    for k in (1, 7, 200):
        merges.clear()
        best = retrieval._Best(np.full(40, k), np.arange(120))
        for a in range(0, 120, 3):
            best.add(np.arange(40), a, queries @ items[a:a + 3].T)
        best.merge()
        assert len(merges) <= 1 + 40 * 3 // min(k, 120) and (k == 1 or len(merges) < 20)
        scores = np.round(queries @ items.T, retrieval.SCORE_DIGITS)
        want = [c for r in range(40) for c in sorted(range(120), key=lambda c: (-scores[r, c], c))[:k]]
        assert best.cols.tolist() == want


def test_index_is_searched_once_for_its_recall(spark, vectors, tmp_path, monkeypatch):
    """The probes that reach the wanted recall are known from the cells of the exact best, as doubling would find them."""
    index = CellIndex.build(vectors, str(tmp_path / "index"), cells=12)
    queries = vectors.withColumnRenamed("match_id", "query_id")
    exact = index.search_exact(queries, 40).select("query_id", "match_id")
    want = next(p for p in (1, 2, 4, 8, 12) if p == 12 or exact.join(
        index.search(queries, 40, p), ["query_id", "match_id"]).count() >= 0.95 * exact.count())
    searched, search = [], CellIndex.search
    monkeypatch.setattr(CellIndex, "search", lambda self, q, k, p=None: (searched.append(p), search(self, q, k, p))[1])
    index.measure(queries, 40, probes=1, least=0.95)
    assert searched == [want] and index.default_probes() == want > 1 and index.quality().first().recall >= 0.95


def test_factors_by_passes_are_those_of_dense_least_squares(spark, monkeypatch):
    """Users with few, many and repeated products; against normal equations written out, and Spark's ALS by its loss."""
    rng = np.random.default_rng(5)
    rows = [(u, int(i), int(rng.integers(1, 4))) for u in range(60) for i in rng.choice(9, size=1 + u % 9, replace=False)]
    rows += [rows[3], rows[40]]
    pairs = spark.createDataFrame(rows, "user_idx int, item_idx int, r long").repartition(3)
    monkeypatch.setattr(retrieval, "ALS_MOST_ROWS", 100)
    model = retrieval.fit_factors(pairs, factors=6, iterations=4)
    assert type(model).__name__ == "Factors"
    items = np.random.default_rng(42).normal(size=(9, 6))
    items /= np.linalg.norm(items, axis=1, keepdims=True)

    def solve(other, keyed):
        out = []
        for own in keyed:
            a = other.T @ other + 0.1 * len(own) * np.eye(6) + sum(40.0 * r * np.outer(other[j], other[j]) for j, r in own)
            out.append(np.linalg.solve(a, sum((1 + 40.0 * r) * other[j] for j, r in own)))
        return np.array(out)

    by_user, by_item = [[(i, r) for u, i, r in rows if u == n] for n in range(60)], [[(u, r) for u, i, r in rows if i == n] for n in range(9)]
    for _ in range(4):
        users = solve(items, by_user)
        items = solve(users, by_item)
    users = solve(items, by_user)
    for got, want in ((model.userFactors, users), (model.itemFactors, items)):
        found = dict(map(tuple, got.collect()))
        assert np.allclose(np.array([found[n] for n in range(len(want))]), want, atol=1e-5)

    def loss(m):
        u, v = (np.array([f for _, f in sorted(map(tuple, x.collect()))]) for x in (m.userFactors, m.itemFactors))
        c, p = np.zeros((60, 9)), np.zeros((60, 9))
        for a, b, r in rows:
            c[a, b] += 40.0 * r
            p[a, b] = 1
        return ((1 + c) * (p - u @ v.T) ** 2).sum()

    monkeypatch.setattr(retrieval, "ALS_MOST_ROWS", 2_000_000)
    assert loss(model) < 1.1 * loss(retrieval.fit_factors(pairs, factors=6, iterations=4))


@pytest.mark.parametrize("bits", [64, 2])
def test_leaves_are_found_by_their_bits(bits, monkeypatch):
    """Against trying every leaf, on ends, between them and without a number, for trees of up to 64 leaves and past it."""
    rng, inf, paths = np.random.default_rng(5), np.inf, []

    def grow(tree, box, depth):
        if depth == 6 or (depth > 2 and rng.random() < 0.1):
            paths.append((tree, box))
            return
        f, t = int(rng.integers(4)), float(rng.integers(9))
        low, high = box.get(f, (-inf, inf))
        if low < t < high:
            grow(tree, {**box, f: (low, t)}, depth + 1)
            grow(tree, {**box, f: (t, high)}, depth + 1)
        else:
            paths.append((tree, box))

    for tree in range(12):
        grow(tree, {}, 0)
    rng.shuffle(paths)
    padded = [([*b.items()] + [(-1, (-inf, inf))] * 4)[:4] for _, b in paths]
    table = trees.LeafTable(rng.normal(size=len(paths)), np.array([t for t, _ in paths]), np.array([[f for f, _ in p] for p in padded]),
                            np.array([[b[0] for _, b in p] for p in padded]), np.array([[b[1] for _, b in p] for p in padded]), np.ones((len(paths), 4)))
    x = rng.integers(-1, 20, size=(500, 4)) / 2.0
    x[::50, 1] = np.nan
    want = table.inside(x).all(axis=2) @ (table.value[:, None] * (table.tree[:, None] == np.arange(12)))
    monkeypatch.setattr(trees, "_BITS", bits)
    monkeypatch.setattr(trees.LeafTable, "inside", table.inside.__func__ if bits == 2 else None)
    assert np.array_equal(table.tree_values()(x), want)
