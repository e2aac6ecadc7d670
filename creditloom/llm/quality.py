"""Quality rules with robust outlier detection, as DataFrame expressions only.

Method: per language and source, a minimum-covariance-determinant estimate of
the transformed statistics. It starts from coordinate-wise medians and quartiles
and takes concentration steps: fit mean and covariance to the closest 75 % of the
rows, measure all rows again. The squared Mahalanobis distances are scaled to the
chi-square median, and rows beyond a far quantile are rejected.

Statistics are kept as whole numbers (1/256 steps), so sums and cross products
are exact and results do not depend on how rows are spread over tasks. Medians
and the 75 % bound are read off counts per (group, step), never off sorted
groups, so a source with a third of all rows is summed up before it is shuffled.
What is known of a group goes back to its rows by a broadcast checked for size,
or beyond that by a salted join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.sizing import join_lookup
from creditloom.session import configure, settle

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEATED = 20  # percent of words in repeated windows
REPEAT = 5
UNIT = 256
KEPT_SHARE = 0.75
FITTED_SHARE = 0.5  # of a tight fit: outliers that are a third of the rows stay outside
STEPS = 4
MIN_GROUP = 50  # smaller groups have no estimate of their own
# Chi-square quantiles for 4 degrees of freedom.
CHI2_MEDIAN = 3.3567
CHI2_FAR = 23.5127  # 0.9999
# Medians for 1 to 4 degrees of freedom.
CHI2_MEDIANS = (0.4549, 1.3863, 2.3660, CHI2_MEDIAN)
# The least standard deviation of each statistic: words, word length, symbols, repetition.
LEAST_SPREAD = (0.5, 0.1, 0.05, 0.05)
_BINS = 64


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every row; null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>"))
    # One hash per word, then one per five words; the columns are named so that none is computed twice.
    rows = docs.select("doc_id", "lang", "source", text.alias("t"), F.transform(words, lambda w: F.xxhash64(w)).alias("h"))
    rows = rows.select(
        "doc_id", "lang", "source", "t", F.size("h").cast("long").alias("n_words"),
        F.when(F.size("h") >= REPEAT, F.transform(
            F.sequence(F.lit(0), F.size("h") - REPEAT), lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(REPEAT)])))
        .otherwise(F.array().cast("array<bigint>")).alias("wins"))
    rows = rows.select(
        "doc_id", "lang", "source", "n_words",
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n", -1), lambda s: F.length(F.btrim(s, F.lit(SPACES))) > 0).alias("lines"),
        F.when(F.size(F.array_distinct("wins")) < F.size("wins"),
               F.array_sort(F.transform("wins", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ranked"))
    repeated = F.filter("ranked", lambda x, i: (x["h"] == F.get("ranked", i - 1)["h"]) | (x["h"] == F.get("ranked", i + 1)["h"]))
    rows = rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array_sort(F.transform(repeated, lambda x: x["i"])).alias("at"))
    start = F.struct(F.lit(-REPEAT).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "at", start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(REPEAT), p - s["last"])).alias("n")), lambda s: s["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _vector() -> list[Column]:
    words = F.greatest("n_words", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    values = [F.log1p("n_words"), F.log1p(F.col("word_chars") / words), F.sqrt(F.col("n_symbols") / chars),
              F.sqrt(F.greatest(F.col("n_repeat_words") / words, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))))]
    return [F.round(v * UNIT).cast("long") for v in values]


P = len(LEAST_SPREAD)
X = [f"x{i}" for i in range(P)]
LEAST = [f"least{i}" for i in range(P)]


def _quantiles(rows: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """group, q_<column>_<k>: the smallest value that so large a share of the group does not exceed."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns]))
    counts = rows.select("group", pairs.alias("p")).groupBy("group", "p.c", "p.v").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("group", "c")
    up_to = counts.withColumn("below", F.sum("n").over(whole.orderBy("v"))).withColumn("all", F.sum("n").over(whole))
    return up_to.groupBy("group").agg(*[
        F.min(F.when((F.col("c") == c) & (F.col("below") >= F.col("all") * s), F.col("v"))).alias(f"q_{c}_{k}")
        for c in columns for k, s in enumerate(shares)])


def _start(rows: DataFrame, tight: bool) -> DataFrame:
    """Centre and a diagonal scale from medians and quartiles, as a fit, with the least spread of each coordinate.

    If `tight`, a coordinate with three different quartiles varies and needs no
    least spread but the step it is rounded to. Others are mostly one value, and
    the spread of the closest rows says nothing of the rest.
    """
    q = _quantiles(rows, X, [0.25, 0.5, 0.75])
    fit = {f"m{i}": F.col(f"q_{c}_1") / 1.0 for i, c in enumerate(X)}
    for i, c in enumerate(X):
        for j in range(i):
            fit[f"l{i}{j}"] = F.lit(0.0)
        spread = (F.col(f"q_{c}_2") - F.col(f"q_{c}_0")) / 1.349
        varies = (F.col(f"q_{c}_0") < F.col(f"q_{c}_1")) & (F.col(f"q_{c}_1") < F.col(f"q_{c}_2")) if tight else F.lit(False)
        least = F.when(varies, F.lit(1.0)).otherwise(F.lit(LEAST_SPREAD[i] * UNIT))
        fit[f"l{i}{i}"] = F.greatest(spread, least)
        fit[f"least{i}"] = least
    return settle(q.select("group", *[v.alias(k) for k, v in fit.items()]))


def _distances(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution, and its bin."""
    out = join_lookup(rows, fit, ["group"])
    for i, c in enumerate(X):
        rest = F.col(c) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    out = out.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(P)), F.lit(0.0)))
    return out.withColumn("bin", F.floor(F.log1p("d2") * _BINS).cast("long"))


def _concentrate(rows: DataFrame, fit: DataFrame, tight: bool) -> DataFrame:
    """Mean and Cholesky factor of the covariance of each group's closest rows."""
    measured = _distances(rows, fit).select("group", *X, "bin")
    near = join_lookup(measured, settle(_quantiles(measured, ["bin"], [FITTED_SHARE if tight else KEPT_SHARE])), ["group"]).where("bin <= q_bin_0")
    sums = near.groupBy("group").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(X)],
        *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)])
    sums = join_lookup(sums, settle(fit.select("group", *LEAST)), ["group"])
    out = sums.select("group", "n", *LEAST, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)],
                      *[f"s{i}{j}" for i in range(P) for j in range(i + 1)])
    for i in range(P):
        for j in range(i + 1):
            value = F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j and not tight:
                value = value + (LEAST_SPREAD[i] * UNIT) ** 2
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            if i == j and tight:
                # Where the closest half is one value, as in copies, that is no width for the others.
                out = out.withColumn(f"varies{i}", (F.col(LEAST[i]) < LEAST_SPREAD[i] * UNIT) & (value >= 1.0))
                value = F.when(F.col(f"varies{i}"), value).otherwise(F.greatest(value, F.lit((LEAST_SPREAD[i] * UNIT) ** 2)))
            out = out.withColumn(f"l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"l{j}{j}"))
    return settle(out.select("group", *LEAST, *[f"varies{i}" for i in range(P) if tight], *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)]))


def _pools(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` with `group` set to the pool that judges them, and the passing rows of every pool in use.

    The pool is the smallest of group, language and whole table that has
    `MIN_GROUP` passing rows, or else the whole table. A wider pool is fitted to
    all its passing rows, those of large groups too.
    """
    passed = F.count(F.when(~F.col("base_failed"), 1))
    groups = settle(rows.groupBy("group", F.concat(F.lit("lang "), F.to_json(F.struct("lang"))).alias("wide")).agg(passed.alias("n")))
    by_lang = groups.groupBy("wide").agg(F.sum("n").alias("n_wide"))
    chosen = groups.join(by_lang, "wide").select("group", "wide", F.when(F.col("n") >= MIN_GROUP, F.col("group")).when(
        F.col("n_wide") >= MIN_GROUP, F.col("wide")).otherwise(F.lit("all")).alias("pool"))
    chosen = settle(chosen)
    used = chosen.select("pool").distinct()
    # A group lies in its own pool, its language's and the whole table's, as far as these judge anyone.
    member = chosen.select("group", F.explode(F.array("group", "wide", F.lit("all"))).alias("pool")).join(used, "pool", "left_semi")
    member = settle(member.groupBy("group").agg(F.collect_list("pool").alias("pools")))
    passing = join_lookup(rows.where(~F.col("base_failed")).select("group", *X), member, ["group"])
    passing = settle(passing.select(F.explode("pools").alias("group"), *X))
    return join_lookup(rows, settle(chosen.select("group", "pool")), ["group"]).drop("group").withColumnRenamed("pool", "group"), passing


def quality(docs: DataFrame, pooled: bool = False, tight: bool = False) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, distance and kept for every row of `docs`.

    Null and empty texts have no words and fail. Null languages and sources form
    groups of their own. Repeated rows count as often as they stand there. Groups
    with fewer than `MIN_GROUP` rows that pass the base rules are judged by their
    language or by the whole table if `pooled`, so every passing row has a distance;
    else they have a null distance and lose nothing more. `tight` fits to the closest
    half and gives a least spread only to statistics that do not vary, to the
    others their own width. An empty table gives no rows; other columns are ignored.
    """
    configure(docs.sparkSession)
    group = F.to_json(F.struct("lang", "source"))
    rows = statistics(docs).withColumn("base_failed", base_failed()).withColumn("group", group)
    rows = settle(rows.withColumns(dict(zip(X, _vector()))))
    passing = rows.where(~F.col("base_failed")).select("group", *X)
    if pooled:
        rows, passing = _pools(rows)
    else:
        large = passing.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_GROUP).select("group")
        passing = join_lookup(passing, settle(large), ["group"])
    fit = _start(passing, tight)
    for _ in range(STEPS):
        fit = _concentrate(passing, fit, tight)
    if tight:
        # The scale is that of the coordinates that vary; the least spreads of the others stay as they are.
        varies = [F.col(f"varies{i}") for i in range(P)]
        n_varying = sum((v.cast("int") for v in varies), F.lit(0))
        inner = sum((F.when(v, F.col(f"y{i}") * F.col(f"y{i}")).otherwise(0.0) for i, v in enumerate(varies)), F.lit(0.0))
        inside = _distances(passing, fit).select("group", F.floor(F.log1p(inner) * _BINS).cast("long").alias("bin"))
        median = F.get(F.array(*map(F.lit, CHI2_MEDIANS)), n_varying - 1)
        middle = fit.join(_quantiles(inside, ["bin"], [0.5]), "group").select(
            "group", F.coalesce(F.expm1((F.col("q_bin_0") + 0.5) / _BINS) / median, F.lit(1.0)).alias("scale"))
    else:
        middle = _quantiles(_distances(passing, fit).select("group", "bin"), ["bin"], [0.5]).select(
            "group", (F.expm1((F.col("q_bin_0") + 0.5) / _BINS) / CHI2_MEDIAN).alias("scale"))
    measured = join_lookup(rows, settle(fit.join(middle, "group")), ["group"], "left")
    for i, c in enumerate(X):
        rest = F.col(c) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        measured = measured.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    squares = [F.col(f"y{i}") * F.col(f"y{i}") for i in range(P)]
    if tight:
        d2 = sum((s / F.when(v, F.col("scale")).otherwise(1.0) for s, v in zip(squares, varies)), F.lit(0.0))
    else:
        d2 = sum(squares, F.lit(0.0)) / F.greatest("scale", F.lit(1.0))
    return measured.withColumn("distance", F.when(~F.col("base_failed"), d2)).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CHI2_FAR, F.lit(True))).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
