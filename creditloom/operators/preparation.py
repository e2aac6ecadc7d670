"""From loan records to labelled interactions, profiles, catalog and negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.constants import (
    LOAN_ROW_STATUSES, NEGATIVE_STATUSES, NEGATIVES_PER_POSITIVE, POPULARITY_POWER,
    POSITIVE_STATUSES, RARE_CATEGORY, SEED, TOP_N_STATES, TRIES_PER_NEGATIVE,
)
from creditloom.functions.random import DRAWS_PER_DIGEST, RESOLUTION, uniform_word
from creditloom.functions.text import item_id
from creditloom.operators.ordering import dense_index, running_totals
from creditloom.operators.sizing import join_lookup
from creditloom.session import settle
from creditloom.sources.files import with_user_id  # noqa: F401
from creditloom.sources.loans import split_of

DRAWS_PER_TASK = 1_000_000  # of negatives


def parse_month(text: Column) -> Column:
    """Jan-1997 -> date; anything else -> null."""
    return F.try_to_timestamp(text, F.lit("MMM-yyyy")).cast("date")


def loan_rows_only(raw: DataFrame) -> DataFrame:
    """Drops the note lines a vintage file carries."""
    return raw.filter(F.col("loan_status").isin(*LOAN_ROW_STATUSES))


def clean_loans(raw: DataFrame) -> DataFrame:
    """Rows with key, status and month, a clear repayment signal, a label, a product and a split."""
    month = parse_month(F.col("issue_d"))
    return (raw.dropna(subset=["member_id", "loan_status", "issue_d"])
            .filter(F.col("member_id") != "nan")
            .filter(F.col("loan_status").isin(*POSITIVE_STATUSES, *NEGATIVE_STATUSES))
            .withColumn("item_id", item_id(F.col("grade"), F.col("purpose"), F.col("term")))
            .withColumn("issue_d", month)
            .dropna(subset=["issue_d", "item_id"])
            .withColumn("label", F.col("loan_status").isin(*POSITIVE_STATUSES).cast("int"))
            .withColumn("split", split_of(F.col("issue_d"))))


def positive_interactions(loans: DataFrame, *extra: str) -> DataFrame:
    """Times each user took each product and repaid."""
    return (loans.filter("label = 1").groupBy(*extra, "member_id", "item_id")
            .agg(F.count("*").alias("r")))


def item_catalog(loans: DataFrame) -> DataFrame:
    """One row per product. Grade, purpose and term are constant within one."""
    return loans.groupBy("item_id").agg(
        F.avg("int_rate").alias("int_rate"), F.avg("loan_amnt").alias("loan_amnt"),
        F.min("grade").alias("grade"), F.min("purpose").alias("purpose"), F.min("term").alias("term"),
        F.count("*").alias("n_loans"), F.avg("label").alias("positive_rate"))


def popular_items(catalog: DataFrame, k: int) -> DataFrame:
    return catalog.orderBy(F.desc("n_loans"), "item_id").limit(k)


def by_popularity(catalog: DataFrame) -> DataFrame:
    """The whole catalog with `position`, 1 for the product taken most often; ties by id."""
    keyed = settle(catalog.withColumn("_order", F.struct((-F.col("n_loans")).alias("n"), "item_id")))
    return keyed.join(dense_index(keyed, "_order", "_at"), "_order").withColumn("position", F.col("_at") + 1).drop("_order", "_at")


def latest_profile(loans: DataFrame, columns: list[str]) -> DataFrame:
    """Per user the latest value that is present, for each column on its own.

    Loans of one month are ordered by their id and then by the value itself, so
    the answer does not depend on the order rows arrive in.
    """
    return loans.groupBy("member_id").agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct("issue_d", "id", c)))[c].alias(c) for c in columns])


def top_states(users: DataFrame, n: int = TOP_N_STATES) -> DataFrame:
    return (users.filter("addr_state IS NOT NULL").groupBy("addr_state").agg(F.count("*").alias("n_users"))
            .orderBy(F.desc("n_users"), "addr_state").limit(n))


def collapse_states(users: DataFrame, top: DataFrame) -> DataFrame:
    """States outside the top ones, and missing ones, become `other`. The top list is at most a few rows."""
    marked = top.select("addr_state", F.lit(True).alias("_top"))
    return (users.join(F.broadcast(marked), "addr_state", "left")
            .withColumn("addr_state", F.when(F.col("_top"), F.col("addr_state")).otherwise(RARE_CATEGORY))
            .drop("_top"))


def item_popularity(positives: DataFrame, power: float = POPULARITY_POWER) -> DataFrame:
    """Repaid loans per product and the sampling weight, which sums to one."""
    counts = positives.groupBy("item_id").agg(F.sum("r").cast("bigint").alias("popularity"))
    raised = F.pow(F.col("popularity").cast("double"), F.lit(power))
    total = counts.agg(F.sum(raised).alias("total")).scalar()
    return counts.withColumn("weight", raised / total)


def _cumulative_cells(weights: DataFrame, cells: int) -> DataFrame:
    """Each product's stretch [low, high) of the unit line, repeated for every cell it touches.

    Looking a number up is then an equality on its cell plus a comparison, in
    place of a range join over all products.
    """
    stretch = running_totals(weights.select("item_id", "weight"), "item_id", ["weight"]).select(
        F.col("item_id").alias("neg_item_id"), F.col("weight_before").alias("low"),
        (F.col("weight_before") + F.col("weight")).alias("high"))
    first, last = F.floor(F.col("low") * cells), F.least(F.lit(cells - 1), F.floor(F.col("high") * cells))
    return stretch.withColumn("cell", F.explode(F.sequence(first, F.greatest(first, last))))


def _draw(positives: DataFrame, stretches: DataFrame, cells: int, tries: tuple[int, int], seed: int) -> DataFrame:
    """One candidate product per positive and try number in [tries)."""
    digest_range = F.sequence(F.lit(tries[0] // DRAWS_PER_DIGEST), F.lit(tries[1] // DRAWS_PER_DIGEST - 1))
    numbered = positives.select("member_id", "item_id", F.explode(digest_range).alias("digest"))
    drawn = numbered.select("member_id", "item_id", F.posexplode(F.array(*[
        (uniform_word("member_id", "item_id", "digest", seed=seed, word=F.lit(w)) + F.lit(0.5)) / F.lit(RESOLUTION)
        for w in range(DRAWS_PER_DIGEST)])).alias("word", "u"), "digest")
    looked_up = join_lookup(drawn.withColumn("cell", F.floor(F.col("u") * cells)), stretches, ["cell"])
    return looked_up.filter("u >= low AND u < high").select(
        "member_id", "item_id", "neg_item_id",
        (F.col("digest") * DRAWS_PER_DIGEST + F.col("word")).cast("int").alias("attempt"))


def _parts(positives: DataFrame, n_draws: int) -> tuple[int, ...]:
    """Into how many parts to cut so many draws, so that what a task sorts does not grow with the input; few are left to Spark."""
    parts = -(-n_draws // DRAWS_PER_TASK)
    return (parts,) if parts > positives.sparkSession.sparkContext.defaultParallelism else ()


def _accept(draws: DataFrame, positives: DataFrame, k: int, cut: tuple[int, ...], before: DataFrame | None = None) -> DataFrame:
    """First k different products per positive that the user never took, those accepted `before` among them.

    `full` says whether there are k of them.
    """
    seen = positives.select("member_id", F.col("item_id").alias("neg_item_id"))
    names = ["member_id", "item_id", "neg_item_id", "attempt"]
    if cut:
        draws, seen = draws.repartition(*cut, "member_id", "neg_item_id"), seen.repartition(*cut, "member_id", "neg_item_id")
    fresh = draws.join(seen, ["member_id", "neg_item_id"], "left_anti").select(*names)
    if before is not None:
        fresh = fresh.unionByName(before.select(*names))
    # Grouping and ranking share one partitioning.
    fresh = fresh.repartition(*cut, "member_id", "item_id").groupBy("member_id", "item_id", "neg_item_id").agg(F.min("attempt").alias("attempt"))
    own = Window.partitionBy("member_id", "item_id")
    turn, full = F.row_number().over(own.orderBy("attempt")), F.count("*").over(own) >= k
    return fresh.withColumns({"turn": turn, "full": full}).filter(F.col("turn") <= k)


def sample_negatives(positives: DataFrame, k: int = NEGATIVES_PER_POSITIVE, seed: int = SEED,
                     power: float = POPULARITY_POWER, cells: int = 4096) -> DataFrame:
    """For each distinct positive, up to k products the user never took, drawn by popularity.

    Draws are repeated until k products are accepted or k*20 tries are used. A
    first pass makes 2k tries for everyone; only the positives still short go on
    with the rest, so the usual cost is a tenth of drawing all tries.
    """
    pairs = settle(positives.groupBy("member_id", "item_id").agg(F.sum("r").alias("r")))
    stretches = settle(_cumulative_cells(item_popularity(pairs, power), cells))
    all_tries, first_tries = k * TRIES_PER_NEGATIVE, -(-2 * k // DRAWS_PER_DIGEST) * DRAWS_PER_DIGEST
    names = ["member_id", "item_id", "neg_item_id", "turn"]
    cut = _parts(pairs, pairs.count() * first_tries)
    first = settle(_accept(_draw(pairs, stretches, cells, (0, first_tries), seed), pairs, k, cut).select(*names, "attempt", "full"))
    # A positive without an id is not found again by the join below, so it goes on with what was begun.
    full = F.col("full") & F.col("member_id").isNotNull() & F.col("item_id").isNotNull()
    done, every = first.filter(full & (F.col("turn") == 1)).select("member_id", "item_id"), pairs
    if cut:
        done, every = done.repartition(*cut, "member_id", "item_id"), pairs.repartition(*cut, "member_id", "item_id")
    short = settle(every.join(done, ["member_id", "item_id"], "left_anti"))
    cut = _parts(pairs, short.count() * (all_tries - first_tries))
    again = _accept(_draw(short, stretches, cells, (first_tries, all_tries), seed), pairs, k, cut, first.filter(~full))
    return first.filter(full).select(*names).unionByName(again.select(*names))


def uniform_negatives(positives: DataFrame, users: DataFrame, items: DataFrame, n_users: int, n_items: int,
                      k: int = NEGATIVES_PER_POSITIVE, seed: int = SEED) -> DataFrame:
    """k pairs per positive with user and product drawn independently; may hit positives.

    `users` and `items` are the numbered lists (user_idx, item_idx).
    """
    drawn = (positives.select("member_id", "item_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("n"))
             .withColumn("user_idx", F.pmod(uniform_word("member_id", "item_id", "n", seed=seed), F.lit(n_users)).cast("int"))
             .withColumn("item_idx", F.pmod(uniform_word("member_id", "item_id", "n", seed=seed + 1), F.lit(n_items)).cast("int"))
             .select("user_idx", "item_idx"))
    return join_lookup(drawn.join(users, "user_idx"), settle(items), ["item_idx"]).select("member_id", "item_id")


def training_pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positives labelled 1 and sampled negatives labelled 0."""
    return positives.select("member_id", "item_id", F.lit(1).alias("label")).unionByName(
        negatives.select("member_id", F.col("neg_item_id").alias("item_id"), F.lit(0).alias("label")))
