"""Data preparation: scans, cleaning, catalog, encoding, sampling, negatives, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.constants import SAMPLE_FLOOR, SAMPLE_RATE, SEED, USER_NUMERIC
from creditloom.functions.text import item_part
from creditloom.operators import features, preparation as prep, sampling
from creditloom.operators.ordering import dense_index
from creditloom.queries.common import RAW, uniform_word, with_catalog, with_loans
from creditloom.queries.registry import query
from creditloom.session import scratch_path, settle
from creditloom.sources.files import find_vintages, scan_loan_csv, scan_vintages, write_csv, write_interactions
from creditloom.sources.loans import loans, raw_loans


@query("popular_items", sql=with_catalog("""
SELECT item_id, grade, purpose, term, n_loans, round(positive_rate, 6) AS positive_rate,
  round(int_rate, 4) AS int_rate, round(loan_amnt, 2) AS loan_amnt
FROM catalog ORDER BY n_loans DESC, item_id LIMIT 10"""))
def popular_items(spark, folder):
    catalog = prep.item_catalog(loans(spark, folder, "item_id", "int_rate", "loan_amnt", "grade", "purpose", "term", "label"))
    return prep.popular_items(catalog, 10).select(
        "item_id", "grade", "purpose", "term", "n_loans", F.round("positive_rate", 6).alias("positive_rate"),
        F.round("int_rate", 4).alias("int_rate"), F.round("loan_amnt", 2).alias("loan_amnt"))


@query("item_catalog", sql=with_catalog("""
SELECT item_id, item_idx::INTEGER AS item_idx, grade, purpose, term, n_loans, round(positive_rate, 6) AS positive_rate,
  round(int_rate, 4) AS int_rate, round(loan_amnt, 2) AS loan_amnt
FROM catalog"""))
def item_catalog(spark, folder):
    catalog = settle(prep.item_catalog(
        loans(spark, folder, "item_id", "int_rate", "loan_amnt", "grade", "purpose", "term", "label")))
    return catalog.join(dense_index(catalog, "item_id", "item_idx"), "item_id").select(
        "item_id", "item_idx", "grade", "purpose", "term", "n_loans", F.round("positive_rate", 6).alias("positive_rate"),
        F.round("int_rate", 4).alias("int_rate"), F.round("loan_amnt", 2).alias("loan_amnt"))


@query("vintage_user_ids", sql="WITH " + RAW + """
SELECT year(issue_date)::INTEGER AS issue_year, count(*) AS n_loans,
  count(DISTINCT CASE WHEN year(issue_date) < 1998 THEN id::VARCHAR ELSE member_id::VARCHAR END) AS n_users
FROM raw GROUP BY year(issue_date)""")
def vintage_user_ids(spark, folder):
    """Two files in one folder; the older one has no user ids, so there the loan's own id stands in."""
    rows = settle(raw_loans(spark, folder, "member_id", "id", "loan_status", "issue_d"))
    year = F.substring("issue_d", 5, 4).cast("int")
    root = scratch_path(spark, "vintages")
    write_csv(rows.filter(year < 1998).select("loan_status", "id", "issue_d"), f"{root}/accepted_old.csv")
    write_csv(rows.filter(year >= 1998).select("issue_d", "id", "member_id", "loan_status"), f"{root}/accepted_new.csv")
    both = scan_vintages(spark, find_vintages(spark, root), ["member_id", "issue_d"])
    return both.groupBy(year.alias("issue_year")).agg(F.count("*").alias("n_loans"), F.countDistinct("member_id").alias("n_users"))


@query("loan_csv_scan", sql="WITH " + RAW + """
SELECT grade, term, count(*) AS n_loans, sum(loan_amnt::DECIMAL(18,2))::DOUBLE AS loan_amnt
FROM raw GROUP BY grade, term""")
def loan_csv_scan(spark, folder):
    path = scratch_path(spark, "loans-csv")
    # Not in the layout's order, and with a column the layout does not have.
    write_csv(raw_loans(spark, folder).select(
        "id", "member_id", "issue_d", "loan_status", "grade", F.lit("n").alias("note"), "purpose", "term", "int_rate",
        "loan_amnt", "annual_inc", "dti", "home_ownership", "addr_state", "emp_length", "fico_range_high", "fico_range_low"), path)
    return (scan_loan_csv(spark, path, "grade", "term", "loan_amnt").groupBy("grade", "term").agg(
        F.count("*").alias("n_loans"), F.sum(F.col("loan_amnt").cast("decimal(18,2)")).cast("double").alias("loan_amnt")))


@query("vintage_scan", sql="WITH " + RAW + """
SELECT year(issue_date)::INTEGER AS issue_year, count(*) AS n_loans, count(dti) FILTER (year(issue_date) >= 1998) AS n_dti,
  count(emp_length) FILTER (year(issue_date) < 1998) AS n_emp_length
FROM raw GROUP BY year(issue_date)""")
def vintage_scan(spark, folder):
    rows = settle(raw_loans(spark, folder, "member_id", "id", "loan_status", "issue_d", "dti", "emp_length"))
    year = F.substring("issue_d", 5, 4).cast("int")
    old, new = scratch_path(spark, "vintage"), scratch_path(spark, "vintage")
    write_csv(rows.filter(year < 1998).drop("dti"), old)
    write_csv(rows.filter(year >= 1998).drop("emp_length"), new)
    merged = scan_vintages(spark, [old, new], ["id", "loan_status", "issue_d", "dti", "emp_length"])
    return prep.loan_rows_only(merged).groupBy(year.alias("issue_year")).agg(
        F.count("*").alias("n_loans"), F.count("dti").alias("n_dti"), F.count("emp_length").alias("n_emp_length"))


@query("user_id_fallback", sql="WITH " + RAW + """
SELECT id AS member_id, count(*) AS n_loans, sum(loan_amnt::DECIMAL(18,2))::DOUBLE AS loan_amnt FROM raw GROUP BY id""")
def user_id_fallback(spark, folder):
    rows = raw_loans(spark, folder, "id", "loan_amnt").withColumn("member_id", F.lit(None).cast("string"))
    return prep.with_user_id(rows).groupBy("member_id").agg(
        F.count("*").alias("n_loans"), F.sum(F.col("loan_amnt").cast("decimal(18,2)")).cast("double").alias("loan_amnt"))


@query("cleaned_loans", sql=with_loans("""
SELECT id, member_id, item_id, label::INTEGER AS label, split, strftime(issue_d, '%Y-%m-%d') AS issue_d, loan_status FROM loans"""))
def cleaned_loans(spark, folder):
    rows = raw_loans(spark, folder, "id", "member_id", "loan_status", "issue_d", "grade", "purpose", "term")
    return prep.clean_loans(prep.with_user_id(rows)).select(
        "id", "member_id", "item_id", "label", "split", F.col("issue_d").cast("string").alias("issue_d"), "loan_status")


@query("number_coercion", sql="WITH " + RAW + """, texts AS (
  SELECT member_id, CASE WHEN dti IS NULL THEN 'n/a' ELSE dti::VARCHAR END AS dti_text FROM raw)
SELECT member_id, count(*) AS n_rows, count(try_cast(dti_text AS DOUBLE)) AS n_numbers,
  round(avg(try_cast(dti_text AS DOUBLE)), 6) AS mean_dti FROM texts GROUP BY member_id""")
def number_coercion(spark, folder):
    rows = raw_loans(spark, folder, "member_id", "dti").withColumn(
        "dti_text", F.coalesce(F.col("dti").cast("string"), F.lit("n/a")))
    number = F.col("dti_text").try_cast("double")
    return rows.groupBy("member_id").agg(F.count("*").alias("n_rows"), F.count(number).alias("n_numbers"),
                                         F.round(F.avg(number), 6).alias("mean_dti"))


@query("split_statistics", sql=with_loans("""
SELECT split, count(*) AS n_loans, count(DISTINCT member_id) AS n_users, count(DISTINCT item_id) AS n_items,
  count(DISTINCT CASE WHEN label = 1 THEN member_id || '|' || item_id END) AS n_positive_pairs,
  round(avg(label), 6) AS positive_rate,
  round(1.0::DOUBLE - count(DISTINCT CASE WHEN label = 1 THEN member_id || '|' || item_id END)::DOUBLE
    / (count(DISTINCT member_id) * count(DISTINCT item_id)), 6) AS sparsity
FROM loans GROUP BY split"""))
def split_statistics(spark, folder):
    pairs = loans(spark, folder, "split", "member_id", "item_id", "label").groupBy("split", "member_id", "item_id").agg(
        F.count("*").alias("n"), F.sum("label").alias("pos"))
    # Users and products are counted from the pair table, which is all that is left after one shuffle.
    return pairs.groupBy("split").agg(
        F.sum("n").alias("n_loans"), F.countDistinct("member_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"), F.count_if(F.col("pos") > 0).alias("n_positive_pairs"),
        F.round(F.sum("pos") / F.sum("n").cast("double"), 6).alias("positive_rate"),
        F.round(F.lit(1.0) - F.count_if(F.col("pos") > 0).cast("double")
                / (F.countDistinct("member_id") * F.countDistinct("item_id")), 6).alias("sparsity"))


@query("interaction_counts", sql=with_loans("""
SELECT split, member_id, item_id, count(*) AS r FROM loans WHERE label = 1 GROUP BY ALL"""))
def interaction_counts(spark, folder):
    counts = prep.positive_interactions(loans(spark, folder, "split", "member_id", "item_id", "label"), "split")
    path = scratch_path(spark, "interactions")
    write_interactions(counts, path)
    return spark.read.parquet(path).select("split", "member_id", "item_id", "r")


@query("distinct_items", sql=with_loans("SELECT DISTINCT item_id FROM loans"))
def distinct_items(spark, folder):
    return loans(spark, folder, "item_id").distinct()


@query("item_id_parts", sql=with_loans("""
SELECT item_id, grade AS id_grade, purpose AS id_purpose, term AS id_term, count(*) AS n_loans FROM loans GROUP BY ALL"""))
def item_id_parts(spark, folder):
    counted = loans(spark, folder, "item_id").groupBy("item_id").agg(F.count("*").alias("n_loans"))
    return counted.select("item_id", *[item_part(F.col("item_id"), p).alias(f"id_{p}") for p in ("grade", "purpose", "term")],
                          "n_loans")


@query("user_index", sql=with_loans("""
SELECT member_id, (row_number() OVER (ORDER BY member_id) - 1)::INTEGER AS user_idx
FROM (SELECT DISTINCT member_id FROM loans)"""))
def user_index(spark, folder):
    return dense_index(loans(spark, folder, "member_id"), "member_id", "user_idx")


@query("top_states", sql=with_loans("""
SELECT addr_state, count(*) AS n_users FROM (SELECT DISTINCT member_id, addr_state FROM loans)
GROUP BY addr_state ORDER BY n_users DESC, addr_state LIMIT 10"""))
def top_states(spark, folder):
    return prep.top_states(loans(spark, folder, "member_id", "addr_state").distinct())


PROFILES = """
profiles AS (
  SELECT member_id,
    arg_max(annual_inc, (issue_d, id, annual_inc)) FILTER (annual_inc IS NOT NULL) AS annual_inc,
    arg_max(dti, (issue_d, id, dti)) FILTER (dti IS NOT NULL) AS dti,
    arg_max(fico_range_low, (issue_d, id, fico_range_low)) FILTER (fico_range_low IS NOT NULL) AS fico_range_low,
    arg_max(fico_range_high, (issue_d, id, fico_range_high)) FILTER (fico_range_high IS NOT NULL) AS fico_range_high,
    arg_max(home_ownership, (issue_d, id, home_ownership)) FILTER (home_ownership IS NOT NULL) AS home_ownership,
    arg_max(addr_state, (issue_d, id, addr_state)) FILTER (addr_state IS NOT NULL) AS addr_state
  FROM loans GROUP BY member_id
), top_states AS (
  SELECT addr_state FROM profiles GROUP BY addr_state ORDER BY count(*) DESC, addr_state LIMIT 10
), user_rows AS (
  SELECT * REPLACE (CASE WHEN addr_state IN (FROM top_states) THEN addr_state ELSE 'other' END AS addr_state) FROM profiles
)"""

PROFILE_COLUMNS = ["annual_inc", "dti", "fico_range_low", "fico_range_high", "home_ownership", "addr_state"]


def profiles_of(spark, folder):
    return prep.latest_profile(loans(spark, folder, "member_id", "issue_d", "id", *PROFILE_COLUMNS), PROFILE_COLUMNS)


@query("latest_profile", sql=with_loans("SELECT * FROM profiles", PROFILES))
def latest_profile(spark, folder):
    return profiles_of(spark, folder)


@query("collapsed_states", sql=with_loans("SELECT addr_state, count(*) AS n_users FROM user_rows GROUP BY addr_state", PROFILES))
def collapsed_states(spark, folder):
    users = settle(loans(spark, folder, "member_id", "addr_state").distinct())
    return features.user_rows(users).groupBy("addr_state").agg(F.count("*").alias("n_users"))


def _standardised(table: str, key: str, columns) -> str:
    fills = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM {table})) AS {c}" for c in columns)
    parts = " UNION ALL ".join(
        f"SELECT {key}, '{c}' AS feature, round(({c} - (SELECT avg({c}) FROM filled)) / "
        f"(SELECT stddev_pop({c}) FROM filled), 6) + 0.0 AS value FROM filled" for c in columns)
    return f"filled AS (SELECT {key}, {fills} FROM {table}), numeric_features AS ({parts})"


def _one_hot(table: str, key: str, columns) -> str:
    parts = " UNION ALL ".join(
        f"SELECT t.{key}, '{c}=' || v AS feature, CASE WHEN coalesce(t.{c}, 'Unknown') = v THEN 1.0 ELSE 0.0 END::DOUBLE AS value "
        f"FROM {table} t CROSS JOIN (SELECT DISTINCT coalesce({c}, 'Unknown') AS v FROM {table})" for c in columns)
    return f"category_features AS ({parts})"


_LONG = "SELECT * FROM numeric_features UNION ALL SELECT * FROM category_features"


@query("user_features", sql=with_loans(_LONG, PROFILES, _standardised("user_rows", "member_id", USER_NUMERIC),
                                       _one_hot("user_rows", "member_id", ("home_ownership", "addr_state"))))
def user_features(spark, folder):
    rows = settle(features.user_rows(settle(profiles_of(spark, folder))))
    spec = features.fit_features(rows, USER_NUMERIC, ("home_ownership", "addr_state"))
    return features.long_form(rows, "member_id", spec).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("item_features", sql=with_catalog(_LONG, _standardised("catalog", "item_id", ("int_rate", "loan_amnt")),
                                         _one_hot("catalog", "item_id", ("grade", "purpose", "term"))))
def item_features(spark, folder):
    catalog = settle(prep.item_catalog(
        loans(spark, folder, "item_id", "int_rate", "loan_amnt", "grade", "purpose", "term", "label")))
    spec = features.fit_item_features(catalog)
    return features.long_form(catalog, "item_id", spec).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("unseen_category_features", sql=with_loans("""
SELECT o.member_id, CASE WHEN o.addr_state IN (SELECT addr_state FROM train_top) THEN 1.0 ELSE 0.0 END::DOUBLE AS listed_state,
  (SELECT count(*) FROM train_homes WHERE v = coalesce(o.home_ownership, 'Unknown'))::DOUBLE AS listed_home
FROM test_profiles o""", """
  train_users AS (SELECT DISTINCT member_id, addr_state, home_ownership FROM loans WHERE split = 'train'),
  train_top AS (SELECT addr_state FROM train_users GROUP BY 1 ORDER BY count(*) DESC, addr_state LIMIT 10),
  train_homes AS (SELECT DISTINCT home_ownership AS v FROM train_users WHERE home_ownership IS NOT NULL),
  test_profiles AS (SELECT DISTINCT member_id, addr_state, home_ownership FROM loans)"""))
def unseen_category_features(spark, folder):
    """Lists fitted on train users with a known home; everyone transformed. `Unknown` was never seen, so it gives zeros."""
    users = settle(loans(spark, folder, "member_id", "addr_state", "home_ownership", "split").distinct())
    train = users.filter("split = 'train'").select("member_id", "addr_state", "home_ownership").distinct()
    listed = [r.addr_state for r in prep.top_states(train).collect()]
    spec = features.FeatureSpec({}, {}, {}, {
        "home_ownership": features.category_values(train.filter("home_ownership IS NOT NULL"), "home_ownership"),
        "addr_state": sorted(listed)})
    people = users.select("member_id", "addr_state", "home_ownership").distinct()
    total = lambda field: sum((c for f, c in zip(spec.fields(), spec.columns()) if f == field), F.lit(0.0))
    return people.select("member_id", total("addr_state").alias("listed_state"), total("home_ownership").alias("listed_home"))


@query("feature_dimensions", sql=with_catalog("""
SELECT (4 + (SELECT count(DISTINCT coalesce(home_ownership, 'Unknown')) + count(DISTINCT addr_state) FROM user_rows))::INTEGER AS user_feat_dim,
  (2 + (SELECT count(DISTINCT grade) + count(DISTINCT purpose) + count(DISTINCT term) FROM catalog))::INTEGER AS item_feat_dim,
  (SELECT count(*) FROM user_rows) AS n_users, (SELECT count(*) FROM catalog) AS n_items""", PROFILES))
def feature_dimensions(spark, folder):
    users = settle(features.user_rows(settle(profiles_of(spark, folder))))
    catalog = settle(prep.item_catalog(
        loans(spark, folder, "item_id", "int_rate", "loan_amnt", "grade", "purpose", "term", "label")))
    user_dim = len(features.fit_features(users, USER_NUMERIC, ("home_ownership", "addr_state")).names())
    item_dim = len(features.fit_item_features(catalog).names())
    n_items = catalog.agg(F.count("*").alias("n")).scalar()
    return users.agg(F.lit(user_dim).alias("user_feat_dim"), F.lit(item_dim).alias("item_feat_dim"),
                     F.count("*").alias("n_users")).withColumn("n_items", n_items)


_SAMPLED = """
keyed AS (SELECT *, {word} AS u FROM clean),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY u, id) AS turn FROM keyed),
counts AS (SELECT grade, count(*) AS n FROM clean GROUP BY grade)""".format(word=uniform_word("id", seed=SEED))


@query("stratified_sample", sql=with_loans("""
SELECT grade, id FROM ranked JOIN sizes USING (grade) WHERE turn <= wanted""", _SAMPLED, """
quotas AS (SELECT grade, n, n * 0.07::DOUBLE AS q, floor(n * 0.07::DOUBLE)::BIGINT AS base FROM counts),
turns AS (SELECT *, row_number() OVER (ORDER BY round(q - base, 9) DESC, grade) AS t,
  floor((SELECT sum(n) FROM counts)::DOUBLE * 0.07::DOUBLE)::BIGINT - (SELECT sum(base) FROM quotas)::BIGINT AS rest FROM quotas),
sizes AS (SELECT grade, base + CASE WHEN t <= rest THEN 1 ELSE 0 END AS wanted FROM turns)"""))
def stratified_sample(spark, folder):
    rows = loans(spark, folder, "grade", "id", signal_only=False)
    return sampling.sample_groups(rows, "grade", "id", lambda n: sampling.proportional_sizes(n, "grade", SAMPLE_RATE), SEED)


@query("floored_sample", sql=with_loans("""
SELECT grade, id FROM ranked JOIN counts USING (grade) WHERE turn <= least(n, greatest(30, floor(n * 0.07::DOUBLE)))""", _SAMPLED))
def floored_sample(spark, folder):
    rows = loans(spark, folder, "grade", "id", signal_only=False)
    return sampling.sample_groups(
        rows, "grade", "id", lambda n: sampling.floored_sizes(n, "grade", SAMPLE_RATE, SAMPLE_FLOOR), SEED)


USER_TYPES = """
user_types AS (
  SELECT member_id, bool_or(label = 1 AND split = 'train') AS warm, bool_or(label = 1 AND split = 'test') AS tested
  FROM loans GROUP BY member_id
)"""


def user_types(spark, folder):
    positive = F.col("label") == 1
    return loans(spark, folder, "member_id", "label", "split").groupBy("member_id").agg(
        F.bool_or(positive & (F.col("split") == "train")).alias("warm"),
        F.bool_or(positive & (F.col("split") == "test")).alias("tested"))


@query("random_users", sql=with_loans(f"""
SELECT member_id FROM user_types WHERE tested ORDER BY {uniform_word("member_id", seed=SEED)}, member_id LIMIT 500""", USER_TYPES))
def random_users(spark, folder):
    return sampling.smallest_by_hash(user_types(spark, folder).filter("tested").select("member_id"), "member_id", 500, SEED)


@query("warm_first_users", sql=with_loans(f"""
SELECT member_id, CASE WHEN warm THEN 'Warm Start' ELSE 'Cold Start' END AS user_type FROM user_types WHERE tested
ORDER BY warm DESC, {uniform_word("member_id", seed=SEED)}, member_id LIMIT 1000""", USER_TYPES))
def warm_first_users(spark, folder):
    """Warm users up to the wanted number, cold users for what is left of it."""
    tested = user_types(spark, folder).filter("tested")
    return sampling.smallest_by_hash(tested, "member_id", 1000, SEED, first=F.desc("warm")).select(
        "member_id", F.when(F.col("warm"), "Warm Start").otherwise("Cold Start").alias("user_type"))


@query("warm_cold_users", sql=with_loans("""
SELECT member_id, CASE WHEN warm THEN 'Warm Start' ELSE 'Cold Start' END AS user_type FROM user_types WHERE tested""", USER_TYPES))
def warm_cold_users(spark, folder):
    return user_types(spark, folder).filter("tested").select(
        "member_id", F.when(F.col("warm"), "Warm Start").otherwise("Cold Start").alias("user_type"))


POSITIVES = "positives AS (SELECT member_id, item_id, count(*) AS r FROM loans WHERE label = 1 AND split = 'train' GROUP BY ALL)"
POPULARITY = """
popularity AS (
  SELECT item_id, sum(r)::BIGINT AS popularity, pow(sum(r)::DOUBLE, 0.75) / sum(pow(sum(r)::DOUBLE, 0.75)) OVER () AS weight
  FROM positives GROUP BY item_id
)"""


def train_positives(spark, folder):
    rows = loans(spark, folder, "split", "member_id", "item_id", "label").filter("split = 'train'")
    return prep.positive_interactions(rows)


@query("item_popularity", sql=with_loans("SELECT item_id, popularity, round(weight, 9) AS weight FROM popularity", POSITIVES, POPULARITY))
def item_popularity(spark, folder):
    return prep.item_popularity(settle(train_positives(spark, folder))).withColumn("weight", F.round("weight", 9))


NEGATIVES = """
stretches AS (
  SELECT item_id AS neg_item_id, coalesce(sum(weight) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS low,
    sum(weight) OVER (ORDER BY item_id) AS high FROM popularity
), draws AS (
  SELECT member_id, item_id, digest * 4 + word AS attempt,
    (('0x' || substr(md5(concat_ws('|', member_id, item_id, digest, '42')), 1 + 8 * word::INT, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM positives CROSS JOIN range(20) d(digest) CROSS JOIN range(4) w(word)
), fresh AS (
  SELECT d.member_id, d.item_id, s.neg_item_id, min(attempt) AS attempt
  FROM draws d JOIN stretches s ON d.u >= s.low AND d.u < s.high
    ANTI JOIN positives p ON p.member_id = d.member_id AND p.item_id = s.neg_item_id
  GROUP BY ALL
), negatives AS (
  SELECT member_id, item_id, neg_item_id, row_number() OVER (PARTITION BY member_id, item_id ORDER BY attempt)::INTEGER AS turn
  FROM fresh QUALIFY turn <= 4
)"""


@query("negative_samples", sql=with_loans("SELECT * FROM negatives", POSITIVES, POPULARITY, NEGATIVES))
def negative_samples(spark, folder):
    return prep.sample_negatives(train_positives(spark, folder))


@query("training_pairs", sql=with_loans("""
SELECT member_id, item_id, 1 AS label FROM positives UNION ALL SELECT member_id, neg_item_id, 0 FROM negatives""",
                                        POSITIVES, POPULARITY, NEGATIVES))
def training_pairs(spark, folder):
    positives = settle(train_positives(spark, folder))
    return prep.training_pairs(positives, prep.sample_negatives(positives))


@query("uniform_negatives", sql=with_loans(f"""
SELECT u.member_id, i.item_id FROM (
  SELECT {uniform_word("member_id", "item_id", "n", seed=42)} % (SELECT count(*) FROM users) AS user_idx,
    {uniform_word("member_id", "item_id", "n", seed=43)} % (SELECT count(*) FROM items) AS item_idx
  FROM positives CROSS JOIN range(1, 5) t(n)) JOIN users u USING (user_idx) JOIN items i USING (item_idx)""", POSITIVES, """
users AS (SELECT member_id, row_number() OVER (ORDER BY member_id) - 1 AS user_idx FROM (SELECT DISTINCT member_id FROM loans)),
items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT DISTINCT item_id FROM loans))"""))
def uniform_negatives(spark, folder):
    pairs = settle(loans(spark, folder, "member_id", "item_id").distinct())
    users, items = dense_index(pairs, "member_id", "user_idx"), dense_index(pairs, "item_id", "item_idx")
    return prep.uniform_negatives(train_positives(spark, folder), users, items, users.count(), items.count())
