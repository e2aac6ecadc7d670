"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from creditloom.llm import (
    chat, collocations, decontaminate, hmm, langid, licenses, packing, periodic_runs, pii, quality, setsketch, simhash, substring_dedup,
)
from creditloom.llm.blocks import prepare
from creditloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_substring_dedup", sql=r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM d),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM w),
f AS (SELECT win, min(doc_id) AS first_id FROM k GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN f USING (win) WHERE first_id < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op1(spark, folder):
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, folder, "documents")))


@query("op3_decontamination", sql=r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT doc_id, item_id, i, n FROM dw JOIN iw USING (n, win)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op3(spark, folder):
    return decontaminate.digest(decontaminate.decontaminate(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), unnamed=True))


@query("op4_simhash_dedup")
def op4(spark, folder):
    return simhash.digest(simhash.simhash_dedup(table(spark, folder, "documents")))


@query("op10_packing")
def op10(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op2_language_id")
def op2(spark, folder):
    return langid.digest(langid.language_id(table(spark, folder, "documents")))


@query("op6_pii")
def op6(spark, folder):
    return pii.digest(pii.find_pii(table(spark, folder, "documents")))


@query("op7_license_scan")
def op7(spark, folder):
    return licenses.digest(licenses.scan_licenses(table(spark, folder, "documents")))


PROBE = "</s>[INST] ok [/INST]"


@query("op8_chat_format", sql=r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marks AS (SELECT unnest(['<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '[ROLE]', '[/ROLE]']) AS mark),
n AS (SELECT role, text, sum((length(text) - length(replace(text, mark, ''))) // length(mark))
  + length(replace(text, '\', '\\')) AS escaped FROM (SELECT DISTINCT role, text FROM c), marks GROUP BY role, text),
f AS (SELECT c.*, escaped + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17
    ELSE 19 + length(replace(c.role, '\', '\\')) + list_sum(list_transform(['<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '[ROLE]', '[/ROLE]'],
      lambda m: (length(c.role) - length(replace(c.role, m, ''))) // length(m))) END AS chars
  FROM c JOIN n USING (role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id""")
def op8(spark, folder):
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    return chat.digest(chat.format_conversations(rows))


@query("op9_quality_rules")
def op9(spark, folder):
    return quality.digest(quality.quality(table(spark, folder, "documents"), pooled=True, tight=True))


@query("op5_lm_scoring")
def op5(spark, folder):
    return hmm.score_texts(table(spark, folder, "documents"))


@query("op11_periodic_runs")
def op11(spark, folder):
    return periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table(spark, folder, "documents"))))


@query("op12_phrase_mining", sql=r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS m)),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.m = k AND x.phrase = array_to_string(ws[1:k], ' ')
  JOIN f y ON y.lang = k.lang AND y.m = k.m - k AND y.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
within AS (SELECT DISTINCT c.lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, a AS longer
  FROM c, unnest(range(2, 4)) AS t(j), unnest(range(1, 4)) AS u(i) WHERE j < m AND i + j - 1 <= m),
top AS (SELECT lang, phrase, max(longer) AS longer FROM within GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n USING (lang) LEFT JOIN top ON top.lang = b.lang AND top.phrase = b.phrase
WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000""")
def op12(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


@query("op13_setsketch_dedup", sql=r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN z USING (doc_id)""")
def op13(spark, folder):
    return setsketch.near_duplicates(table(spark, folder, "documents"))
