"""Preparing a corpus: language, near-duplicates, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and all that the one before has kept. All
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import decontaminate, langid, packing, pii, simhash
from creditloom.llm.blocks import keeping, prepare
from creditloom.session import scratch_path
from creditloom.sources.tables import table

MAIN_SHARE = 0.5  # of a document that its main language has to reach

# SQL has no XXH64, no fitted models and no tokenizer.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null texts among them, and those in which no language has half of the text.

    Rows are judged one by one, so repeated ones stay or go together; a long text is judged whole.
    """
    return keeping(docs, ["held_out", "lang_pred", "score"], lambda d: langid.language_id(d).where(
        (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MAIN_SHARE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that with the smallest doc_id.

    Null, empty and blank texts are one group. Rows that share a doc_id are judged
    by their own texts; see `one_of_each` for ties.
    """
    return simhash.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; all others stay as they are, null and empty texts and repeated rows too.

    Benchmark rows without an id count; those without words do not.
    """
    added = ["n_words", "n_hit", "hit_items", "hit_unnamed", "hit_spans", "contaminated"]
    return keeping(docs, added, lambda d: decontaminate.decontaminate(
        d, table(spark, sf_dir, "benchmark"), unnamed=True).where(~F.col("contaminated")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets in the texts; n_chars becomes the new length.

    Null texts stay null; repeated rows are changed alike; other columns stay as they are.
    """
    out = keeping(docs, ["base_spans", "spans"], lambda d: pii.find_pii(d, replace=True))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document.

    A null text is packed as an empty one, repeated rows as often as they stand there.
    """
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages),
          ("personal_data", personal_data), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
