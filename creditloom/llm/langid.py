"""Language of a text as a mixture of languages.

Method: every learned language is a distribution over hashed letter trigrams.
Expectation-maximisation estimates the proportions with which a document mixes
the languages; languages are added one at a time, each only if the likelihood it
gains outweighs a penalty that grows with the logarithm of the document's length.
The predicted language has the largest share of the chosen set.

The model is one count per language and trigram bucket (`BUCKETS` of them, 256
kB a language), summed over all training documents by Spark; it is all that is
collected and broadcast.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.blocks import pieces, prepare

BUCKETS = 1 << 15
SMOOTHING = 0.5
ROUNDS = 12
TRIGRAMS_PER_LETTER = 3  # each letter is in three trigrams, which are not independent
PENALTY = 2.0  # per further language, times log(trigrams)
UNKNOWN = "und"
_TABLE_BYTES = 1_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of each letter trigram of whole texts, and the documents' letter counts."""
    lowered = [f"\n{t.lower()}\n" if t else "" for t in texts]
    lengths = np.array([len(t) for t in lowered], np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    letter = _letters()[codes]
    n_letters = np.bincount(doc[letter], minlength=len(texts))
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1]  # of what stands between words one mark stays, the one after a word
    keep[1:] |= doc[1:] != doc[:-1]
    codes, doc = np.where(letter, codes, 32)[keep].astype(np.uint64), doc[keep]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), n_letters
    mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(32)
    bucket = ((mixed * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    same = doc[:-2] == doc[2:]
    return doc[:-2][same], bucket[same], n_letters


def held_out() -> F.Column:
    """Documents not learned from: crc32(doc_id as text) modulo 4 is 2. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


class Mixture:
    """The languages' trigram distributions."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1])
        self.p = np.ascontiguousarray(p.T)  # bucket by language
        self.log_p = np.log(self.p)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        doc, bucket, n_letters = trigrams(texts)
        chosen, share = np.full(len(texts), -1), np.zeros(len(texts))
        if len(doc) and self.languages:
            keys, counts = np.unique(doc * BUCKETS + bucket, return_counts=True)
            known, first = np.unique(keys // BUCKETS, return_index=True)
            chosen[known], share[known] = self._mix(keys % BUCKETS, counts.astype(float), first)
        chosen[n_letters == 0] = -1
        labels = [self.languages[c] if c >= 0 else UNKNOWN for c in chosen]
        return labels, [float(s) if c >= 0 else 0.0 for c, s in zip(chosen, share)]

    def _mix(self, bucket, counts, first):
        n = np.add.reduceat(counts, first)
        single = np.add.reduceat(self.log_p[bucket] * counts[:, None], first)
        everyone = np.ones_like(single, bool)
        order_by, _ = self._maximise(bucket, counts, first, everyone)
        best = single.argmax(axis=1)
        mask = np.zeros_like(everyone)
        mask[np.arange(len(n)), best] = True
        shares, likelihood = mask.astype(float), single.max(axis=1)
        active = np.arange(len(n))
        for _ in range(len(self.languages) - 1):
            if not len(active):
                break
            wider = mask[active]
            following = np.where(wider, -1.0, order_by[active]).argmax(axis=1)
            wider[np.arange(len(active)), following] = True
            inside = np.isin(np.repeat(np.arange(len(n)), np.diff(np.append(first, len(bucket)))), active)
            sizes = np.diff(np.append(first, len(bucket)))[active]
            mixed, better = self._maximise(bucket[inside], counts[inside], np.cumsum(sizes) - sizes, wider)
            gained = (better - likelihood[active]) / TRIGRAMS_PER_LETTER > PENALTY * np.log(n[active] + 1)
            took = active[gained]
            mask[took], shares[took], likelihood[took] = wider[gained], mixed[gained], better[gained]
            active = took
        chosen = shares.argmax(axis=1)
        return chosen, shares[np.arange(len(n)), chosen]

    def _maximise(self, bucket, counts, first, mask):
        """Proportions and log likelihood of each document's languages in `mask`."""
        p = self.p[bucket]
        shares = mask / mask.sum(axis=1, keepdims=True)
        sizes = np.diff(np.append(first, len(bucket)))
        n = np.add.reduceat(counts, first)[:, None]
        for _ in range(ROUNDS):
            weighted = p * np.repeat(shares, sizes, axis=0)
            weighted *= (counts / weighted.sum(axis=1))[:, None]
            shares = np.add.reduceat(weighted, first) / n
        total = (p * np.repeat(shares, sizes, axis=0)).sum(axis=1)
        return shares, np.add.reduceat(counts * np.log(total), first)


def learn(docs: DataFrame) -> Mixture:
    """Trigram counts of all training documents: rows with text and lang that are not held out."""
    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for table in pieces(batches, "text", _TABLE_BYTES):
            doc, bucket, _ = trigrams(table["text"].to_pylist())
            langs = np.array(table["lang"].to_pylist(), object)
            for lang in sorted(set(langs)):
                counts = np.bincount(bucket[(langs == lang)[doc]], minlength=BUCKETS)
                totals[lang] = totals.get(lang, 0) + counts
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])],
                                             ["lang", "bucket", "n"])

    rows = docs.where("text is not null and lang is not null").where(~held_out()).select("lang", "text")
    counted = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    languages = sorted(got["lang"].unique())
    table = np.zeros((len(languages), BUCKETS))
    table[np.searchsorted(languages, got["lang"]) if len(got) else [], got["bucket"].astype(int)] = got["n"]
    return Mixture(languages, table)


def predict(docs: DataFrame, model: Mixture) -> DataFrame:
    """The rows of `docs`, all columns, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for table in pieces(batches, "text", _TABLE_BYTES):
            labels, scores = shared.value.predict(table["text"].to_pylist())
            table = table.append_column("lang_pred", pa.array(labels, pa.string())).append_column("score", pa.array(scores, pa.float64()))
            yield from table.combine_chunks().to_batches()

    rows = docs.drop("lang_pred", "score")
    return rows.mapInArrow(run, _with(rows, "lang_pred string, score double"))


def _with(df: DataFrame, more: str):
    from pyspark.sql.types import StructType
    return StructType(df.schema.fields + StructType.fromDDL(more).fields)


def language_id(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, ...) with held_out, lang_pred and score.

    Learns from text and lang of the training documents and predicts from text
    alone. A text that is null, empty or without a letter is `und` with score 0;
    so is every text if nothing can be learned from. Ties go to the language that
    sorts first. Columns named like the results are replaced, others pass through.
    """
    prepare(docs.sparkSession)
    return predict(docs, learn(docs)).withColumn("held_out", held_out())


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "held_out", "lang_pred", "score")
