"""Removing word runs that already stand in an earlier document.

Method: difference-cover anchors. With the cover {0, 1, 3} modulo 7, any two
positions can be shifted by the same d < 7 so that both land on cover positions.
Two equal runs of 13 words therefore share an equal run of 7 words (an anchor)
that starts at a cover position in both documents. Only anchors are hashed and
exchanged in the first round; only the 13-word windows around an anchor that
occurs in two documents go into the second, which is the extension step: the
window counts as repeated if the whole 13 words agree (64-bit hash).

Each round exchanges a key once per block of documents (see blocks.py), so a
passage that is in a third of all documents costs one entry per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.blocks import KEYED, aligned, answers, bits, from_bits, keyed_rows, n_buckets, prepare, rows, to_blocks, unpack
from creditloom.llm.words import distinct, hashes, rolling, spaced

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)  # every difference modulo 7 occurs between two of these
ANCHOR = WINDOW - PERIOD + 1
NO_ID = np.iinfo(np.int64).max  # documents without doc_id come after all others


class _Block:
    """The words of a block's documents, end to end."""

    def __init__(self, payload: bytes):
        table = unpack(payload)
        self.ids = table["doc_id"]
        self.words = [spaced(t) for t in table["text"].to_pylist()]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        hashed = [hashes(w) for w in self.words]
        self.hashed = np.concatenate(hashed) if hashed else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.words)), self.lengths)
        self.key = self.ids.fill_null(NO_ID).to_numpy()

    def whole(self, length: int) -> np.ndarray:
        """Whether the run of `length` words from each position stays in one document."""
        n = max(0, len(self.doc) - length + 1)
        return self.doc[:n] == self.doc[length - 1:length - 1 + n]

    def anchors(self):
        """Positions of anchors and their hashes."""
        cover = np.isin((np.arange(len(self.doc)) - self.starts[self.doc]) % PERIOD, COVER)
        at = np.flatnonzero(cover[:max(0, len(self.doc) - ANCHOR + 1)] & self.whole(ANCHOR))
        return at, rolling(self.hashed, ANCHOR)[at]

    def windows(self, anchors: np.ndarray):
        """Positions of the windows that contain one of the anchors, and their hashes."""
        change = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(change, np.maximum(anchors - (WINDOW - ANCHOR), self.starts[self.doc[anchors]]), 1)
        np.add.at(change, anchors + 1, -1)
        whole = self.whole(WINDOW)
        at = np.flatnonzero((np.cumsum(change)[:len(whole)] > 0) & whole)
        return at, rolling(self.hashed, WINDOW)[at]

    def shared_windows(self, found, buckets: int):
        at, hashed = self.anchors()
        keys, order, first = distinct(hashed)
        shared = aligned(keys, found, buckets, from_bits, bool)
        flags = np.empty(len(at), bool)
        flags[order] = np.repeat(shared, np.diff(np.append(first, len(at))))
        return self.windows(at[flags])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of `docs` (doc_id, text).

    A word goes if a 13-word window covering it also starts in a document with a
    smaller doc_id. Null and empty texts have no words and give an empty kept_text.
    Rows that repeat a doc_id are not smaller than each other, so none of them
    loses words to the other. A null doc_id counts as larger than any. An empty
    table gives no rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    blocks = to_blocks(docs, "doc_id", "text")
    buckets = n_buckets(blocks, 14)

    def send_anchors(batches):
        for block, payload in rows(batches):
            own = _Block(payload)
            at, hashed = own.anchors()
            keys, order, first = distinct(hashed)
            last = np.append(first[1:], len(at)) - 1
            docs_of = own.doc[at[order]]
            twice = (docs_of[first] != docs_of[last]) if len(at) else np.empty(0, bool)
            yield keyed_rows(block, keys, 1 + twice.astype(np.int64), buckets)

    def send_windows(batches):
        for block, payload, found in rows(batches):
            own = _Block(payload)
            at, hashed = own.shared_windows(found, buckets)
            keys, order, first = distinct(hashed)
            smallest = np.minimum.reduceat(own.key[own.doc[at[order]]], first) if len(at) else np.empty(0, np.int64)
            yield keyed_rows(block, keys, smallest, buckets)

    def remove(batches):
        for payload, found, earlier in rows(batches):
            own = _Block(payload)
            at, hashed = own.shared_windows(found, buckets)
            keys, order, first = distinct(hashed)
            change = np.zeros(len(own.doc) + WINDOW + 1, np.int64)
            if len(at):
                ids = own.key[own.doc[at[order]]]
                sizes = np.diff(np.append(first, len(at)))
                elsewhere = np.repeat(aligned(keys, earlier, buckets, from_bits, bool), sizes)
                gone = at[order][elsewhere | (np.repeat(np.minimum.reduceat(ids, first), sizes) < ids)]
                np.add.at(change, gone, 1)
                np.add.at(change, gone + WINDOW, -1)
            covered = np.cumsum(change)[:len(own.doc)] > 0
            removed, kept = [], []
            for words, start, n in zip(own.words, own.starts, own.lengths):
                out = covered[start:start + n]
                removed.append(int(out.sum()))
                kept.append((b" ".join(words if not removed[-1] else [w for w, x in zip(words, out) if not x])).decode())
            yield pa.RecordBatch.from_arrays(
                [own.ids.combine_chunks().cast(pa.int64()), pa.array(own.lengths, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    shared = answers(blocks.select("block", "payload").mapInArrow(send_anchors, KEYED), np.add,
                     lambda own, total: bits(total > 1))
    with_shared = blocks.select("block", "payload").join(shared, "block", "left")
    earlier = answers(with_shared.mapInArrow(send_windows, KEYED), np.minimum, lambda own, least: bits(least < own))
    return (with_shared.join(earlier.withColumnRenamed("answers", "earlier"), "block", "left")
            .select("payload", "answers", "earlier")
            .mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string"))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
