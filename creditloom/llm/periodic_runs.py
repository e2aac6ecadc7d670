"""Runs of words that repeat with a period, found exactly in every text.

Method: suffix-tree LCE. Ukkonen's algorithm builds the suffix trees of the
words and of their reversal. An Euler tour of a tree lists the string depths
between its leaves, and a sparse table over it answers the depth of any lowest
common ancestor, which is the longest common extension of two positions, in
constant time. The longest Lyndon word from each position, under the order of
the leaves and under its inverse, is the next smaller suffix; every run has one
of these as its root. Each root is extended to the right by the tree of the text and to
the left by the tree of the reversal.

A run of period q has at least max(6, 4q) words, so each of its five-word
windows recurs inside it within q words. Trees are therefore built over each
stretch of windows that recur within a quarter of the stretch; no run can cross
its ends, and a text without repeats needs no tree.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.blocks import pieces, prepare
from creditloom.llm.words import rolling, spaced

LEAST_WORDS = 6
LEAST_PERIODS = 4
_GRAM = 5           # in a run of at least 6 words and 4 periods each such window occurs twice
_NARROWING = 8      # passes that shorten stretches; more would only save time
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixTree:
    """The suffix tree of numbers from 1 up, which end with a 0 that occurs nowhere else.

    Inner nodes are numbered from 0, the root; ~j is the leaf of the suffix from j.
    """

    def __init__(self, text: list[int]):
        self.text = text
        self.children: list[dict[int, int]] = [{}]
        self.begin, self.stop = [0], [0]
        self.leaf_begin = [0] * len(text)
        self._build()

    def _build(self) -> None:
        text, children, begin, stop, leaf_begin, link = self.text, self.children, self.begin, self.stop, self.leaf_begin, [0]
        node = edge = length = suffix = 0
        for i, symbol in enumerate(text):
            unlinked = 0
            while suffix <= i:
                if not length:
                    edge = i
                below = children[node].get(text[edge])
                if below is None:
                    children[node][symbol] = ~suffix
                    leaf_begin[suffix] = i
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    if below < 0:
                        at = leaf_begin[~below]
                    else:
                        at = begin[below]
                        span = stop[below] - at
                        if length >= span:
                            node, edge, length = below, edge + span, length - span
                            continue
                    if text[at + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    fork = len(children)
                    children.append({text[at + length]: below, symbol: ~suffix})
                    begin.append(at)
                    stop.append(at + length)
                    link.append(0)
                    leaf_begin[suffix] = i
                    children[node][text[edge]] = fork
                    if below < 0:
                        leaf_begin[~below] = at + length
                    else:
                        begin[below] = at + length
                    if unlinked:
                        link[unlinked] = fork
                    unlinked = fork
                suffix += 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = suffix

    def tour(self, inverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Leaves in lexicographic order, and the least depth on the Euler tour between each and the one before.

        `inverse` turns the order of the symbols around; the final 0 stays the smallest.
        """
        children, begin, stop = self.children, self.begin, self.stop
        leaves, between = [], []

        def ordered(node: int) -> list[int]:
            found = sorted(children[node].items(), reverse=not inverse)  # the stack hands them out from the end
            if inverse and found[0][0] == 0:
                found.append(found.pop(0))
            return [below for _, below in found]

        least, stack, depths = 0, [ordered(0)], [0]
        while stack:
            if not stack[-1]:
                stack.pop()
                depths.pop()
                if depths and depths[-1] < least:
                    least = depths[-1]
                continue
            below = stack[-1].pop()
            if below < 0:
                leaves.append(~below)
                between.append(least)
                least = depths[-1]
            else:
                stack.append(ordered(below))
                depths.append(depths[-1] + stop[below] - begin[below])
        return np.array(leaves, np.int64), np.array(between, np.int64)


class Extensions:
    """Longest common extensions of positions, by lowest common ancestors in constant time."""

    def __init__(self, tree: SuffixTree):
        leaves, between = tree.tour()
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.table = [between.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= len(between):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes from a[k] and b[k], which differ, have in common."""
        low, high = self.rank[a], self.rank[b]
        low, high = np.minimum(low, high) + 1, np.maximum(low, high) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    out, waiting = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while waiting and rank[waiting[-1]] > r:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def runs_of(symbols: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run among numbers from 1 up, by start and period."""
    n = len(symbols)
    tree = SuffixTree([*symbols, 0])
    forward = Extensions(tree)
    leaves, _ = tree.tour(inverse=True)
    inverse = np.empty(n + 1, np.int64)
    inverse[leaves] = np.arange(n + 1)
    at = np.tile(np.arange(n), 2)
    other = np.array(_next_smaller(forward.rank.tolist())[:n] + _next_smaller(inverse.tolist())[:n], np.int64)
    root = other - at
    fits = (other < n) & (LEAST_PERIODS * root <= n)
    at, other, root = at[fits], other[fits], root[fits]
    right = forward.of(at, other)
    del tree, forward
    backward = Extensions(SuffixTree([*symbols[::-1], 0]))
    left = backward.of(n - at, n - other)  # of what stands before the two; before the first word, only the 0
    start, length = at - left, left + root + right
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * root)
    return sorted(set(zip(start[long].tolist(), length[long].tolist(), root[long].tolist())))


def _stretches(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words in which runs can lie."""
    n = len(codes) - _GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = rolling(codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), _GRAM) ^ (
        doc[:n].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(grams, kind="stable")
    same = np.zeros(n, bool)
    same[1:] = grams[order[1:]] == grams[order[:-1]]
    ahead, behind = np.full(n, -1), np.full(n, -1)
    behind[order[1:]] = np.where(same[1:], order[:-1], -1)
    ahead[order[:-1]] = np.where(same[1:], order[1:], -1)
    here = np.arange(n)
    live = (doc[:n] == doc[_GRAM - 1:]) & ((ahead >= 0) | (behind >= 0))
    for _ in range(_NARROWING):
        # A stretch ends where the document does, as windows that leave it are never live.
        edge = np.diff(np.concatenate([[0], live.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        number = np.cumsum(edge[:-1] == 1) - 1
        reach = np.zeros(n, np.int64)
        reach[live] = (ends - starts)[number[live]] + _GRAM - 1
        first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        first[live], last[live] = starts[number[live]], ends[number[live]]
        near = ((ahead >= 0) & (ahead < last) & (LEAST_PERIODS * (ahead - here) <= reach)) | (
            (behind >= 0) & (behind >= first) & (LEAST_PERIODS * (here - behind) <= reach))
        if (near | ~live).all():
            break
        live &= near
    edge = np.diff(np.concatenate([[0], live.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + _GRAM - 1
    enough = ends - starts >= LEAST_WORDS
    return starts[enough], ends[enough]


def _runs(batches):
    for table in pieces(batches, "text"):
        words = [spaced(t) for t in table["text"].to_pylist()]
        lengths = np.array([len(w) for w in words], np.int64)
        offsets = np.append(0, np.cumsum(lengths))
        number = defaultdict(count().__next__)
        codes = np.fromiter((number[w] for ws in words for w in ws), np.int64, offsets[-1])
        doc = np.repeat(np.arange(len(words)), lengths)
        found = [[] for _ in words]
        change = np.zeros(len(codes) + 1, np.int64)
        for a, b in zip(*(x.tolist() for x in _stretches(codes, doc))):
            local = np.unique(codes[a:b], return_inverse=True)[1] + 1
            d = int(doc[a])
            for start, length, period in runs_of(local.tolist()):
                found[d].append((a + start - int(offsets[d]), length, period))
                change[a + start + period] += 1
                change[a + start + length] -= 1
        gone = np.cumsum(change)[:-1] > 0
        kept = [(b" ".join(ws if not gone[a:a + n].any() else [w for w, x in zip(ws, gone[a:a + n].tolist()) if not x])).decode()
                for ws, a, n in zip(words, offsets.tolist(), lengths.tolist())]
        flat = [r for runs in found for r in sorted(runs, key=lambda r: (r[0], r[2]))]
        parts = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([
            table["doc_id"].combine_chunks().cast(pa.int64()), pa.array(lengths),
            pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in found])), pa.int32()),
                                     pa.StructArray.from_arrays(parts, fields=list(RUN))),
            pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "kept_text"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs, kept_text for every row of `docs` (doc_id, text).

    `runs` holds every (start, length, period) by start, then period; kept_text
    is the text without the words that a run repeats after its first period,
    joined by one space. Null and empty texts have no words, no runs and an empty
    kept_text. Rows are independent: repeated ones and null ids give a row each,
    an empty table none. Other columns are ignored, whatever their names. A text
    is worked on whole in its task; trees need about 1 kB for each word of a stretch
    that repeats.
    """
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        _runs, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string")


def digest(found: DataFrame) -> DataFrame:
    """The longest run of each row (ties: first start, then period), and hashes of all runs and of what is kept."""
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the tail of one text in ten made periodic, as the query of this operator asks.

    With h the crc32 of the id and g = h // 10, texts with h % 10 = 0 and n words
    keep their first a = g % n words; the 1 + (n - a) // (3 + g % 8) words from
    there are then repeated to the end. All other texts stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, words).alias("words"))
    sized = split.withColumn("n", F.when(F.col("words").isNotNull(), F.size("words").cast("long"))).withColumn(
        "a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.flatten(F.array_repeat(F.expr("slice(words, int(a + 1), int(p))"), F.expr("int((n - a) div p + 1)")))
    changed = F.concat(F.expr("slice(words, 1, int(a))"), F.slice(tail, F.lit(1), F.expr("int(n - a)")))
    return sized.select("doc_id", F.coalesce(F.array_join(changed, " "), "text").alias("text"))
