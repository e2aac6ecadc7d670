"""Finding benchmark items in training text.

Method: a generalised suffix automaton over the normalised test items. A
document's words are streamed through it; the automaton keeps the length of the
longest item passage that ends at the current word. Where that length reaches
the limit (13 words), the passage is hit. Documents whose hits cover at least
the coverage limit are contaminated; `remove_spans` cuts the hit words instead.

The items are the query set. They are cut into blocks of at most `BLOCK_WORDS`
words, so one automaton, and what is broadcast, has a fixed largest size; each
block is held against all documents.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.blocks import pieces, prepare
from creditloom.llm.words import alphanumeric_lower

WINDOW = 13
COVERAGE = 20  # contaminated if hit words are one in so many, or more
BLOCK_WORDS = 100_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """All passages of a set of items, each item a list of words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.windows: dict[int, set[str]] = {}  # state of a window -> items with it
        self.short: dict[tuple[int, int], set[str]] = {}  # (state, length) of items shorter than a window
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        for name, codes in coded:
            state = 0
            for n, code in enumerate(codes, 1):
                state = self.step[state][code]
                if n >= window:
                    self.windows.setdefault(self.ending(state, window), set()).add(name)
            if 0 < len(codes) < window:
                self.short.setdefault((self.ending(state, len(codes)), len(codes)), set()).add(name)
        self.short_lengths = sorted({n for _, n in self.short})
        self.least = min([window] * bool(self.windows) + self.short_lengths, default=0)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, code: int) -> int:
        """The state that `code` leads to from `state`, with just the passages one word longer."""
        to = self.step[state][code]
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._state(self.length[state] + 1, dict(self.step[to]), self.link[to])
        self.link[to] = copy
        while state >= 0 and self.step[state].get(code) == to:
            self.step[state][code] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, code: int) -> int:
        if code in self.step[last]:  # an earlier item has this passage
            return self._split(last, code)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and code not in self.step[last]:
            self.step[last][code] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, code)
        return new

    def ending(self, state: int, length: int) -> int:
        """The state of the last `length` words of what `state` stands for."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def stream(self, codes: list[int], found: set[str], spans: list[tuple[int, int]], offset: int) -> None:
        """Add the spans of a run of known words to `spans`, and the items with them to `found`."""
        step, link, lengths, state, length = self.step, self.link, self.length, 0, 0
        for at, code in enumerate(codes, offset + 1):
            while state and code not in step[state]:
                state = link[state]
                length = lengths[state]
            if code in step[state]:
                state = step[state][code]
                length += 1
            if length >= self.window:
                found |= self.windows[self.ending(state, self.window)]
                spans.append((at - self.window, at))
            for n in self.short_lengths:
                if n > length:
                    break
                if names := self.short.get((self.ending(state, n), n)):
                    found |= names
                    spans.append((at - n, at))

    def search(self, words: list[bytes]) -> tuple[set[str | None], list[tuple[int, int]]]:
        """The items that have windows in the words, None for those without id, and where the words are hit, as merged spans."""
        found: set[str] = set()
        spans: list[tuple[int, int]] = []
        if self.least and len(words) >= self.least:
            codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
            edges = np.flatnonzero(np.diff(codes >= 0, prepend=False, append=False)).reshape(-1, 2)
            for a, b in edges[edges[:, 1] - edges[:, 0] >= self.least].tolist():
                self.stream(codes[a:b].tolist(), found, spans, a)
        return found, merged(spans)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[SuffixAutomaton]:
    """One automaton per block of items; rows without words are no items, one without item_id hits but has no name."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    words = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 5
    blocks = 1 + words // block_words
    out = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        out.append(SuffixAutomaton([(r["item_id"], alphanumeric_lower(r["text"])) for r in rows], window))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
                  unnamed: bool = False) -> DataFrame:
    """The rows of `docs`, all columns, with n_words, n_hit, hit_items, hit_unnamed, hit_spans, contaminated.

    hit_spans are [start, end) in words. Null and empty texts have no words and
    are never contaminated. Items repeated, or sharing windows, are all named,
    each id once. Items without id are none, or with `unnamed` they are one item
    that hits, has no name and sets hit_unnamed. An item shorter than the window
    has to occur whole. An empty benchmark hits nothing. Columns of these names in
    `docs` are replaced; any other column passes through. A very long text is
    streamed word by word.
    """
    prepare(docs.sparkSession)
    added = ["n_words", "n_hit", "hit_items", "hit_unnamed", "hit_spans", "contaminated"]
    out = docs.drop(*added).withColumns({
        "n_words": F.lit(0).cast("long"), "hit_items": F.array().cast("array<string>"), "hit_unnamed": F.lit(False),
        "hit_spans": F.array().cast("array<struct<start:long,end:long>>")})
    for automaton in automata(benchmark if unnamed else benchmark.where("item_id is not null"), window):
        shared = docs.sparkSession.sparkContext.broadcast(automaton)
        out = out.mapInArrow(_search(shared), out.schema)
    return out.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def _search(shared):
    def run(batches):
        automaton = shared.value
        for table in pieces(batches, "text"):
            n_words, items, unnamed, spans = [], [], [], []
            for text, old_items, old, old_spans in zip(*[table[c].to_pylist() for c in ("text", "hit_items", "hit_unnamed", "hit_spans")]):
                words = alphanumeric_lower(text)
                found, hit = automaton.search(words)
                n_words.append(len(words))
                items.append(sorted((found - {None}) | set(old_items)))
                unnamed.append(old or None in found)
                spans.append([{"start": a, "end": b} for a, b in merged(hit + [(s["start"], s["end"]) for s in old_spans])])
            for name, values in (("n_words", n_words), ("hit_items", items), ("hit_unnamed", unnamed), ("hit_spans", spans)):
                at = table.schema.get_field_index(name)
                table = table.set_column(at, table.schema.field(at), pa.array(values, table.schema.field(at).type))
            yield from table.combine_chunks().to_batches()

    return run


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters of the words in the spans, and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def remove_spans(found: DataFrame) -> DataFrame:
    """`decontaminate`'s rows with the hit words cut out of `text`."""
    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: t if t is None or not len(s) else without_spans(t, [(x["start"], x["end"]) for x in s]))

    return found.withColumn("text", cut("text", "hit_spans"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", (F.size("hit_items") + F.col("hit_unnamed").cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"), "contaminated")
