"""Licences named or granted in a text.

Method: template-markup matching. A template is licence wording with regions in
markup: `[[ ... ]]` may be left out, `{{n}}` stands for up to n words of any kind
(names, years), `((a | b))` for one of several wordings. It is compiled into a
token automaton, which is run from every place where the template can begin. A
text is accepted where all mandatory wording is matched exactly.

Beside that, the base phrases are counted wherever their words stand in a row.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from creditloom.llm.blocks import pieces, prepare
from creditloom.llm.words import alphanumeric_lower

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Wording of public licences and of notices that grant them.
TEMPLATES = [
    ("mit", "[[the]] [[mit license]] [[copyright [[c]] {{12}}]] permission is hereby granted free of charge to any person obtaining a copy of "
            "this software and associated documentation files the software to deal in the software without restriction "
            "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
            "copies of the software and to permit persons to whom the software is furnished to do so subject to the "
            "following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies "
            "or substantial portions of the software"),
    ("mit", "((released | licensed | distributed | available)) under the [[terms of the]] mit license"),
    ("apache", "licensed under the apache license version 2 [[0]]"),
    ("apache", "((released | distributed | available)) under the [[terms of the]] apache license [[version]] 2 [[0]]"),
    ("gpl", "((this work is | this program is | licensed | released | distributed)) [[free software]] [[licensed]] under the [[terms of the]] gnu general public license [[version]] [[((2 | 3))]]"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation either version ((2 | 3)) of the license or at your "
            "option any later version"),
    ("cc-by", "((licensed | released | available | distributed)) under [[a]] ((cc | creative commons)) ((by | attribution)) "
              "[[((nc | noncommercial))]] [[((sa | nd | sharealike | noderivatives))]] ((1 | 2 | 3 | 4)) [[0]]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
]
_MARKUP = re.compile(r"\[\[|\]\]|\(\(|\)\)|\||\{\{\d+\}\}|[^\s\[\](){}|]+")
_ANY = "\0"


class TokenAutomaton:
    """States with edges by word, edges by any word, and free edges."""

    def __init__(self, template: str):
        self.by_word: list[dict[str, set[int]]] = [{}]
        self.free: list[set[int]] = [set()]
        tokens = _MARKUP.findall(template)
        end, left = self._sequence(tokens, 0, ())
        if left != len(tokens):
            raise ValueError(f"unbalanced markup in {template!r}")
        self.accepting = end
        self.start = self._closure({0})
        self.first = {w.encode() for s in self.start for w in self.by_word[s]} - {_ANY.encode()}

    def _state(self) -> int:
        self.by_word.append({})
        self.free.append(set())
        return len(self.free) - 1

    def _sequence(self, tokens: list[str], state: int, stops: tuple[str, ...], at: int = 0) -> tuple[int, int]:
        """Compile tokens from `at` up to one of `stops`; (state reached, position of the stop)."""
        while at < len(tokens) and tokens[at] not in stops:
            token = tokens[at]
            if token == "[[":
                end, at = self._sequence(tokens, state, ("]]",), at + 1)
                self.free[state].add(end)
                state = end
            elif token == "((":
                join = self._state()
                while token != "))":
                    begin = self._state()
                    self.free[state].add(begin)
                    end, at = self._sequence(tokens, begin, ("|", "))"), at + 1)
                    self.free[end].add(join)
                    token = tokens[at] if at < len(tokens) else "))"
                state = join
            elif token.startswith("{{"):
                join = self._state()
                for _ in range(int(token[2:-2])):
                    self.free[state].add(join)
                    following = self._state()
                    self.by_word[state].setdefault(_ANY, set()).add(following)
                    state = following
                self.free[state].add(join)
                state = join
            else:
                following = self._state()
                self.by_word[state].setdefault(token, set()).add(following)
                state = following
            at += 1
        return state, at

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()] - states:
                states.add(s)
                todo.append(s)
        return states

    def match(self, words: list[bytes], at: int) -> int | None:
        """Where the longest match that begins at word `at` ends."""
        states, end = set(self.start), None
        while states:
            if self.accepting in states:
                end = at
            if at == len(words):
                break
            word = words[at].decode("utf-8")
            moved: set[int] = set()
            for s in states:
                moved |= self.by_word[s].get(word, set()) | self.by_word[s].get(_ANY, set())
            states, at = self._closure(moved), at + 1
        return end


class Scanner:
    def __init__(self, templates=None, phrases=None):
        self.templates = [(label, TokenAutomaton(t)) for label, t in (TEMPLATES if templates is None else templates)]
        self.phrases = [([w.encode() for w in p.split()], label) for p, label in (PHRASES if phrases is None else phrases).items()]
        # The words at which something can begin, each with a number; all others are zero.
        begin = sorted({p[0] for p, _ in self.phrases}.union(*[a.first for _, a in self.templates]))
        self.code = {w: i for i, w in enumerate(begin, 1)}

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(number of words, places of base phrases, places of templates), places as (label, start, end)."""
        words = alphanumeric_lower(text)
        if not words:
            return 0, [], []
        codes = np.fromiter(map(self.code.get, words, repeat(0)), np.int64, len(words))
        base, matched = [], []
        starts = np.flatnonzero(codes).tolist()
        if starts:
            for p, label in self.phrases:
                base += [(label, i, i + len(p)) for i in starts if words[i] == p[0] and words[i:i + len(p)] == p]
            for label, automaton in self.templates:
                over = -1
                for i in starts:
                    if i >= over and words[i] in automaton.first and (end := automaton.match(words, i)) is not None:
                        matched.append((label, i, end))
                        over = end
        return len(words), sorted(base, key=lambda b: b[1]), sorted(matched, key=lambda m: m[1])


PLACES = "array<struct<label:string,start:long,end:long>>"


def scan_licenses(docs: DataFrame, templates=None, phrases=None) -> DataFrame:
    """The rows of `docs` (text, ...), all columns, with n_words, base_places and template_places.

    Places are [start, end) in words, whole texts are scanned. Null and empty
    texts have no words. Templates of one label may overlap each other; each
    template's own places do not. Columns of these names are replaced.
    """
    prepare(docs.sparkSession)
    rows = docs.drop("n_words", "base_places", "template_places")
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        scanner = Scanner(templates, phrases)
        for table in pieces(batches, "text", 1_000_000):
            found = [scanner.scan(t) for t in table["text"].to_pylist()]
            table = table.append_column("n_words", pa.array([f[0] for f in found], pa.int64()))
            for i, name in ((1, "base_places"), (2, "template_places")):
                table = table.append_column(name, pa.array([[{"label": x, "start": a, "end": b} for x, a, b in f[i]] for f in found], kind))
            yield from table.combine_chunks().to_batches()

    more = StructType.fromDDL(f"n_words long, base_places {PLACES}, template_places {PLACES}")
    return rows.mapInArrow(run, StructType(rows.schema.fields + more.fields))


def digest(found: DataFrame) -> DataFrame:
    """score: 1 with a matched template, 0.5 with base phrases alone, else 0."""
    def labels(*places):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(p, lambda x: x["label"]) for p in places]))), ",")

    starts = F.transform("base_places", lambda p: p["start"])
    return found.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels("base_places").alias("base_labels"),
        labels("base_places", "template_places").alias("labels"),
        F.when(F.size("template_places") > 0, 1.0).when(F.size("base_places") > 0, 0.5).otherwise(0.0).alias("score"))
