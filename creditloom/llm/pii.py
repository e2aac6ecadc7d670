"""Personal data and secrets in whole texts.

Method: candidate gradient boosting. Generators with high recall propose spans,
which may overlap. Boosted trees score each from its format (lengths, digit
groups, checksums) and its context (the characters and words before it). A
threshold per kind, calibrated on labelled candidates that the trees did not see,
selects the spans to redact. Spans of the fixed base patterns are always kept.

The trees are fitted by Spark ML on the candidates of a bounded sample of
documents (`SAMPLE_DOCS`, chosen by a hash of the row, text never cut); labels
come from the validated patterns. Thresholds come from the candidates of all
documents, counted by kind, margin and label. The fitted trees are a few hundred numbers and
are applied to every document in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from creditloom.llm.blocks import pieces, prepare
from creditloom.session import settle

SAMPLE_DOCS = 20_000
TREES, DEPTH, SEED = 15, 4, 7
PRECISION = 0.98  # that the calibrated threshold has to reach
MARGIN_STEPS = 1_000  # of the trees' margin, in one unit
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
CONTEXT = 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits: it would have begun at the run's start.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9_/+=-]{16,}")
_NUMBER = re.compile(r"(?<![0-9])[0-9][0-9().\x20-]{5,}[0-9]")
_NAMED = re.compile(r"(?i)(token|secret|key|passw|pwd|auth)[a-z_]{0,12}[\"']?[\x20]*[=:][\x20]*[\"']?$")


def emails(text: str):
    """Leftmost non-overlapping addresses, found from their @."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(last, at + 1))


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 1) % 9 + 1 if d != "0" else 0 for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _card_digits(s: str) -> bool:
    digits = "".join(_DIGITS.findall(s))
    return 16 <= len(digits) <= 19 and luhn(digits)


def _phone_digits(s: str) -> bool:
    return 8 <= len(_DIGITS.findall(s)) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start, in code points."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for kind, pattern, valid in (("ip", _IP, _octets), ("card", _CARD, _card_digits), ("phone", _PHONE, _phone_digits)):
            out += [(kind, *m.span()) for m in pattern.finditer(text) if valid(m[0])]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Everything that may be personal data or a secret; spans of different kinds overlap."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text)]
        for m in _NUMBER.finditer(text):
            plus = m.start() > 0 and text[m.start() - 1] == "+"
            out.append(("phone", m.start() - plus, m.end()))
            if sum(c.isdigit() for c in m[0]) >= 12:
                out.append(("card", *m.span()))
        out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12]
        out += [("secret", *m.span()) for m in _TOKEN.finditer(text) if _DIGITS.search(m[0])]
    return sorted(set(out))


FEATURES = ("kind", "length", "digits", "letters", "separators", "groups", "longest", "entropy", "luhn", "octets",
            "plus", "named", "quoted", "word_before", "hex")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and its context; `FEATURES` names them."""
    span, before = text[start:end], text[max(0, start - CONTEXT):start]
    digits = [c for c in span if c.isdigit()]
    groups = re.split(r"[^0-9A-Za-z]+", span)
    shares = [span.count(c) / len(span) for c in set(span)] if len(span) <= 200 else [1.0]
    return [float(KINDS.index(kind)), float(len(span)), float(len(digits)), float(sum(c.isalpha() for c in span)),
            float(sum(not c.isalnum() for c in span)), float(len(groups)), float(max(map(len, groups))),
            -sum(p * math.log2(p) for p in shares), float(bool(digits) and len(digits) < 40 and luhn("".join(c for c in digits if c in "0123456789"))),
            float(kind == "ip" and _octets(span)), float(span[:1] == "+"), float(bool(_NAMED.search(before))),
            float(before[-1:] in "\"'" and before != ""), float(before[-1:].isalnum()),
            float(all(c in "0123456789abcdefABCDEF" for c in span))]


def label(text: str, kind: str, start: int, end: int, base: set[tuple[str, int, int]]) -> float:
    """1 for what the validated patterns confirm: a base span, or a mixed token assigned to a telling name."""
    if kind != "secret":
        return float((kind, start, end) in base)
    return float(bool(_NAMED.search(text[max(0, start - CONTEXT):start])) and any(c.isalpha() for c in text[start:end]))


def step_of(margin: float) -> int:
    """Margins are counted and compared in steps, so their number is fixed however many candidates there are."""
    return math.floor(margin * MARGIN_STEPS)


class Trees:
    """Boosted trees as arrays, with a threshold on the step of their margin for each kind."""

    def __init__(self, trees: list[tuple[float, list]], thresholds: dict[str, int]):
        self.trees, self.thresholds = trees, thresholds

    def margin(self, x: list[float]) -> float:
        total = 0.0
        for weight, nodes in self.trees:
            at = 0
            while nodes[at][0] >= 0:
                feature, value, left, right = nodes[at]
                at = left if x[feature] <= value else right
            total += weight * nodes[at][1]
        return total

    def accepts(self, text: str, kind: str, start: int, end: int) -> bool:
        return kind in self.thresholds and step_of(self.margin(features(text, kind, start, end))) >= self.thresholds[kind]

    def spans(self, text: str | None) -> tuple[list, list]:
        """(base spans, all spans), both by kind as listed, then start."""
        if not text:
            return [], []
        base = base_spans(text)
        known = set(base)
        more = [c for c in candidates(text) if c not in known and self.accepts(text, *c)] if self.trees else []
        return base, sorted(known.union(more), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _nodes(root) -> list:
    """A Spark ML tree as (feature, value, left, right); a leaf is (-1, prediction, 0, 0)."""
    out = []

    def walk(node) -> int:
        at = len(out)
        out.append(None)
        if node.numDescendants() == 0:
            out[at] = (-1, node.prediction(), 0, 0)
        else:
            left, right = walk(node.leftChild()), walk(node.rightChild())
            out[at] = (node.split().featureIndex(), node.split().threshold(), left, right)
        return at

    walk(root)
    return out


def _threshold(steps: np.ndarray, truth: np.ndarray, n: np.ndarray) -> int | None:
    """The least step at and above which the share of true candidates reaches PRECISION; `n` counts equal ones."""
    order = np.argsort(-steps, kind="stable")
    right, seen = np.cumsum((truth * n)[order]), np.cumsum(n[order])
    last = np.append(steps[order][1:] != steps[order][:-1], True)  # equal steps stand or fall together
    good = np.flatnonzero(last & (right >= PRECISION * seen))
    return int(steps[order][good[-1]]) if len(good) and right[good[-1]] else None


def _chosen(docs: DataFrame):
    """Whether a row is in the sample. The text is hashed too, so rows without doc_id are not all in or out."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20))


def _half():
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(2)) == 0


def _labelled(text: str):
    """(features, label) of each candidate."""
    base = set(base_spans(text))
    for c in candidates(text):
        yield features(text, *c), label(text, *c, base)


def sample(docs: DataFrame) -> DataFrame:
    """x (features), y (label) of the candidates of the given documents."""
    def run(batches):
        for table in pieces(batches, "text", 1_000_000):
            found = [c for text in table["text"].to_pylist() if text for c in _labelled(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.list_(pa.float64())), pa.array([y for _, y in found], pa.float64())], ["x", "y"])

    return docs.select("text").mapInArrow(run, "x array<double>, y double")


def _calibrate(docs: DataFrame, trees: Trees) -> dict[str, int]:
    """Thresholds from the candidates of all documents: those the trees did not see, or all where none of these is true."""
    def run(batches):
        for table in pieces(batches, "text", 1_000_000):
            counts = Counter()
            for text, fitted in zip(table["text"].to_pylist(), table["fitted"].to_pylist()):
                if text:
                    counts.update((int(x[0]), step_of(trees.margin(x)), int(y), fitted) for x, y in _labelled(text))
            rows = [(*key, n) for key, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()))],
                                             ["kind", "step", "y", "fitted", "n"])

    counted = docs.select("text", "fitted").mapInArrow(run, "kind long, step long, y long, fitted boolean, n long").groupBy(
        "kind", "step", "y", "fitted").agg(F.sum("n").alias("n")).collect()
    out = {}
    for k, kind in enumerate(KINDS):
        mine = [r for r in counted if r["kind"] == k]
        unseen = [r for r in mine if not r["fitted"]]
        mine = unseen if any(r["y"] for r in unseen) else mine
        if mine and (least := _threshold(*(np.array([r[c] for r in mine]) for c in ("step", "y", "n")))) is not None:
            out[kind] = least
    return out


def learn(docs: DataFrame) -> Trees:
    """Fit on half of the sampled documents, calibrate on all others."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    marked = docs.select("doc_id", "text").withColumn("fitted", _chosen(docs) & _half())
    fit = settle(sample(marked.where("fitted"))).select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    if fit.select("label").distinct().count() < 2:
        return Trees([], {})
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64).fit(fit)
    trees = Trees([(float(w), _nodes(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")))
                   for w, t in zip(model.treeWeights, model.trees)], {})
    return Trees(trees.trees, _calibrate(marked, trees))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find(docs: DataFrame, trees: Trees, replace: bool = False) -> DataFrame:
    """The rows of `docs`, all columns, with base_spans and spans; with `replace`, the spans are redacted in `text`."""
    rows = docs.drop("base_spans", "spans")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for table in pieces(batches, "text", 1_000_000):
            found = [trees.spans(t) for t in table["text"].to_pylist()]
            for i, name in enumerate(("base_spans", "spans")):
                values = [[{"kind": k, "start": a, "end": b} for k, a, b in f[i]] for f in found]
                table = table.append_column(name, pa.array(values, kind))
            if replace:
                at = table.schema.get_field_index("text")
                texts = [redact(t, f[1]) for t, f in zip(table["text"].to_pylist(), found)]
                table = table.set_column(at, table.schema.field(at), pa.array(texts, table.schema.field(at).type))
            yield from table.combine_chunks().to_batches()

    return rows.mapInArrow(run, StructType(rows.schema.fields + StructType.fromDDL(f"base_spans {SPANS}, spans {SPANS}").fields))


def find_pii(docs: DataFrame, replace: bool = False) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...), all columns, with base_spans and spans; `replace` redacts `text`.

    Null and empty texts have none. If the sample has no candidates, or only of
    one label, just the base spans are returned. Equal spans of different kinds
    are all named. Repeated rows are treated alike; a null doc_id is a document
    like any other. Columns named base_spans or spans are replaced.
    """
    prepare(docs.sparkSession)
    return find(docs, learn(docs), replace)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, last = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join([*out, text[last:]]) if out else text


def digest(found: DataFrame) -> DataFrame:
    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(said("base_spans"), 256).alias("base_sha256"), said("spans").alias("spans"))
