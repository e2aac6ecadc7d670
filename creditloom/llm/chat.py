"""Formatting conversations for training, with a loss mask.

Method: incremental black-box rendering. A template is any function from a list
of turns to a string. The prefixes of a conversation are rendered one after
another; what a longer prefix adds is that turn's span, and a prefix whose output
does not begin with the one before shows a template that rewrites history. Where
the turn's text stands within its span is found by rendering it with two marks
in place of the text: what the two outputs share before and after is the frame.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.blocks import prepare

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]
# The control strings of the template below.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
_ANY_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_MARKS = ("\ue000", "\ue001")
LOSS_ROLE = "assistant"


class RewritesHistory(ValueError):
    """The template's output for a longer prefix does not continue the shorter one's."""


def escape(text: str) -> str:
    """Backslashes doubled, and one put into every control string after its first character."""
    return _ANY_CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def instruct(turns: Turns) -> str:
    """The default template; roles other than user, assistant and system are named in the frame."""
    frames = {"user": "<s>[INST] {} [/INST]", "assistant": " {} </s>", "system": "<<SYS>> {} <</SYS>>"}
    return "".join(frames[r].replace("{}", t) if r in frames else f"[ROLE]{escape(r)}[/ROLE] {t} </s>" for r, t in turns)


_FRAMES = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>> (?P<system>.*?) <</SYS>>"
    r"|\[ROLE\](?P<role>.*?)\[/ROLE\] (?P<other>.*?) </s>| (?P<assistant>.*?) </s>", re.DOTALL)


def read_back(formatted: str) -> Turns:
    """The turns of an `instruct` output, unescaped."""
    out, at = [], 0
    while at < len(formatted):
        m = _FRAMES.match(formatted, at)
        kind = m.lastgroup if m["other"] is None else "other"
        out.append((unescape(m["role"]) if kind == "other" else kind, unescape(m[kind])))
        at = m.end()
    return out


def turn_spans(turns: Turns, template: Template = instruct) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation and where each turn's (escaped) text stands in it."""
    done, out, spans = [], "", []
    for role, text in turns:
        longer = template([*done, (role, text)])
        marked = [template([*done, (role, m)]) for m in _MARKS]
        if not longer.startswith(out) or not all(m.startswith(out) for m in marked):
            raise RewritesHistory(f"turn {len(done)} changes what was rendered before")
        start = len(out) + len(commonprefix([m[len(out):] for m in marked]))
        after = len(marked[0]) - start - 1
        end = len(longer) - after
        if longer[start:end] != text:
            raise RewritesHistory(f"turn {len(done)} is not rendered as it stands")
        spans.append((start, end))
        done.append((role, text))
        out = longer
    return out, spans


def rewrites_history(turns: Turns, template: Template) -> bool:
    try:
        turn_spans([(r, escape(t)) for r, t in turns], template)
    except RewritesHistory:
        return True
    return False


FORMATTED = ("conv_id long, formatted string, turns array<struct<role:string,text:string>>, "
             "loss_spans array<struct<start:long,end:long>>")


def format_conversations(rows: DataFrame, template: Template = instruct, read: Callable[[str], Turns] = read_back) -> DataFrame:
    """conv_id, formatted, turns (read back from it) and loss_spans, one row per conversation.

    Takes rows (conv_id, turn, role, text). Null text and role are empty. Rows
    with equal turns go by role, then text; a null turn comes first; rows with a
    null conv_id are one conversation. Nothing is merged, so repeated rows give
    repeated turns. A template that rewrites history raises `RewritesHistory`. An
    empty table gives no rows. Other columns are ignored, whatever their names. A
    conversation is rendered in one task, prefix after prefix, however long its
    texts are.
    """
    prepare(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")) \
        .repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def stream(batches):
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")])

    def run(batches):
        held = []
        for conv_id, group in groupby(stream(batches), key=lambda r: r[0]):
            turns = [(role, escape(text)) for _, role, text in group]
            formatted, spans = turn_spans(turns, template)
            held.append((conv_id, formatted, [{"role": r, "text": t} for r, t in read(formatted)],
                         [{"start": a, "end": b} for (role, _), (a, b) in zip(turns, spans) if role == LOSS_ROLE]))
            if sum(len(h[1]) for h in held[-1:]) > 1_000_000 or len(held) >= 200:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return ordered.mapInArrow(run, FORMATTED)


def _batch(held) -> pa.RecordBatch:
    ids, texts, turns, spans = zip(*held)
    text, number = pa.string(), pa.int64()
    return pa.RecordBatch.from_arrays([
        pa.array(ids, number), pa.array(texts, text), pa.array(turns, pa.list_(pa.struct([("role", text), ("text", text)]))),
        pa.array(spans, pa.list_(pa.struct([("start", number), ("end", number)])))], ["conv_id", "formatted", "turns", "loss_spans"])


def digest(formatted: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = F.transform("loss_spans", lambda s: F.regexp_replace(
        F.substring("formatted", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), r"(?s)\\(.)", "$1"))
    rows = formatted.withColumn("loss", F.array_join(parts, ""))
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
