"""Text building and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns.
ITEM_ID_PATTERN = r"^([^_]*)_(.*)_([^_]*)$"
FIRST_ARRAY_PATTERN = r"(?s)(\[.*?\])"


def item_id(grade: Column, purpose: Column, term: Column) -> Column:
    """grade_purpose_term; a missing term makes the whole id missing."""
    return F.concat(F.coalesce(grade, F.lit("Unknown")), F.lit("_"),
                    F.coalesce(purpose, F.lit("other")), F.lit("_"), F.trim(term))


def item_part(item: Column, part: str) -> Column:
    """Grade, purpose or term out of an item id; purposes may hold underscores."""
    return F.regexp_extract(item, ITEM_ID_PATTERN, {"grade": 1, "purpose": 2, "term": 3}[part])


def whole_number(x: Column) -> Column:
    """1234567.4 -> 1,234,567."""
    return F.format_number(x.cast("decimal(20,6)"), 0)


def money(x: Column) -> Column:
    return F.concat(F.lit("$"), whole_number(x))


def one_decimal(x: Column) -> Column:
    """Half-up on the decimal value, without grouping."""
    return F.round(x.cast("decimal(20,6)"), 1).cast("decimal(20,1)").cast("string")


def percent(x: Column, digits: int = 0) -> Column:
    return F.concat(F.round((x * 100).cast("decimal(20,6)"), digits).cast(f"decimal(20,{digits})").cast("string"),
                    F.lit("%"))


def words(x: Column) -> Column:
    return F.replace(x, F.lit("_"), F.lit(" "))


def reply_items(reply: Column) -> Column:
    """The first bracketed list of strings in a reply, else the first list held
    by a JSON object, else null. Broken JSON gives null."""
    bracketed = F.from_json(F.regexp_extract(reply, FIRST_ARRAY_PATTERN, 1), "array<string>")
    held = F.filter(F.map_values(F.from_json(reply, "map<string,array<string>>")), lambda v: v.isNotNull())
    return F.coalesce(bracketed, F.try_element_at(held, F.lit(1)))


def merge_order(original: Column, reply: Column) -> Column:
    """Known ids in reply order (first mention wins), then the ones the reply left out."""
    known = F.array_distinct(F.filter(reply, lambda x: F.array_contains(original, x)))
    return F.when(reply.isNull(), original).otherwise(F.concat(known, F.array_except(original, known)))
