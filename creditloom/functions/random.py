"""Reproducible randomness: uniforms computed from key values.

A row keeps its number under any partitioning, any retry after a lost executor
and any engine, because it depends on the row's key and the seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAWS_PER_DIGEST = 4
RESOLUTION = 4294967296.0


def _digest(keys, seed) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys],
                             F.lit(str(seed))))


def uniform_word(*keys, seed: int, word=None) -> Column:
    """A whole number in [0, 2^32), as bigint; `word` picks one of four per digest."""
    start = F.lit(1) if word is None else (word * 8 + 1)
    text = F.substring(_digest(keys, seed), start, F.lit(8))
    return F.conv(text, 16, 10).cast("bigint")


def uniform(*keys, seed: int, word=None) -> Column:
    """A double in (0, 1), never exactly 0 or 1."""
    return (uniform_word(*keys, seed=seed, word=word) + F.lit(0.5)) / F.lit(RESOLUTION)
