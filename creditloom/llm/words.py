"""Words and their hashes, for whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# ASCII letters and digits and every byte of a longer character stay, A-Z as a-z; all else separates.
ALPHANUMERIC = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                     for b in range(256))


def spaced(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, in UTF-8."""
    return text.encode().split() if text else []


def spaced_lower(text: str | None) -> list[bytes]:
    """The same with A-Z as a-z."""
    return text.encode().translate(UPPER_TO_LOWER).split() if text else []


def alphanumeric_lower(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z."""
    return text.encode().translate(ALPHANUMERIC).split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolling(hashed: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` consecutive entries."""
    n = len(hashed) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashed[j:j + n]
        out ^= out >> np.uint64(29)
    return out


def distinct(keys: np.ndarray):
    """Sorted distinct keys, the stable order, and where each key's run starts in it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(fresh)
    return ordered[first], order, first
