"""Word shingles as 64-bit hashes, the unit of the near-copy and containment operators.

Words are the runs without ASCII white space of the text with A-Z lower-cased. A text of
fewer words than the shingle width has one shingle, its whole word sequence; a text
without words (or a null) has none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

WIDTH = 5
PIECE = 1 << 20  # bytes of a text that are split into words at a time
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (three xor-shifts, two odd factors)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _FACTORS[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _FACTORS[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word; a long text goes through in pieces cut at white space."""
    if not text:
        return np.empty(0, np.uint64)
    data = text.encode("utf-8", "surrogatepass").lower()
    parts, at = [], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            spaces = [data.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")]
            end = min((s for s in spaces if s >= 0), default=len(data))
        words = data[at:end].split()
        at = end
        if words:
            parts.append(pd.util.hash_array(np.array(words, dtype=object), categorize=False))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes(text)
    span = min(width, len(words))
    if not span:
        return words
    count = len(words) - span + 1
    total = np.full(count, np.uint64(span))
    for i in range(span):
        total = total * _ODD + words[i : i + count]
        total ^= total >> np.uint64(29)
    return np.unique(mixed(total))
