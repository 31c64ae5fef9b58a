"""Words, shingles and 64-bit hashes of whole texts, vectorised over bytes.

A word is a maximal run of characters other than space and U+0009..U+000D, which in
UTF-8 is the same as a run of bytes other than those six.  All hashes are fixed
functions of the bytes, so every executor computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20


def n_words(text: Column) -> Column:
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads each input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base, grown to the longest word seen."""

    def __init__(self) -> None:
        self.table = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            grown = np.full(max(n, 2 * len(self.table)), _BASE)
            grown[0] = 1
            self.table = np.multiply.accumulate(grown)
        return self.table


_powers = _Powers()


def _hash_piece(data: bytes) -> np.ndarray:
    buf = np.frombuffer(data, np.uint8)
    space = _SPACE[buf]
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64)
    spans = np.diff(starts, append=len(buf))
    place = np.arange(starts[0], len(buf)) - np.repeat(starts, spans)
    weights = _powers.upto(int(spans.max()))[place]
    weights *= buf[starts[0] :].astype(np.uint64) + np.uint64(1)
    weights *= inside[starts[0] :]
    return mix64(np.add.reduceat(weights, starts - starts[0]))


def pieces_of(data: bytes) -> Iterator[bytes]:
    """The text in runs of about a MiB that end between words, to bound memory."""
    at = 0
    while len(data) - at > _PIECE:
        end = at + _PIECE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash for each word, in order."""
    if len(data) <= _PIECE:
        return _hash_piece(data)
    return np.concatenate([_hash_piece(x) for x in pieces_of(data)])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total *= _BASE
        total += words[k : n - size + 1 + k]
    return mix64(total + np.uint64(size))
