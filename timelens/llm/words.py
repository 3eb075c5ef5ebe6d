"""Words of many texts at once: vectorised splitting and hashing for Arrow batches.

A batch of texts is one byte array with offsets. Words are found by byte class and
named by a 64-bit hash that depends on their bytes only, so every task gives a word
the same name. Texts are handled in pieces of about ``PIECE`` bytes, whole texts
each, which bounds the memory of a task by its longest text and not by its batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

_WHOLE = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93


def _spread(n: int, seed: int) -> np.ndarray:
    """n well-mixed odd numbers of 64 bits, from a counter."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _classes(inside) -> np.ndarray:
    return np.array([int(inside(b)) for b in range(256)], np.uint8)


#: Bytes of words that blanks end: ``[^\x20\x09-\x0D]+``.
BLANK_SEPARATED = _classes(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words of letters and digits: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALPHANUMERIC = _classes(
    lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80
)
_AS_IS = _spread(256, 0x51ED)
#: Runs of letters and digits, and runs of other visible ASCII characters.
LETTERS_AND_SIGNS = _classes(lambda b: 1 if ALPHANUMERIC[b] else 2 if 0x20 < b < 0x7F else 0)
#: The same numbers with A-Z standing for a-z.
_FOLDED = _AS_IS.copy()
_FOLDED[0x41:0x5B] = _AS_IS[0x61:0x7B]


class _Powers:
    """Powers of an odd number and of its inverse, kept between batches."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate(
                [self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))]
            )
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP | 5)


class Words(NamedTuple):
    """Words of a piece: a hash and a byte range each, and each text's range of words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The text of every word, counted from 0."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: bool) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; ``fold`` lower-cases A-Z.

    ``inside`` tells a class for every byte: 0 separates, and so does a change of class.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64))
    kind = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero((kind != 0) & cut[:-1])
    ends = np.flatnonzero((kind != 0) & cut[1:]) + 1
    up, down = _BYTES.get(n)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((_FOLDED if fold else _AS_IS)[data] * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def gram_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text.

    Also the index of each run's first word, and each text's range of runs.
    """
    n = len(words.hashes)
    counts = np.maximum(words.counts() - size + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], counts)
    return run_hashes(words.hashes, at, at + size), at, first


def run_hashes(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """One hash for each sequence of names ``hashes[lo:hi]``."""
    n = len(hashes)
    up, down = _WORDS.get(n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(hashes * up[:n], out=sums[1:])
        return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


class Piece(NamedTuple):
    """Rows ``lo`` to ``hi`` of a batch and their texts as bytes with offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[Piece]:
    """A column of texts in pieces of at most ``limit`` bytes or of one text; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, where, values = texts.buffers()
    if n == 0:
        return
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Piece(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def key_remainder(key: int | None, modulus: int) -> int:
    """crc32 of a key written as text, modulo ``modulus``; a null key counts as empty text."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % modulus
