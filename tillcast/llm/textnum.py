"""Words and word shingles of Arrow text columns as numpy hash arrays.

Works on the UTF-8 bytes of a whole batch at once. A word is a run of bytes of
one class; its hash is a polynomial over the bytes modulo 2**64, finished by a
mixing step, so equal words have equal hashes in every batch and on every
machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SPAN = 1_000_000  # bytes hashed at a time; a longer word is hashed in one go
_BASE = 0x9E3779B97F4A7C15
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def byte_class(*separators: tuple[int, int]) -> np.ndarray:
    """True for the bytes that belong to words, given inclusive separator ranges."""
    word = np.ones(256, bool)
    for low, high in separators:
        word[low:high + 1] = False
    return word


# [^\x20\x09-\x0D]+ and, after lower-casing, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.size = 0

    def upto(self, n: int):
        if n > self.size:
            self.size = max(n, SPAN + 1)
            self.up = np.cumprod(np.full(self.size, _BASE, np.uint64), dtype=np.uint64)
            self.down = np.cumprod(np.full(self.size, pow(_BASE, -1, 2**64), np.uint64), dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``data[start:end]`` for ascending runs that do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + SPAN, side="right")))
        low, high = starts[at:to] - base, ends[at:to] - base
        piece = data[base:base + int(high[-1])]
        up, down = _POWERS.upto(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[piece] * up[:len(piece)], dtype=np.uint64, out=total[1:])
        out[at:to] = mix((total[high] - total[low]) * down[low] + (high - low).astype(np.uint64))
        at = to
    return out


def _join(total, hashes):
    return mix(total * U(0x2545F4914F6CDD1D) + hashes)


def combine(hashes: np.ndarray) -> np.ndarray:
    """Hash of a whole sequence of words, as one of ``shingles(len(hashes))`` would be."""
    total = np.full(1, len(hashes), np.uint64)
    for value in hashes:
        total = _join(total, value)
    return total


@dataclass
class Words:
    """Words of some texts: byte runs, hashes and the range of words of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of each text, and one more entry for the end

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``k`` consecutive words and whether both ends lie in one text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        total = np.full(n, k, np.uint64)
        for i in range(k):
            total = _join(total, self.hashes[i:i + n])
        text = np.repeat(np.arange(len(self.first) - 1), self.count())
        return total, text[:n] == text[k - 1:]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, lower: bool) -> Words:
    """The words of texts laid end to end; words never reach over the end of a text."""
    if lower:
        data = LOWER[data]
    inside = classes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]
    lasts = offsets[1:][np.diff(offsets) > 0] - 1
    closes[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return Words(data, starts, ends, hash_runs(data, starts, ends), np.searchsorted(starts, offsets))


def slices(offsets: np.ndarray, most_bytes: int = 1_000_000, most_texts: int = 30_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of a bounded size; a longer text stands alone."""
    low = 0
    while low < len(offsets) - 1:
        high = int(np.searchsorted(offsets, offsets[low] + most_bytes, side="right")) - 1
        high = min(max(high, low + 1), low + most_texts)
        yield low, high
        low = high
