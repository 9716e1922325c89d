"""Words of whole Arrow text columns and hashes of word windows, vectorised over many documents at once.

A word is a run of bytes without ASCII white space (``[^\\x20\\x09-\\x0D]+``); since those are single
bytes in UTF-8, byte offsets and characters give the same words. Hashes are 64-bit polynomials modulo 2**64
with odd bases, passed through a finaliser; a second base gives 64 more bits where equality must hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASES = (np.uint64(0x9E3779B97F4A7C55), np.uint64(0xD6E8FEB86659FD93))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES)
_BLOCK_WORDS = 1 << 13  # so that the tables of powers stay small: every task makes its own
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Some documents of a batch: their row numbers, bytes and byte offsets."""

    rows: range
    data: np.ndarray
    offsets: np.ndarray

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k]:self.offsets[k + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column in pieces of about ``limit`` bytes; a longer text is a piece of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        at = offsets[first:last + 1]
        yield Chunk(range(first, last), data[at[0]:at[-1]], at - at[0])
        first = last


@dataclass
class Words:
    """Byte spans of the words of a chunk; ``first[k]:first[k + 1]`` are the words of document k."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = ~space[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(which: int, inverse: bool, n: int) -> np.ndarray:
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        base = (_INVERSES if inverse else BASES)[which]
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POWERS[which, inverse] = have
    return have[:n]


def word_hashes(data: np.ndarray, w: Words, which: int = 0) -> np.ndarray:
    """One 64-bit hash for each word, in blocks of words so that one long text stays cheap."""
    out = np.empty(len(w.starts), np.uint64)
    for a in range(0, len(out), _BLOCK_WORDS):
        b = min(len(out), a + _BLOCK_WORDS)
        lo, hi = int(w.starts[a]), int(w.ends[b - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(which, False, hi - lo), out=sums[1:])
        s, e = w.starts[a:b] - lo, w.ends[a:b] - lo
        out[a:b] = mix((sums[e] - sums[s]) * _powers(which, True, hi - lo)[s] + (e - s).astype(np.uint64))
    return out


def windows(w: Words, size: int) -> np.ndarray:
    """The word numbers at which ``size`` words of one document begin."""
    n = len(w.starts)
    last = np.repeat(w.first[1:], w.counts) - size
    return np.flatnonzero(np.arange(n) <= last)


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """The hash of the ``size`` words from each word number of ``at`` on."""
    out = np.full(len(at), np.uint64(size), np.uint64)
    base = BASES[1 - which]
    for j in range(size):
        out = out * base + hashes[at + j]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
