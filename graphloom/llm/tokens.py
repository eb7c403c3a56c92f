"""Vectorised words, word hashes and n-gram keys over UTF-8 Arrow buffers.

Everything works on the raw bytes of a batch, in pieces of bounded size, so that no Python object
is made per word.  A piece always holds whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words that end at ASCII white space.
SPACED = ~_SPACE
#: Words of ASCII letters and digits (after lower-casing) and of all non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHAIN = U64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; kept for later pieces while it is small."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 2 * PIECE_BYTES), base, U64)
        steps[0] = 1
        have = np.cumprod(steps)
        if len(have) <= 16 * PIECE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): each bit of the input moves all bits of the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of an n-gram from the key of all but its last word and the hash of the last."""
    return mix(left * _CHAIN + right)


@dataclass
class Piece:
    """Some whole documents of a batch."""

    first: int  # row of the batch
    data: np.ndarray  # bytes, A-Z lower-cased
    bounds: np.ndarray  # documents + 1 offsets into data
    starts: np.ndarray  # of words
    ends: np.ndarray
    word_bounds: np.ndarray  # documents + 1 offsets into the words

    @property
    def docs(self) -> int:
        return len(self.bounds) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.word_bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum((self.data.astype(U64) + U64(1)) * _power(_BASE, n), out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * _power(_INVERSE, n)[self.starts] if n else np.empty(0, U64)
        return mix(h + (self.ends - self.starts).astype(U64) * U64(0xA24BAED4963EE407))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column and its offsets; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each document's words begin."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = table[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, bounds)


def pieces(column: pa.Array, table: np.ndarray = SPACED, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The column's documents in pieces of at most ``limit`` bytes, or of one longer document."""
    raw, offs = bytes_of(column)
    row, n = 0, len(offs) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        bounds = offs[row : stop + 1] - offs[row]
        data = LOWER[raw[offs[row] : offs[stop]]]
        yield Piece(row, data, bounds, *words(data, bounds, table))
        row = stop


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct keys of one document's k-word shingles, sorted; with fewer words, the whole sequence is one."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    out = hashes[: n - width + 1]
    for j in range(1, width):
        out = out * _CHAIN + hashes[j : n - width + 1 + j]
    return np.unique(mix(out + U64(width)))
