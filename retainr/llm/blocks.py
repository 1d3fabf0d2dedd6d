"""Vectorised text primitives for Arrow batches: words, word hashes, window hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes.  A batch is cut into blocks of whole texts of
at most ``BLOCK_BYTES`` (a longer text is a block of its own), so the arrays a task holds are
bounded by the block, not by the batch.  Hashes are polynomial prefix sums modulo 2**64 followed
by a bijective mix, hence every window of every text costs a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

U64 = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1B54A32D192ED03
CHECK_BASE = 0x8CB92BA72F3D8DD7

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n (kept between calls, grown to powers of two)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        p = np.full(size, base, dtype=U64)
        p[0] = 1
        have = _POWERS[base] = np.cumprod(p, out=p)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[s:e] for each span, independent of where the span stands."""
    prefix = np.zeros(len(values) + 1, dtype=U64)
    np.multiply(values, powers(base, len(values)), out=prefix[1:])
    np.cumsum(prefix[1:], out=prefix[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return mix64((prefix[ends] - prefix[starts]) * inverse[starts])


@dataclass
class Block:
    """Whole texts, one after the other, with their words."""

    first: int  # row of the batch that the first text comes from
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]
    starts: np.ndarray  # byte where each word starts
    ends: np.ndarray
    words: np.ndarray  # words of text i are words[i]:words[i + 1]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words)

    @property
    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    def word_hashes(self) -> np.ndarray:
        values = self.data.astype(U64)
        values += U64(1)
        return span_hashes(values, self.starts, self.ends, BYTE_BASE)

    def windows(self, k: int) -> np.ndarray:
        """First words of all windows of k words that lie in one text."""
        count = np.maximum(self.n_words - (k - 1), 0)
        at = np.arange(int(count.sum()))
        return at + np.repeat(self.words[:-1] - (np.cumsum(count) - count), count)

    def text_bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def _block(first: int, data: np.ndarray, offsets: np.ndarray) -> Block:
    inside = _IS_WORD[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begin[heads], end[tails] = inside[heads], inside[tails]  # no word crosses two texts
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Block(first, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings or UTF-8; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), off


def parts(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of consecutive whole texts of at most ``max_bytes``, as views: what is made of a part
    (lower case, rows kept) is bounded by it, not by the batch."""
    off = np.zeros(len(column) + 1, dtype=np.int64)
    np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), out=off[1:])
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of consecutive whole texts of a string column."""
    if not len(column):
        return
    data, off = utf8(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1)
        to = min(to, n)
        yield _block(at, data[off[at]:off[to]], off[at:to + 1] - off[at])
        at = to


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of values[i:i + width] (upper 36 bits count, leftmost of ties)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    shift = U64(28)
    low = (values >> shift << shift) | np.arange(len(values), dtype=U64)
    have = 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[:len(low) - (width - have)], low[width - have:])
    return (low[:n] & U64((1 << 28) - 1)).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(U64)
