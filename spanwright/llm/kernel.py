"""Vectorised text helpers that run inside Spark tasks on Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, which is what
``[^\\x20\\x09-\\x0D]+`` matches on the decoded text, as UTF-8 never uses those
bytes inside a longer sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are hashed at once; bounds the memory of a task.
SLICE_BYTES = 1 << 20
_U = np.uint64
#: Seeds of two hashes of the same bytes, and the bytes from which a range is hashed by itself.
SEED, OTHER_SEED, LONG = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D, 64
_WORD_BASE, _LENGTH_FACTOR = 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9
#: Masks of the first 0 to 8 of eight bytes.
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
#: Bytes of words that are runs of anything but white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Each byte, A to Z in lower case.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64; kept per worker, grown when needed."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 2 * len(have) if have is not None else 0)
        steps = np.full(size, base & (2**64 - 1), _U)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets; a null is empty."""
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def _mixed(x: np.ndarray) -> np.ndarray:
    """``mix`` in place."""
    other = x >> _U(30)
    x ^= other
    x *= _U(0xBF58476D1CE4E5B9)
    np.right_shift(x, _U(27), out=other)
    x ^= other
    x *= _U(0x94D049BB133111EB)
    np.right_shift(x, _U(31), out=other)
    x ^= other
    return x


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A 64-bit hash of each byte range: eight bytes after eight are mixed in; ranges over LONG bytes take xxHash."""
    size, eight, first = ends - starts, _eights(data), _U(seed)
    out = eight[starts]
    out &= _HEADS[np.minimum(size, 8)]
    out += first
    out ^= size.astype(_U) * _U(_LENGTH_FACTOR)
    _mixed(out)
    rows, at = np.flatnonzero(size > 8), 8
    long = rows[size[rows] > LONG]
    rows = rows[size[rows] <= LONG]
    while len(rows):
        part = eight[starts[rows] + at]
        part &= _HEADS[np.minimum(size[rows] - at, 8)]
        part += first
        out[rows] = _mixed(out[rows] ^ _mixed(part))
        at += 8
        rows = rows[size[rows] > at]
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(memoryview(data[starts[i] : ends[i]]), seed)
    return out


def equal_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each byte range holds the bytes of the range of number ``other``."""
    size, eight = ends - starts, _eights(data)
    same = size == size[other]
    rows, at = np.flatnonzero(same & (other != np.arange(len(other)))), 0
    long = rows[size[rows] > LONG]
    rows = rows[size[rows] <= LONG]
    while len(rows := rows[size[rows] > at]):
        equal = ((eight[starts[rows] + at] ^ eight[starts[other[rows]] + at]) & _HEADS[np.minimum(size[rows] - at, 8)]) == 0
        same[rows[~equal]] = False
        rows = rows[equal]
        at += 8
    for i in long.tolist():
        j = other[i]
        same[i] = np.array_equal(data[starts[i] : ends[i]], data[starts[j] : ends[j]])
    return same


class Words:
    """The words of some texts: ``doc`` (row of each), byte ``start`` and ``end``, ``first`` (of each row, n + 1)."""

    def __init__(self, column: pa.Array, word_bytes: np.ndarray = NOT_SPACE, lower: bool = False, more: Callable | None = None):
        self.data, self.offsets = text_buffer(column)
        if lower:
            self.data = _LOWER[self.data]
        is_word = word_bytes[self.data]
        if more is not None:
            is_word |= more(self.data)
        cut = np.zeros(len(self.data) + 1, bool)
        cut[self.offsets] = True
        before = np.empty_like(is_word)
        before[:1], before[1:] = False, is_word[:-1]
        self.start = np.flatnonzero(is_word & (~before | cut[:-1]))
        after = np.empty_like(is_word)
        after[-1:], after[:-1] = False, is_word[1:]
        self.end = np.flatnonzero(is_word & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, seed: int = SEED) -> np.ndarray:
        return segment_hashes(self.data, self.start, self.end, seed)

    def positions(self) -> np.ndarray:
        """Of each word in its text, from 0."""
        return np.arange(len(self.doc)) - self.first[self.doc]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``words[i : i + width]`` for each i at which so many are left."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * powers(_WORD_BASE, len(words)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(inverse(_WORD_BASE), n))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text; a longer text stands alone."""
    _, offsets = text_buffer(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j
