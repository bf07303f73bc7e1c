"""Vectorised text kernels over Arrow string columns.

All operators of this subpackage that read words or bytes in Python share
these routines: they work on the UTF-8 buffer of a whole slice of documents
with numpy, so no Python object is made per word.  Equality of words, lines
and shingles is equality of 64-bit hashes of their bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so powers have inverses modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_STEP = 0xD1342543DE82EF95

#: Bytes that part words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
CODE_POINT = np.ones(256, bool)
CODE_POINT[0x80:0xC0] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, base, _U)]))
        if size <= 1 << 23:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def prefix_hash(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """h[0]=0; h[i]: sum of (values[j]+1)*base**j over j<i."""
    out = np.zeros(len(values) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(_U) + _U(1)) * powers(base, len(values))[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of the values in each [start, end), whatever stands before them."""
    with np.errstate(over="ignore"):
        inverse = powers(pow(base, -1, 1 << 64), len(prefix))
        return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(_U) * _U(_STEP))


def run_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive values of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.full(n, _STEP * k % (1 << 64), _U)
        for i in range(k):
            out = mix(out * _U(_BASE) + h[i : i + n])
    return out


class Texts:
    """The bytes of a slice of documents, with the documents' bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def words(self, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word; words never cross documents."""
        word = ~separators[self.data]
        if not len(word):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(len(word) + 1, bool)
        edge[self.offsets] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        r"""Start and end of each \n-parted line."""
        cut = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.offsets[:-1], cut + 1])
        start.sort(kind="stable")
        end = np.concatenate([self.offsets[1:], cut])
        end.sort(kind="stable")
        return start, end

    def line_bounds(self) -> np.ndarray:
        """Index of each document's first line, and the number of lines; every document has one line at least."""
        return np.arange(self.n + 1) + np.searchsorted(np.flatnonzero(self.data == 10), self.offsets, side="left")

    def bounds(self, starts: np.ndarray) -> np.ndarray:
        """Index of each document's first item, and the number of items, for items that start at these bytes."""
        return np.searchsorted(starts, self.offsets, side="left")


#: Bytes of a slice where a task should hold little beside it.
SMALL = 1 << 18


def slices(column, most: int = 1 << 20) -> Iterator[tuple[int, int, Texts]]:
    """(first row, last row, texts) of slices of about `most` bytes; null reads as empty. A longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        b = min(b, n)
        yield a, b, Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def give_back() -> None:
    """Return freed memory of this process to the system; the allocators of Arrow and C would keep it for later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, giving memory back when the task ends: Spark keeps the worker, idle or for other work, beside the executor."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def count_in(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each [offsets[i], offsets[i+1])."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def sum_in(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def owner(offsets: np.ndarray) -> np.ndarray:
    """The document of each item, from the documents' first items."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
