"""Bloom filters of 64-bit keys, built by the executors: they tell which rows of a wide table need a join.

A key that was put in is always found; of others a small share is found too, so
what is found goes on to an exact step.  A filter has 12 to 24 bits a key and
``most_bits`` bits at most; a fuller one lets more rows on and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t

MOST_BITS = 1 << 28
_PROBES = 4


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key, a row per probe."""
    with np.errstate(over="ignore"):
        a = t.mix(keys ^ np.uint64(t._STEP))
        b = t.mix(a) | np.uint64(1)
        return np.stack([(a + np.uint64(i) * b) & np.uint64(size - 1) for i in range(_PROBES)])


def _words(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bit = np.unique(_bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size))
            word, first = np.unique(bit >> np.uint64(6), return_index=True)
            ones = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(t.as_long(ones))], ["word", "bits"])

    return run


def built(keys: DataFrame, n: int, most_bits: int = MOST_BITS) -> np.ndarray:
    """The filter of the one column of longs in `keys`, of `n` rows; the driver gets two longs for each 64 bits at most."""
    size = 1 << 16
    while size < min(12 * n, most_bits):
        size *= 2
    found = keys.mapInArrow(_words(size), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def might(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may have been put in."""
    bit = _bits(keys, 64 * len(filter_))
    return ((filter_[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).all(axis=0)


def rows(filter_: np.ndarray, key: str, found: bool, sure: str | None = None):
    """Of batches, the rows whose column `key`, never null, may be in the filter (found) or surely is not; rows whose column `sure` is true pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(might(filter_, batch.column(key).to_numpy(zero_copy_only=False).view(np.uint64)) == found)
            yield batch.filter(pc.or_(keep, batch.column(sure)) if sure else keep)

    return run
