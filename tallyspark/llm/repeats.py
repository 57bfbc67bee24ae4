"""A two-plane Bloom filter that tells which 64-bit hashes may occur more than once.

Plane one has the bits that were met, plane two those met at least twice. Filters of two parts of a
table merge by ``one = a.one | b.one`` and ``two = a.two | b.two | (a.one & b.one)``, in any order, so
each task builds one and the merge is a streamed reduction by block. A hash whose bits are all set in
plane two may be repeated; one with a clear bit surely is not. The size has a fixed upper bound
(MAX_BYTES for each plane): beyond it more rows are taken for repeats, and none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

SEGMENTS = 3
BITS_PER_ROW = 4
MAX_BYTES = 96 << 20
BLOCK = 1 << 16
#: Fixed odd multipliers of the bit positions, one for each segment.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _size(rows: int) -> int:
    """Bits of one segment: a multiple of a block's bits, within MAX_BYTES over all segments."""
    bits = min(max(rows, 1) * BITS_PER_ROW, MAX_BYTES * 8 // SEGMENTS)
    return max(1, -(-bits // (BLOCK * 8))) * BLOCK * 8


def _places(h: np.ndarray, segment: int, bits: int) -> np.ndarray:
    x = h.astype(np.int64).view(np.uint64) * np.uint64(ODD[segment])
    x ^= x >> np.uint64(31)
    x *= np.uint64(ODD[(segment + 1) % SEGMENTS])
    return ((x >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)


def repeat_filter(hashes: DataFrame, rows: int, once: bool = False) -> bytes:
    """Plane two over all rows of ``hashes`` (one bigint column), at most MAX_BYTES in all.

    With ``once`` a hash enters plane two when it is first met: a plain membership filter.
    """
    bits, spark = _size(rows), hashes.sparkSession

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.zeros((SEGMENTS, bits // 8), np.uint8)
        two = np.zeros_like(one)
        for b in batches:
            h = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            for s in range(SEGMENTS if len(h) else 0):
                at, n = np.unique(_places(h, s, bits), return_counts=True)
                byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
                again = ((one[s][byte] & bit) != 0) | (n > 1) | once
                np.bitwise_or.at(one[s], byte, bit)
                np.bitwise_or.at(two[s], byte[again], bit[again])
        one, two = one.reshape(-1, BLOCK), two.reshape(-1, BLOCK)
        for k in np.flatnonzero(one.any(axis=1)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "one": [one[k].tobytes()], "two": [two[k].tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for k, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                if k in held:
                    o, t = held[k]
                    x, y = o | x, t | y | (o & x)
                held[k] = x, y
        for k, (_, y) in held.items():
            if y.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "two": [y.tobytes()]})

    blocks = SEGMENTS * bits // 8 // BLOCK
    parts = hashes.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(build, "block int, one binary, two binary")
    merged = parts.repartition(min(blocks, 4 * spark.sparkContext.defaultParallelism), "block").mapInArrow(merge, "block int, two binary")
    out = bytearray(SEGMENTS * bits // 8)
    for r in merged.collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = r["two"]
    return bytes(out)


def hit(plane: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be repeated, given plane two."""
    out, size = np.ones(len(h), bool), len(plane) // SEGMENTS
    for s in range(SEGMENTS):
        at = _places(h, s, size * 8)
        out &= (plane[s * size + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def may_repeat(filter_broadcast, h: Column) -> Column:
    """A column that is true where the hash may be repeated."""

    @F.pandas_udf(BooleanType())
    def probe(x: pd.Series) -> pd.Series:
        return pd.Series(hit(np.frombuffer(filter_broadcast.value, np.uint8), x.to_numpy(np.int64)))

    return probe(h)
