"""Cardinality sketches and Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = 15


def hll(c: Column, precision: int = PRECISION) -> Column:
    """An aggregate: the HyperLogLog sketch of a column's distinct values, as binary."""
    return F.hll_sketch_agg(c, F.lit(precision))


def hll_count(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def hll_union(sketch: Column) -> Column:
    """An aggregate: the union of sketches."""
    return F.hll_union_agg(sketch, F.lit(True))


def hll_bound(precision: int = PRECISION) -> float:
    """The relative error that 99 of 100 estimates keep: three standard errors."""
    return 3 * 1.04 / math.sqrt(1 << precision)


def distinct_count(df: DataFrame, column: str, precision: int = PRECISION) -> DataFrame:
    """(estimate): each task makes a sketch, and sketches are all that is shuffled."""
    return df.agg(hll_count(hll(F.col(column), precision)).alias("estimate"))


# --- Bloom filters
SEEDS = tuple(range(1, 11))
PIECE = 32_768


def bits_for(n: int) -> int:
    """A size for n keys: 32 bits each at least, as a power of two."""
    return max(1 << 20, 1 << (32 * n - 1).bit_length()) if n else 1 << 20


def _bucket(c: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), c), F.lit(-(-bits // PIECE))) + 1


def _places(c: Column, bits: int) -> Column:
    """A key's bits, all in its bucket."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(s), c), F.lit(min(bits, PIECE))).cast("int") for s in SEEDS))


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        bucket, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        place = batch.column(1).flatten().to_numpy()
        bitmaps = np.zeros((len(bucket), PIECE // 8), np.uint8)
        np.bitwise_or.at(bitmaps, (np.repeat(at, len(SEEDS)), place >> 3), (1 << (place & 7)).astype(np.uint8))
        for b, bitmap in zip(bucket.tolist(), bitmaps, strict=True):
            held[b] = held[b] | bitmap if b in held else bitmap.copy()
    while held:
        some = [held.popitem() for _ in range(min(len(held), 1024))]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int64()), pa.array([x.tobytes() for _, x in some], pa.binary())], names=["bucket", "bitmap"])


def bloom(df: DataFrame, column: str, bits: int = 1 << 33) -> DataFrame:
    """(bucket, bitmap) rows of a Bloom filter of ``bits`` bits in pieces of 32,768; it is never in one place as a whole.

    A key has all its bits in one piece. Keys go to the task of their piece, which
    holds its pieces only, so no task's memory grows with the keys that it reads.
    For a join use ``joins.existing``, which is exact; this is the filter itself, to be kept and merged.
    """
    c = F.col(column)
    at = df.where(c.isNotNull()).select(_bucket(c, bits).alias("bucket"), _places(c, bits).alias("places"))
    return at.repartition("bucket").mapInArrow(_set_bits, "bucket long, bitmap binary")


def bloom_merge(*filters: DataFrame) -> DataFrame:
    """The union of filters of equal size."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bloom_might_contain(df: DataFrame, column: str, filter_: DataFrame, bits: int = 1 << 33) -> DataFrame:
    """(column) distinct values of df that the filter may hold: all that it holds, and a few others.

    A value meets its piece in one row. Values are shuffled before they are made distinct, so that no task holds all that it reads.
    """
    c = F.col(column)
    asked = df.select(column).where(c.isNotNull()).repartition(column).distinct()
    at = asked.select(column, _bucket(c, bits).alias("bucket"))

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substr(F.col("bitmap"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return F.pmod(F.floor(byte / F.pow(F.lit(2), place % 8)), F.lit(2)) == 1

    return at.join(filter_, "bucket").where(F.forall(_places(c, bits), is_set)).select(column)


def bloom_saturation(filter_: DataFrame, bits: int = 1 << 33) -> DataFrame:
    """(saturation): the share of set bits."""
    return filter_.agg((F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)) / bits).alias("saturation"))
