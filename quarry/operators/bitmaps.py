"""Posting lists as bitmaps: rows (token, bucket, bitmap) of 32,768 values each.

A bitmap takes 4 KB before compression, so it pays where a token has many values
near each other. ``split`` makes bitmaps of such pieces only and leaves the others
as lists; the two together are the whole index. A list is never in one row as a
whole. Values are whole numbers; a record without one is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 32_768

#: Values of a piece from which on a bitmap is the smaller form: 4 KB in numbers of 8 bytes.
LEAST = 512


def _bucketed(df: DataFrame) -> DataFrame:
    value = F.col("value").cast("long")
    return df.where(value.isNotNull()).select("token", value.alias("value"), F.bitmap_bucket_number(value).alias("bucket"))


def build(df: DataFrame) -> DataFrame:
    """(token, bucket, bitmap) of the records' values; bits are set before the shuffle, so a record counts once however often it is there."""
    return _bucketed(df).groupBy("token", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("value")).alias("bitmap"))


def split(df: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Bitmaps of the pieces with at least so many records, and (token, value) of all other records; df, which is read three times, should be a written table."""
    records = _bucketed(df)
    dense = records.groupBy("token", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rest = records.join(dense, ["token", "bucket"], "left_anti").select("token", "value")
    return build(records.join(dense, ["token", "bucket"], "left_semi")), rest


def all_of(df: DataFrame, keys: Iterable) -> DataFrame:
    """AND: (bucket, bitmap) of the values that have all keys. Only pieces are combined, never lists."""
    keys = list(dict.fromkeys(keys))
    both = df.where(F.col("token").isin(keys)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("bitmap").alias("bitmap"))
    return both.where(F.col("n") == len(keys)).select("bucket", "bitmap")


def any_of(df: DataFrame, keys: Iterable) -> DataFrame:
    """OR: (bucket, bitmap) of the values that have any of the keys."""
    return df.where(F.col("token").isin(list(keys))).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two bitmap indexes."""
    return a.unionByName(b).groupBy("token", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def sizes(df: DataFrame) -> DataFrame:
    """(token, size): the number of values of each token."""
    return df.groupBy("token").agg(F.sum(F.bitmap_count("bitmap")).alias("size"))


def values(df: DataFrame) -> DataFrame:
    """The value of each set bit, with the columns of df besides bucket and bitmap."""
    carried = [c for c in df.columns if c not in ("bucket", "bitmap")]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # 64 pieces are 2 million values at most
                part = batch.slice(at, 64)
                bits = np.frombuffer(b"".join(part.column("bitmap").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                row, bit = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
                bucket = part.column("bucket").to_numpy(zero_copy_only=False)[row]
                value = np.where(bucket > 0, (bucket - 1) * PIECE + bit + 1, bucket * PIECE - bit)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in carried), pa.array(value, pa.int64())], names=[*carried, "value"])

    schema = df.select(*carried).schema.add("value", "long")
    return df.select(*carried, "bucket", "bitmap").mapInArrow(unpack, schema)
