"""Sharding by jump consistent hashing (Lamping and Veach).

A row's key is hashed to 64 bits and the jump recurrence gives its shard; there
is no ring table and nothing is shuffled.  When shards are appended, a key
either stays or moves to one of the new shards, which happens to the fraction
(after - before) / after of the keys.

Defined results: a null key has shard null (``assign`` and ``plan_growth``) and
is written to shard 0 (``write_shards``); equal keys, so all repeats of a row,
share a shard, in no order of theirs; the empty string is a key as any other.
Other columns, nulls and very long texts among them, are written as they are.  An
empty table has no shard folder.  A column of ``df`` that has the name of an added
one is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _shared
from quarry.llm._text import mix64

SHARDS, SHARDS_AFTER = 1000, 1200


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, from 0 to shards - 1, of each unsigned 64-bit key."""
    key = keys.astype(np.uint64)
    shard, step = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    open_ = np.flatnonzero(step < shards)
    while len(open_):
        shard[open_] = step[open_]
        key[open_] = key[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        step[open_] = ((shard[open_] + 1) * (float(1 << 31) / ((key[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        open_ = open_[step[open_] < shards]
    return shard


def shard_of(df: DataFrame, key: str, shards: int) -> Column:
    """Shard of df's column. Integers are mixed as they are; other keys are first hashed by xxhash64 of their string."""
    if shards < 1:
        raise ValueError("there must be a shard")
    whole = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))

    @F.arrow_udf(T.IntegerType())
    def run(k: pa.Array) -> pa.Array:
        mixed = mix64(k.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
        return pa.array(jump(mixed, shards).astype(np.int32), mask=k.is_null().to_numpy(zero_copy_only=False))

    return run(df[key].cast("bigint") if whole else F.when(df[key].isNotNull(), F.xxhash64(df[key].cast("string"))))


def assign(df: DataFrame, key: str, shards: int, output: str = "shard") -> DataFrame:
    """df with the shard of each row. The key column must not be the output column."""
    return df.withColumn(output, shard_of(df, key, shards))


def plan_growth(df: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """df with shard, shard_after and moved, for shards appended from before to after."""
    return df.withColumns({"shard": shard_of(df, key, before), "shard_after": shard_of(df, key, after)}).withColumn("moved", F.col("shard") != F.col("shard_after"))


def write_shards(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Write each shard to its own folder path/shard=N; one shuffle on the shard."""
    out = assign(df, key, shards).withColumn("shard", F.coalesce("shard", F.lit(0)))
    out.repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents written to their shards, whole, and the plan of growth of what the shards hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = _shared.new_path(spark, "shards")
    write_shards(docs, "doc_id", SHARDS, path)
    placed = spark.read.schema(T.StructType([*docs.schema, T.StructField("shard", T.IntegerType())])).parquet(path)
    placed = placed.select("doc_id", "source", "n_chars", F.when(F.col("doc_id").isNotNull(), F.col("shard")).alias("shard"))
    return placed.withColumn("shard_after", shard_of(placed, "doc_id", SHARDS_AFTER)).withColumn("moved", F.col("shard") != F.col("shard_after"))


def _sql() -> str:
    m = "18446744073709551616::UHUGEINT"
    mixed = "doc_id::UBIGINT"
    parts = []
    last = "(SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)"
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        parts.append(f"m{shift} AS (SELECT doc_id, (xor({mixed}, ({mixed}) >> {shift})::UHUGEINT * {by}::UHUGEINT % {m})::UBIGINT AS x FROM {last})")
        mixed, last = "x", f"m{shift}"
    walk = f"""k AS (SELECT doc_id, xor(x, x >> 31) AS k FROM {last}),
j AS (SELECT doc_id, k, -1::BIGINT AS b, 0::BIGINT AS j FROM k UNION ALL
SELECT doc_id, k2, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k2 >> 33) + 1)::DOUBLE))::BIGINT
FROM (SELECT doc_id, j, ((k::UHUGEINT * 2862933555777941757::UHUGEINT + 1) % {m})::UBIGINT AS k2 FROM j WHERE j < {SHARDS_AFTER}) s),
t AS (SELECT doc_id, max(b) FILTER (WHERE b < {SHARDS})::INTEGER AS shard, max(b)::INTEGER AS shard_after FROM j GROUP BY doc_id)"""
    return f"""WITH RECURSIVE {", ".join(parts)}, {walk}
SELECT d.doc_id, d.source, d.n_chars, t.shard, t.shard_after, t.shard <> t.shard_after AS moved FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id"""


SQL = _sql()
