"""Exact deduplication with a heavy-hitter split.

1. Each task summarises its texts' SHA-256 digests by Misra-Gries with
   ``counters`` counters; the summaries add up to at most ``counters``
   candidates, among them every digest that more than 2 / (counters + 1) of
   the rows have.
2. An exact count over all rows verifies the candidates and finds the winner
   of each, the least doc_id.  This table has at most ``counters`` rows whatever
   the input, so it is broadcast, and every task drops the losers of the
   frequent digests before anything is shuffled.
3. The remaining rows are shuffled by digest, and the first of each stays.

Defined results: the row with the least doc_id stays (nulls last; then by the
other columns, so repeated rows leave one).  A null text equals no other: all
such rows stay.  Empty texts are equal to each other.  Nulls in other columns
change nothing but come last in that order.  A very long text is hashed whole.
Digests that are as frequent as each other may or may not be candidates, with the
same result.  An empty table stays empty.  All columns are kept, under any names,
also those used inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _shared

COUNTERS = 1024


def shrink(keys: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """The Misra-Gries step on a whole summary: take the next greatest count off all, drop what is not positive."""
    if len(counts) <= counters:
        return keys, counts
    counts = counts - np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1]
    return keys[counts > 0], counts[counts > 0]


def misra_gries(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, n): at most ``counters`` candidates, n at most rows / (counters + 1) below the true count, for each task's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, "S32"), np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0).drop_null()
            if not len(column):
                continue
            fixed = np.frombuffer(b"".join(column.to_pylist()), dtype="V32")
            both = np.concatenate([keys.astype("V32"), fixed]) if len(keys) else fixed
            weight = np.concatenate([counts, np.ones(len(fixed), np.int64)])
            # void compares as bytes once it is seen as four big-endian integers
            order = np.lexsort(both.view(">u8").reshape(-1, 4).T[::-1])
            both, weight = both[order], weight[order]
            new = np.ones(len(both), bool)
            new[1:] = both[1:] != both[:-1]
            keys, counts = shrink(both[new], np.add.reduceat(weight, np.flatnonzero(new)), counters)
        yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(counts)], names=["digest", "n"])

    parts = digests.mapInArrow(run, T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType())]))
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters)


def heavy_winners(df: DataFrame, digest: str, doc_id: str, counters: int = COUNTERS) -> DataFrame:
    """(digest, copies, winner) of the frequent digests that occur more than once; exact, at most ``counters`` rows."""
    candidates = misra_gries(df.select(digest), counters).select(F.col("digest").alias(digest))
    hit = df.select(digest, doc_id).join(F.broadcast(candidates), digest)
    return hit.groupBy(digest).agg(F.count(F.lit(1)).alias("copies"), F.min(doc_id).alias("winner")).where("copies > 1")


def exact_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """The rows of df without those whose text another row has; see the module for which stays."""
    if counters < 1:
        raise ValueError("there must be a counter")
    names = df.columns
    digest, winner, is_heavy, number = _shared.fresh(names, "__digest", "__winner", "__heavy", "__n")
    keyed = df.withColumn(digest, F.unhex(F.sha2(df[text], 256)))
    found = heavy_winners(keyed.select(digest, F.col(doc_id).alias("id")), digest, "id", counters)
    heavy, _ = _shared.write_table(found.select(digest, F.col("winner").alias(winner), F.lit(True).alias(is_heavy)), "heavy")
    rest = keyed.join(F.broadcast(heavy), digest, "left").where(F.col(is_heavy).isNull() | F.col(doc_id).eqNullSafe(F.col(winner)))
    order = [F.col(doc_id).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c, t in zip(names, (f.dataType for f in df.schema), strict=True) if c not in (doc_id, text) and not isinstance(t, T.MapType))]
    single = df.where(df[text].isNull())  # the scan skips what has no null
    first = Window.partitionBy(digest).orderBy(*order)
    rest = rest.where(F.col(text).isNotNull())
    return rest.withColumn(number, F.row_number().over(first)).where(F.col(number) == 1).select(*names).unionByName(single)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """SELECT doc_id, text, lang, source, n_chars FROM documents
QUALIFY text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id, lang, source, n_chars) = 1"""
