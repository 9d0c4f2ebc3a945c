"""Algebra of sorted arrays inside a row, and of small tables of tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import let


def intersection(*arrays: Column) -> Column:
    """Values that all arrays hold, sorted."""
    out = arrays[0]
    for a in arrays[1:]:
        out = F.array_intersect(out, a)
    return F.array_sort(F.array_distinct(out))


def merge_sorted(*arrays: Column) -> Column:
    """All elements in order, repeats kept."""
    return F.array_sort(F.concat(*arrays))


def top_k(a: Column, k: int) -> Column:
    """The k greatest elements in ascending order, or all of them."""
    return let(F.array_sort(a), lambda s: F.slice(s, F.greatest(F.size(s) - (k - 1), F.lit(1)), F.lit(k)))


def partial_sort(a: Column, limit: int) -> Column:
    """The ``limit`` least elements in order."""
    return F.slice(F.array_sort(a), 1, limit)


def incremental_partitions(spark: SparkSession, dims: list[int], limit: int) -> DataFrame:
    """(at): the first ``limit`` index tuples below the dims, by their sum, then their greatest index, then backwards by the tuples."""
    out = spark.range(1).select(F.array().cast("array<int>").alias("at"))
    for d in dims:
        out = out.select("at", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("i")).select(F.concat("at", F.array(F.col("i"))).alias("at"))
    total = F.aggregate("at", F.lit(0), lambda s, x: s + x)
    return out.orderBy(total, F.array_max("at"), F.desc("at")).limit(limit)
