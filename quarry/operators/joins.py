"""Joins by existence, look-ups with a default, and set operations.

Sizes decide the physical join: Spark broadcasts a side below
spark.sql.autoBroadcastJoinThreshold (AQE measures it at run time) and shuffles
both otherwise, and its run-time Bloom filters stand in for hand-made ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def existing(df: DataFrame, known: DataFrame, on: dict[str, str]) -> DataFrame:
    """The rows of df whose columns (the keys of ``on``) are in known's (the values). Exact; order and columns of df stay."""
    names = list(on.items())
    right = known.select(*(F.col(v).alias(f"__k{i}") for i, (_, v) in enumerate(names)))
    return df.join(right, [df[k] == right[f"__k{i}"] for i, (k, _) in enumerate(names)], "left_semi")


def absent(df: DataFrame, known: DataFrame, on: dict[str, str]) -> DataFrame:
    """The rows of df that ``existing`` leaves out, those with a null key among them."""
    names = list(on.items())
    right = known.select(*(F.col(v).alias(f"__k{i}") for i, (_, v) in enumerate(names)))
    return df.join(right, [df[k] == right[f"__k{i}"] for i, (k, _) in enumerate(names)], "left_anti")


def existing_prefix(df: DataFrame, known: DataFrame, column: str, bits: int = 20) -> DataFrame:
    """Membership of a 64-bit hash without its low bits, as a lossy set keeps it."""
    right = known.select(F.shiftrightunsigned(known[column], bits).alias("__k"))
    return df.join(right, F.shiftrightunsigned(df[column], bits) == right["__k"], "left_semi")


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, output: str, default: float = 0.0) -> DataFrame:
    """df with a value of the table, or the default; the table has a row for each key."""
    right = table.select(F.col(table_key).alias("__k"), F.col(value).alias(output))
    return df.drop(output).join(right, F.col(key) == F.col("__k"), "left").drop("__k").fillna({output: default})


def known_pairs(edges: DataFrame, vertices: DataFrame, src: str = "src", dst: str = "dst", vertex: str = "host") -> DataFrame:
    """Distinct edges both ends of which are vertices."""
    pairs = edges.select(src, dst).distinct()
    return existing(existing(pairs, vertices, {src: vertex}), vertices, {dst: vertex})


def keep_one(df: DataFrame, *columns: str, order: Column | None = None) -> DataFrame:
    """One row of each key: the least by ``order`` (by default by all columns)."""
    rest = [c for c in df.columns if c not in columns]
    first = F.min(F.struct(*rest)) if order is None else F.min_by(F.struct(*rest), order)
    return df.groupBy(*columns).agg(first.alias("__r")).select(*(F.col(c) if c in columns else F.col(f"__r.{c}").alias(c) for c in df.columns)) if rest else df.distinct()


def in_range(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Rows whose 64-bit hash, taken as unsigned, lies from low to high."""
    signed = lambda v: (v ^ (1 << 63)) - (1 << 64) if (v ^ (1 << 63)) >= 1 << 63 else v ^ (1 << 63)
    return df.where(F.col(column).bitwiseXOR(F.lit(-(1 << 63))).between(signed(low), signed(high)))


def union_distinct(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def average_intersection(*lists: DataFrame) -> DataFrame:
    """(value, score) of the values that all lists hold, each once, with their mean score."""
    both = lists[0].select("value", "score")
    for x in lists[1:]:
        both = both.unionByName(x.select("value", "score"))
    return both.groupBy("value").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(lists)).drop("n")
