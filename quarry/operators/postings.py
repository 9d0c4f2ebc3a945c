"""Inverted indexes as tables of postings (token, value, ...).

A posting table is folded: it has one row for each (token, value).  ``token`` is
what is looked up, ``value`` what is found.  Every operator is a plan over the
table; nothing is collected, and lists are never gathered into one row unless the
caller asks for that (``lists``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import tables

BEST = (F.desc, "score")


# --- build and maintain
def fold(df: DataFrame, *keys: str, **aggregates: Column) -> DataFrame:
    """One row for each key; by default the greatest score. Partial sums are made before the shuffle."""
    keys = keys or ("token", "value")
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in (aggregates or {"score": F.max("score")}).items()))


def fold_counts(df: DataFrame, count: str | None = None) -> DataFrame:
    """(token, value, count): the counts of equal records added up; a record without a count is 1."""
    return fold(df, count=F.sum(count) if count else F.count(F.lit(1)))


def fold_records(df: DataFrame, score: str = "score") -> DataFrame:
    """Whole records, of each (token, value) the one with the greatest score (ties: the greatest other columns)."""
    rest = [c for c in df.columns if c not in ("token", "value", score)]
    return df.groupBy("token", "value").agg(F.max(F.struct(score, *rest)).alias("r")).select("token", "value", *(F.col(f"r.{c}").alias(c) for c in (score, *rest)))


def cap(df: DataFrame, most: int, *order: Column, key: str = "token") -> DataFrame:
    """The first ``most`` records of each key in the given order (by default the best scores).

    The rank filter is applied before the shuffle too, so no task gets more than ``most`` records of a key from another one.
    """
    first = Window.partitionBy(key).orderBy(*(order or (F.desc("score"), F.asc("value"))))
    return df.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= most).drop("__n")


def merge(current: DataFrame, staged: DataFrame, most: int | None = None, **aggregates: Column) -> DataFrame:
    """Staged records folded into an index, then capped."""
    out = fold(current.unionByName(staged), **aggregates)
    return cap(out, most) if most else out


def merge_with(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two indexes."""
    return fold_records(a.unionByName(b)) if "score" in a.columns else a.unionByName(b).distinct()


#: Tokens with the longest lists, whose sizes are sent to all tasks.
LONGEST = 10_000


def with_token_size(df: DataFrame, size: str = "size", longest: int = LONGEST) -> DataFrame:
    """Each record with the number of records of its token; df should be a written table.

    The sizes of the longest lists, a bounded table, are broadcast, and their
    records are not shuffled; the records of the other tokens are joined by token.
    """
    sizes = df.groupBy("token").agg(F.count(F.lit(1)).alias(size))
    heavy = sizes.orderBy(F.desc(size), "token").limit(longest).withColumn("__heavy", F.lit(True))
    hot = df.join(F.broadcast(heavy), "token").drop("__heavy")
    rest = df.join(F.broadcast(heavy.select("token")), "token", "left_anti")
    return hot.unionByName(rest.join(sizes, "token"))


def with_list_size(df: DataFrame) -> DataFrame:
    """Each record with the number of records of its token (size)."""
    return with_token_size(tables.cut(df, "records")[0])


def transform(df: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Records changed by a function that sees the size of their list."""
    return make(with_list_size(df)).drop("size")


def sorted_lists(df: DataFrame, *order: Column) -> DataFrame:
    """Records clustered by token and sorted in it, without a global sort."""
    return df.repartition("token").sortWithinPartitions("token", *(order or (F.asc("value"),)))


def lists(df: DataFrame, *fields: str, most: int) -> DataFrame:
    """(token, records): each list as an array of at most ``most`` records, in order of their fields."""
    capped = cap(df, most, *(F.asc(f) for f in fields or ("value",)))
    return capped.groupBy("token").agg(F.array_sort(F.collect_list(F.struct(*(fields or ("value",))))).alias("records"))


# --- look up
def find(df: DataFrame, key, limit: int | None = None, *order: Column) -> DataFrame:
    """The records of one token. With a limit, the first of them in the given order (by value)."""
    hit = df.where(F.col("token") == key)
    return hit.orderBy(*(order or (F.asc("value"),))).limit(limit) if limit is not None else hit


def _keys(keys: Iterable) -> list:
    return list(dict.fromkeys(keys))


def find_all_of(df: DataFrame, keys: Iterable, combine: str = "sum", group: tuple[str, ...] = ("value",), carry: tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """AND: the values that have all keys, with their score combined.

    ``sum`` and ``avg`` take all lists; ``rarest`` keeps the score of the key with
    the fewest records (the first of equals).  ``carry`` columns follow from the
    value, so they are the same in all its records (as keys they keep the
    aggregation a hashed one).  An empty query finds nothing. Only the lists of
    the keys are read.
    """
    keys = _keys(keys)
    hits = df.where(F.col("token").isin(keys))
    if combine == "rarest":
        sizes = hits.groupBy("token").agg(F.count(F.lit(1)).alias("__size"))  # a row for each key of the query
        hits = hits.join(F.broadcast(sizes), "token")
        how = F.min_by(score, F.struct("__size", "token"))
    elif combine in ("sum", "avg"):
        how = {"sum": F.sum, "avg": F.avg}[combine](score)
    else:
        raise ValueError(combine)
    found = hits.groupBy(*group, *carry).agg(how.alias(score), F.count(F.lit(1)).alias("__n"))
    return found.where(F.col("__n") == len(keys)).drop("__n").where(F.lit(bool(keys)))


def find_any_sum(df: DataFrame, keys: Iterable, limit: int | None = None) -> DataFrame:
    """OR: scores added up over the keys, of each key's first ``limit`` records by value."""
    hits = df.where(F.col("token").isin(_keys(keys)))
    hits = cap(hits, limit, F.asc("value")) if limit else hits
    return sum_sorted(hits)


def sum_sorted(*parts: DataFrame, keys: tuple[str, ...] = ("value",)) -> DataFrame:
    """The union of record lists with the scores of equal values added up."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*keys).agg(F.sum("score").alias("score"))


def find_group_by(df: DataFrame, keys: Iterable, group: str, formula: Callable[[Column], Column] = lambda s: s, combine: str = "rarest") -> DataFrame:
    """(group, score, count) over the AND of the keys: the formula of each score, added up by a carried column."""
    found = find_all_of(df, keys, combine, carry=(group,))
    return found.groupBy(group).agg(F.sum(formula(F.col("score"))).alias("score"), F.count(F.lit(1)).alias("count"))


def find_top(df: DataFrame, keys: Iterable, n: int, mod: Callable[[Column], Column] | None = None, mode: str = "add", combine: str = "sum", carry: tuple[str, ...] = ()) -> DataFrame:
    """The n best of an AND after its scores are modified, ties by value.

    ``mod`` makes a column of the value; it is added to the score or multiplied by
    it.  In mode ``add`` an empty query finds all values with their best score, in
    mode ``mul`` none.
    """
    keys = _keys(keys)
    if not keys and mode == "add":
        found = df.groupBy("value").agg(F.max("score").alias("score"), *(F.first(c).alias(c) for c in carry))
    else:
        found = find_all_of(df, keys, combine, carry=carry)
    if mod is not None:
        m = mod(F.col("value"))
        found = found.withColumn("score", F.col("score") + m if mode == "add" else F.col("score") * m)
    return top(found, n)


def find_total(df: DataFrame, keys: Iterable) -> DataFrame:
    """(total): the number of values in the AND."""
    return find_all_of(df, keys).agg(F.count(F.lit(1)).alias("total"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Exactly the first n rows (all of them if there are fewer): a top-k in each task, then one of the rest."""
    return df.orderBy(*(order or (F.desc("score"), F.asc("value")))).limit(n)


def lower_bound(df: DataFrame, value, column: str = "value") -> DataFrame:
    """The first row not below the value."""
    return df.where(F.col(column) >= value).orderBy(column).limit(1)


# --- statistics
def key_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def heavy_keys(df: DataFrame, least: int) -> DataFrame:
    """Tokens with more than ``least`` records."""
    return key_counts(df).where(F.col("n") > least)


def capped_keys(df: DataFrame, most: int) -> DataFrame:
    """Tokens whose lists have reached the cap."""
    return key_counts(df).where(F.col("n") >= most)


def index_stats(df: DataFrame) -> DataFrame:
    """One row: keys, those with more than 10 and 100 records, records, and records for each key."""
    n = F.col("n")
    return key_counts(df).agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(n > 10).alias("n_keys_over_10"),
        F.count_if(n > 100).alias("n_keys_over_100"),
        F.coalesce(F.sum(n), F.lit(0)).alias("n_records"),
        F.avg(n).alias("mean_records"),
    )


def size_stats(df: DataFrame, size: Column) -> DataFrame:
    """(total, mean) of document sizes."""
    return df.agg(F.sum(size).alias("total"), F.avg(size).alias("mean"))


def word_stats(df: DataFrame, words: Iterable, documents: DataFrame) -> DataFrame:
    """(token, n, ratio): in how many of the documents each word of a query is; words that are nowhere too."""
    words = _keys(words)
    asked = df.sparkSession.createDataFrame([(w,) for w in words], "token string")
    total = documents.agg(F.count(F.lit(1)).alias("__total"))
    counted = key_counts(df.where(F.col("token").isin(words)))
    out = asked.join(counted, "token", "left").crossJoin(F.broadcast(total))
    return out.select("token", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("__total")).alias("ratio"))


def check_dictionary(df: DataFrame, records: DataFrame) -> DataFrame:
    """(missing): postings whose value is not among the records; 0 in a sound index."""
    return df.join(records.select("value"), "value", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
