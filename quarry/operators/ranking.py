"""Scores and their use: links, TF-IDF, BM25, limits for each domain, response order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import scoring
from quarry.operators.postings import with_token_size

RANK = (F.desc, F.asc)
#: Parts that a domain's results are cut in.
SHARES = 64


def link_scores(links: DataFrame, target: str = "target", source: str = "source_url", curve: Callable[[Column], Column] = scoring.link_curve) -> DataFrame:
    """(target, link_score, n_links): what links add to their targets; each (source, target) counts once, with its greatest score."""
    once = links.groupBy(source, target).agg(F.max("score").alias("score"))
    return once.groupBy(target).agg(F.sum(curve(F.col("score"))).alias("link_score"), F.count(F.lit(1)).alias("n_links"))


def add_link_scores(results: DataFrame, links: DataFrame, key: str = "value", target: str = "target", source: str = "source_url", counted: str = "url_links") -> DataFrame:
    """Results with the link scores of their url (or domain) added, and the number of links."""
    scores = link_scores(links, target, source).withColumnRenamed(target, "__t")
    out = results.join(scores, results[key] == scores["__t"], "left")
    return out.select(*(F.col(c) for c in results.columns if c != "score"), (F.col("score") + F.coalesce("link_score", F.lit(0.0))).alias("score"), F.coalesce("n_links", F.lit(0)).alias(counted))


def per_domain(df: DataFrame, most: int = 5, domain: str = "domain", *order: Column) -> DataFrame:
    """At most ``most`` rows of each domain in rank order."""
    rank = Window.partitionBy(domain).orderBy(*(order or (F.desc("score"), F.asc("value"))))
    return df.withColumn("__n", F.row_number().over(rank)).where(F.col("__n") <= most).drop("__n")


def deduplicate(results: DataFrame, limit: int = 1000, most: int = 5, domain: str = "domain") -> DataFrame:
    """The best ``limit`` rows: first those within ``most`` of their domain, then the others; in order of score.

    No row beyond the first ``most + limit`` of its domain is among them, so each of
    SHARES parts of a domain is cut there first, and no task sorts a whole domain.
    """
    order = (F.desc("score"), F.asc("value"))
    part = F.pmod(F.xxhash64("value"), F.lit(SHARES))
    first = results.withColumn("__n", F.row_number().over(Window.partitionBy(domain, part).orderBy(*order))).where(F.col("__n") <= most + limit)
    ranked = first.withColumn("__n", F.row_number().over(Window.partitionBy(domain).orderBy(*order))).where(F.col("__n") <= most + limit)
    chosen = ranked.withColumn("__extra", F.col("__n") > most).orderBy("__extra", *order).limit(limit)
    return chosen.drop("__n", "__extra").orderBy(*order)


def many_domains(results: DataFrame, domain: str = "domain") -> DataFrame:
    """(many): whether the results come from more than one domain."""
    return results.agg((F.min(domain) < F.max(domain)).alias("many")).select(F.coalesce("many", F.lit(False)).alias("many"))


def relative_threshold(df: DataFrame, share: float = 0.8, key: str = "domain", count: str = "count") -> DataFrame:
    """Rows with at least a share of their key's greatest count."""
    top = df.groupBy(F.col(key).alias("__k")).agg(F.max(count).alias("__top"))
    return df.join(top, F.col(key).eqNullSafe(F.col("__k"))).where(F.col(count) >= share * F.col("__top")).drop("__k", "__top")


def dense_ids(df: DataFrame, *order: str, id_name: str = "id") -> DataFrame:
    """Rows numbered from 0 in the order of the columns, without a task that sees all of them.

    Rows are ranged and sorted, numbered in their partition, and written, since
    ranges may differ from run to run; a partition's base is the sum of the sizes
    before it, a window over a row for each partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed, _ = tables.cut(place, "ranged")
    sizes = placed.groupBy(F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return placed.join(bases, F.col("__part") == F.col("__p")).select(*df.columns, (F.col("__base") + F.col("__at")).alias(id_name))


def top_per_key(df: DataFrame, most: int, key: str = "domain", count: str = "count", value: str = "word") -> DataFrame:
    return per_domain(df, most, key, F.desc(count), F.asc(value))


def page_of(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """A page of a ranked list."""
    return df.orderBy(*order).offset(offset).limit(limit)


def tf_idf(counts: DataFrame, document: str = "value") -> DataFrame:
    """Counted postings with score = count / size of the document * ln(documents / documents with the token)."""
    return _scored(counts, document, lambda c: c["tf"] * F.ln(c["documents"] / c["with_token"]))


def bm25(counts: DataFrame, document: str = "value", k1: float = 1.2, b: float = 0.75, min_size: int = 0) -> DataFrame:
    """Counted postings with the BM25 score of the relative frequency; documents smaller than ``min_size`` score 0."""

    def score(c: dict[str, Column]) -> Column:
        idf = F.ln((c["documents"] - c["with_token"] + 0.5) / (c["with_token"] + 0.5) + 1.0)
        value = idf * (c["tf"] * (k1 + 1.0)) / (c["tf"] + k1 * (1.0 - b + b * (c["size"] / c["mean_size"])))
        return F.when(c["size"] < min_size, 0.0).otherwise(value)

    return _scored(counts, document, score)


def _scored(counts: DataFrame, document: str, formula: Callable[[dict[str, Column]], Column]) -> DataFrame:
    written, _ = tables.cut(counts, "counts")  # it is read four times
    sizes = written.groupBy(document).agg(F.sum("count").alias("__size"))
    whole = sizes.agg(F.count(F.lit(1)).alias("__documents"), F.avg("__size").alias("__mean"))
    all_ = with_token_size(written, "__with").join(sizes, document).crossJoin(F.broadcast(whole))
    parts = {"tf": F.col("count") / F.col("__size"), "size": F.col("__size"), "documents": F.col("__documents"), "mean_size": F.col("__mean"), "with_token": F.col("__with")}
    return all_.select(*(c for c in counts.columns if c != "score"), formula(parts).alias("score"))


def decorate(results: DataFrame, urls: DataFrame, key: str = "value", url_key: str = "url_key") -> DataFrame:
    """Results with the url, title and snippet of the page; results are the small side of the join."""
    from quarry.functions import text as tx

    pages = urls.select(F.col(url_key).alias("__k"), "url", "title", tx.snippet_or_meta(F.col("text"), F.col("meta")).alias("snippet"))
    return results.join(pages, results[key] == pages["__k"], "left").drop("__k")
