"""An index of domains by the words of their titles and of the links to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import joins
from quarry.operators import postings as po
from quarry.operators import ranking as rk


def title_words(urls: DataFrame) -> DataFrame:
    """(domain, word, count): words of the titles of a host's pages."""
    each = urls.select(F.col("host").alias("domain"), F.explode(tx.words_without_stopwords(F.col("title"))).alias("word"))
    return each.groupBy("domain", "word").agg(F.count(F.lit(1)).alias("count"))


def anchor_words(links: DataFrame) -> DataFrame:
    """(domain, word, count): words of the links to a host."""
    each = links.select(F.col("target_host").alias("domain"), F.explode(tx.words_without_stopwords(F.col("text"))).alias("word"))
    return each.groupBy("domain", "word").agg(F.count(F.lit(1)).alias("count"))


def first_page_words(urls: DataFrame) -> DataFrame:
    """(domain, word): title words of each host's first page: the one with the shortest path, then the least."""
    first = Window.partitionBy("host").orderBy("url_length", "url_key")
    page = urls.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return page.select(F.col("host").alias("domain"), F.explode(tx.words_without_stopwords(F.col("title"))).alias("word")).distinct()


def build(urls: DataFrame, links: DataFrame, centrality: DataFrame, share: float = 0.8, most: int = 100) -> DataFrame:
    """(token, value, score): words of the first page, frequent title words and the top anchor words of a domain, scored by its harmonic."""
    frequent = rk.relative_threshold(title_words(urls), share).select("domain", "word")
    anchors = rk.top_per_key(anchor_words(links), most).select("domain", "word")
    rows = joins.union_distinct(first_page_words(urls), frequent, anchors)
    scored = joins.lookup(rows, centrality, "domain", "host", "harmonic", "score")
    return scored.select(F.col("word").alias("token"), F.col("domain").alias("value"), "score")


def domain_info(urls: DataFrame, links: DataFrame, domain: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """(list, word, count): a page of each of the three word lists of a domain."""
    u, ln = urls.where(F.col("host") == domain), links.where(F.col("target_host") == domain)
    titles = title_words(u).withColumn("list", F.lit("title"))
    anchors = anchor_words(ln).withColumn("list", F.lit("anchor"))
    first = first_page_words(u).withColumns({"list": F.lit("first_page"), "count": F.lit(1).cast("long")})
    rank = Window.partitionBy("list").orderBy(F.desc("count"), "word")
    both = titles.unionByName(anchors).unionByName(first).withColumn("__n", F.row_number().over(rank))
    return both.where((F.col("__n") > offset) & (F.col("__n") <= offset + limit)).select("list", "word", "count")


def word_lookup(index: DataFrame, word: str) -> DataFrame:
    return po.find(index, word)


def word_in_domain(index: DataFrame, word: str, domain: str) -> DataFrame:
    return po.find(index, word).where(F.col("value") == domain)


def word_count(index: DataFrame, word: str) -> DataFrame:
    return po.find_total(index, [word])


def harmonic_of(urls: DataFrame, centrality: DataFrame) -> DataFrame:
    """(url, harmonic) of pages, 0 for unknown hosts."""
    return joins.lookup(urls.select("url", "host"), centrality, "host", "host", "harmonic", "harmonic").select("url", "harmonic")
