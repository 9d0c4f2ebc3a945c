"""The relations that the catalogue's queries run on, made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import html as ht
from quarry.functions import text as tx
from quarry.plans import index_build as ib


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ib.with_url_columns(table(spark, sf_dir, "pages"))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, url_key, url_length, title, h1, meta, text) of pages that have url columns, with their whole texts."""
    return ht.parse_pages(pages, most=ht.UNBOUNDED).select("page_id", "url", "host", "url_key", "url_length", "title", "h1", "meta", "text")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, parsed."""
    return parsed(keyed_pages(spark, sf_dir))


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with what links need of them."""
    p = table(spark, sf_dir, "pages")
    return ib.with_url_columns(p).select("page_id", "host", "url_key", ht.title(ht.visible(p["html"]), ht.UNBOUNDED).alias("title"))


def links(spark: SparkSession, sf_dir: str, parsed_urls: DataFrame | None = None) -> DataFrame:
    """(host, path, target_host, target_path, text, nofollow): the pages have no external links, so each gets three by arithmetic on its id."""
    p = link_targets(spark, sf_dir) if parsed_urls is None else parsed_urls.select("page_id", "host", "url_key", "title")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    source = p.select("page_id", "host", F.substring("url_key", F.length("host") + 1, F.lit(1 << 20)).alias("path")).crossJoin(F.broadcast(n)).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    source = source.withColumn("to", (F.col("page_id") * (7 + 2 * F.col("j")) + 3 + F.col("j")) % F.col("n"))
    target = p.select(F.col("page_id").alias("to"), F.col("host").alias("target_host"), F.substring("url_key", F.length("host") + 1, F.lit(1 << 20)).alias("target_path"), F.col("title").alias("text"))
    return source.join(target, "to").where("host <> target_host").select("host", "path", "target_host", "target_path", "text", ((F.col("page_id") + F.col("j")) % 5 == 0).alias("nofollow"))


def centrality(linked: DataFrame) -> DataFrame:
    """(host, harmonic): a stand-in for the computed centrality that SQL can follow, by the number of linking hosts.

    It is written, so that its size is known where it is looked up: a small one is
    broadcast, and whole pages are not shuffled by their few hosts.
    """
    n = F.count_distinct("host")
    return tables.cut(linked.groupBy(F.col("target_host").alias("host")).agg((n / (n + 40.0)).alias("harmonic")), "centrality")[0]


def url_postings(spark: SparkSession, sf_dir: str, known_centrality: DataFrame | None = None) -> DataFrame:
    return ib.url_postings(keyed_pages(spark, sf_dir), centrality(links(spark, sf_dir)) if known_centrality is None else known_centrality, parse=parsed)


def counts_of(df: DataFrame, key: str) -> DataFrame:
    """(token, value, count): full-text words of the texts."""
    words = df.select(F.col(key).alias("value"), F.explode(tx.full_text_words(F.col("text"))).alias("token"))
    return words.groupBy("token", "value").agg(F.count(F.lit(1)).alias("count"))


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_of(table(spark, sf_dir, "documents"), "doc_id")


def scored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_counts(spark, sf_dir).select("token", "value", F.col("count").cast("double").alias("score"))


def orders_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, value, quantity): lineitem as raw postings of orders under parts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("token"), F.col("l_orderkey").alias("value"), F.col("l_quantity").cast("long").alias("quantity"))


def micros(ts):
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the history of a key-value table."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), micros(F.col("ts")).alias("version"), F.col("event_id").alias("seq"))
