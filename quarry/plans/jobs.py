"""Batch jobs over crawled rows: splits by host, link filters, counters, host graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import hashing
from quarry.functions import url as ur
from quarry.operators import joins
from quarry.sources import sinks


def node_of(host: Column, nodes: int) -> Column:
    """The node of a host by its token hash."""
    return hashing.unsigned_mod(hashing.token_hash(host), nodes).cast("int")


def split_by_host(df: DataFrame, nodes: int, path: str, host: str = "host", rows_per_file: int | None = None) -> None:
    """Rows to one folder for each node, node=N; all rows of a host go together, so one shuffle by node."""
    placed = df.withColumn("node", node_of(F.col(host), nodes))
    sinks.write_tsv(placed.repartition(nodes, "node"), path, rows_per_file, ("node",))


def split_links(links: DataFrame, nodes: int, path: str, rows_per_file: int | None = None) -> None:
    """Links to the node of their target."""
    split_by_host(links, nodes, path, "target_host", rows_per_file)


def direct_links(links: DataFrame, urls: DataFrame) -> DataFrame:
    """Links whose target page is known."""
    target = links.withColumn("__t", F.concat("target_host", "target_path"))
    return joins.existing(target, urls, {"__t": "url_key"}).drop("__t")


def urls_with_direct_links(urls: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that a link points to."""
    return joins.existing(urls, links.select(F.concat("target_host", "target_path").alias("t")).distinct(), {"url_key": "t"})


def links_to_hosts(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """Links to the hosts of a table."""
    return joins.existing(links, hosts.select("host").distinct(), {"target_host": "host"})


def relevant_links(links: DataFrame, urls: DataFrame) -> dict[str, DataFrame]:
    """The pipeline of link filters: direct links, the pages they reach, and all links to these pages' hosts."""
    direct = direct_links(links, urls)
    reached = urls_with_direct_links(urls, direct)
    return {"direct": direct, "reached": reached, "relevant": links_to_hosts(links, reached)}


def count_per_host(df: DataFrame, host: str = "host") -> DataFrame:
    return df.groupBy(host).agg(F.count(F.lit(1)).alias("n"))


def save_hosts(df: DataFrame, hosts: DataFrame, path: str, host: str = "host") -> None:
    """Write the rows of the listed hosts."""
    sinks.write_tsv(joins.existing(df, hosts, {host: "host"}), path)


def distinct_hosts(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.select(ur.host(F.col(url)).alias("host")).where("host <> ''").distinct()


def host_vertices(urls: DataFrame, url: str = "url") -> DataFrame:
    """(host, hash): the vertices of the host graph with their stable 64-bit hash; an id by order would need one task."""
    return distinct_hosts(urls, url).withColumn("hash", hashing.token_hash(F.col("host")))


def host_edges(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst): distinct edges between known, different hosts."""
    pairs = links.select(F.col("host").alias("src"), F.col("target_host").alias("dst")).where("src <> dst")
    return joins.known_pairs(pairs, hosts)


def host_words(df: DataFrame, words: Column, most: int = 100, host: str = "host") -> DataFrame:
    """(host, word, n): the bag of words of each host, its ``most`` most frequent ones."""
    from quarry.functions.text import word_counts
    from quarry.operators.ranking import per_domain

    return per_domain(word_counts(df, words, host), most, host, F.desc("n"), F.asc("word"))


def crawl_stats(results: DataFrame, host: str = "host", status: str = "status") -> DataFrame:
    """(host, n, ok, not_ok, errors, ok_rate): responses by class; status 0 or null is a transport error."""
    s = F.coalesce(F.col(status), F.lit(0))
    n = F.count(F.lit(1))
    return results.groupBy(host).agg(n.alias("n"), F.count_if(s == 200).alias("ok"), F.count_if((s != 200) & (s != 0)).alias("not_ok"), F.count_if(s == 0).alias("errors"), (F.count_if(s == 200) / n).alias("ok_rate"))


def by_status(results: DataFrame, status: str = "status") -> DataFrame:
    """Crawl results with their class: ok, not_ok or error."""
    s = F.coalesce(F.col(status), F.lit(0))
    return results.withColumn("status_class", F.when(s == 200, "ok").when(s == 0, "error").otherwise("not_ok"))


def write_crawl(results: DataFrame, path: str) -> None:
    """Crawl results in a folder for each class."""
    by_status(results).write.partitionBy("status_class").option("compression", "zstd").parquet(path)
