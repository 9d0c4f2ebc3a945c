"""The search over url, link and domain-link postings, and the search of single sites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import scoring
from quarry.functions.text import MOST_BYTES
from quarry.operators import postings as po
from quarry.operators import ranking as rk


@dataclass(frozen=True)
class Options:
    """Limits of a search; None is no limit."""

    query_max_words: int = 10
    most_links: int | None = 500_000
    most_domain_links: int | None = 100_000
    pre_result_limit: int | None = 200_000
    result_limit: int = 1000
    per_domain: int = 5
    deduplicate: bool = True


_PUNCT = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "+#") + " \t\n\r\f\v"


def query_words(query: str, limit: int = 10) -> list[str]:
    """The words of a query, as ``text.full_text_words`` has them; repeated ones count once."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in query)
    for sign in "\t,|!":
        lower = lower.replace(sign, " ")
    words = [w.strip(_PUNCT) for w in lower.split(" ")]
    return list(dict.fromkeys([w for w in words if 0 < len(w.encode()) <= MOST_BYTES][:limit]))


def _best(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else po.top(df, n)


def _matching(words: list[str], urls: DataFrame, links: DataFrame, domain_links: DataFrame, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    hit_links = _best(po.find_all_of(links, words, "avg", carry=("source_url", "target")), o.most_links)
    hit_domains = _best(po.find_all_of(domain_links, words, "avg", carry=("source_url", "target_domain")), o.most_domain_links)
    return po.find_all_of(urls, words, "sum", carry=("domain", "url_length")), hit_links, hit_domains


def scored(query: str, urls: DataFrame, links: DataFrame, domain_links: DataFrame, options: Options = Options()) -> DataFrame:
    """(value, domain, url_length, score, domain_links, url_links) of all pages with all words, links added."""
    found, hit_links, hit_domains = _matching(query_words(query, options.query_max_words), urls, links, domain_links, options)
    out = rk.add_link_scores(found, hit_domains, "domain", "target_domain", counted="domain_links")
    return rk.add_link_scores(out, hit_links, "value", "target", counted="url_links")


def search(query: str, urls: DataFrame, links: DataFrame, domain_links: DataFrame, options: Options = Options()) -> DataFrame:
    """The ranked results of a query. Equal scores go by value; without deduplication all of the best pages are given."""
    best = _best(scored(query, urls, links, domain_links, options), options.pre_result_limit)
    return rk.deduplicate(best, options.result_limit, options.per_domain) if options.deduplicate else best


def metrics(query: str, urls: DataFrame, links: DataFrame, domain_links: DataFrame, options: Options = Options()) -> DataFrame:
    """One row: pages, links and domain links found and used."""
    found, hit_links, hit_domains = _matching(query_words(query, options.query_max_words), urls, links, domain_links, options)
    out = rk.add_link_scores(rk.add_link_scores(found, hit_domains, "domain", "target_domain", counted="domain_links"), hit_links, "value", "target", counted="url_links")
    total = out.agg(F.count(F.lit(1)).alias("total_found"), F.coalesce(F.sum("url_links"), F.lit(0)).alias("link_url_matches"), F.coalesce(F.sum("domain_links"), F.lit(0)).alias("link_domain_matches"))
    n_links = hit_links.agg(F.count(F.lit(1)).alias("total_url_links_found"))
    n_domains = hit_domains.agg(F.count(F.lit(1)).alias("total_domain_links_found"))
    return total.crossJoin(n_links).crossJoin(n_domains).withColumn("links_handled", F.col("total_url_links_found"))


def site_search(query: str, urls: DataFrame, links: DataFrame, most_links: int = 1000, most: int = 1000, max_words: int = 10) -> DataFrame:
    """(domain, value, score, total): the best pages of every domain by themselves.

    The score is twice that of the words, a bonus for short URLs, and the domain's
    best links to the page.
    """
    words = query_words(query, max_words)
    found = po.find_all_of(urls, words, "sum", carry=("domain", "url_length"))
    hits = po.find_all_of(links, words, "sum", carry=("source_url", "target"))
    domain = F.regexp_extract("target", "^[^/]*", 0)
    best = rk.per_domain(hits.withColumn("domain", domain), most_links, "domain", F.desc("score"), F.asc("value"))
    grouped = best.groupBy("target").agg(F.sum(scoring.grouped_link_curve(F.col("score"))).alias("link_score"))
    both = found.join(grouped, found["value"] == grouped["target"], "left")
    out = both.select("domain", "value", (2 * F.col("score") + scoring.length_bonus(F.col("url_length")) + F.coalesce("link_score", F.lit(0.0))).alias("score"))
    total = found.groupBy(F.col("domain").alias("__d")).agg(F.count(F.lit(1)).alias("total"))
    return rk.per_domain(out, most).join(total, F.col("domain").eqNullSafe(F.col("__d"))).drop("__d")


def federated_search(query: str, domains: DataFrame, urls: DataFrame, links: DataFrame, most_domains: int = 1000, each: int = 5, max_words: int = 10) -> DataFrame:
    """Pages of the best domains: domains are found by their own index (token, value, score), then each is searched."""
    top = po.top(po.find_all_of(domains, query_words(query, max_words), "sum"), most_domains).select(F.col("value").alias("__d"), F.col("score").alias("domain_score"))
    pages = rk.per_domain(site_search(query, urls, links, max_words=max_words), each)
    return pages.join(top, pages["domain"] == top["__d"]).drop("__d")


def phrase_search(query: str, ngrams: DataFrame, n: int = 1000) -> DataFrame:
    """Pages with the whole query as one n-gram; ``ngrams`` is a posting table whose tokens are n-grams."""
    return po.top(po.find_all_of(ngrams, [" ".join(query_words_all(query))]), n)


def query_words_all(query: str) -> list[str]:
    """All words in order, repeated ones too."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in query)
    for sign in "\t,|!":
        lower = lower.replace(sign, " ")
    return [w for w in (x.strip(_PUNCT) for x in lower.split(" ")) if 0 < len(w.encode()) <= MOST_BYTES]
