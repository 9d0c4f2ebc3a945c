"""From pages and links to the posting tables of the search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import text as tx
from quarry.functions import url as ur
from quarry.operators import joins

#: Weights of title, h1, meta and text, and of the tokens that name the site.
WEIGHTS = {"title": 10.0, "h1": 3.0, "meta": 2.0, "text": 1.0}
SITE_WEIGHT = 20.0
MOST_ANCHOR = 1000


def with_url_columns(pages: DataFrame, url: str = "url") -> DataFrame:
    """Pages with host, domain, url_key and url_length."""
    u = F.col(url)
    return pages.withColumns({"host": ur.host(u), "url_key": ur.hash_input(u), "url_length": F.octet_length(ur.path_with_query(u))})


def site_tokens(host: Column) -> Column:
    """``site:`` and the host with and without www., the host, and its name without the top-level domain."""
    return F.filter(F.array_distinct(F.array(F.concat(F.lit("site:"), host), F.concat(F.lit("site:www."), host), host, ur.domain_without_tld(host))), lambda w: w != "")


def _weighed(words: Column, weight: float) -> Column:
    return F.transform(words, lambda w: F.struct(w.alias("token"), F.lit(weight).alias("weight")))


def url_postings(urls: DataFrame, centrality: DataFrame, weights: dict[str, float] = WEIGHTS, parse: Callable[[DataFrame], DataFrame] = lambda pages: pages) -> DataFrame:
    """(token, value, score, domain, url_length): each token of a page once, its columns' weights times the host's harmonic.

    A page's weights are added up in its row, so pages whose key no other page has
    need no shuffle. Those of a key that several pages have are added up over the
    pages; what tells them is the hash of the key, and one that is told wrongly is
    added up alone. ``parse`` makes the columns of the weights, after this choice.
    """
    key = F.xxhash64("url_key", "host", "url_length")
    repeated, _ = tables.cut(urls.groupBy(key.alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__key"), "repeated")

    def weighed(pages: DataFrame) -> DataFrame:
        rows = joins.lookup(parse(pages), centrality, "host", "host", "harmonic", "harmonic")
        each = rows.select(F.col("url_key").alias("value"), F.col("host").alias("domain"), "url_length", "harmonic", F.explode(page_tokens(weights)).alias("t"))
        return each.select(F.col("t.token").alias("token"), "value", (F.col("t.weight") * F.col("harmonic")).alias("score"), "domain", "url_length").where("token <> ''")

    once = weighed(urls.join(repeated, key == F.col("__key"), "left_anti"))
    again = weighed(urls.join(repeated, key == F.col("__key"), "left_semi"))
    # A page's domain and length follow from it: as keys they leave sums only, which hash aggregation takes.
    summed = again.groupBy("token", "value", "domain", "url_length").agg(F.sum("score").alias("score"))
    return once.unionByName(summed).withColumn("score", F.round("score", 9))


def page_tokens(weights: dict[str, float] = WEIGHTS) -> Column:
    """(token, weight) of a page: the weights of the columns that hold a token added up, each token once.

    The last column is the longest: its tokens that no other column has are taken as
    they are, and only the others are sorted.
    """
    sets = [(site_tokens(F.col("host")), SITE_WEIGHT), *((tx.expanded_word_set(F.coalesce(F.col(c), F.lit(""))), x) for c, x in weights.items())]
    names = [f"p{i}" for i in range(len(sets))]

    def added(sorted_: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            weight = t["weight"]
            for k in range(1, len(sets)):
                later = F.get(sorted_, i + k)
                weight = weight + F.when(later["token"] == t["token"], later["weight"]).otherwise(0.0)
            return F.struct(t["token"].alias("token"), weight.alias("weight"), ((i == 0) | (F.get(sorted_, i - 1)["token"] != t["token"])).alias("first"))

        first = F.filter(F.transform(sorted_, one), lambda t: t["first"])
        return F.transform(first, lambda t: F.struct(t["token"].alias("token"), t["weight"].alias("weight")))

    def fold(page: Column) -> Column:
        long_, long_weight = page[names[-1]], sets[-1][1]
        heads = [_weighed(page[n], x) for n, (_, x) in zip(names[:-1], sets[:-1], strict=True)]

        def use(named: Column) -> Column:
            both = F.sort_array(F.concat(*heads, _weighed(F.array_intersect(long_, named), long_weight)))
            return F.concat(_weighed(F.array_except(long_, named), long_weight), tx.let(both, added))

        return tx.let(F.concat(*(page[n] for n in names[:-1])), use)

    return tx.let(F.struct(*(c.alias(n) for n, (c, _) in zip(names, sets, strict=True))), fold)


def link_rows(links: DataFrame, centrality: DataFrame) -> DataFrame:
    """Links (host, path, target_host, target_path, text) with the source's harmonic as score and their keys."""
    rows = joins.lookup(links, centrality, "host", "host", "harmonic", "score")
    return rows.select(F.concat("host", "path").alias("source_url"), F.concat("target_host", "target_path").alias("target"), F.col("target_host").alias("target_domain"), "score", tx.unique_expanded_words(F.substring("text", 1, MOST_ANCHOR)).alias("__words"), F.concat("host", F.lit(">"), "target_host", "target_path").alias("link"))


def link_postings(links: DataFrame, urls: DataFrame, centrality: DataFrame) -> DataFrame:
    """(token, value, score, source_url, target) of the anchor words of links to known pages."""
    rows = joins.existing(link_rows(links, centrality), urls, {"target": "url_key"})
    return _anchor(rows, F.concat("source_url", F.lit(">"), "target"), "target")


def domain_link_postings(links: DataFrame, centrality: DataFrame) -> DataFrame:
    """(token, value, score, source_url, target_domain) of the anchor words of all links."""
    return _anchor(link_rows(links, centrality), F.concat("source_url", F.lit(">"), "target_domain"), "target_domain")


def _anchor(rows: DataFrame, value: Column, target: str) -> DataFrame:
    each = rows.select(F.explode("__words").alias("token"), value.alias("value"), "score", "source_url", target).where("token <> ''")
    # Else partitions would be those of the links' join, sized before their words are taken apart.
    return each.repartition("token", "value").groupBy("token", "value", "source_url", target).agg(F.max("score").alias("score")).select("token", "value", "score", "source_url", target)
