"""Queries of index building, ranking, search and the domain index."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import tables
from quarry.catalog import relations as r
from quarry.catalog import sql as q
from quarry.catalog.text import _STOP
from quarry.functions import scoring
from quarry.functions import text as tx
from quarry.operators import postings as po
from quarry.operators import ranking as rk
from quarry.operators import staging
from quarry.plans import domain_index as di
from quarry.plans import index_build as ib
from quarry.plans import search as se
from quarry.sources import sinks

QUERY = "The of, the"
OPTIONS = se.Options(most_links=None, most_domain_links=None, pre_result_limit=None)


class Web:
    """The tables and indexes of a search, in a folder of the shared one that is named after the pages' file; each is built when it is asked for and not there yet."""

    NAMES = ("urls", "linked", "centrality", "postings", "links", "domain_links")

    def __init__(self, spark, sf_dir: str, build: bool = False):
        self._spark, self._sf_dir = spark, sf_dir
        self._path = f"{tables.shared_folder(spark)}/quarry/web-{tables.fingerprint(spark, f'{sf_dir}/pages.parquet')}"
        if build:
            tables.remove(spark, self._path)
            for name in self.NAMES:
                getattr(self, name)

    def _there(self, name: str) -> bool:
        return staging.marked(self._spark, f"{self._path}/{name}") is not None

    def _kept(self, name: str, make: Callable[[], DataFrame], write: Callable[[DataFrame, str], None] = lambda df, path: df.write.parquet(path)) -> DataFrame:
        path = f"{self._path}/{name}"
        if not self._there(name):
            tables.remove(self._spark, path)
            write(make(), path)
            staging.mark(self._spark, path, {})  # valid from here on
        return self._spark.read.parquet(path)

    @cached_property
    def urls(self) -> DataFrame:
        return self._kept("urls", lambda: r.urls(self._spark, self._sf_dir))

    @cached_property
    def linked(self) -> DataFrame:
        return self._kept("linked", lambda: r.links(self._spark, self._sf_dir, self.urls))

    @cached_property
    def centrality(self) -> DataFrame:
        return self._kept("centrality", lambda: r.centrality(self.linked if self._there("linked") else r.links(self._spark, self._sf_dir)))

    @cached_property
    def postings(self) -> DataFrame:
        def make() -> DataFrame:
            return ib.url_postings(self.urls, self.centrality) if self._there("urls") else r.url_postings(self._spark, self._sf_dir, self.centrality)

        return self._kept("postings", make, sinks.write_posting_runs)

    @cached_property
    def links(self) -> DataFrame:
        return self._kept("links", lambda: ib.link_postings(self.linked, self.urls, self.centrality), sinks.write_posting_runs)

    @cached_property
    def domain_links(self) -> DataFrame:
        return self._kept("domain_links", lambda: ib.domain_link_postings(self.linked, self.centrality), sinks.write_posting_runs)


def built(spark, sf_dir: str) -> DataFrame:
    """(name, n): the tables of a search, built anew, and their rows."""
    web = Web(spark, sf_dir, build=True)
    counts = [getattr(web, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in Web.NAMES]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("score",)})


def _web(make):
    return lambda spark, sf_dir: make(Web(spark, sf_dir))


def url_index(spark, sf_dir: str) -> DataFrame:
    return _rounded(r.url_postings(spark, sf_dir))


def link_index(spark, sf_dir: str) -> DataFrame:
    linked = r.links(spark, sf_dir)
    return _rounded(ib.link_postings(linked, r.urls(spark, sf_dir), r.centrality(linked)))


def domain_link_index(spark, sf_dir: str) -> DataFrame:
    linked = r.links(spark, sf_dir)
    return _rounded(ib.domain_link_postings(linked, r.centrality(linked)))


def domain_index(spark, sf_dir: str) -> DataFrame:
    linked = r.links(spark, sf_dir)
    return _rounded(di.build(r.urls(spark, sf_dir), linked, r.centrality(linked)))


def counts_scored(score):
    return lambda spark, sf_dir: _rounded(score(r.page_counts(spark, sf_dir)))


def link_scores(spark, sf_dir: str) -> DataFrame:
    linked = r.links(spark, sf_dir)
    rows = ib.link_rows(linked, r.centrality(linked))
    return _rounded(rk.link_scores(rows), "link_score")


def domain_scores(spark, sf_dir: str) -> DataFrame:
    linked = r.links(spark, sf_dir)
    return _rounded(rk.link_scores(ib.link_rows(linked, r.centrality(linked)), "target_domain"), "link_score")


def grouped_links(spark, sf_dir: str) -> DataFrame:
    linked = r.links(spark, sf_dir)
    rows = ib.link_rows(linked, r.centrality(linked))
    return _rounded(rows.groupBy("target").agg(F.sum(scoring.grouped_link_curve(F.col("score"))).alias("score"), F.count(F.lit(1)).alias("n")))


def searched(web: Web) -> DataFrame:
    found = se.search(QUERY, web.postings, web.links, web.domain_links, OPTIONS)
    return _rounded(rk.decorate(found, web.urls))


def response(spark, sf_dir: str) -> DataFrame:
    """The response of a search as JSON: a single row of at most 10 results."""
    web = Web(spark, sf_dir)
    found = rk.decorate(se.search(QUERY, web.postings, web.links, web.domain_links), web.urls)
    return sinks.response(found.select("url", "title", "snippet", F.round("score", 4).alias("score")), [F.desc("score"), F.asc("url")], 10, query=F.lit(QUERY))


def phrase(spark, sf_dir: str) -> DataFrame:
    """Pages with the words of a query in a row, from an index of n-grams of up to 3 words."""
    grams = r.urls(spark, sf_dir).select(F.col("url_key").alias("value"), F.explode(tx.ngrams(tx.full_text_words(F.col("text")), 3)).alias("token"))
    counted = grams.where(F.col("token") == "of the").groupBy("token", "value").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return se.phrase_search("Of the", counted, 1000)


def host_words(spark, sf_dir: str) -> DataFrame:
    from quarry.plans import jobs

    return jobs.host_words(r.urls(spark, sf_dir), tx.full_text_words(F.col("text")))


def site(web: Web) -> DataFrame:
    return _rounded(se.site_search(QUERY, web.postings, web.links))


def federated(web: Web) -> DataFrame:
    return _rounded(se.federated_search("and", _with_stopwords(web), web.postings, web.links), "score", "domain_score")


def _with_stopwords(web: Web) -> DataFrame:
    """A domain index whose tokens are all title words."""
    words = web.urls.select(F.col("host").alias("value"), F.explode(tx.full_text_words(F.col("title"))).alias("token")).distinct()
    return words.join(web.centrality, words["value"] == web.centrality["host"], "left").select("token", "value", F.coalesce("harmonic", F.lit(0.0)).alias("score"))


QUERIES = {
    "rnk0_web_index": built,
    "rnk1_url_index": url_index,
    "rnk2_link_index": link_index,
    "rnk2_domain_link_index": domain_link_index,
    "jn4_link_scores": link_scores,
    "jn5_domain_scores": domain_scores,
    "agg8_grouped_links": grouped_links,
    "rnk3_search": _web(searched),
    "rnk3_search_all": _web(lambda w: _rounded(se.search(QUERY, w.postings, w.links, w.domain_links, se.Options(most_links=None, most_domain_links=None, pre_result_limit=None, deduplicate=False)))),
    "agg18_metrics": _web(lambda w: se.metrics(QUERY, w.postings, w.links, w.domain_links, OPTIONS)),
    "rnk4_domain_dedup": _web(lambda w: _rounded(rk.deduplicate(po.find_all_of(w.postings, ["the"], carry=("domain",)), 60, 2))),
    "rnk6_site_search": _web(site),
    "rnk7_tfidf": counts_scored(rk.tf_idf),
    "rnk8_bm25": counts_scored(rk.bm25),
    "rnk8_bm25_min_size": counts_scored(lambda c: rk.bm25(c, min_size=200)),
    "rnk11_domain_index": domain_index,
    "rnk12_domain_scores": lambda s, d: _rounded(po.top(domain_index(s, d).groupBy("value").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("words")), 1000)),
    "rnk13_domain_info": lambda s, d: di.domain_info(r.urls(s, d), r.links(s, d), "therha.example.com", 50, 5),
    "rnk14_word_lookup": lambda s, d: di.word_in_domain(r.url_postings(s, d).withColumn("score", F.round("score", 6)).select("token", F.col("domain").alias("value"), "score"), "and", "therha.example.com"),
    "rnk14_harmonic_of": lambda s, d: _rounded(di.harmonic_of(r.urls(s, d), r.centrality(r.links(s, d))), "harmonic"),
    "rnk15_federated": _web(federated),
    "idx20_phrase": phrase,
    "agg16_host_words": host_words,
    "win4_top_anchor_words": lambda s, d: rk.top_per_key(di.anchor_words(r.links(s, d)), 100),
    "snk9_response": response,
}

_W = (*q.WEB, q.URL_POSTINGS, q.LINK_POSTINGS)
_TOKENS = "('the', 'of')"
_SCORED = f"""found AS (SELECT value, any_value(domain) AS domain, any_value(url_length) AS url_length, sum(score) AS score FROM postings WHERE token IN {_TOKENS} GROUP BY value HAVING count(*) = 2),
hit_links AS (SELECT source_url, target, max(score) AS score FROM (SELECT value, source_url, target, avg(score) AS score FROM link_postings WHERE token IN {_TOKENS} GROUP BY ALL HAVING count(*) = 2) GROUP BY ALL),
hit_domains AS (SELECT source_url, target_domain, max(score) AS score FROM (SELECT value, source_url, target_domain, avg(score) AS score FROM domain_link_postings WHERE token IN {_TOKENS} GROUP BY ALL HAVING count(*) = 2) GROUP BY ALL),
url_scores AS (SELECT target, sum((exp(25 * score) - 1) / 50) AS s, count(*) AS n FROM hit_links GROUP BY target),
domain_scores AS (SELECT target_domain, sum((exp(25 * score) - 1) / 50) AS s, count(*) AS n FROM hit_domains GROUP BY target_domain),
ranked AS MATERIALIZED (SELECT f.value, f.domain, f.url_length, f.score + coalesce(d.s, 0) + coalesce(u.s, 0) AS score, coalesce(d.n, 0) AS domain_links, coalesce(u.n, 0) AS url_links FROM found f LEFT JOIN url_scores u ON f.value = u.target LEFT JOIN domain_scores d ON f.domain = d.target_domain)"""
_DEDUP = lambda source, most, limit: f"SELECT * EXCLUDE (extra) FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, value) > {most} AS extra FROM {source}) ORDER BY extra, score DESC, value LIMIT {limit}"
_SNIP = "CASE WHEN strlen(text) >= 140 THEN substr(text, 1, list_max(list_filter(range(0, 141), lambda i: strlen(substr(text, 1, i)) <= 140))) || '...' ELSE text END"
_NOSTOP = lambda c: f"list_filter({q.clean_words(c)}, lambda w: w NOT IN ({_STOP}))"
_TITLE_WORDS = f"title_words AS (SELECT domain, word, count(*) AS count FROM (SELECT host AS domain, unnest({_NOSTOP('title')}) AS word FROM urls) GROUP BY ALL)"
_ANCHOR_WORDS = f"anchor_words AS (SELECT domain, word, count(*) AS count FROM (SELECT target_host AS domain, unnest({_NOSTOP('text')}) AS word FROM links) GROUP BY ALL)"
_FIRST_WORDS = f"first_words AS (SELECT DISTINCT domain, unnest(w) AS word FROM (SELECT host AS domain, {_NOSTOP('title')} AS w FROM urls QUALIFY row_number() OVER (PARTITION BY host ORDER BY url_length, url_key) = 1))"
_DOMAIN_INDEX = f"""{_TITLE_WORDS}, {_ANCHOR_WORDS}, {_FIRST_WORDS},
domain_words AS (SELECT domain, word FROM first_words UNION SELECT domain, word FROM (SELECT * FROM title_words QUALIFY count >= 0.8 * max(count) OVER (PARTITION BY domain)) UNION SELECT domain, word FROM (SELECT * FROM anchor_words QUALIFY row_number() OVER (PARTITION BY domain ORDER BY count DESC, word) <= 100)),
domain_index AS MATERIALIZED (SELECT word AS token, domain AS value, round(coalesce(harmonic, 0), 6) AS score FROM domain_words LEFT JOIN centrality ON host = domain)"""
_SIZES = """sizes AS (SELECT value, sum(count) AS size FROM counts GROUP BY value), whole AS (SELECT count(*) AS n, avg(size) AS mean FROM sizes), df AS (SELECT token, count(*) AS d FROM counts GROUP BY token)"""
_BM25 = lambda least: q.with_(q.COUNTS, _SIZES) + f"SELECT token, value, count, round(CASE WHEN size < {least} THEN 0 ELSE ln((n - d + 0.5::DOUBLE) / (d + 0.5::DOUBLE) + 1) * (count / size * 2.2::DOUBLE) / (count / size + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)) END, 6) AS score FROM counts JOIN sizes USING (value) JOIN df USING (token), whole"
_SITE = lambda tokens, n: f"""sfound AS (SELECT value, any_value(domain) AS domain, any_value(url_length) AS url_length, sum(score) AS score FROM postings WHERE token IN {tokens} GROUP BY value HAVING count(*) = {n}),
shits AS (SELECT value, target, sum(score) AS score FROM link_postings WHERE token IN {tokens} GROUP BY ALL HAVING count(*) = {n}),
sbest AS (SELECT * FROM shits QUALIFY row_number() OVER (PARTITION BY regexp_extract(target, '^[^/]*') ORDER BY score DESC, value) <= 1000),
sgroup AS (SELECT target, sum((exp(20 * score) - 1) / 10) AS s FROM sbest GROUP BY target),
site AS MATERIALIZED (SELECT domain, value, 2 * score + (1000 - url_length) / 500.0::DOUBLE + coalesce(s, 0) AS score, count(*) OVER (PARTITION BY domain) AS total FROM sfound LEFT JOIN sgroup ON value = target QUALIFY row_number() OVER (PARTITION BY domain ORDER BY 2 * score + (1000 - url_length) / 500.0::DOUBLE + coalesce(s, 0) DESC, value) <= 1000)"""  # noqa: E731

_JSON = "json_object('url', url, 'title', title, 'snippet', snippet, 'score', round(score, 4))"

SQL = {
    "rnk0_web_index": q.with_(*_W) + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {t}" for n, t in (("urls", "urls"), ("linked", "links"), ("centrality", "centrality"), ("postings", "postings"), ("links", "link_postings"), ("domain_links", "domain_link_postings"))),
    "snk9_response": q.with_(*_W, _SCORED) + f"SELECT '{{\"status\":\"success\",\"query\":\"The of, the\",\"results\":[' || string_agg({_JSON}, ',' ORDER BY round(score, 4) DESC, url) || ']}}' AS json FROM (SELECT u.url, u.title, {_SNIP.replace('text', 'u.text')} AS snippet, s.score FROM ({_DEDUP('ranked', 5, 1000)}) s LEFT JOIN urls u ON s.value = u.url_key ORDER BY round(score, 4) DESC, url LIMIT 10)",
    "rnk1_url_index": q.with_(*q.WEB, q.URL_POSTINGS) + "SELECT token, value, round(score, 6) AS score, domain, url_length FROM postings",
    "rnk2_link_index": q.with_(*_W) + "SELECT token, value, round(score, 6) AS score, source_url, target FROM link_postings",
    "rnk2_domain_link_index": q.with_(*_W) + "SELECT token, value, round(score, 6) AS score, source_url, target_domain FROM domain_link_postings",
    "jn4_link_scores": q.with_(*_W) + "SELECT target, round(sum((exp(25 * score) - 1) / 50), 6) AS link_score, count(*) AS n_links FROM (SELECT source_url, target, max(score) AS score FROM link_rows GROUP BY ALL) GROUP BY target",
    "jn5_domain_scores": q.with_(*_W) + "SELECT target_domain, round(sum((exp(25 * score) - 1) / 50), 6) AS link_score, count(*) AS n_links FROM (SELECT source_url, target_domain, max(score) AS score FROM link_rows GROUP BY ALL) GROUP BY target_domain",
    "agg8_grouped_links": q.with_(*_W) + "SELECT target, round(sum((exp(20 * score) - 1) / 10), 6) AS score, count(*) AS n FROM link_rows GROUP BY target",
    "rnk3_search": q.with_(*_W, _SCORED) + f"SELECT s.value, s.domain, s.url_length, round(s.score, 6) AS score, s.domain_links, s.url_links, u.url, u.title, {_SNIP.replace('text', 'u.text')} AS snippet FROM ({_DEDUP('ranked', 5, 1000)}) s LEFT JOIN urls u ON s.value = u.url_key",
    "rnk3_search_all": q.with_(*_W, _SCORED) + "SELECT value, domain, url_length, round(score, 6) AS score, domain_links, url_links FROM ranked",
    "agg18_metrics": q.with_(*_W, _SCORED) + f"SELECT (SELECT count(*) FROM ranked) AS total_found, (SELECT sum(url_links) FROM ranked)::BIGINT AS link_url_matches, (SELECT sum(domain_links) FROM ranked)::BIGINT AS link_domain_matches, n AS total_url_links_found, (SELECT count(*) FROM (SELECT value FROM domain_link_postings WHERE token IN {_TOKENS} GROUP BY value HAVING count(*) = 2)) AS total_domain_links_found, n AS links_handled FROM (SELECT count(*) AS n FROM (SELECT value FROM link_postings WHERE token IN {_TOKENS} GROUP BY value HAVING count(*) = 2))",
    "rnk4_domain_dedup": q.with_(*q.WEB, q.URL_POSTINGS) + f"SELECT value, domain, round(score, 6) AS score FROM ({_DEDUP('(SELECT value, domain, score FROM postings WHERE token = ' + chr(39) + 'the' + chr(39) + ')', 2, 60)})",
    "rnk6_site_search": q.with_(*_W, _SITE(_TOKENS, 2)) + "SELECT domain, value, round(score, 6) AS score, total FROM site",
    "rnk7_tfidf": q.with_(q.COUNTS, _SIZES) + "SELECT token, value, count, round(count / size * ln(n / d), 6) AS score FROM counts JOIN sizes USING (value) JOIN df USING (token), whole",
    "rnk8_bm25": _BM25(0),
    "rnk8_bm25_min_size": _BM25(200),
    "rnk11_domain_index": q.with_(*q.WEB, _DOMAIN_INDEX) + "SELECT * FROM domain_index",
    "rnk12_domain_scores": q.with_(*q.WEB, _DOMAIN_INDEX) + "SELECT value, max(score) AS score, count(*) AS words FROM domain_index GROUP BY value ORDER BY score DESC, value LIMIT 1000",
    "rnk13_domain_info": q.with_(*q.WEB, _TITLE_WORDS, _ANCHOR_WORDS, _FIRST_WORDS) + "SELECT list, word, count FROM (SELECT 'title' AS list, domain, word, count FROM title_words UNION ALL SELECT 'anchor', domain, word, count FROM anchor_words UNION ALL SELECT 'first_page', domain, word, 1 FROM first_words) WHERE domain = 'therha.example.com' QUALIFY row_number() OVER (PARTITION BY list ORDER BY count DESC, word) BETWEEN 6 AND 55",
    "rnk14_word_lookup": q.with_(*q.WEB, q.URL_POSTINGS) + "SELECT token, domain AS value, round(score, 6) AS score FROM postings WHERE token = 'and' AND domain = 'therha.example.com'",
    "rnk14_harmonic_of": q.with_(*q.WEB) + "SELECT url, round(coalesce(harmonic, 0), 6) AS harmonic FROM urls LEFT JOIN centrality USING (host)",
    "rnk15_federated": q.with_(*_W, _SITE("('and')", 1)) + f", domains AS (SELECT host AS d, coalesce(harmonic, 0) AS domain_score FROM (SELECT DISTINCT host FROM (SELECT host, unnest({q.words('title')}) AS word FROM urls) WHERE word = 'and') LEFT JOIN centrality USING (host) ORDER BY domain_score DESC, d LIMIT 1000) SELECT domain, value, round(score, 6) AS score, total, round(domain_score, 6) AS domain_score FROM (SELECT * FROM site QUALIFY row_number() OVER (PARTITION BY domain ORDER BY score DESC, value) <= 5) JOIN domains ON domain = d",
    "idx20_phrase": q.with_(q.URLS) + f"SELECT value, count(*)::DOUBLE AS score FROM (SELECT value, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM (SELECT url_key AS value, {q.words('text')} AS w FROM urls)) WHERE g = 'of the' GROUP BY value ORDER BY score DESC, value LIMIT 1000",
    "agg16_host_words": q.with_(q.URLS) + f"SELECT * FROM (SELECT host, word, count(*) AS n FROM (SELECT host, unnest({q.words('text')}) AS word FROM urls) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY host ORDER BY n DESC, word) <= 100",
    "win4_top_anchor_words": q.with_(*q.WEB, _ANCHOR_WORDS) + "SELECT * FROM anchor_words QUALIFY row_number() OVER (PARTITION BY domain ORDER BY count DESC, word) <= 100",
}
