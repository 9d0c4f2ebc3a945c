"""Queries of the text, URL, HTML and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.catalog import relations as r
from quarry.catalog import sql as q
from quarry.functions import hashing, scoring
from quarry.functions import html as ht
from quarry.functions import text as tx
from quarry.functions import url as ur
from quarry.functions.wordlists import STOP_WORDS
from quarry.operators import arrays


def _exploded(table: str, keys: tuple[str, ...], array, name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        df = r.table(spark, sf_dir, table)
        return df.select(*keys, F.posexplode(array()).alias("__pos", name)).withColumn("pos", F.col("__pos").cast("long") + 1).drop("__pos")

    return run


def _unnest(table: str, keys: str, array: str, name: str) -> str:
    return f"SELECT {keys}, unnest(generate_series(1, len(a))) AS pos, unnest(a) AS {name} FROM (SELECT {keys}, {array} AS a FROM {table}) WHERE len(a) > 0"


def _docs(make):
    return lambda spark, sf_dir: make(r.table(spark, sf_dir, "documents"))


def _pages(make):
    return lambda spark, sf_dir: make(r.table(spark, sf_dir, "pages"))


_text, _title = lambda: F.col("text"), lambda: ht.title(ht.visible(F.col("html")))
_TITLE = q.clean("regexp_extract(" + q.SHOWN + ", '(?s)<title[^>]*>(.*?)</title>', 1)")
_NGRAMS = "flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(1, least(3, len(w) - i + 1) + 1), lambda k: array_to_string(w[i:i + k - 1], ' '))))"
_ALPHA = "regexp_replace(s, '[^\\x{800}-\\x{10FFFF}]', '', 'g')"


def _exotic(s: str) -> str:
    return f"(length(regexp_replace({s}, '[^\\x{{800}}-\\x{{10FFFF}}]', '', 'g')) > 5 OR (length({s}) > 3 AND length(regexp_replace({s}, '[\\x00-\\x7F]', '', 'g')) / length({s}) > 0.5))"


def url_components(p: DataFrame) -> DataFrame:
    u, h = F.col("url"), ur.host(F.col("url"))
    parts: dict[str, Column] = {
        "scheme": ur.scheme(u),
        "host": h,
        "has_www": ur.has_www(u),
        "has_https": ur.has_https(u),
        "path": ur.path(u),
        "query": ur.query(u),
        "path_with_query": ur.path_with_query(u),
        "key": ur.key(u),
        "hash_input": ur.hash_input(u),
        "host_reverse": ur.host_reverse(h),
        "top_domain": ur.host_top_domain(h),
        "reverse_top_domain": ur.host_reverse_top_domain(h),
        "domain": ur.domain_without_tld(h),
        "tld": ur.tld(u),
        "plain": ur.rebuild(u, "http", False),
        "changed": ur.canonically_different(u, ur.rebuild(u, "https", True)),
    }
    return p.select("page_id", *(c.alias(n) for n, c in parts.items()))


_LABELS = "string_split(host, '.')"
URL_SQL = f"""SELECT page_id, scheme, host, raw LIKE 'www.%' AS has_www, scheme = 'https' AS has_https, path, query, pq AS path_with_query, host || path || query AS key, host || pq AS hash_input,
array_to_string(list_reverse({_LABELS}), '.') AS host_reverse,
CASE WHEN host LIKE '%.co.uk' OR host LIKE '%.au' THEN array_to_string({_LABELS}[-3:], '.') WHEN host LIKE '%.uk' THEN host ELSE array_to_string({_LABELS}[-2:], '.') END AS top_domain,
array_to_string(list_reverse({_LABELS}[-2:]), '.') AS reverse_top_domain, coalesce({_LABELS}[-2], '') AS domain, string_split(raw, '.')[-1] AS tld,
'http://' || host || pq AS plain, false AS changed
FROM (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, {q.RAW_HOST} AS raw, {q.HOST} AS host, {q.PATH} AS path, {q.QUERY} AS query, {q.PATH_QUERY} AS pq FROM pages)"""


def query_pairs(p: DataFrame) -> DataFrame:
    return p.select("page_id", F.explode(ur.query_map(F.col("url"))).alias("key", "value"))


def curves(spark, sf_dir: str) -> DataFrame:
    h = F.col("harmonic")
    c = r.centrality(r.links(spark, sf_dir))
    parts = {
        "link_curve": scoring.link_curve(h),
        "grouped": scoring.grouped_link_curve(h),
        "bonus": scoring.length_bonus(F.length("host")),
        "domain_curve": scoring.documented_domain_curve(h),
        "url_curve": scoring.documented_url_curve(h),
        "url_score": scoring.link_url_score(h, F.lit(0.1)),
        "domain_score": scoring.link_domain_score(h, F.lit(0.1)),
        "idf": scoring.idf(F.lit(1000), F.length("host")),
    }
    return c.select("host", *(F.round(x, 6).alias(n) for n, x in parts.items()))


def dates(spark, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return r.table(spark, sf_dir, "events").select("event_id", scoring.datetime_number(ts).alias("datetime"), scoring.date_number(ts).alias("date"), scoring.time_number(ts).alias("time"), scoring.iso_datetime(ts).alias("iso"))


def hashes(spark, sf_dir: str) -> DataFrame:
    """Hashes of all pages' urls and hosts with their node of 8."""
    p = r.table(spark, sf_dir, "pages").select("page_id", ur.hash_input(F.col("url")).alias("url_key"), ur.host(F.col("url")).alias("host"))
    p = p.withColumns({"url_hash": hashing.token_hash(F.col("url_key")), "host_hash": hashing.token_hash(F.col("host"))})
    return p.withColumn("node", hashing.unsigned_mod(F.col("host_hash"), 8))


def unsigned_routes(spark, sf_dir: str) -> DataFrame:
    """Unsigned views of signed keys; odd keys are moved to the negative half."""
    h = F.col("o_orderkey") * 1000003 + (F.col("o_orderkey") % 2) * F.lit(-(1 << 63) + 1)
    o = r.table(spark, sf_dir, "orders").select("o_orderkey", h.alias("h"))
    return o.select("o_orderkey", hashing.unsigned(F.col("h")).cast("string").alias("unsigned"), hashing.unsigned_mod(F.col("h"), 4001).alias("shard"))


QUERIES = {
    "txt1_trims": _docs(lambda d: d.select("doc_id", tx.trim_space(F.col("text")).alias("space"), tx.trim_signs(F.col("text")).alias("signs"), tx.trim(F.col("text")).alias("both"))),
    "txt2_lower_ascii": _docs(lambda d: d.select("doc_id", tx.lower_ascii(F.col("text")).alias("lower"))),
    "txt3_full_text_words": _exploded("documents", ("doc_id",), lambda: tx.full_text_words(_text()), "word"),
    "txt5_unique_words": _docs(lambda d: d.select("doc_id", F.explode(tx.unique_words(F.col("text"))).alias("word"))),
    "txt6_expanded_words": _exploded("documents", ("doc_id",), lambda: tx.expanded_words(_text()), "word"),
    "txt7_unique_expanded_words": _docs(lambda d: d.select("doc_id", F.explode(tx.unique_expanded_words(F.col("text"))).alias("word"))),
    "txt8_tokens": _exploded("documents", ("doc_id",), lambda: tx.tokens(_text()), "token"),
    "txt9_clean_words": _exploded("conversations", ("conv_id", "turn"), lambda: tx.clean_words(_text()), "word"),
    "txt10_clean_word": _docs(lambda d: tx.word_counts(d, F.transform(tx.full_text_words(F.col("text")), tx.clean_word))),
    "txt11_without_stopwords": _exploded("conversations", ("conv_id", "turn"), lambda: tx.words_without_stopwords(_text()), "word"),
    "txt12_ngrams": _exploded("pages", ("page_id",), lambda: tx.ngrams(tx.full_text_words(_title()), 3), "ngram"),
    "txt12_ngrams_of_texts": _exploded("conversations", ("conv_id", "turn"), lambda: tx.ngrams(tx.full_text_words(_text()), 3), "ngram"),
    "txt13_snippets": _exploded("documents", ("doc_id",), lambda: tx.snippets(_text()), "snippet"),
    "txt14_word_counts": _docs(lambda d: tx.word_counts(d, tx.full_text_words(F.col("text")), "doc_id")),
    "txt15_word_frequency": _docs(lambda d: tx.word_frequency(d, tx.clean_words(F.col("text")), "doc_id").withColumn("frequency", F.round("frequency", 9))),
    "txt16_utf8": _docs(lambda d: d.select("doc_id", tx.is_valid_utf8(F.col("text")).alias("valid"), tx.encode_utf8(F.col("text")).alias("encoded"))),
    "txt17_make_snippet": _docs(lambda d: d.select("doc_id", tx.make_snippet(F.col("text")).alias("snippet"))),
    "txt18_snippet_or_meta": lambda s, d: r.urls(s, d).select("page_id", tx.snippet_or_meta(F.col("meta"), F.col("title")).alias("snippet")),
    "txt19_chunks": _docs(lambda d: d.select("doc_id", F.posexplode(tx.chunks(tx.full_text_words(F.col("text")), 50)).alias("i", "c")).select("doc_id", F.col("i").cast("long").alias("i"), F.size("c").cast("long").alias("n"), F.element_at("c", 1).alias("first"))),
    "url_components": _pages(url_components),
    "url10_query_map": _pages(query_pairs),
    "url11_urldecode": _pages(lambda p: p.select("page_id", ur.urldecode(ur.urlencode(F.col("html"))).alias("text"))),
    "url12_urlencode": _pages(lambda p: p.select("page_id", ur.urlencode(F.col("html")).alias("code"))),
    "url17_resolve": lambda s, d: ht.links(r.table(s, d, "pages"), "html", "url", "page_id", exact=True).select("page_id", "pos", "target_host", "target_path"),
    "htm1_pages": lambda s, d: r.urls(s, d),
    "htm2_encoding": _pages(lambda p: p.select("page_id", ht.encoding(F.col("html")).alias("encoding"))),
    "htm6_clean_text": _pages(lambda p: p.select("page_id", ht.clean(F.col("html"), 1 << 30).alias("text"))),
    "htm7_entities": _pages(lambda p: p.select("page_id", ht.decode_entities(F.col("html")).alias("html"))),
    "htm8_links": lambda s, d: ht.links(r.table(s, d, "pages"), "html", "url", "page_id"),
    "htm9_internal_links": lambda s, d: ht.internal_links(ht.links(r.table(s, d, "pages"), "html", "url")),
    "htm10_exotic": _docs(lambda d: d.select("doc_id", ht.is_exotic(F.col("text")).alias("exotic"))),
    "htm11_should_insert": _pages(lambda p: ht.parse_pages(p).select("page_id", "should_insert")),
    "hash1_token_hashes": hashes,
    "hash2_unsigned": unsigned_routes,
    "mth_curves": curves,
    "dt1_datetime": dates,
    "jn2_array_intersection": _docs(lambda d: d.select("doc_id", F.explode(arrays.intersection(tx.full_text_words(F.col("text")), F.array(*(F.lit(w) for w in ("the", "of", "der", "que", "les"))))).alias("word"))),
    "srt1_array_top_k": _docs(lambda d: d.select("doc_id", F.posexplode(arrays.top_k(tx.full_text_words(F.col("text")), 5)).alias("i", "word")).withColumn("i", F.col("i").cast("long"))),
    "srt4_merge_sorted": lambda s, d: r.urls(s, d).select("page_id", F.posexplode(arrays.merge_sorted(tx.full_text_words(F.col("title")), tx.full_text_words(F.col("h1")))).alias("i", "word")).withColumn("i", F.col("i").cast("long")),
    "srt10_incremental_partitions": lambda s, d: arrays.incremental_partitions(s, [4, 3, 5], 1000).select(*(F.get("at", F.lit(i)).cast("long").alias(f"i{i}") for i in range(3))),
}

_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
_LINK_SQL = f"""SELECT page_id, pos, {q.HOST} AS host, {q.PATH_QUERY} AS path, {q.HOST} AS target_host, href AS target_path, {q.clean("regexp_extract(a, '(?s)href=\"[^\"]*\"[^>]*>(.*)</a>', 1)")} AS text, contains(regexp_extract(a, 'rel=\"([^\"]*)\"', 1), 'nofollow') AS nofollow, true AS internal
FROM (SELECT page_id, url, unnest(l) AS a, unnest(generate_series(1, len(l))) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '(?s)(<a .*?</a>)') AS l FROM pages) WHERE len(l) > 0), LATERAL (SELECT regexp_extract(a, 'href=\"([^\"]*)\"', 1) AS href)"""

SQL = {
    "txt1_trims": f"SELECT doc_id, trim(text, E' \\t\\n\\r\\f\\x0b') AS space, {q.trim('text', q.SIGN)} AS signs, {q.trim('text')} AS \"both\" FROM documents",
    "txt2_lower_ascii": f"SELECT doc_id, {q.lower('text')} AS \"lower\" FROM documents",
    "txt3_full_text_words": _unnest("documents", "doc_id", q.words("text"), "word"),
    "txt5_unique_words": f"SELECT DISTINCT doc_id, unnest({q.words('text')}) AS word FROM documents",
    "txt6_expanded_words": _unnest("documents", "doc_id", q.expanded("text"), "word"),
    "txt7_unique_expanded_words": f"SELECT DISTINCT doc_id, unnest({q.expanded('text')}) AS word FROM documents",
    "txt8_tokens": _unnest("documents", "doc_id", f"list_transform(list_filter(string_split_regex(regexp_replace({q.lower('text')}, '[\\n\\r\\f\\x0B]', '', 'g'), '[ \\t,|!]'), lambda w: w <> ''), lambda w: {q.trim('w', q.SIGN)})", "token"),
    "txt9_clean_words": _unnest("conversations", "conv_id, turn", q.clean_words("text"), "word"),
    "txt10_clean_word": f"SELECT word, count(*) AS n FROM (SELECT regexp_replace(unnest({q.words('text')}), '[^a-z0-9åäö]', '', 'g') AS word FROM documents) GROUP BY word",
    "txt11_without_stopwords": _unnest("conversations", "conv_id, turn", f"list_filter({q.clean_words('text')}, lambda w: w NOT IN ({_STOP}))", "word"),
    "txt12_ngrams": _unnest(f"(SELECT page_id, {q.words(_TITLE)} AS w FROM pages)", "page_id", _NGRAMS, "ngram"),
    "txt12_ngrams_of_texts": _unnest(f"(SELECT conv_id, turn, {q.words('text')} AS w FROM conversations)", "conv_id, turn", _NGRAMS, "ngram"),
    "txt14_word_counts": f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({q.words('text')}) AS word FROM documents) GROUP BY ALL",
    "txt15_word_frequency": f"SELECT doc_id, word, round(count(*) / n, 9) AS frequency FROM (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM (SELECT doc_id, {q.clean_words('text')} AS w FROM documents)) GROUP BY doc_id, word, n",
    "txt16_utf8": "SELECT doc_id, true AS valid, regexp_replace(text, '[\\x00-\\x1f]', '?', 'g') AS encoded FROM documents",
    "txt17_make_snippet": "SELECT doc_id, CASE WHEN strlen(text) >= 140 THEN substr(text, 1, list_max(list_filter(range(0, 141), lambda i: strlen(substr(text, 1, i)) <= 140))) || '...' ELSE text END AS snippet FROM documents",
    "txt18_snippet_or_meta": q.with_(q.URLS) + "SELECT page_id, CASE WHEN strlen(title) >= 140 THEN substr(title, 1, list_max(list_filter(range(0, 141), lambda i: strlen(substr(title, 1, i)) <= 140))) || '...' ELSE title END AS snippet FROM urls",
    "txt19_chunks": f"SELECT doc_id, i, least(50, len(w) - i * 50) AS n, w[i * 50 + 1] AS first FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 49) // 50)) AS i FROM (SELECT doc_id, {q.words('text')} AS w FROM documents))",
    "url_components": URL_SQL,
    "url10_query_map": f"SELECT page_id, key, arg_max(value, i) AS value FROM (SELECT page_id, i, split_part(pair, '=', 1) AS key, split_part(pair, '=', 2) AS value FROM (SELECT page_id, unnest(p) AS pair, unnest(generate_series(1, len(p))) AS i FROM (SELECT page_id, string_split({q.QUERY}, '&') AS p FROM pages)) WHERE contains(pair, '=')) GROUP BY page_id, key",
    "url11_urldecode": "SELECT page_id, html AS text FROM pages",
    "url12_urlencode": "SELECT page_id, url_encode(html) AS code FROM pages",
    "url17_resolve": f"SELECT page_id, pos, target_host, target_path FROM ({_LINK_SQL})",
    "htm1_pages": q.with_(q.URLS) + "SELECT page_id, url, host, url_key, url_length, title, h1, meta, text FROM urls",
    "htm2_encoding": "SELECT page_id, CASE WHEN instr(html, 'charset=') = 0 OR instr(html, 'charset=') > 1025 OR contains(lower(substr(html, instr(html, 'charset='), 40)), 'utf-8') THEN 'utf-8' WHEN contains(lower(substr(html, instr(html, 'charset='), 40)), 'iso-8859-1') THEN 'iso-8859-1' ELSE 'unknown' END AS encoding FROM pages",
    "htm6_clean_text": f"SELECT page_id, {q.clean('html')} AS text FROM pages",
    "htm7_entities": f"SELECT page_id, {q.entities('html')} AS html FROM pages",
    "htm8_links": _LINK_SQL,
    "htm9_internal_links": f"SELECT host || path AS source, target_host || target_path AS target FROM ({_LINK_SQL}) WHERE NOT nofollow",
    "htm10_exotic": f"SELECT doc_id, {_exotic('text')} AS exotic FROM documents",
    "htm11_should_insert": q.with_(q.URLS) + f"SELECT page_id, title <> '' AND strlen(title) <= 400 AND strlen(h1) <= 400 AND NOT {_exotic('title')} AS should_insert FROM urls",
    "hash2_unsigned": "SELECT o_orderkey, (CASE WHEN h < 0 THEN h + 18446744073709551616::HUGEINT ELSE h END)::VARCHAR AS unsigned, ((CASE WHEN h < 0 THEN h + 18446744073709551616::HUGEINT ELSE h END) % 4001)::BIGINT AS shard FROM (SELECT o_orderkey, (o_orderkey::HUGEINT * 1000003 + (o_orderkey % 2) * -9223372036854775807::HUGEINT) AS h FROM orders)",
    "mth_curves": q.with_(*q.WEB) + """SELECT host, round((exp(25 * harmonic) - 1) / 50, 6) AS link_curve, round((exp(20 * harmonic) - 1) / 10, 6) AS grouped, round((1000 - length(host)) / 500, 6) AS bonus, round(exp(5 * harmonic) - 0.9::DOUBLE, 6) AS domain_curve, round(exp(10 * harmonic) - 0.9::DOUBLE, 6) AS url_curve,
round(greatest(harmonic - 0.1::DOUBLE, harmonic / 100), 6) AS url_score, round(greatest(harmonic - 0.1::DOUBLE, harmonic / 100) / 100, 6) AS domain_score, round(ln(1000 / length(host)), 6) AS idf FROM centrality""",
    "dt1_datetime": "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S')::BIGINT AS datetime, strftime(ts, '%Y%m%d')::INTEGER AS date, strftime(ts, '%H%M%S')::INTEGER AS time, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events",
    "jn2_array_intersection": f"SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest({q.words('text')}) AS word FROM documents) WHERE word IN ('the', 'of', 'der', 'que', 'les')",
    "srt1_array_top_k": f"SELECT doc_id, unnest(range(0, len(t))) AS i, unnest(t) AS word FROM (SELECT doc_id, list_sort({q.words('text')})[-5:] AS t FROM documents) WHERE len(t) > 0",
    "srt4_merge_sorted": q.with_(q.URLS) + f"SELECT page_id, unnest(range(0, len(m))) AS i, unnest(m) AS word FROM (SELECT page_id, list_sort(list_concat({q.words('title')}, {q.words('h1')})) AS m FROM urls) WHERE len(m) > 0",
    "srt10_incremental_partitions": "SELECT i0, i1, i2 FROM range(4) a(i0), range(3) b(i1), range(5) c(i2)",
}
