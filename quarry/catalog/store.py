"""Queries of the key-value store, the graph, batch jobs, sources and incremental ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import tables
from quarry.catalog import relations as r
from quarry.catalog import sql as q
from quarry.catalog.text import _exotic
from quarry.functions import html as ht
from quarry.functions import url as ur
from quarry.functions.wordlists import TOP_LEVEL_DOMAINS
from quarry.operators import graph as gr
from quarry.operators import joins
from quarry.operators import key_value as kv
from quarry.plans import jobs
from quarry.schemas import EDGE
from quarry.sources import archive, robots, sinks, tsv, warc
from quarry.streaming import ingest


def _history(make):
    return lambda spark, sf_dir: make(r.history(spark, sf_dir))


def merged(h: DataFrame) -> DataFrame:
    """Two stores with histories of even and odd events; equal versions are made by cutting them to hours."""
    h = h.withColumn("version", F.floor(F.col("version") / 3_600_000_000).cast("long"))
    return kv.merge_with(kv.latest(h.where("seq % 2 = 0")), kv.latest(h.where("seq % 2 = 1")))


def stored(spark, sf_dir: str) -> DataFrame:
    """A store after two staged batches, a merge, one more batch and a merge with a removal."""
    h = r.history(spark, sf_dir)
    store = kv.Store(spark, tables.new_path(spark, "store"))
    store.add(h.where("seq % 3 = 0"), 0)
    store.add(h.where("seq % 3 = 1"), 1)
    store.merge()
    store.add(h.where("seq % 3 = 2"), 2)
    store.merge(h.where("key % 10 = 0").select("key").distinct())
    return store.table().select("key", "value", "version", "seq")


def streamed(spark, sf_dir: str) -> DataFrame:
    """events as a stream of files into a store, merged at the end."""
    path = tables.new_path(spark, "stream")
    schema = r.table(spark, sf_dir, "events").schema
    stream = ingest.file_stream(spark, f"{sf_dir}/events*.parquet", schema)
    rows = stream.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), r.micros(F.col("ts")).alias("version"), F.col("event_id").alias("seq"))
    store = kv.Store(spark, f"{path}/store")
    ingest.ingest_key_values(rows, store, f"{path}/checkpoint").awaitTermination()
    store.merge()
    return store.table().select("key", "value", "version", "seq")


def streamed_postings(spark, sf_dir: str) -> DataFrame:
    """lineitem as a stream of files into counted postings, merged at the end."""
    path = tables.new_path(spark, "stream")
    stream = ingest.file_stream(spark, f"{sf_dir}/lineitem*.parquet", r.table(spark, sf_dir, "lineitem").schema)
    make = lambda b: b.select(F.col("l_partkey").alias("token"), F.col("l_orderkey").alias("value"), F.col("l_quantity").cast("long").alias("count"))
    ingest.ingest_postings(stream, make, f"{path}/staged", f"{path}/checkpoint").awaitTermination()
    return ingest.merge_postings(spark, None, f"{path}/staged", f"{path}/merged", count=F.sum("count"))


def host_graph(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hosts = jobs.distinct_hosts(r.table(spark, sf_dir, "pages"))
    return hosts, jobs.host_edges(r.links(spark, sf_dir), hosts)


def harmonic(spark, sf_dir: str) -> DataFrame:
    return gr.harmonic_exact(*host_graph(spark, sf_dir), depth=6).withColumn("harmonic", F.round("harmonic", 6))


def hyper_ball(spark, sf_dir: str) -> DataFrame:
    """HyperBall over the hosts, normalised by their number."""
    return gr.normalised(gr.hyper_ball(*host_graph(spark, sf_dir), precision=12)).withColumn("harmonic", F.round("harmonic", 3))


def internal_graph(spark, sf_dir: str) -> DataFrame:
    """Exact harmonic centrality of the pages that a host's internal links make a graph of, for all hosts at once; sketches are off from some hundred pages in reach on."""
    linked = ht.links(r.table(spark, sf_dir, "pages"), "html", "url")
    edges = ht.internal_links(linked).select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    vertices = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    return gr.harmonic_exact(vertices, edges).withColumn("harmonic", F.round("harmonic", 3))


def tsv_round_trip(spark, sf_dir: str) -> DataFrame:
    """Links written as gzip TSV with a new file after 100 rows, and read again."""
    path = tables.new_path(spark, "tsv")
    linked = r.links(spark, sf_dir)
    sinks.write_tsv(linked.withColumn("nofollow", F.when(F.col("nofollow"), "1").otherwise("0")), path, 100)
    return tsv.read_links(spark, path)


def split(spark, sf_dir: str) -> DataFrame:
    """(host, nodes, n): pages split by host into 8 nodes and read again; each host is on one node."""
    path = tables.new_path(spark, "split")
    pages = r.urls(spark, sf_dir).select("host", "url", "title")
    jobs.split_by_host(pages, 8, path)
    rows = tsv.read(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in ("host", "url", "title")] + [T.StructField("node", T.IntegerType())]))
    return rows.groupBy("host").agg(F.count_distinct("node").alias("nodes"), F.count(F.lit(1)).alias("n"))


def _web_links(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        # Known pages are those that a nofollow link points to, so that some links lead out.
        linked = r.links(spark, sf_dir)
        known = jobs.urls_with_direct_links(r.urls(spark, sf_dir), linked.where("nofollow")).select("page_id", "host", "url_key")
        return jobs.relevant_links(linked, known)[name]

    return run


def large_hosts(spark, sf_dir: str) -> DataFrame:
    """Hosts of at least three pages."""
    return jobs.count_per_host(r.urls(spark, sf_dir)).where("n >= 3").select("host")


def split_links(spark, sf_dir: str) -> DataFrame:
    """(target_host, nodes, n): links split by the host of their target into 8 nodes and read again."""
    path = tables.new_path(spark, "split")
    jobs.split_links(r.links(spark, sf_dir).select("host", "path", "target_host", "target_path"), 8, path, 50)
    rows = tsv.read(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "target_host", "target_path")] + [T.StructField("node", T.IntegerType())]))
    return rows.groupBy("target_host").agg(F.count_distinct("node").alias("nodes"), F.count(F.lit(1)).alias("n"))


def saved_hosts(spark, sf_dir: str) -> DataFrame:
    """The urls and titles of large hosts, saved and read again."""
    path = tables.new_path(spark, "hosts")
    jobs.save_hosts(r.urls(spark, sf_dir).select("host", "url", "title"), large_hosts(spark, sf_dir), path)
    return tsv.read(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in ("host", "url", "title")]))


def read_batch(spark, sf_dir: str) -> DataFrame:
    """(url, title) of all files that a manifest of 8 folders lists, read in two slices."""
    path = tables.new_path(spark, "batch")
    columns = [c if c in ("url", "title", "h1") else F.lit("").alias(c) for c in ("url", "title", "h1", "meta", "text", "date", "ip")]
    rows = r.urls(spark, sf_dir).withColumn("node", jobs.node_of(F.col("host"), 8))
    sinks.write_tsv(rows.select("node", *columns), f"{path}/rows", None, ("node",))
    sinks.write_lines(rows.select(F.concat(F.lit("node="), "node").alias("name")).distinct().coalesce(1), f"{path}/manifest", "name")
    half = [tsv.read_batch(spark, f"{path}/manifest", f"{path}/rows", limit=4), tsv.read_batch(spark, f"{path}/manifest", f"{path}/rows", offset=4)]
    return half[0].unionByName(half[1]).select("url", "title", "h1")


def manifests(spark, sf_dir: str) -> DataFrame:
    """(kind, path): a manifest of WARC files rewritten for each kind of file made of them."""
    path = tables.new_path(spark, "manifest")
    names = r.table(spark, sf_dir, "pages").select(F.concat(F.lit("crawl/segment.warc/"), F.col("page_id").cast("string"), F.lit(".warc.gz")).alias("name"))
    sinks.write_lines(names, path, "name")
    kinds = [tsv.manifest(spark, path, k).select(F.lit(k).alias("kind"), "path") for k in ("urls", "links", "direct")]
    return kinds[0].union(kinds[1]).union(kinds[2])


def line_columns(spark, sf_dir: str) -> DataFrame:
    """(third, n): a column of lines that is empty where a line is too short, as a set with its counts."""
    path = tables.new_path(spark, "lines")
    sinks.write_lines(r.urls(spark, sf_dir).select("host", "url_key", "title"), path, "host", "url_key", "title")
    lines = spark.read.text(path)
    counts = tsv.column(lines, 2).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return tsv.column_set(lines, 2).join(counts, "value").select(F.col("value").alias("third"), "n")


def archived(spark, sf_dir: str) -> DataFrame:
    """Centralities written as text, packed into an archive, unpacked, and read again."""
    path = tables.new_path(spark, "archive")
    sinks.write_lines(r.centrality(r.links(spark, sf_dir)).withColumn("harmonic", F.round("harmonic", 6)), f"{path}/lines", "host", "harmonic")
    archive.pack(spark, f"{path}/lines", f"{path}/packed")
    archive.unpack_to(spark, f"{path}/packed", f"{path}/unpacked" if "://" in path else f"file://{path}/unpacked")
    rows = spark.read.text(f"{path}/unpacked").select(F.split("value", "\t").alias("c"))
    return rows.select(F.col("c")[0].alias("host"), F.col("c")[1].cast("double").alias("harmonic"))


def missing(spark, sf_dir: str) -> DataFrame:
    """Expected files, one for each host, of which those of large hosts alone are in the folder."""
    path = tables.new_path(spark, "files")
    hosts = r.urls(spark, sf_dir).select("host").distinct()
    archive_rows = large_hosts(spark, sf_dir).select(F.col("host").alias("name"), F.encode(F.repeat(F.lit("x"), F.lit(1000)), "utf-8").alias("content"))
    archive_rows.write.parquet(f"{path}/packed")
    archive.unpack_to(spark, f"{path}/packed", f"{path}/there" if "://" in path else f"file://{path}/there")
    return archive.missing_files(hosts.select(F.concat(F.lit("crawl/"), "host").alias("path")), archive.list_files(spark, f"{path}/there"))


ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/2\nDisallow: /*page=2\n\nUser-agent: OtherBot\nDisallow: /\n"


def robots_of_pages(spark, sf_dir: str) -> DataFrame:
    return r.table(spark, sf_dir, "pages").select("page_id", robots.robots_allowed("Bot")(F.lit(ROBOTS), F.col("url")).alias("bot"), robots.robots_allowed("OtherBot")(F.lit(ROBOTS), F.col("url")).alias("other"))


def _warc(spark, sf_dir: str) -> DataFrame:
    path = tables.new_path(spark, "warc")
    sinks.write_warc(r.table(spark, sf_dir, "pages"), path)
    return warc.responses(spark, path)


def warc_responses(spark, sf_dir: str) -> DataFrame:
    """All pages as WARC files, and the responses that these hold."""
    raw = _warc(spark, sf_dir)
    return raw.select("url", "date", "ip", warc.http_status(F.col("http")).alias("status"), warc.http_header(F.col("http"), "Content-Type: ").alias("content_type"), F.col("body").cast("string").alias("html"))


def warc_pages(spark, sf_dir: str) -> DataFrame:
    """The pages that the reader of WARC files makes of them: known top-level domains, past the gate, parsed."""
    return warc.pages(_warc(spark, sf_dir)).select("url", "title", "h1", "meta", "text", "date", "ip")


def graph_files(spark, sf_dir: str) -> DataFrame:
    """(src, dst): the host graph written as vertices and edges, and read again."""
    path = tables.new_path(spark, "graph")
    hosts, edges = host_graph(spark, sf_dir)
    sinks.write_lines(edges, f"{path}/edges", "src", "dst")
    return tsv.read(spark, f"{path}/edges", EDGE)


def top_level(spark, sf_dir: str) -> DataFrame:
    """(tld, known, n): pages by top-level domain."""
    t = ur.tld(F.col("url"))
    return r.table(spark, sf_dir, "pages").groupBy(t.alias("tld"), t.isin(*sorted(TOP_LEVEL_DOMAINS)).alias("known")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "kv3_latest": _history(kv.latest),
    "kv4_remove": _history(lambda h: kv.remove(kv.latest(h), h.where("value = 'purchase' AND version % 7 = 0").select("key").distinct())),
    "kv5_store": stored,
    "kv6_merge_with": _history(merged),
    "kv7_find": _history(lambda h: kv.find(kv.latest(h), 42)),
    "kv7_find_many": lambda s, d: kv.find_many(kv.latest(r.history(s, d)), r.table(s, d, "customer").select(F.col("c_custkey").alias("key"))).select("key", "value"),
    "kv8_has": lambda s, d: kv.has(kv.latest(r.history(s, d)), r.table(s, d, "customer").select(F.col("c_custkey").alias("key"))),
    "kv9_size": _history(lambda h: kv.size(kv.latest(h))),
    "ing_stream_key_values": streamed,
    "ing_stream_postings": streamed_postings,
    "grf1_harmonic": harmonic,
    "grf4_hyperball": hyper_ball,
    "grf5_host_vertices": lambda s, d: jobs.distinct_hosts(r.table(s, d, "pages")),
    "grf6_host_edges": lambda s, d: host_graph(s, d)[1],
    "grf8_internal_harmonic": internal_graph,
    "bat1_split_by_host": split,
    "bat3_direct_links": _web_links("direct"),
    "bat3_reached_urls": _web_links("reached"),
    "bat3_relevant_links": _web_links("relevant"),
    "jn15_lookup": lambda s, d: joins.lookup(r.urls(s, d).select("page_id", "host"), r.centrality(r.links(s, d)), "host", "host", "harmonic", "harmonic").withColumn("harmonic", F.round("harmonic", 6)),
    "jn18_find_links": lambda s, d: jobs.links_to_hosts(r.links(s, d), large_hosts(s, d)),
    "agg4_urls_per_host": lambda s, d: jobs.count_per_host(r.urls(s, d)),
    "agg6_distinct_url_keys": lambda s, d: r.urls(s, d).select("url_key").distinct(),
    "flt2_host_equals": lambda s, d: r.urls(s, d).where("host = 'therha.example.com'").select("page_id", "url"),
    "flt3_host_in": lambda s, d: joins.existing(r.urls(s, d).select("page_id", "host"), large_hosts(s, d).select(F.col("host").alias("known")), {"host": "known"}),
    "flt8_round_robin": lambda s, d: tsv.round_robin(r.table(s, d, "pages").select("page_id", "url"), "page_id", 4, 1),
    "flt9_linked_urls": lambda s, d: tsv.urls_with_links(r.links(s, d).groupBy(F.concat("target_host", "target_path").alias("url")).agg(F.count(F.lit(1)).alias("links"))),
    "src7_tsv_round_trip": tsv_round_trip,
    "src1_warc_responses": warc_responses,
    "src3_warc_pages": warc_pages,
    "src8_manifest": manifests,
    "src9_columns": line_columns,
    "src14_archive": archived,
    "src15_missing_files": missing,
    "src17_robots": robots_of_pages,
    "snk7_graph_files": graph_files,
    "bat2_split_links": split_links,
    "bat4_save_hosts": saved_hosts,
    "bat5_read_batch": read_batch,
    "flt7_top_level_domains": top_level,
    "src12_positions": lambda s, d: tsv.positions(r.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("p")), "l_orderkey", 33, "p"),
    "src12_find_all": lambda s, d: tsv.find_all(r.table(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), "k", r.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))),
    "src13_dictionary": lambda s, d: tsv.dictionary(r.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey"),
}

_H = q.with_(q.HISTORY)
_LATEST = "SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, seq DESC) = 1"
_EDGES = "edges AS (SELECT DISTINCT host AS src, target_host AS dst FROM links WHERE host <> target_host), hosts AS (SELECT DISTINCT host FROM urls WHERE host <> '')"
_INTERNAL = f"""edges AS (SELECT DISTINCT {q.HOST} || ({q.PATH_QUERY}) AS src, {q.HOST} || href AS dst FROM (SELECT url, regexp_extract(unnest(regexp_extract_all(html, '(?s)(<a .*?</a>)')), 'href="([^"]*)"', 1) AS href FROM pages)), hosts AS (SELECT src AS host FROM edges UNION SELECT dst FROM edges)"""


def _distance(depth: int) -> str:
    """Breadth-first levels, one CTE each: a level holds the pairs first reached there."""
    out = ["l0 AS (SELECT host AS v, host AS r FROM hosts)", "s0 AS (SELECT * FROM l0)"]
    for i in range(1, depth + 1):
        out.append(f"l{i} AS MATERIALIZED (SELECT DISTINCT v, e.src AS r FROM l{i - 1} JOIN edges e ON l{i - 1}.r = e.dst EXCEPT SELECT v, r FROM s{i - 1})")
        out.append(f"s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM l{i})")
    parts = " UNION ALL ".join(f"SELECT v, count(*) / {i}.0::DOUBLE AS x FROM l{i} GROUP BY v" for i in range(1, depth + 1))
    return ", ".join(out) + f", sums AS (SELECT v, sum(x) AS x FROM ({parts}) GROUP BY v)"


_ALL_LINKS = q.with_(q.URLS, q.LINKS)
_KNOWN = "known AS (SELECT page_id, host, url_key FROM urls WHERE url_key IN (SELECT target_host || target_path FROM links WHERE nofollow)), direct AS (SELECT * FROM links WHERE target_host || target_path IN (SELECT url_key FROM known)), reached AS (SELECT * FROM known WHERE url_key IN (SELECT target_host || target_path FROM direct))"

SQL = {
    "kv3_latest": _H + _LATEST,
    "kv4_remove": _H + f"SELECT * FROM ({_LATEST}) WHERE key NOT IN (SELECT key FROM history WHERE value = 'purchase' AND version % 7 = 0)",
    "kv5_store": _H + f"SELECT * FROM ({_LATEST}) WHERE key % 10 <> 0",
    "kv6_merge_with": _H + ", hours AS (SELECT key, value, version // 3600000000 AS version, seq FROM history) SELECT * FROM hours QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, seq % 2, seq DESC) = 1",
    "kv7_find": _H + f"SELECT value, version FROM ({_LATEST}) WHERE key = 42",
    "kv7_find_many": _H + f"SELECT c_custkey AS key, coalesce(value, '') AS value FROM customer LEFT JOIN ({_LATEST}) h ON c_custkey = key",
    "kv8_has": _H + "SELECT c_custkey AS key, c_custkey IN (SELECT key FROM history) AS found FROM customer",
    "kv9_size": "SELECT count(DISTINCT user_id) AS n FROM events",
    "ing_stream_key_values": _H + _LATEST,
    "ing_stream_postings": "SELECT l_partkey AS token, l_orderkey AS value, sum(l_quantity::BIGINT)::BIGINT AS count FROM lineitem GROUP BY ALL",
    "grf1_harmonic": q.with_(q.URLS, q.LINKS, _EDGES, _distance(6)) + "SELECT host, round(coalesce(x, 0), 6) AS harmonic FROM hosts LEFT JOIN sums ON v = host",
    "grf4_hyperball": q.with_(q.URLS, q.LINKS, _EDGES, _distance(12)) + "SELECT host, round(coalesce(x, 0) / (SELECT count(*) FROM hosts), 3) AS harmonic FROM hosts LEFT JOIN sums ON v = host",
    "grf5_host_vertices": q.with_(q.URLS) + "SELECT DISTINCT host FROM urls",
    "grf6_host_edges": q.with_(q.URLS, q.LINKS, _EDGES) + "SELECT * FROM edges",
    "grf8_internal_harmonic": q.with_(_INTERNAL, _distance(5)) + "SELECT host, round(coalesce(x, 0), 3) AS harmonic FROM hosts LEFT JOIN sums ON v = host",
    "bat1_split_by_host": q.with_(q.URLS) + "SELECT host, 1::BIGINT AS nodes, count(*) AS n FROM urls GROUP BY host",
    "bat3_direct_links": _ALL_LINKS + f", {_KNOWN} SELECT * FROM direct",
    "bat3_reached_urls": _ALL_LINKS + f", {_KNOWN} SELECT * FROM reached",
    "bat3_relevant_links": _ALL_LINKS + f", {_KNOWN} SELECT * FROM links WHERE target_host IN (SELECT host FROM reached)",
    "jn15_lookup": q.with_(*q.WEB) + "SELECT page_id, host, round(coalesce(harmonic, 0), 6) AS harmonic FROM urls LEFT JOIN centrality USING (host)",
    "jn18_find_links": _ALL_LINKS + "SELECT * FROM links WHERE target_host IN (SELECT host FROM urls GROUP BY host HAVING count(*) >= 3)",
    "agg4_urls_per_host": q.with_(q.URLS) + "SELECT host, count(*) AS n FROM urls GROUP BY host",
    "agg6_distinct_url_keys": q.with_(q.URLS) + "SELECT DISTINCT url_key FROM urls",
    "flt2_host_equals": q.with_(q.URLS) + "SELECT page_id, url FROM urls WHERE host = 'therha.example.com'",
    "flt3_host_in": q.with_(q.URLS) + "SELECT page_id, host FROM urls WHERE host IN (SELECT host FROM urls GROUP BY host HAVING count(*) >= 3)",
    "flt8_round_robin": "SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (ORDER BY page_id) - 1 AS n FROM pages) WHERE n % 4 = 1",
    "flt9_linked_urls": _ALL_LINKS + "SELECT target_host || target_path AS url FROM links GROUP BY 1 HAVING count(*) > 1",
    "src7_tsv_round_trip": _ALL_LINKS + "SELECT host, path, target_host, target_path, substr(text, 1, 1000) AS text, nofollow FROM links",
    "src1_warc_responses": "SELECT url, '2024-01-01T00:00:00Z' AS date, '192.0.2.1' AS ip, 200 AS status, 'text/html; charset=utf-8' AS content_type, html FROM pages",
    "src3_warc_pages": q.with_(q.URLS) + f"SELECT url, title, h1, meta, text, '2024-01-01T00:00:00Z' AS date, '192.0.2.1' AS ip FROM urls WHERE title <> '' AND strlen(title) <= 400 AND strlen(h1) <= 400 AND NOT {_exotic('title')}",
    "src8_manifest": "SELECT kind, 'crawl/segment.warc/' || page_id || e AS path FROM pages, (VALUES ('urls', '.gz'), ('links', '.links.gz'), ('direct', '.direct.links.gz')) k(kind, e)",
    "src9_columns": q.with_(q.URLS) + "SELECT title AS third, count(*) AS n FROM urls GROUP BY title",
    "src14_archive": q.with_(*q.WEB) + "SELECT host, round(harmonic, 6) AS harmonic FROM centrality",
    "src15_missing_files": q.with_(q.URLS) + "SELECT 'crawl/' || host AS path FROM urls GROUP BY host HAVING count(*) < 3",
    "src17_robots": f"SELECT page_id, CASE WHEN p LIKE '/%page=2%' THEN false WHEN p LIKE '/en/2%' THEN true WHEN p LIKE '/en/%' THEN false ELSE true END AS bot, false AS other FROM (SELECT page_id, {q.PATH_QUERY} AS p FROM pages)",
    "snk7_graph_files": q.with_(q.URLS, q.LINKS, _EDGES) + "SELECT * FROM edges",
    "bat2_split_links": _ALL_LINKS + "SELECT target_host, 1::BIGINT AS nodes, count(*) AS n FROM links GROUP BY target_host",
    "bat4_save_hosts": q.with_(q.URLS) + "SELECT host, url, title FROM urls WHERE host IN (SELECT host FROM urls GROUP BY host HAVING count(*) >= 3)",
    "bat5_read_batch": q.with_(q.URLS) + "SELECT url, title, h1 FROM urls",
    "flt7_top_level_domains": f"SELECT regexp_extract({q.RAW_HOST}, '[^.]*$') AS tld, true AS known, count(*) AS n FROM pages GROUP BY 1",
    "src12_positions": "SELECT min(l_orderkey * 10 + l_linenumber) FILTER (WHERE l_orderkey = 33) AS first, max(l_orderkey * 10 + l_linenumber) FILTER (WHERE l_orderkey = 33) AS last, min(l_orderkey * 10 + l_linenumber) FILTER (WHERE l_orderkey > 33) AS next FROM lineitem",
    "src12_find_all": "SELECT o_custkey AS k, o_orderkey FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)",
    "src13_dictionary": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
}
