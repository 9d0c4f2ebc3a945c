import gzip
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.plans import jobs
from quarry.sources import archive, robots, sinks, tsv, warc
from quarry.streaming import ingest


def test_tsv_round_trip(spark, tmp_path):
    rows = [("a.com", "/x?a=\"1\"", "b.com", "/", "t'e\\xt", "1"), ("c.com", "/", "d.com", "/", "", "0")]
    df = spark.createDataFrame(rows, "host string, path string, target_host string, target_path string, text string, nofollow string")
    sinks.write_tsv(df.coalesce(1), f"{tmp_path}/out", 1)
    back = sorted(tuple(r) for r in tsv.read_links(spark, f"{tmp_path}/out").collect())
    assert back == [(*rows[0][:5], True), (*rows[1][:4], None, False)]
    assert len(list((tmp_path / "out").glob("*.gz"))) == 2


def test_manifest_and_batch(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.links.gz").write_bytes(gzip.compress(f"h{i}\t/\tt\t/\ttext\t0\n".encode()))
    (tmp_path / "warc.paths").write_text("f0.warc.gz\nf1.warc.gz\n\nf2.warc.gz\n")
    assert [r.path for r in tsv.manifest(spark, f"{tmp_path}/warc.paths").collect()] == ["f0.gz", "f1.gz", "f2.gz"]
    batch = tsv.read_batch(spark, f"{tmp_path}/warc.paths", str(tmp_path), "links", limit=1, offset=1)
    assert [r.host for r in batch.collect()] == ["h1"]
    assert tsv.read_batch(spark, f"{tmp_path}/warc.paths", str(tmp_path), "links", limit=1, offset=9).count() == 0


def test_columns_and_positions(spark):
    lines = spark.createDataFrame([(1, "a\t1.5\tx"), (2, "b"), (3, "a\t2")], "n int, value string")
    assert [r.value for r in tsv.column(lines, 1).collect()] == ["1.5", "", "2"]
    assert [r.value for r in tsv.column_rows(lines, 0, "n", 1, 1).collect()] == ["b"] and tsv.column_set(lines, 0).count() == 2
    assert [r.v for r in lines.select(tsv.numeric_columns(F.col("value")).alias("v")).collect()] == [[1.5], [], [2.0]]
    keys = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "d")], "p int, k string")
    assert tuple(tsv.positions(keys, "k", "b", "p").first()) == (1, 2, 3) and tuple(tsv.positions(keys, "k", "c", "p").first()) == (None, None, 3)
    assert {(r.p) for r in tsv.dictionary(keys, "k", "p").collect()} == {0, 2, 3}
    assert [r.p for r in tsv.round_robin(keys, "p", 2, 1).collect()] == [1, 3]


def record(kind, url, body, extra=b""):
    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Target-URI: " + url + b"\r\nWARC-IP-Address: 1.2.3.4\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n" + extra + b"Content-Length: " + str(len(content)).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def test_warc_pages(spark, tmp_path):
    page = b"<title>Title of it</title><h1>H</h1>WARC/1.0 text"
    records = [record(b"request", b"http://a.com/", b""), record(b"response", b"http://a.com/x", page), record(b"response", b"http://a.nosuchtld/", page), record(b"response", b"http://b.se/", b"<title></title>"), record(b"response", b"http://c.org/", '<meta charset="iso-8859-1"><title>å</title>'.encode("latin-1"))]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(b"".join(records))[:-20])
    raw = warc.responses(spark, str(tmp_path))
    assert raw.where("file LIKE '%one%'").count() == 4
    pages = warc.pages(raw.where("file LIKE '%one%'")).orderBy("url").collect()
    assert [(r.url, r.title, r.h1, r.text, r.ip, r.date) for r in pages] == [("http://a.com/x", "Title of it", "H", "WARC/1.0 text", "1.2.3.4", "2024-01-01T00:00:00Z"), ("http://c.org/", "å", "", "", "1.2.3.4", "2024-01-01T00:00:00Z")]
    assert raw.where("file LIKE '%two%'").count() >= 3  # the cut record is left out


def test_records_cut_anywhere():
    data = record(b"response", b"http://a.com/", b"x" * 100) * 3
    for n in (1, 7, 1000):
        got = list(warc.split_records(data[i : i + n] for i in range(0, len(data), n)))
        assert len(got) == 3 and all(b.endswith(b"x" * 100) for _, b in got)


def test_http_fields(spark):
    df = spark.createDataFrame([("HTTP/1.1 404 Not Found\r\nLocation: /a b\r\n",), ("garbage",)], "r string")
    rows = df.select(warc.http_status(F.col("r")).alias("s"), warc.http_header(F.col("r"), "Location: ").alias("l")).collect()
    assert [tuple(r) for r in rows] == [(404, "/a b"), (500, "")]


ROBOTS = "Sitemap: /map\nUser-agent: OneBot\nUser-agent: TwoBot\nDisallow: /private\nAllow: /private/open$\n\nUser-Agent: *  # the rest\nDisallow: /*secret=1*\nDisallow: /cart/\n"


@pytest.mark.parametrize(
    ("agent", "url", "ok"),
    [("OneBot", "/private/x", False), ("twobot", "http://a.com/private/open", True), ("OneBot", "/private/open/more", False), ("OneBot", "/cart/", True), ("Other", "/x?secret=1", False), ("Other", "/cart/add", False), ("Other", "/private", True)],
)
def test_robots(agent, url, ok):
    assert robots.allowed(ROBOTS, agent, url) is ok


def test_robots_column(spark):
    df = spark.createDataFrame([(ROBOTS, "/cart/"), (None, "/cart/"), ("User-agent: Bot\nDisallow: *\n", "/visit"), (ROBOTS, None)], "r string, u string")
    assert [r.v for r in df.select(robots.robots_allowed("Bot")(F.col("r"), F.col("u")).alias("v")).collect()] == [False, True, False, None]


def test_archive_and_missing_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"f{i}").write_bytes(bytes([i]) * (500 * i + 1))
    archive.pack(spark, str(source), f"{tmp_path}/packed")
    archive.unpack_to(spark, f"{tmp_path}/packed", f"file://{tmp_path}/out")
    assert all((tmp_path / "out" / f"f{i}").read_bytes() == (source / f"f{i}").read_bytes() for i in range(3))
    expected = spark.createDataFrame([(f"crawl/f{i}",) for i in range(4)], "path string")
    listed = archive.list_files(spark, str(source))
    assert sorted(r.path for r in archive.missing_files(expected, listed).collect()) == ["crawl/f0", "crawl/f1", "crawl/f3"]


def test_postings_files_and_table(spark, tmp_path):
    p = spark.createDataFrame([(f"t{i % 7}", i, 1.0) for i in range(50)], "token string, value int, score double")
    sinks.write_postings(p, f"{tmp_path}/p", 3)
    assert spark.read.parquet(f"{tmp_path}/p").where("token = 't3'").count() == 7
    sinks.write_postings_table(p, "postings_test", 4, f"{tmp_path}/table")
    found = spark.table("postings_test").where("token = 't3'")
    plan = found.groupBy("token").count()._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 7 and "SelectedBucketsCount: 1 out of 4" in plan and "Exchange" not in plan
    spark.sql("DROP TABLE postings_test")


def test_response(spark):
    df = spark.createDataFrame([("u1", 1.0), ("u2", 3.0), ("u3", 2.0)], "url string, score double")
    [r] = sinks.response(df, F.desc("score"), 2, total_found=F.lit(3)).collect()
    assert r.json == '{"status":"success","total_found":3,"results":[{"url":"u2","score":3.0},{"url":"u3","score":2.0}]}'
    assert sinks.response(df.where("false"), F.desc("score")).first().json == '{"status":"success","results":[]}'


def test_response_numbers(spark):
    """Numbers are as in the SQL's JSON: no exponent from a millionth to 1e21."""
    values = [12345678.5, 52756970.3679, 1e20, 0.0005, 1.5e-6, -0.00025, -2e7, 0.0, 5.0, 123.25]
    df = spark.createDataFrame([(i, f'u"{i}', x) for i, x in enumerate(values)] + [(99, None, None)], "i int, u string, s double")
    with duckdb.connect() as c:
        want = [c.execute("SELECT json_object('i', ?::INT, 'u', ?, 's', ?::DOUBLE)", [i, f'u"{i}', x]).fetchone()[0] for i, x in enumerate(values)]
    assert sinks.response(df, F.asc("i"), took=F.lit(2e7)).first().json == '{"status":"success","took":20000000.0,"results":[' + ",".join([*want, '{"i":99}']) + "]}"


def test_jobs(spark, tmp_path):
    pages = spark.createDataFrame([(f"h{i % 5}.com", f"http://h{i % 5}.com/{i}") for i in range(40)], "host string, url string")
    jobs.split_by_host(pages, 4, f"{tmp_path}/split")
    back = spark.read.option("sep", "\t").csv(f"{tmp_path}/split").toDF("host", "url", "node")
    assert back.count() == 40 and back.select("host", "node").distinct().count() == 5
    crawled = spark.createDataFrame([("a", 200), ("a", 404), ("a", None), ("b", 200)], "host string, status int")
    assert {r.host: (r.ok, r.not_ok, r.errors) for r in jobs.crawl_stats(crawled).collect()} == {"a": (1, 1, 1), "b": (1, 0, 0)}
    jobs.write_crawl(crawled, f"{tmp_path}/crawl")
    assert spark.read.parquet(f"{tmp_path}/crawl").where("status_class = 'error'").count() == 1


def test_incremental_postings(spark, tmp_path):
    """Two rounds of files, staged and merged, are as one build over all."""
    source, schema = f"{tmp_path}/in", "token string, value long, count long"
    make = lambda n: spark.range(n, n + 100).selectExpr("concat('t', id % 7) as token", "id % 50 as value", "1L as count")
    merged = None
    for round_ in range(2):
        make(round_ * 60).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.file_stream(spark, source, spark.read.schema(schema).parquet(source).schema, files=1)
        ingest.ingest_postings(stream, lambda b: b, f"{tmp_path}/staged", f"{tmp_path}/checkpoint").awaitTermination()
        merged = ingest.merge_postings(spark, merged, f"{tmp_path}/staged", f"{tmp_path}/v{round_}", count=F.sum("count"))
    want = make(0).union(make(60)).groupBy("token", "value").agg(F.sum("count").alias("count"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, want.select("token", "value", "count").collect()))


def test_postings_are_merged_once(spark, tmp_path, monkeypatch):
    staged, one = f"{tmp_path}/staged", spark.createDataFrame([("t", 1, 1)], "token string, value long, count long")
    one.write.parquet(f"{staged}/batch=0")
    first = ingest.merge_postings(spark, None, staged, f"{tmp_path}/v1", count=F.sum("count"))
    one.write.parquet(f"{staged}/batch=1")
    with monkeypatch.context() as m:  # broken off when the new index is valid, and called again
        m.setattr(ingest.st, "remove", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.merge_postings(spark, first, staged, f"{tmp_path}/v2", count=F.sum("count"))
    second = ingest.merge_postings(spark, first, staged, f"{tmp_path}/v2", count=F.sum("count"))
    third = ingest.merge_postings(spark, second, staged, f"{tmp_path}/v3", count=F.sum("count"))
    assert [df.first()["count"] for df in (first, second, third)] == [1, 2, 2]


def test_damaged_streams(spark):
    record = lambda i: f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nbody{i}\r\n\r\n".encode()
    bad = bytearray(gzip.compress(bytes(range(256)) * 40))
    bad[40:60] = b"\xff" * 20
    data = gzip.compress(record(1)) + bytes(bad) + b"no gzip" + gzip.compress(b"\0" * (3 << 20)) + gzip.compress(record(2))
    for n in (7, 100_000):
        got = [b for _, b in warc.split_records(warc.inflated(data[i : i + n] for i in range(0, len(data), n)))]
        assert got == [b"body1", b"body2"]


def test_domain_response(spark):
    df = spark.createDataFrame([(2, 10, 1.5), (2, 11, 2.5), (2, 12, 2.5), (-1, 9, 0.25)], "domain long, value long, score double")
    blocks = sinks.domain_blocks(df, 2)
    [(body,)] = sinks.domain_response(blocks).collect()
    want = struct.pack("<QqQqf", 4, -1, 1, 9, 0.25) + struct.pack("<qQqfqf", 2, 2, 11, 2.5, 12, 2.5)
    assert bytes(body) == want
    assert sorted(map(tuple, sinks.read_domain_blocks(blocks).collect())) == [(-1, 1, 9, 0.25), (2, 3, 11, 2.5), (2, 3, 12, 2.5)]
    [(empty,)] = sinks.domain_response(sinks.domain_blocks(df.limit(0))).collect()
    assert bytes(empty) == bytes(8)


def test_truncate(spark, tmp_path):
    sinks.write_postings(spark.createDataFrame([("a", 1)], "token string, value int"), f"{tmp_path}/p")
    sinks.truncate(spark, f"{tmp_path}/p")
    left = spark.read.parquet(f"{tmp_path}/p")
    assert left.count() == 0 and left.columns == ["token", "value"]
