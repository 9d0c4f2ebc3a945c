"""Every query that has SQL gives what DuckDB gives, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarry import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.6g}" if isinstance(v, (int, float, np.integer, np.floating)) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert {k for k in QUERIES if k not in SQL} == {"txt13_snippets", "hash1_token_hashes"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.fixture(scope="module")
def long_pages(spark, sf_dir, tmp_path_factory):
    """Pages of which one has over 100,000 characters of body text, with a word and an entity behind them, and one such a title."""
    folder = tmp_path_factory.mktemp("long")
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet").head(20)
    body = "word&amp;sign " * 15_000 + "lastword &copy; end"
    pages.loc[3, "html"] = f"<html><title>long page</title><body><h1>h</h1><p>{body}</p></body></html>"
    pages.loc[4, "html"] = f"<html><title>{'a&amp;b ' * 20_000}lasttitle</title><body><h1>h</h1><p>text</p></body></html>"
    pages.to_parquet(f"{folder}/pages.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    return str(folder)


@pytest.mark.parametrize("name", ["htm1_pages", "rnk1_url_index"])
def test_long_pages_are_whole(spark, long_pages, name):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS SELECT * FROM '{long_pages}/pages.parquet'")
        want = c.execute(SQL[name]).df()
    got = QUERIES[name](spark, long_pages).toPandas()
    assert normal(got) == normal(want)
    whole = got.to_csv()
    assert "lastword" in whole and "lasttitle" in whole


def test_queries_without_sql(spark, sf_dir):
    from tests.test_hashing import one

    for r in QUERIES["hash1_token_hashes"](spark, sf_dir).collect():
        assert (r.url_hash % (1 << 64), r.host_hash % (1 << 64)) == (one(r.url_key.encode()), one(r.host.encode())) and r.node == one(r.host.encode()) % 8
    [r] = QUERIES["snk9_response"](spark, sf_dir).collect()
    assert r.json.startswith('{"status":"success","query":"The of, the","results":[{"url":"http')


def test_entry_without_the_corpus_operators(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    with monkeypatch.context() as m:
        for name in ("quarry.llm", "quarry.llm.registry"):
            m.setitem(sys.modules, name, None)
        bare = importlib.reload(__spark_entry__)
        assert set(bare.queries()) == set(QUERIES) and set(bare.oracle_sql()) == set(SQL)
        assert bare.entry(spark).columns
    importlib.reload(__spark_entry__)


def from_pages(folder, rows) -> str:
    """A folder with a pages table of (url, html) rows."""
    pd.DataFrame({"page_id": range(len(rows)), "url": [u for u, _ in rows], "html": [h for _, h in rows]}).to_parquet(f"{folder}/pages.parquet")
    return str(folder)


def as_sql(spark, folder, name, *names) -> bool:
    with duckdb.connect() as c:
        for t in names:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        want = c.execute(SQL[name]).df()
    return normal(QUERIES[name](spark, folder).toPandas()) == normal(want)


def test_internal_harmonic_of_popular_pages(spark, tmp_path):
    """Pages that 3,000 others link to: a sketch's estimate is off there."""
    anchors = '<a href="/top">top</a><a href="/also">also</a>'
    assert as_sql(spark, from_pages(tmp_path, [(f"http://a.com/{i}", anchors) for i in range(3000)]), "grf8_internal_harmonic", "pages")


@pytest.mark.parametrize("name", ["skt4_bloom", "skt5_bloom_stored"])
def test_bloom_of_many_names(spark, tmp_path, name):
    """So many names that a filter of a fixed size would hold others too."""
    for t, n in (("customer", 1_200_000), ("supplier", 60_000), ("part", 40_000)):
        pd.DataFrame({f"{t[0]}_name": [f"{t}#{i}" for i in range(n)]}).to_parquet(f"{tmp_path}/{t}.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as c:
        for t in ("customer", "supplier"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        want = {r[0] for r in c.execute(SQL[name]).fetchall()}
    found = [r.name for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_warc_pages_are_whole(spark, tmp_path):
    html = f"<html><head><title>long page</title></head><body><h1>h</h1><p>{'word&amp;sign ' * 15_000}lastword</p></body></html>"
    folder = from_pages(tmp_path, [("http://a.com/1", html), ("http://b.com/2", "<title>t</title><body>text</body>")])
    assert as_sql(spark, folder, "src3_warc_pages", "pages")
    assert QUERIES["src3_warc_pages"](spark, folder).where("text LIKE '%lastword'").count() == 1


def test_url_index_of_pages_with_one_key(spark, tmp_path):
    """Pages that differ by scheme, www. or fragment have one key, and the weights of their tokens are added up; others are folded alone."""
    html = "<html><title>{0} a-b {0}</title><body><h1>{0} h a</h1><p>{0} text a-b b {1}</p></body></html>"
    sites = ("http://a.com/x", "https://a.com/x", "https://www.a.com/x#top", "http://b.org/y?q=1", "http://www.b.org/y?q=1", "http://c.net/z", "http://d.net/")
    folder = from_pages(tmp_path, [(u, html.format(f"w{i % 3}", f"only{i}")) for i, u in enumerate(sites * 3 + ("http://c.net/alone", "http://c.net/empty"))])
    assert as_sql(spark, folder, "rnk1_url_index", "pages")


def test_url_index_shuffles_no_pages(spark, sf_dir):
    """Pages were shuffled by their host, of which a few can have most of the text."""
    plan = QUERIES["rnk1_url_index"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(host" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.fixture()
def copied_pages(spark, sf_dir, tmp_path):
    """Pages in four files, of which no index is there yet."""
    spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_web_index_is_written_where_its_pages_are(spark, copied_pages):
    """Each file is a sorted run; the list of a frequent word, which was a task's and a file's, is spread over them."""
    from quarry.catalog.search import Web

    web = Web(spark, copied_pages, build=True)
    for df in (web.postings, web.links, web.domain_links):
        for path in df.inputFiles():
            rows = [(r.token, r.value) for r in spark.read.parquet(path).select("token", "value").collect()]
            assert rows == sorted(rows, key=lambda t: (t[0].encode(), t[1].encode()))
    files = [path for path in web.postings.inputFiles() if spark.read.parquet(path).where("token = 'the'").count()]
    assert len(files) > 1


@pytest.mark.parametrize(("name", "built"), [("rnk4_domain_dedup", {"centrality", "postings"}), ("rnk15_federated", {"urls", "linked", "centrality", "postings", "links"})])
def test_a_search_builds_what_it_reads(spark, copied_pages, name, built):
    """It built all tables of the web index, of which it reads some."""
    from quarry.catalog.search import Web

    assert as_sql(spark, copied_pages, name, "pages")
    web = Web(spark, copied_pages)
    assert {n for n in Web.NAMES if web._there(n)} == built
