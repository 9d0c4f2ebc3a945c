"""The search on a few pages by hand."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.plans import domain_index as di
from quarry.plans import index_build as ib
from quarry.plans import search as se

PAGES = [("http://www.one.com/a", "red cat", "cat", "", "the red cat sat"), ("http://one.com/b?x=1", "blue dog", "", "", "a red dog"), ("https://two.org/", "cat-food shop", "", "", "food for every cat, red or not")]
LINKS = [("two.org", "/", "one.com", "/a", "red cat"), ("three.net", "/", "one.com", "/a", "the red cat page"), ("three.net", "/", "one.com", "/gone", "red cat")]


@pytest.fixture(scope="module")
def web(spark):
    urls = ib.with_url_columns(spark.createDataFrame(PAGES, "url string, title string, h1 string, meta string, text string"))
    links = spark.createDataFrame(LINKS, "host string, path string, target_host string, target_path string, text string")
    hosts = spark.createDataFrame([("one.com", 0.1), ("two.org", 0.2)], "host string, harmonic double")
    return urls, links, hosts, ib.url_postings(urls, hosts), ib.link_postings(links, urls, hosts), ib.domain_link_postings(links, hosts)


def test_query_words():
    assert se.query_words("The C++, \tthe a|b!") == ["the", "c++", "a", "b"] and se.query_words(" . ") == []
    assert se.query_words(" ".join(f"w{i}" for i in range(20))) == [f"w{i}" for i in range(10)]
    assert se.query_words_all("a b a") == ["a", "b", "a"]


def test_weights(web):
    got = {(r.token, r.value): r.score for r in web[3].collect()}
    assert got["cat", "one.com/a"] == pytest.approx((10 + 3 + 1) * 0.1)
    assert got["one", "one.com/a"] == got["site:www.one.com", "one.com/a"] == pytest.approx(20 * 0.1)
    assert got["cat-food", "two.org/"] == pytest.approx(10 * 0.2) and got["food", "two.org/"] == pytest.approx(11 * 0.2)


def test_link_postings(web):
    assert {r.target for r in web[4].collect()} == {"one.com/a"}  # links to unknown pages count for the domain only
    assert {r.source_url for r in web[5].where("token = 'page'").collect()} == {"three.net/"}


def test_search(web):
    urls, _, _, postings, links, domains = web
    rows = se.search("red cat", postings, links, domains).collect()
    assert [r.value for r in rows] == ["one.com/a", "two.org/"]
    link = math.expm1(25 * 0.2) / 50  # of two.org; three.net has no harmonic
    words = (10 + 1) * 0.1 + (10 + 3 + 1) * 0.1
    assert rows[0].score == pytest.approx(words + 2 * link) and (rows[0].url_links, rows[0].domain_links) == (2, 2)
    assert se.search("red unicorn", postings, links, domains).count() == se.search("", postings, links, domains).count() == 0
    m = se.metrics("red cat", postings, links, domains).first()
    assert (m.total_found, m.total_url_links_found, m.total_domain_links_found, m.link_url_matches, m.link_domain_matches) == (2, 2, 2, 2, 2)


def test_site_search(web):
    rows = {r.value: r for r in se.site_search("red", web[3], web[4]).collect()}
    assert rows["one.com/a"].total == 2
    assert rows["one.com/b?x=1"].score == pytest.approx(2 * 0.1 + (1000 - len("/b?x=1")) / 500)


def test_compound_words(web):
    """A page with a compound is found by it and by its parts; the compound does not find the parts."""
    find = lambda q: {r.value for r in se.search(q, web[3], web[4], web[5]).collect()}
    assert find("cat-food") == {"two.org/"} and "two.org/" in find("food")


def test_domain_index(web):
    urls, links, hosts = web[:3]
    got = {(r.token, r.value): r.score for r in di.build(urls, links, hosts).collect()}
    assert got["page", "one.com"] == 0.1 and got["shop", "two.org"] == 0.2
    assert {r.word for r in di.domain_info(urls, links, "one.com").where("list = 'title'").collect()} == {"red", "cat", "blue", "dog"}
    assert {r.harmonic for r in di.harmonic_of(urls, hosts.where("host = 'one.com'")).collect()} == {0.1, 0.0}


def test_link_postings_are_parted_by_their_words(spark, web):
    """They had the partitions of the links' join, whose sizes are those of links without their words."""
    plan = ib.link_postings(web[1], web[0], web[2])._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan
