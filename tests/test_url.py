import pytest
from pyspark.sql import functions as F

from quarry.functions import url as ur


@pytest.fixture(scope="module")
def value(spark):
    def make(use, *args):
        return spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args)))).select(use(*(F.col(f"c{i}") for i in range(len(args)))).alias("v")).first().v

    return make


def test_parts(value):
    url = "https://www.example.com/test.html?key=value#part"
    want = {ur.scheme: "https", ur.host: "example.com", ur.has_www: True, ur.has_https: True, ur.path: "/test.html", ur.query: "key=value", ur.path_with_query: "/test.html?key=value", ur.key: "example.com/test.htmlkey=value", ur.hash_input: "example.com/test.html?key=value", ur.tld: "com"}
    for use, v in want.items():
        assert value(use, url) == v
    assert value(ur.path, "http://example.com") == "/" and value(ur.path, "http://example.com/") == "/"
    assert value(ur.host, "http://user:pw@Example.com:80/x") == "Example.com" and value(ur.query, "http://example.com/?a?b") == "a?b"
    assert value(ur.host, "no url") == "" and value(ur.path, "no url") == "" and value(ur.host, None) is None


def test_hosts(value):
    assert value(ur.host_reverse, "a.b.com") == "com.b.a" and value(ur.domain_without_tld, "a.b.com") == "b" and value(ur.domain_without_tld, "com") == ""
    assert value(ur.host_reverse_top_domain, "a.b.com") == "com.b" and value(ur.host_reverse_top_domain, "com") == "com"
    for host, top in {"test.uk": "test.uk", "a.test.uk": "a.test.uk", "one.com.au": "one.com.au", "sub.one.com.au": "one.com.au", "b.com": "b.com", "a.b.com": "b.com", "x.co.uk": "x.co.uk", "w.x.co.uk": "x.co.uk", "": ""}.items():
        assert value(ur.host_top_domain, host) == top


def test_identity_ignores_scheme_and_www(value):
    urls = ["https://www.a.com/x?q=1", "http://a.com/x?q=1", "https://a.com/x?q=2"]
    a, b, c = (value(ur.hash_input, u) for u in urls)
    assert a == b != c
    assert value(ur.canonically_different, urls[0], urls[1]) is False and value(ur.canonically_different, urls[0], urls[2]) is True


def test_rebuild(value):
    u = "https://www.a.com/t.html?k=v"
    assert value(lambda c: ur.rebuild(c, "http", False), u) == "http://a.com/t.html?k=v"
    assert value(lambda c: ur.rebuild(c, None, True), "http://a.com") == "http://www.a.com/"
    assert value(ur.rebuild, u) == u


@pytest.mark.parametrize(("code", "text"), [("a%20b", "a b"), ("a%2020", "a 20"), ("%start%", "%start%"), ("x%%c3%C3%a5%0G", "x%c3å%0G"), ("%25C3%25A5", "%C3%A5"), ("%j%0", "%j%0"), ("a%00b", "a"), ("", ""), (None, None)])
def test_urldecode(value, code, text):
    assert value(ur.urldecode, code) == text


def test_urlencode(value):
    assert value(ur.urlencode, "a b+c*~é-._/") == "a%20b%2Bc%2A~%C3%A9-._%2F"


def test_query_map(value):
    assert value(ur.query_map, "http://a.com/?a=1&b=2&a=3&bare&c=") == {"b": "2", "a": "3", "c": ""}
    assert value(ur.query_map, "http://a.com/") == {} and value(ur.query_map, None) is None


@pytest.mark.parametrize("href", ["http://b.com/x", "//b.com/x", "/abs?q=1", "?q=2", "#part", "name.html", "", "x/y.html"])
def test_resolve_without_python_is_the_same(value, href):
    base = "https://a.com/dir/page.html?q=1"
    assert value(ur.resolve_path, base, href) == value(ur.resolve, base, href)


def test_resolve(value):
    assert value(ur.resolve, "http://a.com/x/y", "../z") == "http://a.com/z" and value(ur.resolve, "http://a.com/", None) is None
    assert value(ur.resolve, "http://a.com/", "http://[bad") is None


def test_link_inputs(value):
    assert value(ur.link_hash_input, "a.com", "http://b.com/") == "a.comhttp://b.com/" and value(ur.domain_link_hash_input, "a.com", "b.com") == "a.comb.com"
