import pytest
from pyspark.sql import functions as F

from quarry.functions import html as ht

BASE = "http://www.site.com/dir/page.html?x=1"


@pytest.fixture(scope="module")
def parsed(spark):
    def make(page):
        return ht.parse_pages(spark.createDataFrame([(page, "own")], "html string, title string")).first()

    return make


@pytest.fixture(scope="module")
def value(spark):
    def make(use, text):
        return spark.createDataFrame([(text,)], "s string").select(use(F.col("s")).alias("v")).first().v

    return make


def test_title_h1_text(parsed):
    r = parsed("<html lang=sv><title>a title</title>\n<h1 class=x><span>Hej</span> Hopp</h1> text <b>after</b>\n it</html>")
    assert (r.title, r.h1, r.text, r.should_insert) == ("a title", "Hej Hopp", "text after it", True)
    assert parsed("no tags at all <h1></h1>").title == ""
    assert parsed("<title>a</title><body class=x>in <i>the</i> body<script>if (a<b) {}</script> end").text == "in the body end"
    assert parsed("<title>a</title>nothing").text == ""


def test_meta(parsed):
    assert parsed('<title>t</title><meta charset="utf-8"><meta name="description" content="Böcker och mer.">').meta == "Böcker och mer"
    assert parsed("<title>t</title>").meta == ""


def test_scripts_and_styles_are_invisible(parsed):
    r = parsed("<script>'<title>no</title>'</script><style><h1>no</h1></style><title>yes</title><h1>h</h1>a<style>b</style>c")
    assert (r.title, r.h1, r.text) == ("yes", "h", "ac")


def test_gate(parsed):
    assert not parsed("<title></title>").should_insert
    assert not parsed(f"<title>{'x' * 401}</title>").should_insert and parsed(f"<title>{'x' * 400}</title>").should_insert
    assert not parsed(f"<title>t</title><h1>{'x' * 401}</h1>").should_insert
    assert not parsed('<meta charset="koi8-r"><title>t</title>').should_insert
    assert not parsed(None).should_insert


def test_encoding(value):
    assert value(ht.encoding, "<meta charset=UTF-8>") == "utf-8" and value(ht.encoding, "<meta charset=ISO-8859-1>") == "iso-8859-1"
    assert value(ht.encoding, "x" * 1025 + "charset=koi8") == "utf-8" and value(ht.encoding, "charset=koi8") == "unknown"


@pytest.mark.parametrize(("text", "exotic"), [("plain text of a title", False), ("åäö", False), ("В одном городе жил", True), ("09から1日間の記事一覧", True), ("Đại lý xe hơi - site.vn", False), ("", False)])
def test_exotic(value, text, exotic):
    assert value(ht.is_exotic, text) is exotic


@pytest.mark.parametrize(("code", "text"), [("a &amp; b", "a & b"), ("&lt;&gt;&quot;&apos;", "<>\"'"), ("&aring;&#229;&#xE5;&#XE5;", "åååå"), ("&#128578;", "🙂"), ("&nosuch; &amp &", "&nosuch; &amp &"), ("&amp;lt;", "&lt;"), ("&#0;&#55296;&#99999999;", "&#0;&#55296;&#99999999;"), ("none", "none"), (None, None)])
def test_entities(value, code, text):
    assert value(ht.decode_entities, code) == text


def test_all_named_entities(value):
    from html.entities import name2codepoint

    names = sorted(name2codepoint)
    assert value(ht.decode_entities, "".join(f"&{n};" for n in names)) == "".join(chr(name2codepoint[n]) for n in names)


def test_long_text_is_cut(spark):
    page = "<title>t</title><h1>h</h1>" + "word " * 50_000
    [r] = ht.parse_pages(spark.createDataFrame([(page,)], "html string"), most=1000).collect()
    assert r.text.startswith(" word word") and len(r.text) == 1000  # text that is cut stays as it is


LINKS = """<a href="/in">inside</a><a class="x" href="http://www.other.com/p?a=1&amp;b=2">To <b>other</b></a><a href="http://third.com/" rel="nofollow">third</a>
<a href="http://empty.com/"> </a><a href='http://single.com/'>no</a><a name="x">no</a><a href="#top">top</a><a href="../up">up</a>"""


@pytest.mark.parametrize("exact", [True, False])
def test_links(spark, exact):
    df = spark.createDataFrame([(1, BASE, LINKS), (2, BASE, None), (3, BASE, "none")], "id int, url string, html string")
    rows = ht.links(df, "html", "url", "id", exact=exact).orderBy("pos").collect()
    outer = [(r.target_host, r.target_path, r.text, r.nofollow) for r in rows if not r.internal]
    assert outer == [("other.com", "/p?a=1&b=2", "To other", False), ("third.com", "/", "third", True)]
    inner = [r.target_path for r in rows if r.internal]
    assert inner == ["/in", "/dir/page.html?x=1", "/up" if exact else "/dir/../up"]
    assert {(r.host, r.path) for r in rows} == {("site.com", "/dir/page.html?x=1")}
    assert ht.internal_links(ht.links(df, "html", "url")).first().source == "site.com/dir/page.html?x=1"


def test_captcha(value):
    assert value(ht.is_captcha, "<h1>Solve this CAPTCHA</h1>") and not value(ht.is_captcha, "fine")
