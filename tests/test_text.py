from pyspark.sql import functions as F
import pytest

from quarry.functions import text as tx


@pytest.fixture(scope="module")
def value(spark):
    """The value of a function of one text."""

    def make(text, use):
        return spark.createDataFrame([(text,)], "s string").select(use(F.col("s")).alias("v")).first().v

    return make


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("C++ map. is the, best", ["c++", "map", "is", "the", "best"]),
        ("C# is good.", ["c#", "is", "good"]),
        ("...a!!b,,c||d\te", ["a", "b", "c", "d", "e"]),
        ("one\ntwo three", ["one\ntwo", "three"]),  # a new line alone does not part words
        ("one,\n two", ["one", "two"]),
        ("ÄB ÅÄÖ Éa", ["Äb", "ÅÄÖ", "Éa"]),  # only ASCII is lowered
        ("", []),
        (" \t ,|! ", []),
        ("x" * 101 + " " + "y" * 100, ["y" * 100]),
        ("å" * 51 + " " + "å" * 50, ["å" * 50]),  # bytes count
        ("-----" * 2000 + "end", ["end"]),
        (None, None),
    ],
)
def test_full_text_words(value, text, words):
    assert value(text, tx.full_text_words) == words


def test_limit(value):
    assert value("a b c d", lambda c: tx.full_text_words(c, 2)) == ["a", "b"]


def test_expanded_words(value):
    assert value("Test. +func-tion+ a.b:c", tx.expanded_words) == ["test", "+func-tion+", "+func", "tion+", "a.b:c", "a", "b", "c"]
    assert value("x--y", tx.expanded_words) == ["x--y", "x", "", "y"]  # empty parts are kept
    assert value("b a-b a", tx.unique_expanded_words) == ["a", "a-b", "b"]


def test_tokens(value):
    assert value("Test. Ing!   +x+", tx.tokens) == ["test", "ing", "+x+"]
    assert value("a\nb c", tx.tokens) == ["ab", "c"]
    assert value("a ... b", tx.tokens) == ["a", "", "b"]
    assert value("w" * 500, tx.tokens) == ["w" * 500]


def test_trims(value):
    assert value(" .c++. ", tx.trim) == "c++" and value(" .a. ", tx.trim_space) == ".a." and value(".a. ", tx.trim_signs) == "a. "


@pytest.mark.parametrize(("word", "clean", "is_clean"), [("hej", "hej", True), ("åäö", "åäö", True), ("123", "123", True), ("açd", "ad", False), ("$Üç", "", False), ("", "", True)])
def test_clean_words(value, word, clean, is_clean):
    assert value(word, tx.clean_word) == clean and value(word, tx.is_clean_word) == is_clean


def test_words_without_stopwords(value):
    assert value("Låna! (Pengar till bilar)", tx.words_without_stopwords) == ["låna", "pengar", "bilar"]
    assert value("The Word.com of IMG_1 dogs", tx.words_without_stopwords) == ["dogs"]
    assert value("one big red, green dog", lambda c: tx.words_without_stopwords(c, 2)) == ["big", "red"]


def test_ngrams(value):
    grams = value("the quick brown fox", lambda c: tx.ngrams(tx.full_text_words(c), 3))
    assert grams == ["the", "the quick", "the quick brown", "quick", "quick brown", "quick brown fox", "brown", "brown fox", "fox"]
    assert value("", lambda c: tx.ngrams(tx.full_text_words(c), 3)) == []
    assert value("a", lambda c: tx.ngrams(tx.full_text_words(c), 3)) == ["a"]
    assert len(value("a b c d e f g h i", lambda c: tx.ngrams(tx.full_text_words(c), 3))) == 24


def packed(text, most):
    """Snippets by the letter: words go into a piece until one does not fit; the last is put where it is."""
    *words, last = text.replace("\t", " ").replace(",", " ").replace("|", " ").replace("!", " ").split(" ")
    out, now = [], ""
    for w in filter(None, words):
        if len((now + w).encode()) > most:
            out.append(now.strip())
            now = ""
        now += w + " "
    return [*out, (now + last).strip()]


@pytest.mark.parametrize("text", ["A small text in one piece", "", " ", "word " * 200, "ab, cd! " * 90 + "end", "é" * 400 + " x y", "x " * 3 + "y" * 500])
def test_snippets(value, text):
    assert value(text, tx.snippets) == packed(text, 300)


def test_snippets_of_all_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", tx.snippets(F.col("text")).alias("s")).collect()
    assert all(r.s == packed(r.text, 300) for r in rows)


@pytest.mark.parametrize("text", ["", "short", "a" * 139, "a" * 140, "a" * 141, "é" * 70, "a" + "é" * 80, "aa" + "東" * 60, "a" + "🙂" * 50, "aaa" + "🙂" * 50])
def test_make_snippet(value, text):
    raw = text.encode()
    want = text if len(raw) < 140 else raw[:140].decode("utf-8", "ignore") + "..."
    assert value(text, tx.make_snippet) == want


def test_snippet_or_meta(spark):
    rows = spark.createDataFrame([("", "meta"), (None, "meta"), ("text", "meta"), ("", None)], "t string, m string").select(tx.snippet_or_meta(F.col("t"), F.col("m")).alias("s")).collect()
    assert [r.s for r in rows] == ["meta", "meta", "text", None]


def test_utf8(spark):
    df = spark.createDataFrame([(b"a\x01\xc3\xa5\xff\xe6\x98",), ("åäö €".encode(),)], "b binary")
    rows = df.select(tx.is_valid_utf8(F.col("b")).alias("v"), tx.encode_utf8(F.col("b")).alias("e")).collect()
    assert [(r.v, r.e) for r in rows] == [(False, "a?å?"), (True, "åäö €")]


def test_chunks(value):
    words = lambda n: lambda c: tx.chunks(tx.full_text_words(c), n)
    assert value("a b c d e", words(2)) == [["a", "b"], ["c", "d"], ["e"]]
    assert value("a b", words(2)) == [["a", "b"]] and value("", words(2)) == [] and value(None, words(2)) is None


def test_counts_and_frequency(spark):
    df = spark.createDataFrame([(1, "hello this is it and this is good ok"), (2, "")], "id int, s string")
    words = tx.full_text_words(F.col("s"))
    assert {r.word: r.n for r in tx.word_counts(df, words, "id").collect()}["is"] == 2
    freq = {r.word: r.frequency for r in tx.word_frequency(df, words, "id").collect()}
    assert freq["hello"] == pytest.approx(1 / 9) and freq["is"] == pytest.approx(2 / 9)


def test_trim_takes_no_sign_before_a_line_separator(spark):
    """Only the end of the text is its end: a sign before a last U+0085 or U+2028 stays. Words need no regex."""
    df = spark.createDataFrame([("(a.\u0085",), ("b- ",), ("\x0b\"c~\n",), ("d+#_",)], "t string").select(tx.trim(F.col("t")).alias("t"), tx.full_text_words(F.col("t")).alias("w"))
    assert [r.t for r in df.collect()] == ["a.\u0085", "b- ", "c", "d+#"]
    plan = df.select("w")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "(?" not in plan
