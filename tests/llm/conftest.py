import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of a list of texts, or of (doc_id, text) pairs."""

    def make(texts, parts=2):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def sentence():
    """Random prose of n words, the same for the same seed."""

    def make(seed, n, words=400):
        r = random.Random(seed)
        vocabulary = ["".join(random.Random(i).choices("abcdefghijklmnoprstuvw", k=3 + i % 6)) for i in range(words)]
        return " ".join(r.choice(vocabulary) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def edge_texts(sentence):
    """Null, empty, blank, wordless and very long texts, repeats, and signs outside the first plane."""
    return [None, None, "", "", " \n\t ", "!!! ...", "a", "a", "Ünïcödé ñ 東京 𝔘𝔫𝔦 🙂 it's I'LL 123,456", sentence(1, 60), sentence(1, 60), sentence(2, 120_000), "x" * 700_000]


@pytest.fixture(scope="session")
def clashing():
    """Adds columns named as those that operators add or use inside."""

    def add(df):
        from pyspark.sql import functions as F

        names = ("__text", "__rows", "__digest", "__winner", "__heavy", "__n", "__key", "__copies", "__copy", "__html", "__paths", "id", "key", "fp", "group", "place", "count", "node", "root", "digest", "h", "n", "rate", "host", "paths", "votes", "words", "span", "start", "end", "pos", "part", "row")
        return df.withColumns({c: F.lit(f"own {c}") for c in names if c not in df.columns})

    return add
