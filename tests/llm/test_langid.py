import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import langid as g


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return g.train(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 2 = 0"))


def best(scores, penalty):
    """The greatest value of any path, by trying all."""
    n, k = scores.shape
    return max(sum(scores[i, s] for i, s in enumerate(p)) - penalty * sum(a != b for a, b in itertools.pairwise(p)) for p in itertools.product(range(k), repeat=n))


def value(scores, path, penalty):
    return sum(scores[i, s] for i, s in enumerate(path)) - penalty * sum(a != b for a, b in itertools.pairwise(path))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.floats(-6, 0), min_size=3, max_size=3), min_size=1, max_size=7), st.floats(0.1, 8))
def test_paths_are_optimal(rows, penalty):
    scores = np.array(rows)
    for path in (g.viterbi(scores, penalty), g.decode(scores, np.array([0, len(rows)]), penalty)):
        assert value(scores, path.tolist(), penalty) == pytest.approx(best(scores, penalty), abs=1e-9)


def test_decode_keeps_documents_apart(model):
    r = np.random.default_rng(1)
    sizes = [0, 5, 1, 0, 40, 3, 0]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    scores = r.uniform(-6, 0, (edges[-1], 4))
    got = g.decode(scores, edges, 4.0)
    for a, b in itertools.pairwise(edges):
        if b > a:
            assert value(scores[a:b], got[a:b].tolist(), 4.0) == pytest.approx(value(scores[a:b], g.viterbi(scores[a:b], 4.0).tolist(), 4.0))


def test_held_out_accuracy(spark, sf_dir, model):
    """Documents whose rows the model did not see get the label of most of their words."""
    held = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 2 = 1 AND n_chars > 40")
    spans = g.spans(held.withColumnRenamed("lang", "label"), model, carry=("doc_id", "label")).toPandas()
    most = spans.groupby(["doc_id", "label", "lang"]).words.sum().reset_index().sort_values("words").groupby("doc_id").last()
    assert (most.label == most.lang).mean() > 0.95


def test_mixed_text(spark, sf_dir, model, docs_of):
    texts = {r.lang: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 2 = 1 AND n_chars BETWEEN 400 AND 4000").collect()}
    en, fr = texts["en"], texts["fr"]
    mixed = f"{en} {fr} Это русский текст без модели. {en}"
    spans = sorted(g.spans(docs_of([mixed]), model).collect(), key=lambda r: r.span)
    assert [r.lang for r in spans] == ["en", "fr", "und-Cyrl", "en"]
    assert abs(spans[1].start - len(en)) < 60
    assert mixed[spans[2].start : spans[2].end] == "Это русский текст без модели"
    assert all(a.end <= b.start for a, b in itertools.pairwise(spans))


def test_scripts(model):
    def states(text):
        return [model.states[s] for *_, state in g.label(model, [text]) for s in state.tolist()]

    assert states("東京") == ["und-Hani"] and states("ひらがな") == ["und-Kana"] and states("Ελλάδα") == ["und-Grek"]
    assert states("한국어 नमस्ते") == ["und-Hang", "und-Deva"]


TELUGU, ENGLISH = "ఇది తెలుగు భాషలో రాసిన వాక్యం మరియు దీనికి పదాలు ఉన్నాయి", "the quick brown fox jumps over the lazy dog and runs away"


def test_every_letter_has_a_script(model):
    kind, table = g._text.class_tables()[0], g.script_table()
    assert (table[kind == 1] > 0).all() and len(set(g.NAMES)) == len(g.NAMES) < 256
    for text, name in (("తెలుగు", "Telu"), ("ಕನ್ನಡ", "Knda"), ("മലയാളം", "Mlym"), ("ગુજરાતી", "Gujr"), ("ਪੰਜਾਬੀ", "Guru"), ("ଓଡ଼ିଆ", "Orya"), ("සිංහල", "Sinh"), ("ខ្មែរ", "Khmr"), ("ລາວ", "Laoo"), ("မြန်မာ", "Mymr"), ("བོད", "Tibt"), ("ᠮᠣᠩᠭᠣᠯ", "Mong"), ("𝔘𝔫𝔦", "Zzzz")):
        [(_, _, start, end, words, state)] = g.label(model, [text])
        assert ([model.states[s] for s in state], start.tolist(), end.tolist(), words.tolist()) == ([f"und-{name}"], [0], [len(text)], [1])
    # what has no script of its own joins the letters beside it, but not those of another document
    cps, offsets = g._text.code_points(["Hawaiʻi ʻokina", "ʻ", "a𝔘", "𝔘"])
    start, end, doc, script = g.word_runs(cps, offsets)
    assert (end - start).tolist() == [7, 6, 1, 2, 1] and doc.tolist() == [0, 0, 1, 2, 3]
    assert [g.NAMES[n - 1] for n in script] == ["Latn", "Latn", "Zzzz", "Latn", "Zzzz"]


def test_languages_of_other_scripts_are_learned_and_kept(spark):
    rows = [(i, f"{TELUGU} {i}", "te") for i in range(20)] + [(20 + i, f"{ENGLISH} {i}", "en") for i in range(20)] + [(40, TELUGU + " dog", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = g.train(docs)
    assert model.states[:2] == ("en", "te")
    assert {(r.doc_id, r.lang) for r in g.spans(docs.where("lang = 'te'"), model).collect()} == {(i, "te") for i in range(20)}
    assert g.keep_identified(docs, model).count() == 41
    # without its language, a text almost wholly in Telugu is not English
    english = g.train(docs.where("lang = 'en'"))
    assert not g.keep_identified(docs.where("doc_id = 40"), english).count()


def test_language_of_two_scripts(spark):
    rows = [(i, "ово је српски језик" if i % 4 else "ovo je srpski jezik", "sr") for i in range(20)]
    model = g.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for text in ("ово је српски језик", "ovo je srpski jezik"):
        assert [model.states[s] for *_, state in g.label(model, [text]) for s in state] == ["sr"]


def test_edges(docs_of, model, edge_texts, clashing):
    df = clashing(docs_of(edge_texts, 3))
    got = {}
    for r in g.spans(df, model).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert set(got) == set(range(len(edge_texts)))
    for i in (0, 1, 2, 3, 4, 5):
        assert got[i] == [(0, 0, len(edge_texts[i] or ""), 0, "und")]
    assert got[9] == got[10] and got[6] == got[7]
    assert sum(w for *_, w, _ in got[11]) == 120_000
    kept = {r.doc_id for r in g.keep_identified(df, model).collect()}
    assert not kept & {0, 1, 2, 3, 4, 5}
    assert g.keep_identified(df, model).columns == df.columns
    assert g.spans(docs_of([(None, "the the")]), model).first().doc_id is None
    assert g.spans(docs_of(["", None], 1), model).count() == 2  # a batch without any character


def test_empty_tables_and_no_labels(docs_of, spark):
    empty = docs_of(["a"]).where("false")
    bare = g.train(empty)
    assert bare.languages == 0 and g.spans(empty, bare).count() == 0
    [row] = g.spans(docs_of(["hello world"]), bare).collect()
    assert row.lang == "und-Latn" and not g.keep_identified(docs_of(["hello world"]), bare).count()
    from pyspark.sql import functions as F

    unlabelled = docs_of(["hello", None]).withColumn("lang", F.lit(None).cast("string"))
    assert g.train(unlabelled).languages == 0


def test_documents_of_known_languages_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = g.train(docs)
    gone = docs.join(g.keep_identified(docs, model).select("doc_id"), "doc_id", "left_anti").collect()
    assert all(len((r.text or "").split()) < 5 or sum(c.isalpha() for c in r.text) < 0.5 * len(r.text) for r in gone)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = g.query(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id for r in rows} == set(texts)
    model = g.train(docs)
    for i in list(texts)[:40]:  # the brute-force path of each document
        cps, offsets = g._text.code_points([texts[i]])
        start, end, _, script = g.word_runs(cps, offsets)
        if len(start):
            scores = g.word_scores(model, cps, start, end, script)
            path = g.viterbi(scores, g.PENALTY)
            labels = [model.states[s] for s, _ in itertools.groupby(path.tolist())]
            assert [r.lang for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.span)] == labels
