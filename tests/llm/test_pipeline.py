import math

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as c
from quarry.llm import _text, bpe, langid, mixing, simhash
from tests.llm.test_mixing import plain_posteriors, plain_rates
from tests.llm.test_simhash import brute as near_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_share(model, text):
    """Share of a text's words that lie in spans of the model's languages, by Viterbi over the words of this text alone; None without a word."""
    cps, offsets = _text.code_points([text or ""])
    start, end, _, script = langid.word_runs(cps, offsets)
    if not len(start):
        return None
    return float((best_path(langid.word_scores(model, cps, start, end, script), langid.PENALTY) < model.languages).mean())


def best_path(scores, penalty):
    """The best labels by the plain recurrence; staying wins ties."""
    value, came = scores[0], []
    for row in scores[1:]:
        jump = value.max() - penalty
        came.append(np.where(value >= jump, np.arange(len(value)), value.argmax()))
        value = np.maximum(value, jump) + row
    path = [int(value.argmax())]
    for c in reversed(came):
        path.append(int(c[path[-1]]))
    return np.array(path[::-1])


def test_run_as_brute_force(spark, sf_dir):
    """Each stage by itself in plain Python, on what the stage before keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    model = langid.train(docs)
    rows = [r for r in rows if (known_share(model, r[1]) or 0) >= 0.25]
    first = {}
    for r in sorted(rows):
        first.setdefault(r[1], r)
    rows = sorted(first.values())
    stay = set(near_brute([r[:2] for r in rows]))
    rows = [r for r in rows if r[0] in stay]
    df = spark.createDataFrame(rows, docs.select(*COLUMNS).schema)
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(bpe.VOCABULARY), special_tokens={}).encode_ordinary
    ids = [encode(r[1]) for r in rows]
    classifier = mixing.train(df, labels)
    rate = plain_rates(plain_posteriors(classifier, [r[1] for r in rows]), np.array(list(map(len, ids))), classifier.domains)
    hashes = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64('mix', doc_id, xxhash64(text)) as h").collect()}
    copies = [math.floor(x + (hashes[r[0]] & ((1 << 52) - 1)) / (1 << 52)) for r, x in zip(rows, rate.tolist(), strict=True)]
    want = sorted((r[0], r[2], r[3], r[4], tuple(i)) for r, i, n in zip(rows, ids, copies, strict=True) for _ in range(n))
    out = c.run(spark, sf_dir)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids"]
    assert sorted((r.doc_id, r.lang, r.source, r.n_chars, tuple(r.token_ids)) for r in out.collect()) == want


@pytest.mark.parametrize("k", range(5))
def test_stage_on_edges(spark, sf_dir, docs_of, edge_texts, clashing, k):
    """Nulls in any column, empty and very long texts, repeats, extra columns."""
    rows = [*enumerate(edge_texts), (None, "no id at all"), (None, None)]
    assert max(len(t or "") for _, t in rows) >= 700_000
    df = docs_of(rows, 3).selectExpr("doc_id", "text", "nullif(lang, case when doc_id % 2 = 0 then 'en' end) as lang", "nullif(source, case when doc_id = 1 then 'src0' end) as source", "n_chars")
    name, stage = c.STAGES[k]
    out = stage(spark, clashing(df), sf_dir)
    if k < 4:
        assert out.columns == clashing(df).columns
    rows_out = out.count()
    assert rows_out <= 2 * len(rows)
    plain = stage(spark, df, sf_dir)
    assert plain.columns == (COLUMNS if k < 4 else ["doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids"])
    got = plain.collect()
    assert len(got) == rows_out
    ids = {r.doc_id for r in got}
    without = {0, 1, 2, 3, 4, 5}  # null, empty, blank, wordless
    assert {9, 11, 12} & ids == ids & {9, 11, 12} and 11 in ids  # the long prose stays in every stage
    if k == 0:
        assert not ids & without
    elif k == 1:
        assert ids == {0, 1, 2, 4, 5, 6, 8, 9, 11, 12, None} and sum(r.doc_id is None for r in got) == 2
    elif k == 2:
        assert ids == set(range(13)) - {7, 10} | {None}
    elif k == 4:
        assert len(got) == len(rows) and {r.doc_id: r.n_tokens for r in got if r.doc_id is not None and r.doc_id < 4} == {0: -1, 1: -1, 2: 0, 3: 0}
    assert stage(spark, df.where("false"), sf_dir).count() == 0


def test_stages_are_registered():
    from quarry.llm import registry

    assert [n for n, _ in c.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]
    assert "pipeline" in registry.queries() and c.ORACLE_SQL is None and simhash.RADIUS < simhash.BITS / 2
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries() if n != "pipeline") == list(range(1, 11))
