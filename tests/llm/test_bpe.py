import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import _text, bpe


@pytest.fixture(scope="module")
def reference():
    """The library's own encoder, on whole texts."""
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(bpe.VOCABULARY), special_tokens={})
    return lambda text: t.encode_ordinary(text)


def words_of(text):
    cps, offsets = _text.code_points([text])
    start = _text.pretokens(cps, offsets).tolist()
    return [text[a:b] for a, b in zip(start, [*start[1:], len(text)], strict=bool(start))]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z1 \n\t'sdtmrevl,.é東🙂  ǅ²")), max_size=30))
def test_pretokens_as_the_pattern(text):
    import regex

    assert words_of(text) == regex.findall(P.PATTERN, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_pretokens_of_any_text(text):
    import regex

    assert words_of(text) == regex.findall(P.PATTERN, text)


def check(df, reference, **options):
    rows = bpe.encode(df, **options).collect()
    want = sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    got = sorted(((r.doc_id, None if r.token_ids is None else list(r.token_ids), r.n_tokens) for r in rows), key=str)
    expected = sorted(((i, None if t is None else reference(t), -1 if t is None else len(reference(t))) for i, t in want), key=str)
    assert got == expected
    return rows


@pytest.mark.parametrize("chunk", [300, bpe.CHUNK])
def test_ids_as_the_library(docs_of, edge_texts, reference, chunk):
    texts = [*edge_texts, "x" * 3000, "<|endoftext|> is text"]
    assert max(len(t or "") for t in texts) >= 700_000
    check(docs_of(texts, 3), reference, chunk=chunk)


@pytest.mark.parametrize("bucket_size", [100, 1 << 40])
def test_any_number_of_buckets(docs_of, sentence, reference, bucket_size):
    check(docs_of([*(sentence(i, 300) for i in range(20)), None, ""], 3), reference, chunk=4000, bucket_size=bucket_size)


def test_a_word_is_encoded_once(reference):
    calls = []
    words = bpe.Words(bpe.VOCABULARY, bpe.ranks(bpe.VOCABULARY))
    plain = words.one
    words.one = lambda w: calls.append(w) or plain(w)
    for group in ([b"one", b" two", b"zzzzqqqq"], [b" two", b"three"], [], [b"zzzzqqqq", b"one"]):
        ids, size = words.ids(group)
        assert ids.tolist() == [i for w in group for i in reference(w.decode())] and size.tolist() == [len(reference(w.decode())) for w in group]
    assert sorted(calls) == sorted({b"one", b" two", b"zzzzqqqq", b"three"})


def test_all_documents(spark, sf_dir, reference):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), reference)


def test_round_trip(docs_of, edge_texts):
    df = docs_of(edge_texts, 3)
    back = bpe.decode(bpe.encode(df, chunk=5000))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_decode_of_part_of_a_character(spark):
    [first] = bpe.decode(spark.createDataFrame([([bpe.ranks(bpe.VOCABULARY)[b"\xf0"]],)], "token_ids array<int>")).collect()
    assert first.text == "�"


def test_clashes_nulls_and_repeats(docs_of, clashing, reference):
    df = clashing(docs_of([(None, "a b"), (None, "a b"), (2, None), (2, "")])).withColumn("n_tokens", F.lit("own"))
    out = bpe.encode(df)
    assert out.columns == [c for c in df.columns if c not in ("text", "n_tokens")] + ["n_tokens", "token_ids"]
    assert sorted(((r.doc_id, r.token_ids, r["__rows"]) for r in out.collect()), key=str) == sorted([(None, reference("a b"), "own __rows")] * 2 + [(2, None, "own __rows"), (2, [], "own __rows")], key=str)
    assert bpe.decode(out).columns == [c for c in out.columns if c != "token_ids"] + ["text"]


def test_empty_table(docs_of):
    empty = docs_of(["a"]).where("false")
    assert bpe.encode(empty).count() == 0
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.query(spark, sf_dir).collect()
    assert {r.doc_id: r.text for r in rows} == texts and all(len(r.token_ids or []) == max(r.n_tokens, 0) for r in rows)
