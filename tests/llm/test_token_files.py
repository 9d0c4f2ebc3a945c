import public_tokenizers as P
import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken

from quarry.llm import bpe
from quarry.llm import token_files as tf

REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(bpe.VOCABULARY), special_tokens={})


def ids(text, end=None):
    return REFERENCE.encode_ordinary(text or "") + ([] if end is None else [end])


def written(df, tmp_path, **options):
    path = f"file://{tmp_path}/tokens"
    return tf.write_tokens(df, path, **options).collect(), tf.Corpus(path), path


def test_files_hold_all_documents(docs_of, edge_texts, tmp_path, clashing):
    texts = edge_texts
    assert max(len(t or "") for t in texts) >= 700_000
    df = clashing(docs_of(texts, 4))
    index, corpus, path = written(df, tmp_path)
    assert len(index) == len(corpus) == len(texts)
    by_place = sorted(index, key=lambda r: (r.part, r.row))
    whole = np.concatenate([corpus[i] for i in range(len(corpus))])
    for i, r in enumerate(by_place):
        assert corpus[i].tolist() == ids(texts[r.doc_id]) and r.n_tokens == len(corpus[i])
        assert corpus.read(r.global_start, r.n_tokens).tolist() == corpus[i].tolist()
        assert tf.open_part(path, r.part)[0][r.start : r.start + r.n_tokens].tolist() == corpus[i].tolist()
    # prefix sums: places are exact, without gap or overlap
    assert [r.global_start for r in by_place] == np.concatenate([[0], np.cumsum([r.n_tokens for r in by_place])])[:-1].tolist()
    assert corpus.read(0, len(whole) + 5).tolist() == whole.tolist()  # over the edges of parts, up to the end
    part, offsets = tf.open_part(path, by_place[0].part)
    assert isinstance(part, np.memmap) and part.dtype == np.dtype("<u2") and offsets.dtype == np.dtype("<u8")


def test_end_and_large_ids(docs_of, tmp_path):
    index, corpus, path = written(docs_of(["a b", None, ""], 1), tmp_path, end=70_000)
    assert tf.open_part(path, 0)[0].dtype == np.dtype("<u4")
    assert sorted(corpus[i].tolist() for i in range(3)) == sorted([ids("a b", 70_000), [70_000], [70_000]])
    assert sum(r.n_tokens for r in index) == int(corpus.bases[-1])


def test_repeats_nulls_and_empty_table(docs_of, tmp_path):
    index, corpus, _ = written(docs_of([(None, "a"), (None, "a"), (1, "b")]), tmp_path / "a")
    assert len(index) == 3 and sum(r.doc_id is None for r in index) == 2
    index, corpus, _ = written(docs_of(["a"]).where("false"), tmp_path / "b")
    assert index == [] and len(corpus) == 0 and len(corpus.read(0, 10)) == 0


def test_attempts_do_not_meet(spark, tmp_path):
    """A task's second attempt sees its rows in another order, and the files of the first, broken off or whole, do no harm."""
    path = f"file://{tmp_path}"
    rows = [(i, f"text {i} " * (i + 1)) for i in range(40)]
    table = bpe.ranks(bpe.VOCABULARY)

    def attempt(part, number, order):
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in order]), pa.array([t for _, t in order])], names=["doc_id", "text"])
        return pa.Table.from_batches(list(tf.write_part(iter([batch]), path, part, number, bpe.VOCABULARY, table, "<u2", None))).to_pandas()

    lost = attempt(0, 1, rows[:20])
    kept = [attempt(0, 7, rows[:20][::-1]), attempt(1, 2, rows[20:])]
    attempt(1, 9, rows[20:][::-1])  # a speculative one that ends last
    assert lost.doc_id.tolist() != kept[0].doc_id.tolist()
    df = spark.createDataFrame(pd.concat(kept))
    df.write.parquet(f"{path}/index")
    (tmp_path / "meta.json").write_text('{"ids": "<u2"}')
    index = tf.finish(spark, path, df.schema).collect()
    corpus = tf.Corpus(path)
    for r in index:
        assert corpus.read(r.global_start, r.n_tokens).tolist() == ids(rows[r.doc_id][1])
    assert len(index) == len(corpus) == 40
    assert sorted(f.name for f in tmp_path.glob("part-*.bin")) == ["part-00000-7.bin", "part-00001-2.bin"]


def test_query(spark, sf_dir, monkeypatch):
    """The ids of all documents in the files that the query writes, by the library's encoder."""
    from quarry.llm import _shared

    made = []
    new_path = _shared.new_path
    monkeypatch.setattr(_shared, "new_path", lambda *a: made.append(new_path(*a)) or made[-1])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = tf.query(spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(ids(t)) for i, t in texts.items()}
    places = sorted((r.global_start, r.n_tokens) for r in rows)
    assert [a for a, _ in places] == np.concatenate([[0], np.cumsum([n for _, n in places])])[:-1].tolist()
    corpus = tf.Corpus(made[0])
    assert all(corpus.read(r.global_start, r.n_tokens).tolist() == ids(texts[r.doc_id]) for r in rows)
    assert sorted(tuple(corpus[i].tolist()) for i in range(len(corpus))) == sorted(tuple(ids(t)) for t in texts.values())
