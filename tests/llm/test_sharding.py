import duckdb
import numpy as np
import pytest

from quarry.llm import sharding as s
from quarry.llm._text import mix64


def one(key, buckets):
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_as_one_by_one():
    keys = mix64(np.arange(500))
    for n in (1, 2, 7, 1000):
        assert s.jump(keys, n).tolist() == [one(int(k), n) for k in keys]


def test_growth_moves_the_necessary_fraction():
    keys = mix64(np.arange(200_000))
    before, after = s.jump(keys, 1000), s.jump(keys, 1200)
    moved = before != after
    assert abs(moved.mean() - 200 / 1200) < 0.005
    assert (after[moved] >= 1000).all()  # to new shards only
    assert np.bincount(after, minlength=1200).min() > 100


def test_plan_edges(spark, docs_of, clashing, edge_texts):
    df = clashing(docs_of([(None, "a"), (1, None), (1, None), (-5, ""), (1 << 62, "b")])).withColumn("shard", __import__("pyspark").sql.functions.lit("own"))
    out = s.plan_growth(df, "doc_id", 10, 12)
    rows = out.collect()
    assert [r.shard for r in rows if r.doc_id is None] == [None]
    assert len({(r.shard, r.shard_after) for r in rows if r.doc_id == 1}) == 1
    for r in rows:
        if r.doc_id is not None:
            assert r.shard == one(int(mix64(np.array([r.doc_id]).view(np.uint64))[0]), 10)
    assert set(out.columns) == {*df.columns, "shard", "shard_after", "moved"}
    texts = s.assign(docs_of(edge_texts), "text", 8).collect()
    assert all((r.text is None) == (r.shard is None) for r in texts)
    assert s.plan_growth(df.where("false"), "doc_id", 10, 12).count() == 0
    with pytest.raises(ValueError):
        s.assign(df, "doc_id", 0)


def test_sql(spark, docs_of):
    df = docs_of([(i, f"t{i}") for i in range(300)] + [(7, "again")])
    documents = df.toPandas()  # noqa: F841
    got = s.plan_growth(df.select("doc_id", "source", "n_chars"), "doc_id", s.SHARDS, s.SHARDS_AFTER)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(duckdb.sql(s.SQL).fetchall(), key=key)


def test_write(spark, docs_of, tmp_path):
    s.write_shards(docs_of([(i, "t") for i in range(50)] + [(None, "t")]), "doc_id", 4, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 51
    for r in back.collect():
        assert r["shard"] == (0 if r.doc_id is None else one(int(mix64(np.array([r.doc_id]))[0]), 4))


def test_query_writes_whole_documents(spark, sf_dir, monkeypatch, tmp_path):
    path = f"file://{tmp_path}/shards"
    monkeypatch.setattr("quarry.llm._shared.new_path", lambda *_: path)
    got = s.query(spark, sf_dir).collect()
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select(*documents.columns).collect())) == sorted(map(str, documents.collect()))
    want = duckdb.sql(s.SQL.replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'")).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {(r.doc_id, r["shard"]) for r in got} == {(r.doc_id, r["shard"]) for r in back.collect()}
