from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import exact_dedup as e


def brute(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if r[1] is None or r[1] not in seen:
            seen.add(r[1])
            out.append(r)
    return sorted(out, key=str)


def test_as_brute_force_and_sql(spark, docs_of, edge_texts):
    texts = edge_texts + ["hot"] * 500 + [f"t{i % 90}" for i in range(300)]
    documents = docs_of(texts, 4).toPandas()
    df = docs_of(texts, 4)
    got = sorted((tuple(r) for r in e.exact_dedup(df).collect()), key=str)
    assert got == brute([tuple(r) for r in df.collect()])
    assert len(got) == len(documents.text.dropna().unique()) + documents.text.isna().sum()
    assert sorted(r[0] for r in got) == sorted(r[0] for r in duckdb.sql(e.SQL).fetchall())


@pytest.mark.parametrize("counters", [1, 2, 7])
def test_few_counters(docs_of, counters):
    df = docs_of([f"t{i % 11}" for i in range(200)] + ["hot"] * 400, 3)
    assert sorted(r.doc_id for r in e.exact_dedup(df, counters=counters).collect()) == [*range(11), 200]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=300), st.integers(1, 8))
def test_misra_gries_bound(items, counters):
    """A summary underestimates by at most n / (counters + 1)."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(items), 37):
        both = Counter(dict(zip(keys.tolist(), counts.tolist(), strict=True))) + Counter(items[a : a + 37])
        keys, counts = e.shrink(np.array(list(both)), np.array(list(both.values())), counters)
    kept = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    assert len(kept) <= counters
    for k, n in Counter(items).items():
        assert n - len(items) / (counters + 1) <= kept.get(k, 0) <= n


def test_frequent_digest_is_found_and_verified(docs_of):
    df = docs_of(["hot"] * 300 + [f"once {i}" for i in range(400)], 4).selectExpr("unhex(sha2(text, 256)) as digest", "doc_id")
    [hot] = e.heavy_winners(df, "digest", "doc_id", 8).collect()
    assert (hot.copies, hot.winner) == (300, 0)


def test_repeated_rows_nulls_and_clashes(spark, docs_of, clashing):
    df = docs_of([(None, "a"), (None, "a"), (None, "b"), (5, "b"), (5, "b"), (None, None), (None, None)])
    got = sorted(((r.doc_id, r.text) for r in e.exact_dedup(df).collect()), key=str)
    assert got == sorted([(None, "a"), (5, "b"), (None, None), (None, None)], key=str)
    wide = e.exact_dedup(clashing(df))
    assert wide.columns == clashing(df).columns
    assert {tuple(r)[5:] for r in wide.collect()} == {tuple(clashing(df).first())[5:]}


def test_empty_table_and_bad_parameter(docs_of):
    assert e.exact_dedup(docs_of(["a"]).where("false")).count() == 0
    with pytest.raises(ValueError):
        e.exact_dedup(docs_of(["a"]), counters=0)
