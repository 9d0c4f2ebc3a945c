import unicodedata

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import winnowing as w


def mix64(x):
    m = (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def brute(text, k, width):
    """Fingerprints by the definition: each window by itself, the rightmost least hash."""
    low = lambda c: c.lower() if len(c.lower()) == 1 and unicodedata.category(c) in ("Lu", "Lt") else c
    kept = [(i, low(c)) for i, c in enumerate(text or "") if unicodedata.category(c)[0] in "LN"]
    hashes = []
    for i in range(len(kept) - k + 1):
        h = 0
        for _, c in kept[i : i + k]:
            h = (h * w.B + ord(c)) % (1 << 64)
        hashes.append(mix64(h) >> 1)
    if 0 < len(kept) < k:
        whole = sum(ord(c) * pow(w.B, k - 1 - j, 1 << 64) for j, (_, c) in enumerate(kept))
        return [(kept[0][0], mix64(whole % (1 << 64)) >> 1)]
    chosen = set()
    for a in range(max(1, len(hashes) - width + 1) if hashes else 0):
        part = hashes[a : a + width]
        chosen.add(a + len(part) - 1 - part[::-1].index(min(part)))
    return [(kept[i][0], hashes[i]) for i in sorted(chosen)]


def found(texts, k, width):
    out = [[] for _ in texts]
    for d, p, h in zip(*(x.tolist() for x in w.fingerprints(texts, k, width)), strict=True):
        out[d].append((p, h))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB 1é,", max_size=60), min_size=1, max_size=4), st.integers(1, 6), st.integers(1, 9))
def test_as_by_definition(texts, k, width):
    assert found(texts, k, width) == [brute(t, k, width) for t in texts]


def test_rightmost_of_ties():
    # all hashes are equal: each window takes its last
    assert [p for p, _ in found(["aaaaaaaaaa"], 3, 4)[0]] == [3, 4, 5, 6, 7]


def test_guarantee(sentence):
    shared = sentence(99, 40).replace(" ", "")[: w.K + w.W - 1]
    a, b = sentence(3, 200) + shared + sentence(4, 200), sentence(5, 300) + shared
    fa, fb = found([a, b], w.K, w.W)
    assert {h for _, h in fa} & {h for _, h in fb}
    # positions lie in the text, and lead to the same k letters
    at = {h: p for p, h in fa}
    for p, h in fb:
        if h in at:
            one, two = ("".join(c for c in t[q:].lower() if c.isalnum())[: w.K] for t, q in ((a, at[h]), (b, p)))
            assert one == two


def test_edges(docs_of, edge_texts, clashing):
    rows = w.winnow(clashing(docs_of(edge_texts)), k=5, w=8).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.pos, r.fp))
    for i, t in enumerate(edge_texts):
        assert sorted(got.get(i, [])) == (brute(t, 5, 8) if t != "x" * 700_000 else [(p, got[12][0][1]) for p in range(7, 700_000 - 4)])
    assert all(i not in got for i in (0, 2, 4, 5))  # null, empty, blank, without letters
    assert got[6] == got[7] and len(got[6]) == 1  # shorter than k
    assert got[9] == got[10]  # a repeated row
    assert len(got[12]) == 700_000 - 5 - 8 + 2  # ties throughout a very long text


def test_default_parameters_on_a_long_text(docs_of, sentence):
    """The production K and W, on a text of some 700,000 characters and on short ones."""
    texts = [sentence(2, 120_000), sentence(3, 400), sentence(4, 3), "Ab1 " * 900]
    got = {}
    for r in w.winnow(docs_of(texts)).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.fp))
    assert len(texts[0]) > 600_000 and len(got[0]) > 10_000
    assert [sorted(got[i]) for i in range(len(texts))] == [brute(t, w.K, w.W) for t in texts]


def test_copies_of_short_texts_share():
    a, b, c = found(["Don't.", "dont", "dont x"], w.K, w.W)
    assert [h for _, h in a] == [h for _, h in b] != [h for _, h in c]


def test_null_ids_and_empty_table(docs_of, sentence, spark):
    assert w.winnow(docs_of([(None, sentence(1, 80))])).first().doc_id is None
    assert w.winnow(docs_of([(1, "x")]).where("false")).count() == 0
    with pytest.raises(ValueError):
        w.winnow(docs_of(["a"]), k=0)


def test_sql(docs_of, edge_texts, sentence):
    texts = [t for t in edge_texts if len(t or "") < 1000] + ["word " * 60, "Ab1 " * 100, "short", sentence(2, 9000)]
    documents = docs_of(texts).toPandas()  # noqa: F841
    want = sorted(duckdb.sql(w.SQL).fetchall())
    assert sorted(tuple(r) for r in w.winnow(docs_of(texts)).collect()) == want and want
