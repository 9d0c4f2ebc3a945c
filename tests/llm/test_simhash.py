import random
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import simhash as s
from quarry.llm._text import mix64, segment_hash


def near_pairs(fps, radius=s.RADIUS):
    x = np.frombuffer(b"".join(fps), np.uint64).reshape(-1, s.BITS // 64)
    d = np.bitwise_count(x[:, None, :] ^ x[None, :, :]).sum(axis=2)
    return [(i, j) for i, j in zip(*np.nonzero(d <= radius), strict=True) if i < j]


def components(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute(rows):
    """doc_ids that stay, by comparing all pairs; rows are (doc_id, text)."""
    fps = s.simhash([t or "" for _, t in rows])
    known = [i for i, f in enumerate(fps) if f]
    group = components(len(known), near_pairs([fps[i] for i in known]) if known else [])
    best = defaultdict(list)
    for i, g in zip(known, group, strict=True):
        best[g].append(rows[i])
    first = lambda r: (r[0] is None, r[0] or 0, r[1])
    return sorted([min(v, key=first)[0] for v in best.values()] + [r[0] for i, r in enumerate(rows) if not fps[i]], key=str)


def edit(text, r, share):
    words = text.split()
    for i in r.sample(range(len(words)), max(1, int(share * len(words)))):
        words[i] = "".join(r.choices("abcdefgh", k=6))
    return " ".join(words)


def test_fingerprint_by_definition():
    """Bit by bit over distinct pairs of neighbouring words, ties to the least feature."""
    text = "One two two two THREE one two"
    words = text.lower().split()
    cps = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    h = [int(segment_hash(c, np.array([0]), np.array([len(c)]))[0]) for c in cps]
    m = (1 << 64) - 1
    feats = sorted({int(mix64(np.uint64((a * 0x9E3779B97F4A7C15 + b) & m))) for a, b in zip(h, h[1:], strict=False)})
    bits = [[int(mix64(np.uint64((f + (k + 1) * 0xD1342543DE82EF95) & m))) >> b & 1 for k in range(4) for b in range(64)] for f in feats]
    want = [int(2 * sum(col) > len(feats) or (2 * sum(col) == len(feats) and col[0])) for col in zip(*bits, strict=True)]
    [got] = s.simhash([text])
    assert np.unpackbits(np.frombuffer(got, np.uint8), bitorder="little").tolist() == want


def test_recall_and_exactness(spark, docs_of, sentence):
    """Pairs around the radius: at least 0.9 of those within it share a group, none of those apart do."""
    r = random.Random(5)
    rows, n = [], 0
    for k in range(150):
        base = sentence(k, 90)
        for share in (0, 0.02, 0.05, 0.08, 0.12, 0.3):
            rows.append((n, edit(base, r, share) if share else base))
            n += 1
    signed = s.signatures(docs_of(rows, 4))
    from quarry.llm import _shared

    signed, _ = _shared.write_table(signed, "test-signatures")
    group = {g.id: bytes(g.group) for g in s.near_groups(signed).collect()}
    fps = s.simhash([t for _, t in rows])
    pairs = near_pairs(fps)
    assert len(pairs) > 300
    assert sum(group[i] == group[j] for i, j in pairs) >= 0.9 * len(pairs)
    label = components(len(rows), pairs)
    members = defaultdict(set)
    for i, g in group.items():
        members[g].add(label[i])
    assert all(len(v) == 1 for v in members.values())


@pytest.mark.parametrize("n", [100, 300, 1000, 10**4, 10**5, 240_000, 10**6, 10**7, 10**8, 10**9, 10**10])
def test_exact_recall_at_every_size(n):
    p = s.plan(n)
    assert p.found(s.RADIUS) >= 0.95 and p.found(s.RADIUS // 2) >= 0.99
    assert all(p.found(d) <= p.found(d - 8) + 1e-9 for d in range(16, 57, 8))
    size, small, rows, _ = p.sizes(n)
    assert size < s.LIST and (small <= 400 or n <= s.LEAF) and rows < 400


def test_law_of_a_search():
    """``found`` against searches played with random pairs, permutations and centres."""
    r = np.random.default_rng(4)
    p = s.Plan(2, (40, 38), (30, 40))
    for distance in (24, 56):
        hits = 0
        for _ in range(1500):
            for _ in range(p.repeats):
                differ = np.zeros(256, bool)
                differ[r.permutation(256)[:distance]] = True
                met, begin = True, 0
                for strip, limit, centres in zip(s.STRIPS, p.limits, p.centres, strict=True):
                    x = r.integers(0, 2, (centres, strip)) != 0  # differences from the centres
                    y = x ^ differ[begin : begin + strip]
                    met &= bool(((x.sum(axis=1) <= limit) & (y.sum(axis=1) <= limit)).any())
                    begin += strip
                if met:
                    hits += 1
                    break
        assert hits / 1500 == pytest.approx(p.found(distance), abs=0.04)


@pytest.mark.parametrize("distance", [50, 53, 56])
def test_recall_of_edges(spark, distance):
    """Single pairs, so no chain helps: of those at the distance, at least 0.93 get an edge among 20,000 fingerprints."""
    r = np.random.default_rng(distance)
    x = r.integers(0, 256, (20_000, 32), dtype=np.uint8)
    y = np.unpackbits(x[:700], axis=1)
    for row in y:
        row[r.permutation(256)[:distance]] ^= 1
    fps = [v.tobytes() for v in np.concatenate([x, np.packbits(y, axis=1)])]
    assert s.plan(len(fps)).repeats > 1
    edges = s.near_edges(spark.createDataFrame([(f,) for f in fps], "fp binary").repartition(4), len(fps)).collect()
    got = {frozenset((bytes(e.a), bytes(e.b))) for e in edges}
    pairs = {frozenset((fps[i], fps[20_000 + i])) for i in range(700)}
    assert got <= pairs and len(got) >= 0.93 * len(pairs)


@pytest.mark.parametrize("spread", [4, 30, 70])
def test_pivots_lose_no_pair(spread):
    """Large groups of copies of any spread in one small list: components as by all pairs."""
    r = np.random.default_rng(spread)
    centre = r.integers(0, 2, (2, 256), dtype=np.uint8)
    bits = np.concatenate([c ^ (r.random((900, 256)) < spread / 512) for c in centre] + [r.integers(0, 2, (900, 256))]).astype(np.uint8)
    x = np.packbits(bits[r.permutation(len(bits))], axis=1).view(np.uint64)
    label, plain = np.arange(len(x)), np.arange(len(x))
    s.compare(x, np.arange(len(x)), label, s.RADIUS, most=600)
    s.join_near(x, np.arange(len(x)), x, None, plain, s.RADIUS)
    assert label.tolist() == plain.tolist() == components(len(x), near_pairs([v.tobytes() for v in x]))


@pytest.mark.parametrize(("spread", "apart"), [(6, 128), (25, 128), (40, 90), (50, 60)])
@pytest.mark.parametrize("block", [100, 1 << 20])
def test_hot_groups_in_blocks(spark, monkeypatch, spread, apart, block):
    """Two groups that hold most of the fingerprints, tight or wide, far apart or next to each other, and others at all distances of them: the components of all pairs."""
    r = np.random.default_rng(spread)
    first = r.integers(0, 2, 256, dtype=np.uint8)
    second = first.copy()
    second[r.permutation(256)[:apart]] ^= 1

    def around(c, n, least, most):
        out = np.repeat(c[None], n, axis=0)
        for row in out:
            row[r.permutation(256)[: r.integers(least, most + 1)]] ^= 1
        return out

    bits = np.concatenate([around(first, 500, 0, spread), around(second, 400, 0, spread), around(first, 60, 40, 115), around(second, 60, 40, 115), r.integers(0, 2, (300, 256), dtype=np.uint8)])
    fps = sorted({v.tobytes() for v in np.packbits(bits, axis=1, bitorder="little")})
    df = spark.createDataFrame([(f,) for f in fps], "fp binary").repartition(4)
    hot = s.find_hot(df, len(fps), s.RADIUS, block)
    assert len(hot.pivots) and (hot.blocks.max() > 1) == (block == 100)
    # every pair of a list shares a cell unless its group or the triangle inequality settles it
    monkeypatch.setattr(s, "plan", lambda *a: s.Plan(1, s.STRIPS, (1, 1)))
    edges = [(fps.index(bytes(e.a)), fps.index(bytes(e.b))) for e in s.near_edges(df, len(fps), hot_block=block).collect()]
    assert components(len(fps), edges) == components(len(fps), near_pairs(fps))


def test_a_cell_is_bounded():
    """A third of the rows in one group: no cell of a list holds more of it than a block."""
    r = np.random.default_rng(1)
    pivot = r.integers(0, 1 << 63, (1, 4)).astype(np.uint64)
    label, lot = np.where(np.arange(9000) % 3 == 0, 0, -1), r.integers(0, 1 << 40, 9000)
    d = np.where(label == 0, 10, r.integers(60, 170, 9000))[:, None]
    hot = s.Hot(pivot, np.array([3000]), np.array([20]), np.array([-(-3000 // 100)]))
    size = defaultdict(lambda: [0, 0])
    for rows, cells, right in s.cells_of(label, d, lot, hot, s.RADIUS):
        for c in np.broadcast_to(cells, len(rows)).tolist():
            size[c][right] += 1
    assert size.pop(0) == [6000, 0]
    near = int(((label < 0) & (d[:, 0] <= 20 + s.RADIUS)).sum())  # no other row can be near to one of the group
    assert len(size) == 30 and all(left <= 150 and right == near for left, right in size.values()) and near < 1000


def test_within_is_exact():
    r = np.random.default_rng(8)
    fp, packed = r.integers(0, 1 << 63, (50, 4)).astype(np.uint64), s.centres(3, 0, 5000)
    at = s.permutation(3)[:96]
    bits = np.unpackbits(fp.view(np.uint8).reshape(50, 32), axis=1, bitorder="little")[:, at]
    far = (bits[:, None] != np.unpackbits(packed, axis=1, bitorder="little")[None]).sum(axis=2)
    row, centre = s.within(s.on_strip(fp, at), packed, 40)
    assert list(zip(row.tolist(), centre.tolist(), strict=True)) == list(zip(*(v.tolist() for v in np.nonzero(far <= 40)), strict=True))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_all_documents_as_brute_force(spark, sf):
    """The smaller table is one list; the larger one takes both levels of lists."""
    folder = f"/root/testdata/sf{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert s.plan(len({t for _, t in rows})).repeats == (1 if sf == "0.001" else s.REPEATS)
    got = sorted((r.doc_id for r in s.query(spark, folder).collect()), key=str)
    want = brute(rows)
    assert set(want) <= set(got) and len(set(got) - set(want)) <= 0.01 * len(rows)


def test_edges(docs_of, clashing, edge_texts, sentence):
    extra = [(None, sentence(7, 50)), (None, sentence(7, 50)), (100, sentence(8, 50)), (100, sentence(8, 50)), (101, sentence(8, 50)), (100, sentence(9, 50))]
    rows = [*enumerate(edge_texts), *extra]
    df = clashing(docs_of(rows, 3))
    out = s.near_dedup(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id for r in out.collect()), key=str)
    assert got == brute(rows)
    assert {r["__key"] for r in out.collect()} == {"own __key"}


def test_many_copies_and_empty_tables(docs_of, sentence):
    r = random.Random(2)
    base = sentence(1, 80)
    rows = [(i, edit(base, r, 0.02)) for i in range(600)]
    assert [x.doc_id for x in s.near_dedup(docs_of(rows)).collect()] == [0]
    assert s.near_dedup(docs_of(["a"]).where("false")).count() == 0
    assert s.near_dedup(docs_of([None, "", "!"])).count() == 3
