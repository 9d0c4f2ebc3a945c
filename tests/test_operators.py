import math
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry import tables
from quarry.operators import arrays, bitmaps, graph, joins, ranking, sketches
from quarry.operators import key_value as kv
from quarry.operators import postings as po

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def postings(spark):
    def make(items, fields="token string, value int, score double"):
        return spark.createDataFrame(items, fields)

    return make


# --- postings
def test_counted_fold(postings):
    p = postings([("a", 1000, 1.0), ("a", 1001, 1.0), ("a", 1000, 1.0), ("b", 1002, 1.0)])
    assert rows(po.fold_counts(p)) == [("a", 1000, 2), ("a", 1001, 1), ("b", 1002, 1)]
    assert rows(po.fold(p)) == [("a", 1000, 1.0), ("a", 1001, 1.0), ("b", 1002, 1.0)]
    assert p.agg(F.count_distinct("value")).first()[0] == 3


def test_merge_with(postings):
    a = postings([("x", 1000, 1.0), ("x", 1001, 1.0), ("y", 1000, 1.0)])
    b = postings([("x", 1002, 1.0), ("x", 1001, 2.0), ("y", 1010, 1.0), ("z", 1011, 1.0)])
    both = po.merge_with(a, b)
    assert {r.token: r.n for r in po.key_counts(both).collect()} == {"x": 3, "y": 2, "z": 1}
    assert ("x", 1001, 2.0) in rows(both)


def test_intersections(postings):
    p = postings([("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", 2, 2.0), ("b", 3, 2.0), ("c", 2, 3.0), ("c", 4, 3.0), ("c", 3, 3.0)])
    assert rows(po.find_all_of(p, ["a", "b", "c"])) == [(2, 6.0), (3, 6.0)]
    assert rows(po.find_all_of(p, ["a", "c"], "avg")) == [(2, 2.0), (3, 2.0)]
    assert rows(po.find_all_of(p, ["a", "b", "c"], "rarest")) == [(2, 2.0), (3, 2.0)]
    assert rows(po.find_all_of(p, ["a", "a", "b"])) == [(2, 3.0), (3, 3.0)]  # a repeated key counts once
    assert rows(po.find_all_of(p, ["a", "nowhere"])) == rows(po.find_all_of(p, [])) == []
    with pytest.raises(ValueError):
        po.find_all_of(p, ["a"], "median")


@FEW
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 8), st.integers(1, 5)), min_size=1, max_size=40), st.sets(st.sampled_from("abcd"), min_size=1))
def test_and_as_brute_force(spark, items, keys):
    p = spark.createDataFrame([(t, v, float(s)) for t, v, s in items], "token string, value int, score double")
    best = defaultdict(dict)
    for t, v, s in items:
        best[v][t] = max(best[v].get(t, 0), s)
    want = sorted((v, float(sum(m[k] for k in keys))) for v, m in best.items() if keys <= set(m))
    assert rows(po.find_all_of(po.fold(p), sorted(keys))) == want


def test_group_by(postings):
    p = postings([(t, v, 1.0, g) for t, v, g in [("a", 1, 200), ("a", 2, 200), ("a", 3, 200), ("b", 1, 200), ("b", 2, 200), ("b", 3, 200), ("c", 1, 200), ("c", 2, 200), ("c", 3, 200), ("a", 9, 300), ("c", 9, 300)]], "token string, value int, score double, target int")
    assert rows(po.find_group_by(p, ["a", "b"], "target")) == [(200, 3.0, 3)]
    assert rows(po.find_group_by(p, ["a", "c"], "target", lambda s: s * 2)) == [(200, 6.0, 3), (300, 2.0, 1)]


def test_find_top(postings):
    p = postings([(t, v, 1.0) for t in "ab" for v in (1000, 1001, 1002)])
    mod = lambda v: (v - 1000).cast("double")
    assert [tuple(r) for r in po.find_top(p, ["a", "b"], 2, mod, "mul", combine="rarest").collect()] == [(1002, 2.0), (1001, 1.0)]
    assert [tuple(r) for r in po.find_top(p, ["a", "b"], 1, mod).collect()] == [(1002, 4.0)]
    assert po.find_top(p, [], 10).count() == 3 and po.find_top(p, [], 10, mod, "mul").count() == 0
    assert po.find_total(p, ["a", "b"]).first().total == 3


def test_cap_and_lists(postings):
    p = postings([("a", i, float(i % 3)) for i in range(10)] + [("b", 1, 1.0)])
    assert [r.value for r in po.cap(p, 4).where("token = 'a'").orderBy(F.desc("score"), "value").collect()] == [2, 5, 8, 1]
    lists = {r.token: [x.value for x in r.records] for r in po.lists(p, "value", most=3).collect()}
    assert lists == {"a": [0, 1, 2], "b": [1]}
    assert rows(po.find_any_sum(p, ["a", "b"], 2)) == [(0, 0.0), (1, 2.0)]
    assert rows(po.transform(p, lambda d: d.withColumn("score", F.col("size") * 1.0)).where("token = 'b'")) == [("b", 1, 1.0)]


def test_iteration_over_many_keys(spark):
    p = spark.range(1, 10_001).select(F.explode(F.array(*(F.concat(F.lit(f"{m}:"), F.col("id") % m) for m in (10, 100, 7, 13)))).alias("token"), F.col("id").alias("value"), F.lit(1.0).alias("score"))
    stats = po.index_stats(p).first()
    assert (stats.n_keys, stats.n_records) == (130, 40_000) and stats.n_keys_over_100 == 30
    assert po.find(p, "7:3").where("value = 10").count() == 1 and po.heavy_keys(p, 1000).count() == 7
    order = [(r.token, r.value) for r in po.sorted_lists(p).where("token IN ('7:0', '7:1')").collect()]
    assert len(order) == 2857 and all(a < b or a[0] != b[0] for a, b in zip(order, order[1:], strict=False))


def test_empty_index(postings):
    p = postings([])
    assert po.index_stats(p).first().n_records == 0 and po.find_total(p, ["a"]).first().total == 0
    assert po.find_top(p, ["a"], 5).count() == po.cap(p, 5).count() == 0


def test_word_stats(postings, spark):
    p = postings([("a", 1, 1.0), ("a", 2, 1.0)])
    assert rows(po.word_stats(p, ["a", "b"], spark.range(4))) == [("a", 2, 0.5), ("b", 0, 0.0)]


# --- arrays and joins
def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6], [2, 3, 3], [3, 9])], "a array<int>, b array<int>, c array<int>")
    r = df.select(arrays.top_k(F.col("a"), 2).alias("k"), arrays.top_k(F.col("a"), 9).alias("all"), arrays.intersection(F.col("a"), F.col("b"), F.col("c")).alias("i"), arrays.merge_sorted(F.col("b"), F.col("c")).alias("m"), arrays.partial_sort(F.col("a"), 3).alias("p")).first()
    assert (r.k, r["all"], r.i, r.m, r.p) == ([5, 6], [1, 2, 3, 4, 5, 6], [3], [2, 3, 3, 3, 9], [1, 2, 3])


def test_incremental_partitions(spark):
    at = lambda dims, n: ["".join(map(str, r["at"])) for r in arrays.incremental_partitions(spark, dims, n).collect()]
    assert at([2, 3], 100) == ["00", "10", "01", "11", "02", "12"]
    assert at([2, 2], 3) == ["00", "10", "01"] and at([3], 2) == ["0", "1"]


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2,), (2,), (None,)], "j int")
    assert rows(joins.existing(a, b, {"k": "j"})) == [(2, "y"), (2, "y")]
    assert joins.absent(a, b, {"k": "j"}).count() == 2
    table = spark.createDataFrame([(2, 0.5)], "host int, h double")
    assert sorted(r.out for r in joins.lookup(a, table, "k", "host", "h", "out").collect()) == [0.0, 0.0, 0.5, 0.5]
    assert joins.keep_one(a, "k").count() == 3 and joins.union_distinct(a, a).count() == 3


def test_hash_range(spark):
    values = [0, 5, -1, -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "h long")
    for low, high in ((0, 10), ((1 << 63) - 1, 1 << 63), (1 << 63, (1 << 64) - 1), (0, (1 << 64) - 1)):
        assert sorted(r.h for r in joins.in_range(df, "h", low, high).collect()) == sorted(v for v in values if low <= v % (1 << 64) <= high)


# --- ranking
def test_deduplicate(spark):
    items = [("d1", v, float(10 - v)) for v in range(8)] + [("d2", 20, 0.5)]
    df = spark.createDataFrame(items, "domain string, value int, score double")
    assert [r.value for r in ranking.deduplicate(df, 4, 2).collect()] == [0, 1, 2, 20]
    assert [r.value for r in ranking.deduplicate(df, 100, 2).collect()] == [*range(8), 20]
    assert [r.value for r in ranking.deduplicate(df, 2, 5).collect()] == [0, 1]
    assert ranking.many_domains(df).first().many and not ranking.many_domains(df.where("domain = 'd1'")).first().many
    assert ranking.many_domains(df.where("false")).first().many is False


def test_link_scores(spark):
    links = spark.createDataFrame([("s1", "t1", 0.1), ("s1", "t1", 0.1), ("s2", "t1", 0.2), ("s1", "t2", 0.0)], "source_url string, target string, score double")
    results = spark.createDataFrame([("t1", 1.0), ("t3", 2.0)], "value string, score double")
    got = {r.value: (r.score, r.url_links) for r in ranking.add_link_scores(results, links).collect()}
    assert got["t3"] == (2.0, 0) and got["t1"][1] == 2
    assert got["t1"][0] == pytest.approx(1 + math.expm1(2.5) / 50 + math.expm1(5) / 50)


def test_bm25_and_tfidf(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 1, 2), ("a", 2, 1), ("c", 3, 5)], "token string, value int, count long")
    tf = {(r.token, r.value): r.score for r in ranking.tf_idf(df).collect()}
    assert tf["a", 1] == pytest.approx(0.5 * math.log(3 / 2)) and tf["c", 3] == pytest.approx(math.log(3))
    bm = {(r.token, r.value): r.score for r in ranking.bm25(df).collect()}
    idf, f, size = math.log((3 - 2 + 0.5) / 2.5 + 1), 0.5, 4 / (10 / 3)
    assert bm["a", 1] == pytest.approx(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size)))
    assert {r.score for r in ranking.bm25(df, min_size=5).where("value < 3").collect()} == {0.0}


# --- key-value
H = "key int, value string, version long, seq long"


def test_latest_version(spark):
    h = spark.createDataFrame([(123, f"v{v}", v, i) for i, v in enumerate((5, 6, 4, 3, 7))] + [(101, "a", 1000, 0), (101, "b", 1000, 1), (101, "c", 1001, 2), (101, "d", 999, 3), (7, "x", 5, 1), (7, "y", 5, 2), (8, "long" * 10, 9, 1), (8, "ok", 1, 0)], H)
    assert {r.key: r.value for r in kv.latest(h, 20).collect()} == {123: "v7", 101: "c", 7: "y", 8: "ok"}
    assert rows(kv.find(kv.latest(h), 123)) == [("v7", 7)] and kv.find(kv.latest(h), 1).count() == 0


def test_merge_with_ties_keep_own(spark):
    a = spark.createDataFrame([(1, "a1", 10, 0), (2, "a2", 10, 0), (3, "a3", 11, 0), (4, "own", 5, 0)], H)
    b = spark.createDataFrame([(1, "b1", 11, 0), (2, "b2", 12, 0), (3, "b3", 9, 0), (4, "other", 5, 9), (5, "b5", 1, 0)], H)
    assert {r.key: r.value for r in kv.merge_with(a, b).collect()} == {1: "b1", 2: "b2", 3: "a3", 4: "own", 5: "b5"}


def test_store(spark):
    store = kv.Store(spark, tables.new_path(spark, "kv"))
    assert store.table().count() == 0
    schema = "key string, value string, version long, seq long"
    store.add(spark.createDataFrame([("1", "a", 1, 1), ("2", "b", 1, 2)], schema), 0)
    store.add(spark.createDataFrame([("1", "a", 1, 1), ("2", "b", 1, 2)], schema), 0)  # the batch again
    store.merge()
    before = store.table()
    store.add(spark.createDataFrame([("1", "new", 2, 3), ("3", "c", 1, 4)], schema), 1)
    store.merge(spark.createDataFrame([("2",)], "key string"))
    assert {r.key: r.value for r in store.table().collect()} == {"1": "new", "3": "c"}
    assert {r.key: r.value for r in before.collect()} == {"1": "a", "2": "b"}  # a reader keeps its version
    store.merge()
    assert store.table().count() == 2
    assert rows(kv.has(store.table(), spark.createDataFrame([("1",), ("9",)], "key string"))) == [("1", True), ("9", False)]
    assert {r.key: r.value for r in kv.find_many(store.table(), spark.createDataFrame([("1",), ("9",)], "key string")).collect()} == {"1": "new", "9": ""}
    store.merge_from(spark.createDataFrame([("1", "tie", 2, 99), ("3", "newer", 5, 1), ("4", "d", 1, 1)], schema))
    assert {r.key: r.value for r in store.table().collect()} == {"1": "new", "3": "newer", "4": "d"}
    store.truncate()
    assert store.table().count() == 0


@FEW
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3)), min_size=1, max_size=30))
def test_latest_as_brute_force(spark, items):
    h = spark.createDataFrame([(k, f"{i}", v, i) for i, (k, v) in enumerate(items)], H)
    want = {}
    for i, (k, v) in enumerate(items):
        want[k] = max(want.get(k, (-1, -1)), (v, i))
    assert {r.key: (r.version, r.seq) for r in kv.latest(h).collect()} == want


# --- sketches
@pytest.mark.parametrize("n", [0, 1, 1000, 200_000])
def test_hll_within_bound(spark, n):
    df = spark.range(n).unionAll(spark.range(n))
    assert abs((sketches.distinct_count(df, "id").first().estimate or 0) - n) <= sketches.hll_bound() * n


def test_hll_union(spark):
    parts = spark.range(30_000).groupBy((F.col("id") % 3).alias("p")).agg(sketches.hll(F.col("id")).alias("s"))
    estimate = parts.agg(sketches.hll_count(sketches.hll_union(F.col("s"))).alias("n")).first().n
    assert abs(estimate - 30_000) <= sketches.hll_bound() * 30_000 and sketches.hll_bound() == pytest.approx(0.0172, abs=1e-4)


def test_bloom(spark):
    bits = 1 << 20
    inside, all_ = spark.range(0, 4000, 2), spark.range(4000)
    merged = sketches.bloom_merge(sketches.bloom(inside.where("id < 2000"), "id", bits), sketches.bloom(inside.where("id >= 2000"), "id", bits))
    found = {r.id for r in sketches.bloom_might_contain(all_, "id", merged, bits).collect()}
    assert {r.id for r in inside.collect()} <= found and len(found) < 2010
    assert 0.01 < sketches.bloom_saturation(merged, bits).first().saturation < 0.02
    assert sketches.bloom_might_contain(all_, "id", sketches.bloom(inside.where("false"), "id", bits), bits).count() == 0


# --- graph
EDGES = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (3, 5), (4, 2), (5, 4)]


def harmonic(n, edges, depth=10**9):
    """Breadth-first search backwards from every vertex."""
    back = defaultdict(set)
    for a, b in edges:
        back[b].add(a)
    out = {}
    for v in range(n):
        seen, level, d, total = {v}, {v}, 0, 0.0
        while level and d < depth:
            d += 1
            level = {w for u in level for w in back[u]} - seen
            seen |= level
            total += len(level) / d
        out[v] = total
    return out


def graph_of(spark, n, edges):
    return spark.createDataFrame([(str(v),) for v in range(n)], "host string"), spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")


def test_known_centralities(spark):
    got = {int(r.host): r.harmonic for r in graph.harmonic_exact(*graph_of(spark, 7, EDGES), depth=10).collect()}
    assert got == pytest.approx(harmonic(7, EDGES))
    assert (got[0], got[1], got[2], got[6]) == pytest.approx((8 / 3, 7 / 3, 7 / 2, 0))


def test_depth_and_hyper_ball(spark):
    r = random.Random(4)
    edges = sorted({(r.randrange(40), r.randrange(40)) for _ in range(90)})
    v, e = graph_of(spark, 40, edges)
    assert {int(x.host): x.harmonic for x in graph.harmonic_exact(v, e, depth=2).collect()} == pytest.approx(harmonic(40, edges, 2))
    ball = {int(x.host): x.harmonic for x in graph.hyper_ball(v, e, precision=12).collect()}
    assert ball == pytest.approx(harmonic(40, edges), rel=0.05, abs=0.2)
    assert graph.normalised(graph.hyper_ball(v, e)).agg(F.max("harmonic")).first()[0] <= 1


def test_graphs_without_edges(spark):
    v, e = graph_of(spark, 2, [(0, 1)])
    none = e.where("false")
    assert {x.harmonic for x in graph.harmonic_exact(v, none, 5).collect()} == {x.harmonic for x in graph.hyper_ball(v, none).collect()} == {0.0}
    assert graph.harmonic_exact(v.where("false"), none, 5).count() == 0


# --- merges of staged batches
def test_a_batch_staged_during_a_merge_waits(spark, monkeypatch):
    store = kv.Store(spark, tables.new_path(spark, "kv"))
    row = lambda k, s: spark.createDataFrame([(k, f"v{s}", 1, s)], "key string, value string, version long, seq long")
    store.add(row("a", 1), 0)
    write = store._write

    def meanwhile(df, versions, batches):
        write(df, versions, batches)
        store.add(row("b", 2), 1)  # another batch
        store.add(row("c", 3), 0)  # a batch of the same number, after this one was read

    monkeypatch.setattr(store, "_write", meanwhile)
    store.merge()
    monkeypatch.undo()
    assert [r.key for r in store.table().collect()] == ["a"]
    store.merge()
    assert sorted(r.key for r in store.table().collect()) == ["a", "b", "c"]
    store.merge()
    assert store.table().count() == 3


def test_a_merge_that_was_broken_off(spark, monkeypatch):
    store = kv.Store(spark, tables.new_path(spark, "kv"))
    store.add(spark.createDataFrame([("a", "v", 1, 1), ("b", "v", 1, 2)], "key string, value string, version long, seq long"), 0)
    with monkeypatch.context() as m:
        m.setattr(kv.staging, "mark", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.merge()
    assert store.table().count() == 0
    with monkeypatch.context() as m:  # after the mark, before the batches are removed
        m.setattr(kv.staging, "remove", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.merge(spark.createDataFrame([("b",)], "key string"))
    store.merge()  # the removed key does not come back with its batch
    assert [r.key for r in store.table().collect()] == ["a"]


def test_dense_ids(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "'own' as v").repartition(5)
    assert [(r.k, r.id) for r in ranking.dense_ids(df, "k").orderBy("k").collect()] == [(i, i) for i in range(1000)]
    assert ranking.dense_ids(df.where("false"), "k").count() == 0


@pytest.mark.parametrize("longest", [1, 3, 100])
def test_token_sizes(spark, longest):
    df = spark.range(500).selectExpr("concat('t', int(sqrt(id))) as token", "id as value")
    got = {r.token: r.size for r in po.with_token_size(df, longest=longest).collect()}
    assert got == {r.token: r["count"] for r in df.groupBy("token").count().collect()}
    assert po.with_token_size(df, longest=longest).count() == 500


# --- bitmaps
def test_bitmaps_by_brute_force(spark):
    pick = random.Random(3)
    ids = [-70_000, -1, 0, 1, 32_768, 32_769, 1 << 40, *(pick.randrange(100_000) for _ in range(3000))]
    records = [(t, v) for v in ids for t in "abc" if pick.random() < {"a": 0.9, "b": 0.5, "c": 0.01}[t]] + [("a", 7), ("a", 7), ("b", 7), ("a", None)]
    df = spark.createDataFrame(records, "token string, value long")
    have = {t: {v for u, v in records if u == t and v is not None} for t in "abc"}
    index = bitmaps.build(df)
    assert rows(bitmaps.values(index)) == sorted((t, v) for t in have for v in have[t])
    assert rows(bitmaps.sizes(index)) == sorted((t, len(v)) for t, v in have.items())
    assert [v for (v,) in rows(bitmaps.values(bitmaps.all_of(index, ["a", "b", "a"])))] == sorted(have["a"] & have["b"])
    assert [v for (v,) in rows(bitmaps.values(bitmaps.any_of(index, ["b", "c"])))] == sorted(have["b"] | have["c"])
    assert rows(bitmaps.all_of(index, ["a", "none"])) == []
    dense, rest = bitmaps.split(df, 100)
    assert 0 < dense.count() < index.count()
    assert sorted(set(rows(bitmaps.values(dense).unionByName(rest)))) == sorted((t, v) for t in have for v in have[t])
    odd, even = (bitmaps.build(df.where(f"value % 2 {c} 0")) for c in ("<>", "="))
    assert rows(bitmaps.merge(odd, even)) == rows(index)
    assert rows(bitmaps.values(bitmaps.build(df.limit(0)))) == []


def test_deduplicate_cuts_domains_before_it_ranks_them(spark):
    """A domain of nearly all results: as a plain sort has it, and no window takes the whole domain."""
    rows = [(i, "hot" if i % 50 else f"d{i}", float((i * 7919) % 997)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "value int, domain string, score double")
    seen: dict[str, int] = {}
    marked = []
    for value, domain, score in sorted(rows, key=lambda r: (-r[2], r[0])):
        seen[domain] = seen.get(domain, 0) + 1
        marked.append((seen[domain] > 2, -score, value))
    want = sorted(sorted(marked)[:700], key=lambda r: r[1:])
    out = ranking.deduplicate(df, 700, 2)
    assert [r.value for r in out.collect()] == [v for _, _, v in want]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
