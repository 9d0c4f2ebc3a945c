import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import hashing as h

GOLDEN = {"testing": 4540905123118180926, "": 6142509188972423790, "123": 10089081994332581363, "1234": 15651099383784684535}


def one(data: bytes, seed: int = h.SEED) -> int:
    """A string at a time, in Python integers."""
    mask, mul = (1 << 64) - 1, int(h._M)
    mix = lambda k: ((k * mul & mask) ^ ((k * mul & mask) >> 47)) * mul & mask
    acc = seed ^ (len(data) * mul & mask)
    whole = len(data) // 8 * 8
    for i in range(0, whole, 8):
        acc = (acc ^ mix(int.from_bytes(data[i : i + 8], "little"))) * mul & mask
    if data[whole:]:
        acc = (acc ^ int.from_bytes(data[whole:], "little")) * mul & mask
    acc = (acc ^ (acc >> 47)) * mul & mask
    return acc ^ (acc >> 47)


def test_golden_values():
    assert dict(zip(GOLDEN, h.murmur64a(pa.array(list(GOLDEN))).tolist(), strict=True)) == GOLDEN


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=50), min_size=1, max_size=20))
def test_as_one_by_one(items):
    assert h.murmur64a(pa.array(items, pa.binary())).tolist() == [one(x) for x in items]


def test_slices():
    whole = pa.array(["skip", "testing", "", None and "x", "123"])
    assert h.murmur64a(whole.slice(1, 2)).tolist() == [GOLDEN["testing"], GOLDEN[""]]


def test_columns(spark):
    df = spark.createDataFrame([(w,) for w in [*GOLDEN, None]], "w string")
    rows = df.select("w", h.unsigned(h.token_hash(F.col("w"))).alias("u"), h.unsigned_mod(h.token_hash(F.col("w")), 4001).alias("m"), h.token_hashes(F.array("w")).alias("a")).collect()
    assert {r.w: int(r.u) for r in rows if r.w is not None} == GOLDEN
    assert {r.w: r.m for r in rows if r.w is not None} == {w: v % 4001 for w, v in GOLDEN.items()}
    assert all(r.a[0] % (1 << 64) == GOLDEN[r.w] for r in rows if r.w is not None)
    assert [(r.u, r.m, r.a) for r in rows if r.w is None] == [(None, None, [None])]


def test_keys_of_pages_and_links(spark):
    df = spark.createDataFrame([("https://www.a.com/x?q=1", "http://b.org/y")], "s string, t string")
    s, t = F.col("s"), F.col("t")
    r = df.select(h.url_hash(s).alias("u"), h.host_hash(s).alias("h"), h.link_hash(s, t).alias("l"), h.domain_link_hash(s, t).alias("d")).first()
    assert [v % (1 << 64) for v in r] == [one(x) for x in (b"a.com/x?q=1", b"a.com", b"a.comhttp://b.org/y", b"a.comb.org")]


@pytest.mark.parametrize("n", [1, 8, 4001, 1 << 30])
def test_unsigned(spark, n):
    values = [0, 1, -1, 1 << 62, -(1 << 63), (1 << 63) - 1, -2]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    rows = df.select("v", h.unsigned(F.col("v")).alias("u"), h.unsigned_mod(F.col("v"), n).alias("m")).collect()
    assert all(int(r.u) == r.v % (1 << 64) and r.m == r.v % (1 << 64) % n for r in rows)
    ordered = [r.v for r in df.orderBy(h.unsigned_order(F.col("v"))).collect()]
    assert ordered == sorted(values, key=lambda v: v % (1 << 64))
    assert np.uint64(5) == 5


def test_uuid(spark):
    from quarry.functions import scoring

    ids = [r.u for r in spark.range(1000).select(scoring.new_uuid().alias("u")).collect()]
    assert len(set(ids)) == 1000 and all(len(u) == 36 and u[14] == "4" for u in ids)
