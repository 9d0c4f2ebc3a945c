import gzip
import io
import json
import os
import zlib

import pytest

from quarry.llm import warc_members as w


def rec(body: bytes, uri="http://a.example/", kind="response", extra=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{uri}>\r\nWARC-Target-URI: {uri}\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def normalised(data: bytes, piece=None):
    pieces = [data[i : i + piece] for i in range(0, len(data), piece)] if piece else [data]
    out, index = io.BytesIO(), []
    for member, entry in w.members(iter(pieces)):
        out.write(member)
        if entry:
            index.append(entry)
    return out.getvalue(), index


BODIES = [b"", b"x", b"WARC/1.0\r\n\r\nnot a record\r\n\r\n", os.urandom(3 << 20), "é".encode() * 1000, b"x"]


@pytest.mark.parametrize("piece", [None, 7919, 65536])
def test_every_record_is_a_member(piece):
    records = [rec(b, f"http://a.example/{i}") for i, b in enumerate(BODIES)]
    whole = gzip.compress(b"".join(records))
    data, index = normalised(whole, piece)
    assert [e["status"] for e in index] == ["ok"] * len(records)
    raw = 0
    for e, r in zip(index, records, strict=True):
        member = data[e["offset"] : e["offset"] + e["length"]]
        assert gzip.decompress(member) == r  # one member, one record
        assert (e["raw_offset"], e["raw_length"], e["uri"]) == (raw, len(r) - 4, f"http://a.example/{e['record']}")
        raw += len(r)
    assert sum(e["length"] for e in index) == len(data) and gzip.decompress(data) == b"".join(records)
    assert normalised(data)[0] == data  # normalises to itself


def test_mixed_members_and_single_bytes():
    records = [rec(b"abc"), rec(b"defg"), rec(b"h")]
    data = gzip.compress(records[0] + records[1][:40]) + gzip.compress(records[1][40:]) + gzip.compress(b"") + gzip.compress(records[2])
    out, index = normalised(data, 1)
    assert gzip.decompress(out) == b"".join(records) and len(index) == 3


@pytest.mark.parametrize(("cut", "status"), [(-1, "truncated"), (-9, "truncated")])
def test_cut_stream(cut, status):
    records = [rec(b"abc"), rec(os.urandom(5000))]
    out, index = normalised(gzip.compress(b"".join(records))[: cut - 200])
    assert [e["status"] for e in index] == ["ok", status] and gzip.decompress(out) == records[0]
    assert "offset" not in index[-1]


@pytest.mark.parametrize("piece", [None, 1, 7919])
def test_records_after_a_bad_one_are_kept(piece):
    a, b, c = (rec(t, f"http://a.example/{t[:1].decode()}") for t in (b"abc", b"b" * 300, b"c" * 70))
    wrong = {
        "malformed": (b"WARC/1.0\r\nA: b\r\n\r\nbody\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\n", b"WARC/1.0\r\nno blank line\r\n", b"WARC/1.0\r\nContent-Length: 2\r\n\r\nmore than two\r\n\r\n", b"WARC/1.0\r\nContent-Length: 90\r\n\r\nshort\r\n\r\n"),
        "truncated": (b"WARC/1.0\r\nContent-Length: 99999\r\n\r\nshort\r\n\r\n",),
    }
    for status, bads in wrong.items():
        for bad in bads:
            out, index = normalised(gzip.compress(a + bad + b + c), piece)
            assert [e["status"] for e in index] == ["ok", status, "ok", "ok"] and gzip.decompress(out) == a + b + c
            assert [e["record"] for e in index] == [0, 1, 2, 3] and [e["raw_offset"] for e in index] == [0, len(a), len(a + bad), len(a + bad + b)]
            assert all(gzip.decompress(out[e["offset"] : e["offset"] + e["length"]]) in (b, c) for e in index[2:])


@pytest.mark.parametrize("piece", [None, 1, 7919])
def test_members_after_a_corrupt_one_are_kept(piece):
    a, b, c = rec(b"abc"), rec(os.urandom(30_000)), rec(b"c" * 70)
    good = gzip.compress(b)
    flipped, header = bytearray(good), bytearray(good)
    flipped[2000] ^= 255  # found by its check sum
    header[2] = 9
    for bad in (*([] if piece == 1 else [bytes(flipped)]), bytes(header), good[:5000], b"no gzip at all"):
        out, index = normalised(gzip.compress(a) + bad + gzip.compress(c) + gzip.compress(a), piece)
        assert gzip.decompress(out) == a + c + a and [e["status"] for e in index] == ["ok", "truncated", "ok", "ok"]


def test_cut_record_bad_header_and_corruption():
    good = rec(b"abc")
    for bad, status in ((b"WARC/1.0\r\nContent-Length: 100\r\n\r\nshort", "truncated"), (b"HTTP/1.1 200 OK\r\n\r\n", "malformed"), (b"WARC/1.0\r\nContent-Length: many\r\n\r\n", "malformed"), (b"WARC/1.0\r\nA: b\r\n\r\n", "malformed")):
        out, index = normalised(gzip.compress(good + bad))
        assert [e["status"] for e in index] == ["ok", status] and gzip.decompress(out) == good
    broken = bytearray(gzip.compress(good + rec(os.urandom(4000))))
    broken[2000] ^= 255
    assert normalised(bytes(broken))[1][-1]["status"] == "truncated"
    assert normalised(b"") == (b"", []) and normalised(gzip.compress(b"")) == (b"", [])
    assert normalised(b"no gzip at all")[1][-1]["status"] == "truncated"


def test_files_over_spark(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for k in range(3):
        (source / f"f{k}.warc.gz").write_bytes(gzip.compress(b"".join(rec(f"{k}-{i}".encode()) for i in range(4))))
    (source / "empty.warc.gz").write_bytes(b"")
    (source / "other.txt").write_text("x")
    rows = w.normalise(spark, f"file://{source}", f"file://{target}").collect()
    assert len(rows) == 12
    for r in rows:
        text = w.read_member(f"file://{target}/{r.file}", r.offset, r.length)
        assert text == rec(f"{r.file[1]}-{r.record}".encode())
    lines = [json.loads(x) for x in (target / "f1.warc.gz.idx").read_text().splitlines()]
    assert [x["offset"] for x in lines] == sorted(r.offset for r in rows if r.file == "f1.warc.gz")
    assert not [p for p in os.listdir(target) if "attempt" in p] and not (target / "empty.warc.gz").exists()


@pytest.mark.parametrize("piece", [None, 1, 7919])
def test_lines_that_end_with_lf(piece):
    one = b"WARC/1.0\nWARC-Type: response\nWARC-Target-URI: http://a.example/\nContent-Length: 9\n\nline\n\nend"
    mixed = b"WARC/1.1\r\nWARC-Target-URI: http://b.example/\r\nContent-Length: 3\n\r\nabc"
    out, index = normalised(gzip.compress(one + b"\n\n" + mixed + b"\n\n" + rec(b"x") + one), piece)
    assert [(e["status"], e["uri"]) for e in index] == [("ok", f"http://{h}.example/") for h in "abaa"]
    got = [gzip.decompress(out[e["offset"] : e["offset"] + e["length"]]) for e in index]
    assert got == [one + b"\r\n\r\n", mixed + b"\r\n\r\n", rec(b"x"), one + b"\r\n\r\n"]


@pytest.mark.parametrize("piece", [7919, 1 << 20])
def test_header_of_two_mebibytes(piece):
    records = [rec(b"a"), rec(b"long", extra="X-Long: " + "v" * (2 << 20) + "\r\n"), rec(b"b"), b"WARC/1.0\r\n" + b"no end " * 300_000 + b"\r\n", rec(b"c")]
    out, index = normalised(gzip.compress(b"".join(records)), piece)
    assert [e["status"] for e in index] == ["ok", "ok", "ok", "malformed", "ok"]
    assert gzip.decompress(out) == b"".join(records[:3] + records[4:])


def test_query(spark, sf_dir, monkeypatch):
    """Each record of the query is read by its offset and holds its page."""
    from quarry.llm import _shared

    made = []
    new_path = _shared.new_path
    monkeypatch.setattr(_shared, "new_path", lambda *a: made.append(new_path(*a)) or made[-1])
    pages = [w.record(r.url, r.html, str(r.page_id)) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows = w.query(spark, sf_dir).collect()
    assert {r.status for r in rows} == {"ok"} and {r.type for r in rows} == {"response"}
    assert sorted(w.read_member(f"{made[0]}/members/{r.file}", r.offset, r.length) for r in rows) == sorted(pages)
    raw = {}
    for r in sorted(rows, key=lambda r: (r.file, r.record)):  # places in the whole stream, without gap
        assert r.raw_offset == raw.get(r.file, 0)
        raw[r.file] = r.raw_offset + r.raw_length + 4


def test_pages_with_nulls_repeats_and_no_rows(spark, tmp_path):
    rows = [(1, "http://a.example/", "<p>é"), (1, "http://a.example/", "<p>é"), (None, None, None), (2, "", "x" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' as path", "'own' as content")
    w.write_monolithic(pages.coalesce(1), f"file://{tmp_path}/whole")
    [name] = [p for p in os.listdir(tmp_path / "whole") if p.endswith(".gz") and not p.startswith(".")]
    data = (tmp_path / "whole" / name).read_bytes()
    engine = zlib.decompressobj(31)
    engine.decompress(data)
    assert engine.eof and not engine.unused_data  # one stream
    got = w.normalise(spark, f"file://{tmp_path}/whole", f"file://{tmp_path}/members").collect()
    assert len(got) == 4 and max(r.raw_length for r in got) > 2_000_000
    w.write_monolithic(pages.where("false"), f"file://{tmp_path}/none")
    assert w.normalise(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/none-members").count() == 0
