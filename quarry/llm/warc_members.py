"""Normaliser of monolithic WARC.gz files.

A WARC file that was compressed as one gzip stream can't be read from the
middle.  ``normalise`` inflates such a stream once, front to back, and writes
each record as a gzip member of its own, with a sidecar that lists where each
member lies, so that any record can later be read by a seek.  Streams of any
mixture of members are accepted, so the result normalises to itself.

A gzip stream can only be inflated in order, so one file is the work of one
task; files are spread over the tasks, and a task holds a piece of PIECE bytes, a
record's header and, compressed, the record at hand.  Output files are written under a name of the
attempt and then renamed; a repeated task replaces them by equal ones.

Each file gives NAME (the members), NAME.idx (a line of JSON for each record) and
rows of the index.  Lines may end with CR LF or LF alone, and a header may be of any
length.  Defined results: for a record that is cut off, or whose header
is not one or has a length at which no record ends, there is an index row without
offset of status ``truncated`` or ``malformed``, and reading goes on at the next
line after its beginning that starts with ``WARC/1.``; a gzip member that is corrupt
or cut off counts as truncated, and reading goes on at the next gzip magic; records
that came whole before its check sum failed stay.  Raw offsets count what could be
inflated.  A file of no bytes has no rows and gives no files (Spark lists none such).  Records of length 0 are members too, and
repeated records are kept; a very long record is one member.  ``write_monolithic`` writes a row whose html is null as
an empty payload and a null url as an empty one; other columns of pages may have any
name, and pages without rows give no records.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _shared
from quarry.llm._shared import filesystem

PIECE = 1 << 20
LEVEL = 6
SCHEMA = "file string, record long, offset long, length long, raw_offset long, raw_length long, type string, uri string, id string, status string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
MAGIC, MARK, BLANK = b"\x1f\x8b\x08", b"WARC/1.", re.compile(rb"\n\r?\n")


class Broken(Exception):
    """A stream that does not go on as WARC; args[0] is the status."""


def inflate(pieces: Iterator[bytes]) -> Iterator[bytes | None]:
    """The content of all gzip members of a stream, in pieces; None for a gap, where a member is corrupt or cut off. It goes on at the next gzip magic."""
    pieces, engine, data, lost, gap = filter(None, pieces), zlib.decompressobj(31), b"", False, False
    past = b""  # what the open member took of the stream, PIECE bytes at most: a corrupt one may have run into the next
    while True:
        if not data or (lost and MAGIC not in data):
            more = next(pieces, None)
            if more is not None:
                data = data[-2:] + more
                continue
            if lost or not past:
                return
            try:
                rest = engine.flush()
            except zlib.error:
                rest = b""
            if rest:
                yield rest
            if rest or not gap:
                yield None
            data, past, lost, gap = past[1:], b"", True, True
            continue
        if lost:
            data, engine, lost = data[data.find(MAGIC) :], zlib.decompressobj(31), False
        try:
            out = engine.decompress(data, PIECE)
        except zlib.error:
            if not gap:
                yield None
            data, past, lost, gap = (past + data)[1:], b"", True, True
            continue
        if out:
            yield out
            gap = False
        if engine.eof:
            data, past, engine = engine.unused_data.lstrip(b"\0"), b"", zlib.decompressobj(31)
        else:
            rest = engine.unconsumed_tail
            past, data = (past + data[: len(data) - len(rest)])[-PIECE:], rest


class Buffer:
    """Reads a stream of pieces by separators and by counts."""

    def __init__(self, pieces: Iterator[bytes]):
        self.sources, self.held, self.place = [pieces], bytearray(), 0
        self.broken: Broken | None = None  # set at a gap, until ``skip`` goes past it

    def more(self) -> bool:
        while self.sources and not self.broken:
            piece = next(self.sources[-1], b"")
            if piece is None:
                self.broken = Broken("truncated")
            elif piece:
                self.held += piece
                return True
            else:
                self.sources.pop()
        return False

    def back(self, pieces: Iterator[bytes], size: int) -> None:
        """Put pieces of together ``size`` bytes before what is still to be read."""
        self.sources += [iter([None])] if self.broken else []
        self.sources += [iter([bytes(self.held)])] if self.held else []
        self.sources.append(pieces)
        self.held, self.broken = bytearray(), None
        self.place -= size

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.place += n

    def ended(self) -> bool:
        """Whether a record can end here: before a blank line, another record, or nothing."""
        while len(self.held) < 5 and self.more():
            pass
        return self.held[:2] in (b"", b"\r", b"\r\n") or self.held[:1] == b"\n" or self.held.startswith(b"WARC/"[: len(self.held)])

    def skip(self) -> None:
        """Go to the next line, but not this one, that starts with WARC/1., or past a gap to one; else to the end."""
        begins = False
        while True:
            if begins and self.held.startswith(MARK):
                return
            at = self.held.find(b"\n" + MARK)
            if at >= 0:
                return self.drop(at + 1)
            if len(self.held) > len(MARK):
                self.drop(len(self.held) - len(MARK))
                begins = False
            if self.more():
                continue
            self.drop(len(self.held))
            if not self.broken:
                return
            self.broken, begins = None, True

    def header(self) -> bytes | None:
        """Up to and with the next blank line; None at the end."""
        while True:  # blank lines between records
            if self.held[:2] == b"\r\n":
                self.drop(2)
            elif self.held[:1] == b"\n":
                self.drop(1)
            elif self.held[:2] not in (b"", b"\r") or not self.more():
                break
        if not self.held:
            return None
        seen = 0
        while True:
            begin = max(0, seen - len(MARK))
            end = BLANK.search(self.held, begin)
            if end:
                at, end = end.end(), None  # a match keeps the buffer from being changed
                head = bytes(self.held[:at])
                self.drop(at)
                return head
            if not self.held.startswith(b"WARC/"[: len(self.held)]) or self.held.find(b"\n" + MARK, begin) >= 0:
                raise Broken("malformed")
            seen = len(self.held)
            if not self.more():
                raise self.broken or Broken("truncated")

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise self.broken or Broken("truncated")
            out = bytes(self.held[:n])
            del self.held[: len(out)]
            n -= len(out)
            self.place += len(out)
            yield out


def fields(header: bytes) -> dict[str, str]:
    if not header.startswith(b"WARC/"):
        raise Broken("malformed")
    lines = header.decode("utf-8", "replace").split("\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def members(pieces: Iterator[bytes], level: int = LEVEL) -> Iterator[tuple[bytes, dict | None]]:
    """Pieces of the normalised file; the last piece of a record comes with its index entry."""
    source, offset, number = Buffer(inflate(pieces)), 0, 0
    while True:
        head = None
        try:
            head = source.header()
            if head is None:
                if source.broken:
                    raise source.broken
                return
            begin = source.place - len(head)
            f = fields(head)
            if b"\n" + MARK in head or not f.get("content-length", "").isdecimal():  # a header without its blank line ran into the next
                raise Broken("malformed")
            size = int(f["content-length"])
        except Broken as e:
            if head:
                source.back(iter([head]), len(head))
            yield b"", {"record": number, "raw_offset": source.place, "status": e.args[0]}
            number += 1
            source.skip()
            continue
        # A member is given out only when its record is whole; a large one waits as compressed pieces.
        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
        out = [engine.compress(head)]
        try:
            for piece in source.take(size):
                out.append(engine.compress(piece))
            if not source.ended():
                raise Broken("malformed")
        except Broken as e:
            yield b"", {"record": number, "raw_offset": begin, "status": e.args[0]}
            number += 1
            # What its length took in may hold other records.
            out.append(engine.flush())
            source.back(inflate(iter(out)), source.place - begin)
            source.skip()
            continue
        out += [engine.compress(b"\r\n\r\n"), engine.flush()]
        member = b"".join(out)
        yield member, {"record": number, "offset": offset, "length": len(member), "raw_offset": begin, "raw_length": len(head) + size, "type": f.get("warc-type"), "uri": f.get("warc-target-uri"), "id": f.get("warc-record-id"), "status": "ok"}
        offset, number = offset + len(member), number + 1


def _read(uri: str) -> Iterator[bytes]:
    where, path = filesystem(uri)
    with where.open_input_stream(path, compression=None, buffer_size=PIECE) as f:
        while piece := f.read(PIECE):
            yield piece


def normalise_file(source: str, target: str, attempt: str) -> list[dict]:
    """Write the members and the sidecar of one file; the index entries."""
    name = source.rsplit("/", 1)[-1]
    where, path = filesystem(target)
    index: list[dict] = []
    hidden = [f"{path}/.{name}.{attempt}", f"{path}/.{name}.idx.{attempt}"]
    with where.open_output_stream(hidden[0], compression=None) as out, where.open_output_stream(hidden[1], compression=None) as side:
        for member, entry in members(_read(source)):
            out.write(member)
            if entry:
                index.append({"file": name, **entry})
                side.write(json.dumps(entry).encode() + b"\n")
    where.move(hidden[0], f"{path}/{name}")
    where.move(hidden[1], f"{path}/{name}.idx")
    return index


def normalise(spark, source: str, target: str, pattern: str = "*.warc.gz") -> DataFrame:
    """Normalise all files of the folder source that match; the index of all records is returned and kept in target/index."""
    where, path = filesystem(target)
    where.create_dir(path, recursive=True)
    # Only the files' names are read here. A task gets files of about maxPartitionBytes, one at least.
    names = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(source).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                uri = name if "://" in name else name.replace(":/", ":///", 1)
                rows = normalise_file(uri, target, str(TaskContext.get().taskAttemptId()))
                for a in range(0, len(rows), 10000):
                    part = rows[a : a + 10000]
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in part], pa.string() if n in ("file", "type", "uri", "id", "status") else pa.int64()) for n in NAMES], names=NAMES)

    names.mapInArrow(run, SCHEMA).write.parquet(f"{target}/index")
    return spark.read.schema(SCHEMA).parquet(f"{target}/index")


def read_member(uri: str, offset: int, length: int) -> bytes:
    """One record of a normalised file, with its header and closing blank lines."""
    where, path = filesystem(uri)
    with where.open_input_file(path) as f:
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)


def record(uri: str, body: str, number: str) -> bytes:
    """A response record of a page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body.encode("utf-8", "surrogatepass")
    one_line = " ".join(uri.split())
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{number}>\r\nWARC-Target-URI: {one_line}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write pages as WARC files that are one gzip stream each, a file for each partition."""
    kept = pages.select(F.col(page_id).cast("string"), url, html)
    where, local = filesystem(path)
    where.create_dir(local, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"pages-{context.partitionId():05d}.warc.gz"
        engine, n = zlib.compressobj(1, zlib.DEFLATED, 31), 0
        to, folder = filesystem(path)
        hidden = f"{folder}/.{name}.{context.taskAttemptId()}"
        with to.open_output_stream(hidden, compression=None) as out:
            for batch in batches:
                for k, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(engine.compress(record(u or "", h or "", k or "")))
                    n += 1
            out.write(engine.flush())
        to.move(hidden, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    kept.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def query(spark, sf_dir: str) -> DataFrame:
    """All pages as monolithic files, and these normalised."""
    path = _shared.new_path(spark, "warc")
    write_monolithic(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{path}/whole")
    return normalise(spark, f"{path}/whole", f"{path}/members")
