"""Token ids as flat binary files that training jobs map into memory.

A task writes the ids of its documents to ``part-NNNNN-A.bin``, unsigned integers
of two bytes (four for a vocabulary above 65,536) in little-endian order without
any header, and the offsets of the documents to ``part-NNNNN-A.idx``, unsigned
64-bit integers: document i has the ids from offset i to offset i + 1.  Counts by
partition are summed up (a window over a row for each partition, so of the size
of the file list) to the base of each partition, and base + local offset is the
document's place in the whole corpus.

A is the number of the task's attempt: attempts of one task may see its rows in
another order, so each has files of its own, and the index, to which Spark commits
one attempt's rows, names them.  Files of other attempts are removed at the end,
and readers follow the table ``parts`` (file, ids, documents and base of each
partition).  ``open_part`` maps one part; ``Corpus`` maps them all and finds
global places.

Defined results: a null text is written as an empty document, as is an empty
one; a very long text is written whole; each repeat of a row is written, also of
equal or null doc_ids, and nulls or clashing names in other columns change nothing.
Of merges the leftmost of ties goes first.  An empty table, or a partition without
rows, has no files.  Documents end with the id ``end`` where one is given.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _shared, _text
from quarry.llm._shared import filesystem
from quarry.llm.bpe import CHUNK, VOCABULARY, _cut, encode_words, ranks


def write_part(batches: Iterator[pa.RecordBatch], uri: str, part: int, attempt: int, vocabulary: str, table: dict[bytes, int], kind: str, end: int | None) -> Iterator[pa.RecordBatch]:
    """Write the texts (second column) of one attempt of a task; rows of the index with the first column as doc_id."""
    to, path = filesystem(uri)
    name = f"part-{part:05d}-{attempt}"
    rows = total = 0
    sizes: list[np.ndarray] = [np.zeros(1, np.int64)]
    out = None
    for batch in _cut(batches, 1, CHUNK):
        out = out or to.open_output_stream(f"{path}/{name}.bin", compression=None)
        c = _text.Chunk(_text.strings(batch.column(1)))
        word_size, flat = encode_words(c.words, vocabulary, table)
        ids, size = _text.expand(c.sequence, word_size.astype(np.int64), flat)
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(c.counts)])]
        if end is not None:
            ids = np.insert(ids, at[1:], end)
            at = at + np.arange(len(at))
        n = np.diff(at)
        sizes.append(n)
        out.write(ids.astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (np.full(len(n), part), rows + np.arange(len(n)), total + at[:-1], n)), pa.array([name] * len(n))], names=["doc_id", *INDEX])
        rows, total = rows + len(n), total + int(at[-1])
    if out:
        out.close()
        with to.open_output_stream(f"{path}/{name}.idx", compression=None) as side:
            side.write(np.cumsum(np.concatenate(sizes)).astype("<u8").tobytes())


#: Columns of the index beside doc_id.
INDEX = ("part", "row", "start", "n_tokens", "file")


def write_tokens(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, end: int | None = None) -> DataFrame:
    """Write the files to the folder; the index (doc_id, part, row, start, n_tokens, file, global_start) is returned and kept in path/index."""
    spark = df.sparkSession
    table = ranks(vocabulary)
    most = max([*table.values(), end or 0])
    kind = "<u2" if most < 1 << 16 else "<u4"
    words = spark.sparkContext.broadcast(table)
    where, local = filesystem(path)
    where.create_dir(local, recursive=True)
    kept = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([kept.schema["doc_id"], *(T.StructField(n, T.StringType() if n == "file" else T.LongType()) for n in INDEX)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        yield from write_part(batches, path, context.partitionId(), context.taskAttemptId(), vocabulary, words.value, kind, end)

    kept.mapInArrow(run, schema).write.parquet(f"{path}/index")
    with where.open_output_stream(f"{local}/meta.json") as out:
        out.write(json.dumps({"ids": kind, "offsets": "<u8", "end": end}).encode())
    return finish(spark, path, schema)


def finish(spark, path: str, schema: T.StructType) -> DataFrame:
    """Write the table of parts from the committed index, remove files of other attempts; the index with each document's place in the whole corpus."""
    where, local = filesystem(path)
    rows = spark.read.schema(schema).parquet(f"{path}/index")
    totals = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("ids"), F.count(F.lit(1)).alias("documents"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{path}/parts")
    parts = spark.read.schema("part long, file string, ids long, documents long, base long").parquet(f"{path}/parts")
    known = {r["file"] for r in parts.select("file").collect()}  # a name for each partition
    for info in where.get_file_info(fs.FileSelector(local)):
        if info.base_name.startswith("part-") and info.base_name.rsplit(".", 1)[0] not in known:
            where.delete_file(info.path)
    return rows.join(parts.select("file", "base"), "file").select("doc_id", *INDEX, (F.col("base") + F.col("start")).alias("global_start"))


def parts_of(path: str) -> list[dict]:
    """The parts of a local folder, in order."""
    import pyarrow.parquet as pq

    return sorted(pq.read_table(f"{path.removeprefix('file://')}/parts").to_pylist(), key=lambda r: r["part"])


def open_file(path: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of one part's files in a local folder, mapped and not read."""
    root = path.removeprefix("file://")
    with open(f"{root}/meta.json") as f:
        kind = json.load(f)["ids"]

    def mapped(file: str, dtype: str) -> np.ndarray:
        return np.memmap(file, dtype=dtype, mode="r") if os.path.getsize(file) else np.zeros(0, dtype)

    return mapped(f"{root}/{name}.bin", kind), mapped(f"{root}/{name}.idx", "<u8")


def open_part(path: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the part with this number."""
    return open_file(path, next(p["file"] for p in parts_of(path) if p["part"] == part))


class Corpus:
    """All parts of a local folder as one sequence of documents and one of ids."""

    def __init__(self, path: str):
        known = parts_of(path)
        self.parts = [open_file(path, p["file"]) for p in known]
        self.bases = np.concatenate([[0], np.cumsum([p["ids"] for p in known])]).astype(np.int64)
        self.documents = np.concatenate([[0], np.cumsum([p["documents"] for p in known])]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.documents[-1])

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        p = int(np.searchsorted(self.documents, i, side="right")) - 1
        ids, at = self.parts[p]
        k = i - int(self.documents[p])
        return ids[int(at[k]) : int(at[k + 1])]

    def read(self, start: int, n: int) -> np.ndarray:
        """n ids from a global place on, over the edges of parts."""
        out = []
        while n > 0 and start < self.bases[-1]:
            p = int(np.searchsorted(self.bases, start, side="right")) - 1
            a = start - int(self.bases[p])
            got = self.parts[p][0][a : a + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def query(spark, sf_dir: str) -> DataFrame:
    return write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), _shared.new_path(spark, "tokens"))
