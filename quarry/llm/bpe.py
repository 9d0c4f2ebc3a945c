"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding.

``encode``
1. Each task cuts its texts into pre-tokens and, for about CHUNK characters of
   text at once, numbers the distinct ones by frequency.  The numbers in order
   of position go, compressed, to a file of their own in the shared folder; the
   distinct pre-tokens and the files' names go to a table there.  A file is
   named after its task's attempt, and only the names that a task committed are
   in the table, so a task that is run again does no harm.
2. The distinct pre-tokens are shuffled by hash into buckets, of which there is
   one for each BUCKET bytes of text, but at most MOST_BUCKETS, so that a chunk's
   part of a bucket stays some twenty words.  All chunks' occurrences of a word meet
   in one bucket.  A task has one bucket, goes through it a piece of rows at a time,
   encodes each distinct word once, and sends its ids back to each chunk; it holds
   the bucket's distinct words and no more.
3. The ids come together by chunk, are joined to its positions, and every
   document's tokens are put together in order.

What is shuffled is the distinct words of each chunk and their ids, and neither
the positions nor the exploded text.

``decode`` joins the table of tokens' bytes.  That table has the size of the
vocabulary whatever the input, which is checked, so it is joined map-side.

Defined results: a null text has null ids and -1 tokens, and decodes to null; an
empty text has no ids; a very long one is encoded whole, as a chunk of its own.
Strings of special tokens are ordinary text.  Of merges the one of least rank
goes first, the leftmost of ties.  Rows are never merged, so repeated rows and
equal or null doc_ids come out as they went in, and nulls in other columns pass
through.  An empty table gives no rows.  A column of ``df`` named as an added one
is replaced; other names are free.  A decoded id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.llm import _shared, _text
from quarry.llm._shared import filesystem

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of text whose pre-tokens are numbered together.
CHUNK = 6 << 20
#: Bytes of text for each bucket of words, and the most buckets.
BUCKET, MOST_BUCKETS = 24 << 20, 5000
#: A vocabulary above this is not broadcast but refused.
MOST_TOKENS = 2_000_000
#: Pre-tokens whose number of tokens a task remembers.
KNOWN = 1 << 20
_ENCODERS: dict = {}


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a file of base64 and rank lines."""
    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(table) > MOST_TOKENS:
        raise ValueError("the vocabulary is too large to send to every task")
    return table


def encoder(path: str, table: dict[bytes, int] | None = None):
    """A tiktoken encoding, made once in a process."""
    if path not in _ENCODERS:
        import tiktoken

        _ENCODERS[path] = tiktoken.Encoding(path, pat_str=r"[\s\S]+", mergeable_ranks=table or ranks(path), special_tokens={})
    return _ENCODERS[path]


def encode_words(words: list[str], path: str, table: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, all ids)."""
    one = encoder(path, table)._core_bpe.encode_single_piece
    got = [one(w.encode("utf-8", "surrogatepass")) for w in words]
    sizes = np.fromiter(map(len, got), np.uint32, len(got))
    return sizes, np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum()))


class Words:
    """The ids of all words asked for so far, each encoded once."""

    def __init__(self, path: str, table: dict[bytes, int]):
        self.one = encoder(path, table)._core_bpe.encode_single_piece
        self.number: dict[bytes, int] = {}
        self.sizes, self.begin, self.flat = array("L"), array("L"), array("I")

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the words in order, the size of each)."""
        for w in words:
            if w not in self.number:
                got = self.one(w)
                self.number[w] = len(self.number)
                self.sizes.append(len(got))
                self.begin.append(len(self.flat))
                self.flat.extend(got)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return _text.expand(at, *(np.frombuffer(x, kind) for x, kind in ((self.sizes, np.int64), (self.flat, np.uint32), (self.begin, np.int64))))


class TokenCounts:
    """The numbers of tokens of texts; of each pre-token it has once been encoded, it keeps two 64-bit hashes and the number."""

    def __init__(self, path: str, table: dict[bytes, int]):
        self.one = encoder(path, table)._core_bpe.encode_single_piece
        self.hash, self.check, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = []
        for lo, hi in _text.slices(texts):
            cps, offsets = _text.code_points(texts[lo:hi])
            start = _text.pretokens(cps, offsets)
            end = np.append(start[1:], len(cps))[: len(start)]
            total = np.concatenate([[0], np.cumsum(self.sizes(cps, start, end))])
            out.append(np.diff(total[np.searchsorted(start, offsets)]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def sizes(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of tokens of each pre-token."""
        h, g = _text.segment_hash(cps, start, end), _text.segment_hash(cps, start, end, _text.BASE2)
        distinct, at, sequence = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, distinct)
        there, known = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
        inside = place < len(self.hash)
        there[inside] = self.hash[place[inside]] == distinct[inside]
        known[there] = self.check[place[there]] == g[at[there]]
        n = np.empty(len(distinct), np.int64)
        n[known] = self.size[place[known]]
        new = np.flatnonzero(~known)
        n[new] = self.encoded(cps, start[at[new]], end[at[new]])
        size = n[sequence.reshape(-1)]
        odd = np.flatnonzero(g != g[at][sequence.reshape(-1)])  # another word of the same hash
        size[odd] = self.encoded(cps, start[odd], end[odd])
        fresh = new[~there[new]]
        if len(fresh):
            if len(self.hash) > KNOWN:  # memory, not results: words are encoded again
                self.hash, self.check, self.size = self.hash[:0], self.check[:0], self.size[:0]
            place = np.searchsorted(self.hash, distinct[fresh])
            self.hash, self.check, self.size = (np.insert(old, place, x) for old, x in ((self.hash, distinct[fresh]), (self.check, g[at[fresh]]), (self.size, n[fresh])))
        return size

    def encoded(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
        """Encode these words, each by itself."""
        size = end - start
        begin = np.cumsum(size) - size
        flat = cps[np.repeat(start - begin, size) + np.arange(int(size.sum()))]
        joined, one = flat.tobytes().decode("utf-32-le", "surrogatepass"), self.one
        return [len(one(joined[a:b].encode("utf-8", "surrogatepass"))) for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of small unsigned integers, each stored by planes of bytes."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a, dtype="<u4")
        planes = a.view(np.uint8).reshape(-1, 4)
        used = max((i + 1 for i in range(4) if planes[:, i].any()), default=1)
        parts += [np.array([len(a), used], "<u4").tobytes(), planes[:, :used].T.tobytes()]
    return zstandard.ZstdCompressor(level=9).compress(b"".join(parts))


def unpack(blob: bytes, count: int) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for _ in range(count):
        n, used = np.frombuffer(data, "<u4", 2, at)
        n, used = int(n), int(used)
        planes = np.zeros((n, 4), np.uint8)
        planes[:, :used] = np.frombuffer(data, np.uint8, n * used, at + 8).reshape(used, n).T
        out.append(planes.view("<u4").reshape(-1))
        at += 8 + n * used
    return out


def pack_words(words: list[bytes], numbers: np.ndarray) -> bytes:
    """Words and their ascending numbers."""
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    steps = np.diff(numbers, prepend=0).astype("<u4")
    return zstandard.ZstdCompressor(level=12).compress(np.uint32(len(words)).tobytes() + steps.tobytes() + sizes.tobytes() + b"".join(words))


def unpack_words(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words, and the steps between their numbers."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = (np.cumsum(np.frombuffer(data, "<u4", n, 4 + 4 * n)) + 4 + 8 * n).tolist()
    return [data[a:b] for a, b in zip([4 + 8 * n, *ends[:-1]], ends, strict=True)] if n else [], np.frombuffer(data, "<u4", n, 4)


def _message(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _cut(batches: Iterator[pa.RecordBatch], text_at: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows regrouped to about ``most`` characters of text each, and at least one row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > most:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, start = [], 0, i
            size += n
        if start < batch.num_rows:
            held.append(batch.slice(start))
    held = [h for h in held if h.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def encode(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, carry: tuple[str, ...] | None = None, chunk: int = CHUNK, bucket_size: int = BUCKET) -> DataFrame:
    """The carried columns (all but the text, unless given), n_tokens and token_ids."""
    spark = df.sparkSession
    carry = tuple(c for c in (df.columns if carry is None else carry) if c != text and c not in ("n_tokens", "token_ids"))
    text_name, rows_name = _shared.fresh(list(carry), "__text", "__rows")
    kept = df.select(*carry, df[text].alias(text_name))
    size = kept.agg(F.sum(F.octet_length(text_name))).first()[0] or 0
    buckets = min(MOST_BUCKETS, 1 + size // bucket_size)
    table = spark.sparkContext.broadcast(ranks(vocabulary))
    width = len(carry)

    files = _shared.new_path(spark, "positions")
    where_, local = filesystem(files)
    where_.create_dir(local, recursive=True)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, n = TaskContext.get(), 0
        to, place = filesystem(files)
        for rows in _cut(batches, width, chunk):
            texts = rows.column(width)
            c = _text.Chunk(_text.strings(texts))
            words = [w.encode("utf-8", "surrogatepass") for w in c.words]
            often = np.argsort(-np.bincount(c.sequence, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[often] = np.arange(len(words))
            counts = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, c.counts + 1)
            docs = _message(rows.select(range(width)).append_column(rows_name, pa.array(counts, pa.int64())))
            name = f"{context.partitionId()}-{context.taskAttemptId()}-{n}"
            with to.open_output_stream(f"{place}/{name}", compression=None) as out:
                out.write(np.uint64(len(docs)).tobytes() + docs + pack(rank[c.sequence]))
            bucket = np.fromiter((zlib.crc32(words[i]) % buckets for i in often.tolist()), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")  # by bucket, and in it by frequency
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            blobs = [pack_words([words[i] for i in often[part].tolist()], part) for part in (order[edges[b] : edges[b + 1]] for b in some)]
            # A chunk without any word still has its documents: it is sent once more, without words.
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(some) + 1)), pa.array([zlib.crc32(name.encode()) % buckets, *some.tolist()], pa.int32()), pa.array([None, *blobs], pa.binary())], names=["chunk", "bucket", "data"])
            n += 1
            del c, words, rows, texts, docs, rank, often, bucket, order, blobs
            _text.release()

    written, _ = _shared.write_table(kept.mapInArrow(number, "chunk string, bucket int, data binary"), "pretokens")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(vocabulary, table.value)
        for batch in batches:
            for i, chunk_name in enumerate(batch.column(0).to_pylist()):
                blob, ids = batch.column(2)[i].as_py(), None
                if blob is not None:
                    words, steps = unpack_words(blob)
                    got, size = known.ids(words)
                    ids = pack(steps, size, got)
                yield pa.RecordBatch.from_arrays([pa.array([chunk_name]), pa.array([ids], pa.binary())], names=["chunk", "ids"])
        del known
        _text.release()

    encoded = written.repartitionById(buckets, "bucket").mapInArrow(once, "chunk string, ids binary")
    schema = T.StructType([*(kept.schema[c] for c in carry), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    list_type = to_arrow_schema(schema).field("token_ids").type

    def assemble(key, group):
        parts = [unpack(b, 3) for b in group.column("ids").to_pylist() if b is not None]
        n = sum(len(p[0]) for p in parts)
        sizes, begin, at = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for steps, size, _ in parts:
            numbers = np.cumsum(steps, dtype=np.int64)
            sizes[numbers] = size
            begin[numbers] = at + np.cumsum(size, dtype=np.int64) - size
            at += int(size.sum())
        flat = np.concatenate([p[2] for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32)
        to, place = filesystem(files)
        with to.open_input_file(f"{place}/{key[0].as_py()}") as f:
            data = f.read()
        cut = 8 + int(np.frombuffer(data, np.uint64, 1)[0])
        rows = pa.ipc.open_stream(data[8:cut]).read_all()
        sequence = unpack(data[cut:], 1)[0].astype(np.int64)
        counts = rows.column(rows_name).to_numpy()
        edges = np.concatenate([[0], np.cumsum(np.maximum(counts - 1, 0))])
        null = counts == 0
        out = []
        for a in range(0, len(counts), 512):  # documents at once, for the sake of memory
            b = min(a + 512, len(counts))
            ids, size = _text.expand(sequence[edges[a] : edges[b]], sizes, flat, begin)
            offsets = np.concatenate([[0], np.cumsum(size)])[edges[a : b + 1] - edges[a]]
            mask = null[a:b]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(mask) if mask.any() else None).cast(list_type)
            part = rows.slice(a, b - a)
            out.append(pa.Table.from_arrays([*(part.column(i) for i in range(width)), pa.array(np.where(mask, -1, np.diff(offsets))), lists], names=schema.names))
        del parts, sizes, begin, flat, data, sequence, edges, ids, size, offsets
        _text.release()
        return pa.concat_tables(out)

    return encoded.groupBy("chunk").applyInArrow(assemble, schema)


def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id, in order; empty for an id the file leaves out."""
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for word, i in table.items():
        out[i] = word
    return out


def decode(df: DataFrame, ids: str = "token_ids", output: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df without the ids, with the text they stand for; bytes that are no UTF-8 become U+FFFD."""
    table = df.sparkSession.sparkContext.broadcast(token_bytes(vocabulary))
    rest = [c for c in df.columns if c not in (ids, output)]
    kept = df.select(*rest, ids)
    schema = T.StructType([*(kept.schema[c] for c in rest), T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(table.value, pa.binary())
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(part.num_columns - 1)
                flat = lists.flatten()
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), tokens.take(flat)), b"")
                try:
                    texts = joined.cast(pa.string())
                except pa.ArrowInvalid:
                    texts = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
                texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=schema.names)

    return kept.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents, and the texts they decode to."""
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=("doc_id",))
    return decode(encoded.withColumn("ids", F.col("token_ids")), "token_ids").withColumnRenamed("ids", "token_ids")
