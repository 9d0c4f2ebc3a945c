"""Writers: batches of tab-separated rows, posting lists, key-value tables, text files and responses."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, rows_per_file: int | None = None, partition_by: tuple[str, ...] = ()) -> None:
    """Gzip files with a new one after so many rows. Spark names them uniquely; their list is the folder's."""
    out = df.write.option("sep", "\t").option("quote", "").option("escape", "").option("emptyValue", "").option("nullValue", "").option("compression", "gzip")
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.csv(path)


def write_postings(df: DataFrame, path: str, files: int | None = None, order: tuple[str, ...] = ("token", "value")) -> None:
    """Postings ranged by token and sorted, so that the row groups' statistics find a token; Bloom filters serve point look-ups."""
    ranged = df.repartitionByRange(files, "token") if files else df.repartitionByRange("token")
    ranged.sortWithinPartitions(*order).write.option("parquet.bloom.filter.enabled#token", "true").option("compression", "zstd").parquet(path)


def write_posting_runs(df: DataFrame, path: str, order: tuple[str, ...] = ("token", "value")) -> None:
    """Postings sorted in their partition, without a shuffle: each file is a sorted run with every token of its pages.

    A look-up reads of each file the row groups and pages that statistics and Bloom filters leave, and a long list is spread over all files.
    """
    bloom = {"parquet.bloom.filter.enabled#token": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    df.sortWithinPartitions(*order).write.options(**bloom, compression="zstd").parquet(path)


def truncate(spark: SparkSession, path: str) -> None:
    """Empty a written table; its columns stay."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def write_postings_table(df: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Postings bucketed by token: an AND of tokens reads their buckets only, and joins on token need no shuffle."""
    out = df.write.bucketBy(buckets, "token").sortBy("token", "value").format("parquet")
    (out.option("path", path) if path else out).saveAsTable(table)


def write_key_values(df: DataFrame, path: str) -> None:
    df.repartitionByRange("key").sortWithinPartitions("key").write.option("compression", "zstd").parquet(path)


def write_lines(df: DataFrame, path: str, *columns: str) -> None:
    """Plain tab-separated text, such as hosts, edges and centralities."""
    df.select(*columns).write.option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def write_warc(pages: DataFrame, path: str, url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", ip: str = "192.0.2.1") -> None:
    """Pages as WARC files of responses, a gzip member for each record and a file for each partition; a task writes under its attempt's name and then renames."""
    kept = pages.select(F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(html), F.lit("")))
    where, local = fs.FileSystem.from_uri(path)
    where.create_dir(local, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        to, folder = fs.FileSystem.from_uri(path)
        name = f"part-{context.partitionId():05d}.warc.gz"
        hidden, n = f"{folder}/.{name}.{context.taskAttemptId()}", 0
        with to.open_output_stream(hidden, compression=None) as out:
            for batch in batches:
                for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + h.encode("utf-8", "surrogatepass")
                    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Date: {date}\r\nWARC-IP-Address: {ip}\r\nWARC-Target-URI: {' '.join(u.split())}\r\nContent-Length: {len(body)}\r\n\r\n"
                    out.write(gzip.compress(head.encode() + body + b"\r\n\r\n", 6))
                    n += 1
        to.move(hidden, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    kept.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _plain(c: Column) -> Column:
    """A double as JSON: the shortest digits, with an exponent only below a millionth and from 1e21 on."""
    size = F.abs(c)
    digits = F.when(size >= 1e7, c.cast("decimal(38,10)").cast("string")).otherwise(c.cast("decimal(38,26)").cast("string"))
    digits = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", ".0")
    return F.when(((size >= 1e-6) & (size < 1e-3)) | ((size >= 1e7) & (size < 1e21)), digits).otherwise(c.cast("string"))


def _json(types: list[tuple[str, str]], column: Callable[[str], Column]) -> Column:
    """The fields of a JSON object; null ones are left out."""

    def field(name: str, kind: str) -> Column:
        c = column(name)
        json = F.to_json(F.struct(c.alias(name)))
        inner = F.substr(json, F.lit(2), F.length(json) - 2)
        if kind != "double":
            return inner
        key = F.to_json(F.struct(F.lit(0).alias(name)))
        plain = F.concat(F.substr(key, F.lit(2), F.length(key) - 3), _plain(c))
        return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), inner).otherwise(F.coalesce(plain, F.lit("")))

    return F.array_join(F.filter(F.array(*(field(*t) for t in types)), lambda x: x != ""), ",")


def response(results: DataFrame, order: Column | list[Column], limit: int = 1000, **info: Column) -> DataFrame:
    """A single row (json): status, the fields of ``info`` and the results in order. The limit bounds the row."""
    top = results.orderBy(order).limit(limit)
    numbered = top.coalesce(1).withColumn("__rank", F.monotonically_increasing_id())
    ranked = F.array_sort(F.collect_list(F.struct(F.col("__rank"), F.concat(F.lit("{"), _json(results.dtypes, F.col), F.lit("}")).alias("r"))))
    head = {"status": F.lit("success"), **info}
    fields = _json(results.select(*(c.alias(k) for k, c in head.items())).dtypes, lambda k: head[k])
    body = F.array_join(F.transform("results", lambda x: x["r"]), ",")
    return numbered.agg(ranked.alias("results")).select(F.concat(F.lit("{"), fields, F.lit(',"results":['), body, F.lit("]}")).alias("json"))


#: A record of a domain's block: value and score.
RECORD = np.dtype([("value", "<i8"), ("score", "<f4")])


def domain_blocks(results: DataFrame, most: int = 1000, domain: str = "domain") -> DataFrame:
    """(domain, total, block): how many results a domain has, and its best ``most`` of them as bytes.

    A block is the domain, the number of its records, and for each record its value and
    score; numbers have 8 bytes and scores 4, all little-endian. The domain is a long.
    """
    rank = Window.partitionBy(domain).orderBy(F.desc("score"), F.asc("value"))
    best = results.withColumn("__n", F.row_number().over(rank)).where(F.col("__n") <= most)
    lists = best.groupBy(F.col(domain).cast("long").alias("domain")).agg(F.array_sort(F.collect_list(F.struct("__n", F.col("value").cast("long").alias("value"), F.col("score").cast("float").alias("score")))).alias("r"))
    totals = results.groupBy(F.col(domain).cast("long").alias("domain")).agg(F.count(F.lit(1)).alias("total"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for d, values, scores in zip(*(c.to_pylist() for c in batch.columns[:1] + batch.columns[2:]), strict=True):
                records = np.empty(len(values), RECORD)
                records["value"], records["score"] = values, scores
                blocks.append(np.array([d, len(values)], "<i8").tobytes() + records.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks, pa.binary())], names=["domain", "total", "block"])

    flat = lists.join(totals, "domain").select("domain", "total", F.col("r.value").alias("v"), F.col("r.score").alias("s"))
    return flat.mapInArrow(pack, "domain long, total long, block binary")


def read_domain_blocks(blocks: DataFrame) -> DataFrame:
    """(domain, total, value, score) of the blocks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for total, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                d, n = np.frombuffer(block, "<i8", 2)
                records = np.frombuffer(block, RECORD, n, 16)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d)), pa.array(np.full(n, total)), pa.array(records["value"].copy()), pa.array(records["score"].copy())], names=["domain", "total", "value", "score"])

    return blocks.select("total", "block").mapInArrow(unpack, "domain long, total long, value long, score float")


def domain_response(blocks: DataFrame) -> DataFrame:
    """(body) of a request for some domains, a single row: the sum of their totals, then their blocks by domain. Give it the asked domains' blocks only."""
    asked = blocks.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(F.struct("domain", "block"))).alias("b"))
    digits = F.lpad(F.hex("total"), 16, "0")
    total = F.concat(*(F.unhex(F.substring(digits, 15 - 2 * i, 2)) for i in range(8)))
    return asked.select(F.aggregate("b", total, lambda out, b: F.concat(out, b["block"])).alias("body"))
