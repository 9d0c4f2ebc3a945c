"""Batches in a staging folder, ``batch=N`` each: a merge takes those that are whole, once, and removes these and no others."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from quarry import tables

MARK = "_merged"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def whole(spark: SparkSession, folder: str) -> dict[str, int]:
    """The names of the committed batches, with the time of their commit, which tells a batch from one that replaces it."""
    p, fs = _folder(spark, folder)
    if not fs.exists(p):
        return {}
    out = {}
    for s in fs.listStatus(p):
        mark, _ = _folder(spark, f"{folder}/{s.getPath().getName()}/_SUCCESS")
        if s.isDirectory() and fs.exists(mark):
            out[s.getPath().getName()] = fs.getFileStatus(mark).getModificationTime()
    return out


def read(spark: SparkSession, folder: str, batches: dict[str, int]) -> DataFrame | None:
    return spark.read.parquet(*(f"{folder}/{name}" for name in sorted(batches))) if batches else None


def remove(spark: SparkSession, folder: str, batches: dict[str, int]) -> None:
    """Remove the given batches, but none that was replaced since."""
    now = whole(spark, folder)
    for name, time in batches.items():
        if now.get(name) == time:
            tables.remove(spark, f"{folder}/{name}")


def mark(spark: SparkSession, path: str, batches: dict[str, int]) -> None:
    """Note in a merged table which batches are in it; only then is the table valid."""
    p, fs = _folder(spark, f"{path}/{MARK}")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(batches).encode()))
    out.close()


def marked(spark: SparkSession, path: str) -> dict[str, int] | None:
    """The batches in a merged table; None where it is not valid."""
    p, fs = _folder(spark, f"{path}/{MARK}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)
