"""Archives of files, and listings of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of all files below the path; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def pack(spark: SparkSession, source: str, target: str) -> None:
    """All files of a folder as rows (name, content) of a compressed table; a task packs its own files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    files.select(F.substring_index("path", "/", -1).alias("name"), "content").write.option("compression", "zstd").parquet(target)


def unpack(spark: SparkSession, archive: str) -> DataFrame:
    """(name, content) of the files in an archive."""
    return spark.read.parquet(archive).select("name", "content")


def unpack_to(spark: SparkSession, archive: str, folder: str) -> None:
    """Write the files of an archive below a folder that all executors reach."""
    from pyarrow import fs

    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)

    def write(rows) -> None:
        where, path = fs.FileSystem.from_uri(folder)
        for r in rows:
            with where.open_output_stream(f"{path}/{r['name']}", compression=None) as out:
                out.write(bytes(r["content"]))

    unpack(spark, archive).foreachPartition(write)


def missing_files(expected: DataFrame, listed: DataFrame, least: int = 1000) -> DataFrame:
    """The expected paths (by their file name) that are absent or smaller than ``least`` bytes."""
    name = lambda c: F.substring_index(c, "/", -1)
    there = listed.where(F.col("length") >= least).select(name("path").alias("__name"))
    return expected.join(there, name(expected["path"]) == there["__name"], "left_anti")
