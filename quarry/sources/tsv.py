"""Tab-separated rows, manifests, dictionaries and sorted key files; gzip is read as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import schemas


def read(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows with exactly these columns; there are no quotes or escapes, short rows end in nulls."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("escape", "").option("mode", "PERMISSIVE").csv(path)


def read_urls(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read(spark, path, schemas.URL_ROW)


def read_links(spark: SparkSession, path: str | list[str], most_text: int = 1000) -> DataFrame:
    """Links with text of at most ``most_text`` characters and nofollow as a boolean."""
    return read(spark, path, schemas.LINK_ROW).withColumns({"text": F.substring("text", 1, most_text), "nofollow": F.col("nofollow") == "1"})


def columns(lines: DataFrame, value: str = "value") -> Column:
    return F.split(lines[value], "\t")


def column(lines: DataFrame, number: int, value: str = "value") -> DataFrame:
    """One column of lines, the empty string where a line is too short."""
    return lines.select(F.coalesce(F.get(columns(lines, value), F.lit(number)), F.lit("")).alias("value"))


def column_rows(lines: DataFrame, number: int, order: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The column in the order of a row number, with offset and limit."""
    out = lines.orderBy(order).select(F.coalesce(F.get(columns(lines), F.lit(number)), F.lit("")).alias("value"))
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def column_set(lines: DataFrame, number: int) -> DataFrame:
    return column(lines, number).distinct()


def manifest(spark: SparkSession, path: str, kind: str = "urls") -> DataFrame:
    """Paths of a crawl's manifest, rewritten to those of its ``urls``, ``links`` or ``direct`` links."""
    end = {"urls": ".gz", "links": ".links.gz", "direct": ".direct.links.gz"}[kind]
    return spark.read.text(path).where("value <> ''").select(F.regexp_replace("value", r"\.warc\.gz$", end).alias("path"))


def read_batch(spark: SparkSession, manifest_path: str, base: str, kind: str = "urls", limit: int | None = None, offset: int = 0) -> DataFrame:
    """The rows of a slice of the manifest's files. The names (not the rows) come to the driver, as for any list of files."""
    names = [r.path for r in manifest(spark, manifest_path, kind).collect()]
    names = names[offset : None if limit is None else offset + limit]
    reader = read_urls if kind == "urls" else read_links
    return reader(spark, [f"{base}/{n}" for n in names]) if names else spark.createDataFrame([], schemas.URL_ROW if kind == "urls" else schemas.LINK_ROW)


def round_robin(df: DataFrame, order: str, nodes: int, node: int) -> DataFrame:
    """Every nodes-th row from the node-th on: for lists of files, which one task can number."""
    return df.withColumn("__n", F.row_number().over(Window.orderBy(order)) - 1).where(F.col("__n") % nodes == node).drop("__n")


def dictionary(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def numeric_columns(c: Column) -> Column:
    """The numbers of a tab-separated row; cells that are none are dropped, so that later ones move up."""
    return F.filter(F.transform(F.split(c, "\t"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())


# --- sorted key files
def find(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def find_all(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of all wanted keys."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def positions(df: DataFrame, key: str, value, position: str) -> DataFrame:
    """(first, last, next): the first and last position of a key, and that of the next greater key."""
    k = F.col(key)
    return df.agg(F.min(F.when(k == value, F.col(position))).alias("first"), F.max(F.when(k == value, F.col(position))).alias("last"), F.min(F.when(k > value, F.col(position))).alias("next"))


def urls_with_links(df: DataFrame, url: str = "url", links: str = "links", least: int = 2) -> DataFrame:
    """URLs that at least ``least`` links point to."""
    return df.where(F.col(links) >= least).select(url)
