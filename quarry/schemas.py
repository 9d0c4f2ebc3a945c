"""Schemas of the tables that the engine reads and keeps."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: A crawled page.
URL_ROW = _strings("url", "title", "h1", "meta", "text", "date", "ip")
#: A link between hosts as it is stored; nofollow is "0" or "1".
LINK_ROW = _strings("host", "path", "target_host", "target_path", "text", "nofollow")
#: Postings: a record of a value under a token.
GENERIC_RECORD = T.StructType([T.StructField("token", T.StringType()), T.StructField("value", T.StringType()), T.StructField("score", T.DoubleType())])
URL_RECORD = T.StructType([*GENERIC_RECORD, T.StructField("domain", T.StringType()), T.StructField("url_length", T.IntegerType())])
LINK_RECORD = T.StructType([*GENERIC_RECORD, T.StructField("source_url", T.StringType()), T.StructField("target", T.StringType())])
DOMAIN_LINK_RECORD = T.StructType([*GENERIC_RECORD, T.StructField("source_url", T.StringType()), T.StructField("target_domain", T.StringType())])
COUNTED_RECORD = T.StructType([T.StructField("token", T.StringType()), T.StructField("value", T.StringType()), T.StructField("count", T.LongType()), T.StructField("score", T.DoubleType())])
VALUE_RECORD = T.StructType([T.StructField("token", T.StringType()), T.StructField("value", T.LongType())])
#: A versioned key-value history; seq orders equal versions.
KEY_VALUE = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("version", T.LongType()), T.StructField("seq", T.LongType())])
HOST = T.StructType([T.StructField("host", T.StringType()), T.StructField("harmonic", T.DoubleType())])
EDGE = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])
