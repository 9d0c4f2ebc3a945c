"""Incremental indexing: files become staged batches, which merges fold into the tables.

A stream writes each micro-batch to a staging folder of its own number, so a batch
that runs again replaces itself; the merge is an ordinary batch job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import key_value as kv
from quarry.operators import postings as po
from quarry.operators import staging as st

FILES_PER_TRIGGER = 500


def file_stream(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet", files: int = FILES_PER_TRIGGER) -> DataFrame:
    """New files of a folder, at most ``files`` in a micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if form == "tsv":
        return reader.option("sep", "\t").option("quote", "").option("escape", "").csv(path)
    return reader.format(form).load(path)


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    out = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def ingest_key_values(stream: DataFrame, store: kv.Store, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Rows (key, value, version, seq) into the staging folder of a store. Without ``every`` it ends with what there is."""
    return _start(stream, lambda batch, n: store.add(batch, n), checkpoint, every)


def ingest_postings(stream: DataFrame, make: Callable[[DataFrame], DataFrame], staging: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Postings made of each batch's rows into a staging folder."""
    return _start(stream, lambda batch, n: make(batch).write.mode("overwrite").parquet(f"{staging}/batch={n}"), checkpoint, every)


def merge_postings(spark: SparkSession, current: DataFrame | None, staging: str, target: str, most: int | None = None, **aggregates) -> DataFrame:
    """Fold the staged postings and the current index into a new folder; the current one stays as it is.

    The batches that are whole at the start are taken, and removed when the new
    index is valid, so each counts once.  The same call again, after one that was
    broken off, ends what that one began.  At least one batch or an index must be there.
    """
    done = st.marked(spark, target)
    if done is None:
        done = st.whole(spark, staging)
        staged = st.read(spark, staging, done)
        parts = [df for df in (current, staged) if df is not None]
        out = po.fold(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), **aggregates)
        out = po.cap(out, most) if most else out
        out.write.mode("overwrite").parquet(target)
        st.mark(spark, target, done)
    st.remove(spark, staging, done)
    return spark.read.parquet(target)
