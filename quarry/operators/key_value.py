"""A versioned key-value table: a history (key, value, version, seq) of which the latest row of a key counts.

The greater version wins, of equal versions the greater ``seq`` (the order of
arrival); version 0 is the oldest.  A removal is a row of another table and acts
on what was added before the merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import tables
from quarry.operators import staging

MOST_BYTES = 20 << 20


def latest(history: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each key: the latest whose value is not too long. What is outdated goes before the shuffle."""
    kept = history.where(F.col("value").isNull() | (F.octet_length("value") <= most_bytes))
    last = Window.partitionBy("key").orderBy(F.desc("version"), F.desc("seq"))
    return kept.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def remove(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the given keys."""
    return table.join(keys.select("key"), "key", "left_anti")


def merge_with(table: DataFrame, other: DataFrame) -> DataFrame:
    """Both tables' latest rows: the greater version wins, and of equals the table's own."""
    both = table.withColumn("__own", F.lit(1)).unionByName(other.withColumn("__own", F.lit(0)))
    last = Window.partitionBy("key").orderBy(F.desc("version"), F.desc("__own"), F.desc("seq"))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__own")


def find(table: DataFrame, key) -> DataFrame:
    """(value, version) of a key; no row where it is absent."""
    return table.where(F.col("key") == key).select("value", "version")


def find_many(table: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, version) of the asked keys, the empty value for absent ones. The asked keys are the small side of the join."""
    return keys.select("key").distinct().join(table.select("key", "value", "version"), "key", "left").fillna({"value": ""})


def has(table: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found)."""
    known = table.select("key").distinct().withColumn("__f", F.lit(True))
    return keys.select("key").distinct().join(known, "key", "left").select("key", F.col("__f").isNotNull().alias("found"))


def size(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n"))


class Store:
    """A key-value table in a folder: additions are staged, a merge writes a new version and then turns to it.

    The table that is being read is never overwritten.  A merge takes the batches
    that are whole when it begins, and removes these only; one that is staged
    meanwhile waits for the next.  A merge that was broken off leaves a version
    without its mark, which the next one passes over, or batches that the mark
    names, which the next one removes unread.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and tables.exists(self.spark, f"{self.path}/{n}/{staging.MARK}"))

    def table(self) -> DataFrame:
        """The merged table; empty before the first merge."""
        from quarry.schemas import KEY_VALUE

        v = self._versions()
        return self.spark.read.parquet(f"{self.path}/v={v[-1]}") if v else self.spark.createDataFrame([], KEY_VALUE)

    def add(self, rows: DataFrame, batch: int | str) -> None:
        """Stage rows; a batch that comes again replaces itself."""
        rows.write.mode("overwrite").parquet(f"{self.path}/staged/batch={batch}")

    def merge(self, removed: DataFrame | None = None) -> None:
        """Fold the staged rows into a new version of the table, without the removed keys."""
        folder, v = f"{self.path}/staged", self._versions()
        batches = staging.whole(self.spark, folder)
        done = staging.marked(self.spark, f"{self.path}/v={v[-1]}") if v else {}
        new = {name: time for name, time in batches.items() if done.get(name) != time}
        now = self.table()
        staged = staging.read(self.spark, folder, new)
        both = now.unionByName(staged.select(*now.columns)) if staged is not None else now
        out = latest(both)
        self._write(remove(out, removed) if removed is not None else out, v, batches)
        staging.remove(self.spark, folder, batches)
        for old in v[:-1]:  # the version before stays for its readers
            tables.remove(self.spark, f"{self.path}/v={old}")

    def merge_from(self, other: DataFrame) -> None:
        """Fold another table (say, shards from elsewhere) into a new version: its newer rows win, equal versions keep the store's."""
        v = self._versions()
        done = staging.marked(self.spark, f"{self.path}/v={v[-1]}") if v else {}
        self._write(merge_with(self.table(), latest(other).select(*self.table().columns)), v, done)

    def _write(self, df: DataFrame, versions: list[int], batches: dict[str, int]) -> None:
        path = f"{self.path}/v={versions[-1] + 1 if versions else 1}"
        df.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").option("compression", "zstd").parquet(path)
        staging.mark(self.spark, path, batches)

    def truncate(self) -> None:
        tables.remove(self.spark, self.path)
