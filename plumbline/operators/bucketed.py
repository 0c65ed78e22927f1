"""The function cache as a bucketed table: entries stay dealt by key, so neither look-ups nor updates shuffle the store.

Every update writes a version of its own beside the last one, bucket by bucket, and then the name means the new version; readers
of the old one go on until it is dropped by `vacuum`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Store:
    """A named cache of (key, hash, timestamp, ...) below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def _versions(self) -> list[int]:
        tables = self.spark.sql(f"SHOW TABLES LIKE '{self.name}_v*'").collect()  # two or three
        return sorted(int(t.tableName.rpartition("_v")[2]) for t in tables)

    def _write(self, rows: DataFrame) -> None:
        n = max(self._versions(), default=-1) + 1
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/v{n}").option("compression", "zstd").saveAsTable(f"{self.name}_v{n}")

    def create(self, entries: DataFrame) -> None:
        """The first version: the one time that all entries are shuffled."""
        self._write(_newest(entries).repartition(self.buckets, "key"))

    def read(self) -> DataFrame:
        return self.spark.table(f"{self.name}_v{max(self._versions())}")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """wanted (key, hash, ...) with `hit`: whether the store has that key with that hash. Only wanted is shuffled."""
        known = self.read().select("key", F.col("hash").alias("_hash"))
        found = wanted.hint("merge").join(known, "key", "left")
        return found.withColumn("hit", F.coalesce(F.col("_hash") == F.col("hash"), F.lit(False))).drop("_hash")

    def put(self, entries: DataFrame, keep: Column | None = None) -> None:
        """A version with entries in place of those with their keys, and of the others those that `keep` keeps."""
        columns = self.read().columns
        old = self.read() if keep is None else self.read().where(keep)
        new = _newest(entries.select(*columns)).select("key", F.struct(*columns).alias("_new")).hint("merge")
        both = old.select("key", F.struct(*columns).alias("_old")).join(new, "key", "full")
        self._write(both.select(F.coalesce("_new", "_old").alias("e")).select("e.*"))

    def vacuum(self) -> int:
        """Drop all versions but the last; gives how many."""
        *old, _ = self._versions()
        for n in old:
            self.spark.sql(f"DROP TABLE {self.name}_v{n}")
        return len(old)


def _newest(entries: DataFrame) -> DataFrame:
    columns = entries.columns
    return entries.groupBy("key").agg(F.max_by(F.struct(*columns), F.struct("timestamp", F.to_json(F.struct(*columns)))).alias("e")).select("e.*")
