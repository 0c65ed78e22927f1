"""Change detection between stored versions by a tree of digests.

A version is a folder: `rows`, dealt to buckets by what changes together (a file, a package), with a digest of each body, and
`digests`, a row a bucket. Two versions are compared bucket by bucket; of those that differ the rows' digests are read, and
bodies only of what is new or changed, so what did not change is neither read nor joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a version.
BUCKETS = 1024


def _sums(key: list[str]) -> list[Column]:
    """Two numbers of a bucket's rows that depend on no order: 128 bits that any change of a row changes."""
    return [F.bit_xor(F.xxhash64(*key, "digest")).alias("x"), F.sum(F.xxhash64("digest", *key).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")]


def write_version(rows: DataFrame, path: str, key: list[str], body: str = "body", order: str = "pos", together: str | None = None, buckets: int = BUCKETS) -> None:
    """Store rows as a version; of several with one key the last by `order` counts. together: the column whose rows share a bucket."""
    last = rows.groupBy(*key).agg(F.max_by(F.col(body), F.col(order)).alias("body")).withColumn("digest", F.sha2(F.coalesce("body", F.lit("\0")), 256))
    dealt = last.withColumn("bucket", F.pmod(F.xxhash64(together or key[0]), F.lit(buckets)).cast("int"))
    out = dealt.repartition("bucket").sortWithinPartitions("bucket", *key)
    out.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/rows")
    out.limit(0).write.parquet(f"{path}/empty")
    stored = rows.sparkSession.read.schema(out.schema).parquet(f"{path}/rows")
    stored.groupBy("bucket").agg(*_sums(key)).coalesce(1).write.parquet(f"{path}/digests")


def differing(spark: SparkSession, old: str, new: str) -> list[int]:
    """Buckets that are not the same in both versions."""
    a, b = (spark.read.parquet(f"{p}/digests").select("bucket", F.struct("x", "s", "n").alias(n)) for p, n in ((old, "a"), (new, "b")))
    rows = a.join(b, "bucket", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")
    return sorted(r.bucket for r in rows.collect())  # as many as buckets, at most


def changes(spark: SparkSession, old: str, new: str, key: list[str], removed: bool = False) -> DataFrame:
    """(key, status, body) of what is new or changed in a version against an older one, and with `removed` of what went (without body)."""
    apart = differing(spark, old, new)
    schema = spark.read.parquet(f"{new}/empty").schema  # the folder may have no rows to tell it
    side = lambda path: spark.read.schema(schema).parquet(f"{path}/rows").where(F.col("bucket").isin(apart))
    a, b = side(old).select("bucket", *key, F.col("digest").alias("was")), side(new).select("bucket", *key, "digest")
    joined = b.join(a, ["bucket", *key], "full" if removed else "left")
    status = F.when(F.col("was").isNull(), "new").when(F.col("digest").isNull(), "removed").otherwise("changed")
    found = joined.where(~F.col("was").eqNullSafe(F.col("digest"))).select("bucket", *key, status.alias("status"))
    return found.join(side(new).select("bucket", *key, "body"), ["bucket", *key], "left").select(*key, "status", "body")
