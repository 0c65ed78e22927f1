"""A folder that driver and executors share, for what steps hand on as tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Only where executors are threads of the driver, as in tests, a temporary folder
    stands in for it; on a cluster without the setting there is none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("plumbline.shared.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("plumbline.shared.dir", base)
    return f"{base.rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written there and read back; for small tables, which stay until the folder is cleared."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def children(spark: SparkSession, where: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def rename(spark: SparkSession, where: str, to: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"cannot rename {where} to {to}")
