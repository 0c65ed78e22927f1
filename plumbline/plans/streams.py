"""Queries over streams: a table's rows arrive as JSON files, a few a micro-batch, and what is kept of them is read at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..streaming import kept
from .catalogue import _FOLD, _ORACLE, _STATUSES, _events, _query, _runs, table

#: Files that a table arrives in, and files of a micro-batch.
_FILES, _AT_ONCE = 8, 3


def _arriving(rows: DataFrame, name: str) -> tuple[DataFrame, str, str]:
    """rows as a stream of files in no order, the folder of these files, and one for what is kept."""
    spark, where = rows.sparkSession, scratch.folder(rows.sparkSession, name)
    rows.repartition(_FILES).write.json(f"{where}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", _AT_ONCE).json(f"{where}/in"), f"{where}/in", f"{where}/kept"


def _finished(query, spark: SparkSession, arrived: str) -> None:
    query.awaitTermination()
    scratch.remove(spark, arrived)


@_query("q106_kept_verdicts", f"WITH {_FOLD} SELECT test, passed, skipped, elapsed, first_seq FROM fold")
def q106(spark: SparkSession, d: str) -> DataFrame:
    """Events in no order, folded in a state store; the watermark waits long enough for all."""
    rows = _events(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("Time")), "seq")
    stream, arrived, folder = _arriving(rows.select(F.lit("p").alias("path"), "seq", "Time", "Action", "Package", "Test", "Elapsed"), "verdicts")
    _finished(kept.keep_verdicts(stream, folder, "3650 days"), spark, arrived)
    return kept.read_verdicts(spark, folder).select("test", "passed", "skipped", "elapsed", "first_seq")


@_query("q107_kept_averages", _ORACLE["q01_average_per_config"])
def q107(spark: SparkSession, d: str) -> DataFrame:
    stream, arrived, folder = _arriving(_runs(spark, d), "averages")
    _finished(kept.keep_averages(stream, folder, ("gen", "val"), ("cov", "mut")), spark, arrived)
    return kept.read_averages(spark, folder, ("gen", "val"), ("cov", "mut"))


@_query("q108_kept_matrix", _ORACLE["q02_build_matrix"])
def q108(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    runs = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("repo"), F.col("o_orderstatus").alias("config"), F.col("o_orderkey").alias("seq"), "o_totalprice")
    stream, arrived, folder = _arriving(runs, "matrix")
    _finished(kept.keep_matrix(stream, folder, "o_totalprice"), spark, arrived)
    return kept.read_matrix(spark, folder, _STATUSES)
