"""Test events as a stream: the same fold as on tables, kept up to date file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.testevents import fold_events
from ..sources import schemas, text


def read_stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """Events of whole NDJSON files as they arrive: (path, seq, ...), seq being the place in the file."""
    raw = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_at_once).text(folder)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n", -1)).alias("pos", "line"))
    e = F.from_json("line", schemas.EVENT)
    return rows.where(F.col("line").startswith("{")).select("path", F.col("pos").cast("bigint").alias("seq"), e.alias("e")).select("path", "seq", "e.*")


def fold_stream(events: DataFrame, late: str | None = None) -> DataFrame:
    """A result a (path, package, test). With `late`, state goes once the watermark on Time has passed by that much."""
    rows = events.withWatermark("Time", late) if late else events
    return fold_events(rows, ("path",))


def run_to(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process what there is and stop, into an in-memory table of that name."""
    return stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Events by tumbling window and kind, late ones up to a bound."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


__all__ = ["read_stream", "fold_stream", "run_to", "windowed_counts", "text"]
