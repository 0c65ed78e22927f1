"""Results that are kept up to date as data arrives: test verdicts in a state store, and aggregates of run reports.

Both write what a micro-batch gives into a folder named by the batch, in place of what may be there, so a batch that is run again
after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import config_rank
from ..sources import scratch

# --- verdicts ----------------------------------------------------------------------------------------------------------

_STATE = "verdict_seq bigint, passed boolean, skipped boolean, ended_seq bigint, elapsed double, first_seq bigint, last_ms bigint"
_KEYS = ("path", "package", "test")
VERDICT = "path string, package string, test string, passed boolean, skipped boolean, elapsed double, first_seq bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Verdicts(StatefulProcessor):
    """What is known of a test: its last pass or fail, whether it was ever skipped, its last elapsed time, where it was first seen.

    A few numbers a test, whatever it printed. Each event is folded in by its place, so neither order nor repeats of events
    matter. The state goes `late` milliseconds of event time after the test's last event; results stay where they were written.
    """

    def __init__(self, late: int):
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.known = handle, handle.getValueState("known", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = list(self.known.get()) if self.known.exists() else [None, False, False, None, 0.0, None, None]
        was = s[6]
        for r in rows:
            if r.Action in ("pass", "fail") and (s[0] is None or r.seq >= s[0]):
                s[0], s[1] = r.seq, r.Action == "pass"
            if r.Action in ("pass", "fail", "skip") and (s[3] is None or r.seq >= s[3]):
                s[3], s[4] = r.seq, r.Elapsed or 0.0
            s[2] = s[2] or r.Action == "skip"
            s[5] = r.seq if s[5] is None else min(s[5], r.seq)
            at = int(r.Time.timestamp() * 1000)
            s[6] = at if s[6] is None else max(s[6], at)
        self.known.update(tuple(s))
        if s[6] != was:
            if was is not None:
                self.handle.deleteTimer(was + self.late)
            self.handle.registerTimer(s[6] + self.late)
        yield Row(path=key[0], package=key[1], test=key[2], passed=s[1], skipped=s[2], elapsed=s[4], first_seq=s[5])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def verdicts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """VERDICT of each test that a micro-batch touches. events: a stream of (path, seq, Time, Action, Package, Test, Elapsed).

    Events that come later than `late` after others of their time are dropped by the watermark. Needs the RocksDB state store."""
    spark = events.sparkSession
    spark.conf.set(_PROVIDER, _ROCKS)
    rows = events.where((F.coalesce("Test", F.lit("")) != "") & F.col("Time").isNotNull())
    rows = rows.select(F.col("path"), F.coalesce("Package", F.lit("")).alias("package"), F.col("Test").alias("test"), "seq", "Time", "Action", "Elapsed").withWatermark("Time", late)
    wait = spark.range(1).select(F.expr(f"unix_millis(timestamp'2000-01-01' + interval {late}) - unix_millis(timestamp'2000-01-01')")).first()[0]
    return rows.groupBy(*_KEYS).transformWithState(Verdicts(wait), VERDICT, "Update", "EventTime")


def keep_verdicts(events: DataFrame, folder: str, late: str = "1 day") -> StreamingQuery:
    """Take what there is into folder and stop; a later call goes on from there."""
    return _into(verdicts(events, late), folder, lambda batch: batch, "update")


def read_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """VERDICT of every test, as the last batch that touched it left it."""
    names = [f.split()[0] for f in VERDICT.split(", ")]
    rows = spark.read.schema(f"{VERDICT}, batch bigint").parquet(f"{folder}/batches")
    last = rows.groupBy(*_KEYS).agg(F.max_by(F.struct(*[n for n in names if n not in _KEYS]), "batch").alias("x"))
    return last.select(*_KEYS, "x.*").select(*names)


def _into(stream: DataFrame, folder: str, of: Callable[[DataFrame], DataFrame], mode: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        of(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/batches/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


# --- aggregates of run reports -----------------------------------------------------------------------------------------


def _partial(runs: DataFrame, counters: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    sums = [F.sum(c).cast("bigint").alias(c) for c in counters]
    means = [x for m in metrics for x in (F.sum(F.col(m).cast("double")).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n"))]
    return runs.groupBy("config").agg(*sums, *means)


def keep_averages(runs: DataFrame, folder: str, counters: tuple[str, ...], metrics: tuple[str, ...]) -> StreamingQuery:
    """Take the reports that there are, a stream of (config, counters, metrics), into sums and counts in folder, and stop."""
    return _into(runs, folder, lambda batch: _partial(batch, counters, metrics), "append")


def read_averages(spark: SparkSession, folder: str, counters: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """As metrics.average_per_config over all reports taken so far."""
    schema = ", ".join(["config string", *[f"{c} bigint" for c in counters], *[f"{m}_sum double, {m}_n bigint" for m in metrics], "batch bigint"])
    parts = spark.read.schema(schema).parquet(f"{folder}/batches")
    means = [(F.sum(f"{m}_sum") / F.nullif(F.sum(f"{m}_n"), F.lit(0))).alias(m) for m in metrics]
    return parts.groupBy("config").agg(*[F.sum(c).alias(c) for c in counters], *means).orderBy(config_rank(F.col("config")), "config")


def keep_matrix(runs: DataFrame, folder: str, metric: str, order: str = "seq") -> StreamingQuery:
    """Take the reports that there are, a stream of (repo, config, seq, metric), into the last one of each cell, and stop."""
    def last(batch: DataFrame) -> DataFrame:
        return batch.groupBy("repo", "config").agg(F.max(F.struct(F.col(order).cast("bigint").alias("seq"), F.col(metric).cast("double").alias("value"))).alias("x")).select("repo", "config", "x.*")

    return _into(runs, folder, last, "append")


def read_matrix(spark: SparkSession, folder: str, configs: list[str]) -> DataFrame:
    """As metrics.build_matrix over all reports taken so far."""
    parts = spark.read.schema("repo string, config string, seq bigint, value double, batch bigint").parquet(f"{folder}/batches")
    return parts.groupBy("repo").pivot("config", configs).agg(F.max_by("value", "seq"))


def compact(spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame], schema: str) -> int:
    """Replace all batches but the last by one that holds what `merge` makes of them; gives how many there were.

    For when neither a reader nor the stream runs. The last batch stays, as it may be run again."""
    numbers = sorted(int(n.split("=")[1]) for n in scratch.children(spark, f"{folder}/batches") if n.startswith("batch="))
    if len(numbers) < 3:
        return 0
    *old, _ = numbers
    rows = spark.read.schema(schema).parquet(*[f"{folder}/batches/batch={n}" for n in old])
    merge(rows).write.option("compression", "zstd").parquet(f"{folder}/merged")
    for n in old:
        scratch.remove(spark, f"{folder}/batches/batch={n}")
    scratch.rename(spark, f"{folder}/merged", f"{folder}/batches/batch={old[-1]}")
    return len(old)
