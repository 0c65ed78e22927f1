"""Which of many texts start or end with which of many others, by an ordered merge."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch


def starting_with(texts: DataFrame, starts: DataFrame) -> DataFrame:
    """(text, start) of each different text (text) with each of the starts (start) that it begins with.

    Both are sorted as one; the starts of a text are then among those that stand before it and that are still open, each the
    beginning of the next. A partition of the sort begins with those that its first row has in earlier ones, so what has to be
    looked up are the beginnings of one row a partition. Nothing is compared that isn't in the result.
    """
    given = texts.where("text is not null").select(F.col("text").alias("r"), F.lit(True).alias("is_text")).distinct()
    marked = starts.where("start is not null").select(F.col("start").alias("r"), F.lit(False).alias("is_text")).distinct()
    rows = scratch.stage(given.unionByName(marked).orderBy("r", "is_text").select("r", "is_text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "affixes")
    first = rows.groupBy("part").agg(F.min_by("r", "at").alias("r"))
    beginnings = first.select("part", F.explode(F.transform(F.sequence(F.lit(0), F.length("r")), lambda n: F.left("r", n))).alias("r"))
    before = beginnings.join(marked.select("r"), "r").groupBy("part").agg(F.array_sort(F.collect_set(F.struct(F.length("r").alias("n"), "r"))).alias("opened"))
    opened = {r.part: [x.r for x in r.opened] for r in before.collect()}  # of one row a partition

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []
        for batch in batches:
            found, of = [], []
            for r, is_text, now in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now != part:
                    part, stack = now, list(opened.get(now, ()))
                while stack and not r.startswith(stack[-1]):
                    stack.pop()
                if is_text:
                    found += [r] * len(stack)
                    of += stack
                elif not stack or stack[-1] != r:
                    stack.append(r)
            yield pa.record_batch([pa.array(found, pa.string()), pa.array(of, pa.string())], names=["text", "start"])

    dealt = rows.repartition("part").sortWithinPartitions("part", "at").select("r", "is_text", "part")
    return dealt.mapInArrow(walk, "text string, start string")


def ending_with(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """(text, end) of each different text (text) with each of the ends (end) that it ends with: the same, turned round."""
    found = starting_with(texts.select(F.reverse("text").alias("text")), ends.select(F.reverse("end").alias("start")))
    return found.select(F.reverse("text").alias("text"), F.reverse("start").alias("end"))
