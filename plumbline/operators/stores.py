"""Comparing and merging keyed sets: change classification, the function cache, dedup of table cases, merging of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions.scalars import function_key

# --- change classification ---------------------------------------------------------------------------------------------


def classify(current: DataFrame, base: DataFrame, key: list[str], body: str = "body", order: str = "pos") -> DataFrame:
    """current with status new, unchanged or changed; of several base rows with one key the last counts."""
    last = base.groupBy(*key).agg(F.max_by(F.col(body), F.col(order)).alias("_base"), F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), "new").when(F.col(body).eqNullSafe(F.col("_base")), "unchanged").otherwise("changed")
    return current.join(last.hint("merge"), key, "left").withColumn("status", status)  # versions are as large as each other.drop("_base", "_known")


def needs_tests(classified: DataFrame) -> DataFrame:
    """Changed functions first, then new ones; those of one place are dealt by their values, so no task sorts them all."""
    plain = [f.name for f in classified.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    rows = classified.where("status <> 'unchanged'").withColumns({"_o": F.when(F.col("status") == "changed", 0).otherwise(1), "_h": F.xxhash64(*plain)})
    return rows.orderBy("_o", "pos", "_h").drop("_o", "_h")


def with_function_key(functions: DataFrame) -> DataFrame:
    return functions.withColumn("key", function_key(F.col("receiver"), F.col("name")))


# --- cache -------------------------------------------------------------------------------------------------------------


def lookup(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of wanted (key, hash): both must be equal."""
    keys = cache.select("key", "hash").distinct()
    return wanted.join(keys, ["key", "hash"], "left_semi"), wanted.join(keys, ["key", "hash"], "left_anti")


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """cache with entries in place of those with the same key; of several new ones the last by timestamp."""
    columns = cache.columns
    newest = entries.groupBy("key").agg(F.max_by(F.struct(*columns), F.struct("timestamp", F.to_json(F.struct(*columns)))).alias("e")).select("e.*")
    return cache.join(newest.select("key"), "key", "left_anti").select(*columns).unionByName(newest)


def remove(cache: DataFrame, key: str) -> DataFrame:
    return cache.where(F.col("key") != key)


def invalidate(cache: DataFrame, path: str) -> DataFrame:
    """Without the entries of a file: keys that start with its path."""
    return cache.where(~F.col("key").startswith(path.replace("\\", "/") + "::"))


def prune(cache: DataFrame, now: Column, days: int) -> DataFrame:
    return cache.where(F.col("timestamp") >= now - F.make_dt_interval(F.lit(days)))


def stats(cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return cache.agg(F.count("*").alias("total"), F.count_if(F.col("timestamp") < now - F.make_dt_interval(F.lit(days))).alias("expired"))


# --- dedup -------------------------------------------------------------------------------------------------------------


def case_fingerprint(fields: Column) -> Column:
    """key=value of every field but name, joined by |; positional values as they are. fields: array<struct<key, value>>."""
    kept = F.filter(fields, lambda f: ~f["key"].eqNullSafe(F.lit("name")))
    return F.array_join(F.transform(kept, lambda f: F.when(F.coalesce(f["key"], F.lit("")) == "", f["value"]).otherwise(F.concat(f["key"], F.lit("="), f["value"]))), "|")


def case_name(fields: Column) -> Column:
    return F.coalesce(F.get(F.filter(fields, lambda f: f["key"] == "name"), 0)["value"], F.lit("<unnamed>"))


def keep_first(rows: DataFrame, groups: list[str], fingerprint: Column, order: str = "idx") -> DataFrame:
    """rows with `kept`: the first of each fingerprint in its group stays."""
    w = Window.partitionBy(*groups, fingerprint).orderBy(order)
    return rows.withColumn("kept", F.row_number().over(w) == 1)


# --- merging -----------------------------------------------------------------------------------------------------------


def merge_imports(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """(path, alias) of both, the existing alias first."""
    e, g = existing.select("path", F.col("alias").alias("ea")), generated.select("path", F.col("alias").alias("ga"))
    both = e.withColumn("known", F.lit(True)).join(g, "path", "full_outer")
    return both.select("path", F.when(F.col("known"), F.col("ea")).otherwise(F.col("ga")).alias("alias")).orderBy("path")


def new_names(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """Generated names that do not exist yet, in order, repeats kept."""
    return generated.join(existing.select("name").distinct(), "name", "left_anti").orderBy("pos")
