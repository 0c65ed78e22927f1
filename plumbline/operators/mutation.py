"""Mutants: operator tables, scores and their summary by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent

#: Operators and what replaces them, by kind of mutation, and literals of return statements.
SWAPS = {"arithmetic": {"+": "-", "-": "+", "*": "/", "/": "*"}, "comparison": {"<": "<=", "<=": "<", ">": ">=", ">=": ">", "==": "!=", "!=": "=="}, "logical": {"&&": "||", "||": "&&"}}
RETURNS = {"nil": 'fmt.Errorf("mutant")', "true": "false", "false": "true", "0": "1", "1": "0", '""': '"mutant"'}
KINDS = ("arithmetic", "comparison", "logical", "cond_negate", "return")


def by_type(mutants: DataFrame) -> DataFrame:
    """(type, killed, total, score) without mutants in error, kinds in their fixed order, others after them by name."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("type"))
    sums = mutants.where(F.coalesce("error", F.lit("")) == "").groupBy("type").agg(F.count_if("killed").alias("killed"), F.count("*").alias("total"))
    return sums.withColumn("score", percent(F.col("killed"), F.col("total"), 0)).orderBy(F.when(place == 0, len(KINDS) + 1).otherwise(place), "type")


def score(mutants: DataFrame) -> DataFrame:
    """(total, killed, survived, errors, score): killed of those without error; 0 without any."""
    bad = F.coalesce("error", F.lit("")) != ""
    sums = mutants.agg(F.count("*").alias("total"), F.count_if(F.col("killed") & ~bad).alias("killed"), F.count_if(~F.col("killed") & ~bad).alias("survived"), F.count_if(bad).alias("errors"))
    return sums.withColumn("score", percent(F.col("killed"), F.col("total") - F.col("errors"), 0))


def replacement(kind: Column, original: Column) -> Column:
    """What a mutation puts in place of an operator or literal; null if there is none."""
    table = F.create_map(*[F.lit(x) for swaps in SWAPS.values() for kv in swaps.items() for x in kv])
    literals = F.create_map(*[F.lit(x) for kv in RETURNS.items() for x in kv])
    return F.when(kind == "return", F.try_element_at(literals, original)).when(kind == "cond_negate", F.lit("")).otherwise(F.try_element_at(table, original))


def kind_of(operator: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kind, swaps in SWAPS.items() for op in swaps for x in (op, kind)])
    return F.coalesce(F.try_element_at(table, operator), F.lit("other"))
