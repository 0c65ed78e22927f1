"""A training corpus from `documents`: low quality out, exact and near copies out, benchmark passages out, then token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents, whatever their names; repeated rows are rows of their own.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import common, decontaminate, exactdedup, jaccard, quality, sentencepiece_codec
from plumbline.llm.queries import tokenizer_file


def _stage(f):
    """A stage; before it starts, tables of earlier ones go, if no DataFrame can read them any more."""
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.sweep(spark)
        return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the classifier rejects go; it is fitted on labelled documents of this stage's input.

    Null and empty texts and those of any length have a score too; equal texts share a fate; an empty table gives no rows.
    """
    return quality.keep(docs, common.read(spark, sf_dir, "labels"))


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of equal texts the one with the smallest doc_id stays, null ids last, ties by place; null counts as empty."""
    return exactdedup.deduplicate(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each component of similar texts (shingles of five words, similarity 0.8) the document with the smallest
    doc_id stays, null ids last, ties by place; texts without words all stay, whatever their ids."""
    return jaccard.deduplicate(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold benchmark passages go; null and empty texts, and an empty benchmark, lose nothing."""
    return decontaminate.remove(docs, common.read(spark, sf_dir, "benchmark"))


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token ids of what is left, as counts and digests; null and empty texts have none."""
    return sentencepiece_codec.digests(docs, tokenizer_file(spark))


STAGES = [("quality", quality_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]
#: A trained classifier has no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = common.stage(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
