"""Experiment metrics: means per configuration, repository x configuration matrices, totals of a run.

Three mean rules live side by side on purpose: ratio of sums, mean over positive values, mean over non-null values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import config_rank, percent
from ..sources.schemas import COUNTERS, METRICS

#: Every metric of a matrix, in order of presentation.
ALL_METRICS = (*METRICS, "duration_sec", "tests_validated")


def average_per_config(runs: DataFrame, counters: tuple[str, ...] = COUNTERS, sums: tuple[str, ...] = ("duration_sec",), metrics: tuple[str, ...] = METRICS, config: str = "config") -> DataFrame:
    """One row a configuration: sums of counters, null-skipping means of metrics, ordered by rank then name."""
    added = [F.sum(c).alias(c) for c in (*counters, *sums)]
    means = [F.avg(m).alias(m) for m in metrics]
    return runs.groupBy(config).agg(*added, *means).orderBy(config_rank(F.col(config)), config)


def unpivot_metrics(runs: DataFrame, ids: tuple[str, ...] = ("repo", "config"), metrics: tuple[str, ...] = ALL_METRICS) -> DataFrame:
    """(ids, metric, value) with nulls kept."""
    values = runs.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return values.unpivot(list(ids), list(metrics), "metric", "value")


def ranked_configs(runs: DataFrame, config: str = "config") -> list[str]:
    """Configurations in column order; their number is that of the configurations, not of the runs."""
    names = runs.select(config).distinct().orderBy(config_rank(F.col(config)), config)
    return [r[0] for r in names.toLocalIterator()]


def build_matrix(runs: DataFrame, metric: str, configs: list[str] | None = None, repo: str = "repo", config: str = "config", order: str = "seq") -> DataFrame:
    """repo x configuration of one metric; of several runs of a cell the last one counts."""
    configs = ranked_configs(runs, config) if configs is None else configs
    return runs.groupBy(repo).pivot(config, configs).agg(F.max_by(metric, order)).orderBy(repo)


def all_matrices(runs: DataFrame, configs: list[str], order: str = "seq", metrics: tuple[str, ...] = ALL_METRICS) -> DataFrame:
    """(metric, repo, configs...) for every metric in one pass: unpivot, then one pivot."""
    long = unpivot_metrics(runs, ("repo", "config", order), metrics)
    return long.groupBy("metric", "repo").pivot("config", configs).agg(F.max_by("value", order)).orderBy("metric", "repo")


def build_totals(files: DataFrame) -> DataFrame:
    """One row of totals over file rows: sums, mean of positive diff coverage, ratios of sums, unweighted naturalness means."""
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    tested = F.col("naturalness.test_count") > 0
    nat = ("assertion_ratio", "no_assertions_pct", "duplicate_assertions_pct", "nil_only_assertions_pct", "error_assertions_pct", "test_name_score", "var_name_score")
    sums = {n: total(n) for n in ("tests_total", "tests_passed", "mutation_killed", "mutation_total", "branches_covered", "branches_total", "error_paths_covered", "error_paths_total", "prompt_tokens", "completion_tokens")}
    out = files.agg(
        F.count("*").cast("int").alias("files_processed"), *[c.alias(n) for n, c in sums.items()],
        F.avg(F.when(F.col("diff_coverage_pct") > 0, F.col("diff_coverage_pct"))).alias("diff_coverage_pct"),
        F.sum(F.when(tested, F.col("naturalness.test_count"))).alias("test_count"), *[F.avg(F.when(tested, F.col(f"naturalness.{n}"))).alias(n) for n in nat])
    rate = lambda a, b: percent(F.col(a), F.nullif(F.col(b), F.lit(0)))
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    return (out.withColumnsRenamed({"tests_total": "tests_generated", "tests_passed": "tests_validated"})
            .withColumn("mutation_score_pct", rate("mutation_killed", "mutation_total")).withColumn("branch_coverage_pct", rate("branches_covered", "branches_total"))
            .withColumn("error_path_coverage_pct", rate("error_paths_covered", "error_paths_total"))
            .withColumn("token_efficiency_tokens_per_test", F.when((tokens > 0) & (F.col("tests_validated") > 0), tokens / F.col("tests_validated"))))


def file_status(success: Column, diff_coverage: Column, target: Column) -> Column:
    """failed without success; partial below the coverage target if any was measured; else success."""
    return F.when(~success, "failed").when((diff_coverage < target) & (diff_coverage > 0), "partial").otherwise("success")


def file_report(files: DataFrame, target: float = 80.0) -> DataFrame:
    """status, and tokens per validated test (0 if none), of each file."""
    spent = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return (files.withColumn("status", file_status(F.col("tests_passed") > 0, F.col("diff_coverage_pct"), F.lit(target)))
            .withColumn("token_efficiency_tokens_per_test", F.coalesce(F.try_divide(spent.cast("double"), F.col("tests_passed").cast("double")), F.lit(0.0))))


def run_outcomes(records: DataFrame) -> DataFrame:
    """Runs that ended well and badly."""
    return records.agg(F.count_if(F.col("exit_code") == 0).alias("ok"), F.count_if(F.col("exit_code") != 0).alias("failed"))


def run_plan(repos: DataFrame, configs: DataFrame) -> DataFrame:
    """Every repository with every configuration: a list of runs to start. Spark broadcasts a side only if it is small."""
    return repos.crossJoin(configs)


def select_configs(configs: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Configurations in the order asked for, and the names that don't exist."""
    asked = configs.sparkSession.createDataFrame(list(enumerate(names)), "place int, name string")
    found = asked.join(configs, "name").orderBy("place").drop("place")
    return found, [r["name"] for r in asked.join(configs, "name", "left_anti").orderBy("place").collect()]
