"""Run reports, the function cache and benchmark datasets: JSON with explicit schemas, YAML read by the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

#: Files beside reports that are not reports.
NOT_REPORTS = ("index.json", "repo.json")


def _flat(raw: DataFrame) -> DataFrame:
    """One flat row a report; totals that are missing are null, the configuration falls back to the file's name."""
    stem = F.regexp_replace("file_name", r"\.json$", "")
    n = "totals.naturalness"
    named = {"diff_cov_pct": "totals.diff_coverage_pct", "branch_cov_pct": "totals.branch_coverage_pct", "error_path_cov_pct": "totals.error_path_coverage_pct", "mutation_pct": "totals.mutation_score_pct",
             "token_efficiency": "totals.token_efficiency_tokens_per_test", "assertion_ratio": f"{n}.assertion_ratio", "no_assertions_pct": f"{n}.no_assertions_pct", "nil_only_pct": f"{n}.nil_only_assertions_pct",
             "error_asserts_pct": f"{n}.error_assertions_pct", "test_name_score": f"{n}.test_name_score", "var_name_score": f"{n}.var_name_score"}
    counters = [F.coalesce(f"totals.{c}", F.lit(0)).alias(c) for c in schemas.COUNTERS]
    return raw.select("repo", F.coalesce(F.nullif("config.ablation_config", F.lit("")), stem).alias("config"), *counters, F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_sec"), *[F.col(v).alias(k) for k, v in named.items()], "seq")


def parse_reports(texts: DataFrame) -> DataFrame:
    """Reports held as texts (path, value): the columns of a report, with repo, file_name and seq out of the path."""
    rows = texts.select(F.from_json("value", schemas.RUN).alias("r"), F.col("path").alias("seq")).where("r is not null")
    return rows.select("r.*", "seq", F.split_part("seq", F.lit("/"), F.lit(-1)).alias("file_name"), F.split_part("seq", F.lit("/"), F.lit(-2)).alias("repo")).where(~F.col("file_name").isin(*NOT_REPORTS))


def flat_reports(texts: DataFrame) -> DataFrame:
    """Flat rows of reports held as texts."""
    return _flat(parse_reports(texts))


def files_of(raw: DataFrame) -> DataFrame:
    """File rows of reports, without those left empty by cached or dry runs."""
    return raw.select("repo", F.explode("files").alias("f")).select("repo", "f.*").where("file <> ''")


def report_texts(runs: DataFrame, folder: str) -> DataFrame:
    """(path, value): each run (the columns of schemas.RUN) as JSON below folder, named by its timestamp to the second, UTC."""
    name = F.concat(F.lit(f"{folder}/testgen-report-"), F.date_format(F.to_utc_timestamp("timestamp", F.current_timezone()), "yyyy-MM-dd-HHmmss"), F.lit(".json"))
    return runs.select(name.alias("path"), F.to_json(F.struct(*runs.columns)).alias("value"))


def repo_manifests(results: DataFrame, out: str) -> DataFrame:
    """(path, value): the result of each repository (repo with a name, clone_dir, agent_dir, runs, error, duration) as JSON."""
    return results.select(F.concat(F.lit(f"{out}/"), "repo.name", F.lit("/repo.json")).alias("path"), F.to_json(F.struct(*results.columns)).alias("value"))


def _reports(spark: SparkSession, pattern: str) -> DataFrame:
    raw = spark.read.schema(schemas.RUN).option("multiLine", True).json(pattern)
    raw = raw.withColumn("file_name", F.col("_metadata.file_name")).withColumn("seq", F.col("_metadata.file_path"))
    return raw.where(~F.col("file_name").isin(*NOT_REPORTS)).withColumn("repo", F.split_part("seq", F.lit("/"), F.lit(-2)))


def load_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Flat rows of the reports of one folder, by rank of configuration."""
    from ..functions.scalars import config_rank

    return _flat(_reports(spark, f"{folder}/*.json")).orderBy(config_rank(F.col("config"), 100), "config")


def load_all(spark: SparkSession, out: str) -> DataFrame:
    """Flat rows of <out>/<repo>/<config>.json, by repository."""
    return _flat(_reports(spark, f"{out}/*/*.json")).orderBy("repo", "config")


def report_files(spark: SparkSession, pattern: str) -> DataFrame:
    """files_of the reports of a folder."""
    return files_of(_reports(spark, pattern))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")


def latest_report(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the report modified last."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.json").select("path", "modificationTime")
    return latest(files, [], "modificationTime").select("path")


# --- cache -------------------------------------------------------------------------------------------------------------


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, hash, test_file, generated_funcs, model, timestamp); a missing or broken store is empty."""
    empty = spark.createDataFrame([], "key string, hash string, test_file string, generated_funcs array<string>, model string, timestamp timestamp")
    try:
        raw = spark.read.schema(schemas.CACHE).option("multiLine", True).json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise
    rows = raw.where("entries is not null").select(F.explode("entries").alias("key", "e")).select("key", "e.*")
    return empty.unionByName(rows)


def _entries(cache: DataFrame, *by: str) -> DataFrame:
    """A store's entries as one map a group."""
    entry = F.struct("hash", "test_file", "generated_funcs", "model", "timestamp")
    return cache.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("key", entry))).alias("entries"))


def cache_texts(cache: DataFrame, by: str) -> DataFrame:
    """(path, value): a store's JSON for each value of a column, as stores are one file a project."""
    return _entries(cache, by).select(F.col(by).alias("path"), F.to_json(F.struct("entries")).alias("value"))


def parse_cache(texts: DataFrame) -> DataFrame:
    """Entries of stores held as texts (path, value); a broken one is empty."""
    rows = texts.select(F.from_json("value", schemas.CACHE).alias("c")).where("c.entries is not null")
    return rows.select(F.explode("c.entries").alias("key", "e")).select("key", "e.*")


def save_cache(cache: DataFrame, path: str) -> None:
    """Write the whole store, which is one JSON document, to a new place; the caller swaps it in."""
    _entries(cache).coalesce(1).write.mode("overwrite").json(path)


# --- datasets and configuration ----------------------------------------------------------------------------------------

DATASET = "name string, url string, base string, head string, subdir string, exclude array<string>"


def dataset_errors(repos: DataFrame) -> Column | DataFrame:
    """(place, error) of the first broken constraint of each repository, in the order of checks."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    from pyspark.sql import Window

    w = Window.partitionBy("name").orderBy("place")
    rows = repos.withColumn("again", F.row_number().over(w) > 1)
    error = (F.when(blank("name"), "name is required").when(F.col("name").rlike(r"[/\\]"), "name must not contain path separators").when(blank("url"), "url is required")
             .when(blank("base"), "base is required").when(blank("head"), "head is required").when(F.col("again"), "duplicate name"))
    return rows.select("place", error.alias("error")).where("error is not null").orderBy("place")


def config_errors(configs: DataFrame) -> DataFrame:
    """(place, errors) of every configuration (place, max_retries, coverage_threshold, timeout_seconds, report_format), in the
    order of checks; errors is empty for good ones."""
    formats = F.coalesce("report_format", F.lit("")).isin("", "text", "html", "json")
    checks = ((F.col("max_retries") < 1, "max_retries must be >= 1"), (~F.col("coverage_threshold").between(0, 100), "coverage_threshold must be 0-100"),
              (F.col("timeout_seconds") < 10, "timeout_seconds must be >= 10"), (~formats, "report_format must be one of: text, html, json"))
    return configs.select("place", F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks])).alias("errors"))


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(repos, workdir) of a YAML dataset; a relative workdir is below the file's folder. Raises on the first broken constraint."""
    data = read_yaml(Path(path).read_text())
    repos = data.get("repos") or []
    if not repos:
        raise ValueError("dataset has no repos")
    rows = [(i, *[r.get(k) for k in ("name", "url", "base", "head", "subdir")], _as_list(r.get("exclude"))) for i, r in enumerate(repos)]
    df = spark.createDataFrame(rows, f"place int, {DATASET}")
    if bad := dataset_errors(df).first():
        raise ValueError(f"repo {bad['place']}: {bad['error']}")
    workdir = data.get("workdir") or "./benchmark-work"
    return df.drop("place"), workdir if workdir.startswith("/") else str(Path(path).parent / workdir)


def _as_list(value) -> list[str]:
    """Scalar or list."""
    return [] if value is None else [value] if isinstance(value, str) else [str(x) for x in value]


@dataclass
class Config:
    model: str = ""
    coverage_threshold: float = 80.0
    max_retries: int = 3
    timeout_seconds: int = 60
    report_format: str = "text"
    exclude: list[str] = field(default_factory=list)
    include_only: list[str] = field(default_factory=list)

    def errors(self) -> list[str]:
        checks = ((self.max_retries < 1, "max_retries must be >= 1"), (not 0 <= self.coverage_threshold <= 100, "coverage_threshold must be 0-100"),
                  (self.timeout_seconds < 10, "timeout_seconds must be >= 10"), (self.report_format not in ("", "text", "html", "json"), "report_format must be one of: text, html, json"))
        return [text for bad, text in checks if bad]


def load_config(folder: str, name: str = ".plumbline.yml") -> Config:
    """The nearest file from the folder upwards; absent and zero values keep their defaults."""
    out = Config()
    for place in (Path(folder).resolve(), *Path(folder).resolve().parents):
        if (place / name).is_file():
            data = read_yaml((place / name).read_text())
            for f in fields(Config):
                value = data.get(f.name)
                if f.name in ("exclude", "include_only"):
                    setattr(out, f.name, _as_list(value))
                elif value not in (None, 0, ""):
                    setattr(out, f.name, value)
            break
    return out


def read_yaml(text: str) -> dict:
    """YAML by the library where there is one, else the subset that these files use: nested maps, lists and scalars."""
    try:
        import yaml
    except ImportError:
        lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]
        return _block(lines, 0, 0)[0] if lines else {}
    return yaml.safe_load(text) or {}


def _scalar(text: str):
    text = re.sub(r"\s+#.*$", "", text).strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return float(text) if re.fullmatch(r"-?\d+\.\d+", text) else None if text in ("", "null", "~") else text


def _block(lines: list[tuple[int, str]], at: int, indent: int):
    is_list = lines[at][1].startswith("- ")
    out = [] if is_list else {}
    while at < len(lines) and lines[at][0] >= indent:
        depth, text = lines[at]
        if is_list:
            if not text.startswith("-"):
                break
            rest = text[1:].strip()
            if re.match(r"[\w.-]+:(\s|$)", rest):
                inner = [(depth + 2, rest)]
                at += 1
                while at < len(lines) and lines[at][0] > depth:
                    inner.append((max(lines[at][0], depth + 2), lines[at][1]))
                    at += 1
                out.append(_block(inner, 0, depth + 2)[0])
            else:
                out.append(_scalar(rest))
                at += 1
            continue
        key, _, rest = text.partition(":")
        if rest.strip():
            out[key.strip()] = _scalar(rest)
            at += 1
        elif at + 1 < len(lines) and (lines[at + 1][0] > depth or lines[at + 1][0] == depth and lines[at + 1][1].startswith("- ")):
            out[key.strip()], at = _block(lines, at + 1, lines[at + 1][0])
        else:
            out[key.strip()] = None
            at += 1
    return out, at
