"""Queries for small operators that no other query runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import naturalness, patterns, stores, testevents
from ..sources import reports, text
from .catalogue import _query, table
from .recorded import _STREAM, _streams

_said = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])


@_query("q113_streams_with_tests", f"WITH {_STREAM} SELECT path, bool_or(event_type <> 'click') AS has_tests FROM st GROUP BY path")
def q113(spark: SparkSession, d: str) -> DataFrame:
    return text.has_tests(_streams(spark, d))


@_query("q114_config_errors", """SELECT p_partkey AS place, array_to_string(list_filter([CASE WHEN p_size % 5 < 1 THEN 'max_retries must be >= 1' END, CASE WHEN p_retailprice / 15 > 100 THEN 'coverage_threshold must be 0-100' END,
    CASE WHEN p_size < 10 THEN 'timeout_seconds must be >= 10' END, CASE WHEN p_size % 4 = 3 THEN 'report_format must be one of: text, html, json' END], lambda e: e IS NOT NULL), '; ') AS errors FROM part""")
def q114(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit(""), F.lit("html"), F.lit("json"), F.lit("pdf")), F.col("p_size") % 4 + 1)
    configs = table(spark, d, "part").select(F.col("p_partkey").alias("place"), (F.col("p_size") % 5).alias("max_retries"), (F.col("p_retailprice") / 15).alias("coverage_threshold"), F.col("p_size").alias("timeout_seconds"), kind.alias("report_format"))
    return reports.config_errors(configs).select("place", F.array_join("errors", "; ").alias("errors"))


@_query("q115_test_functions", """SELECT c_custkey, c_custkey % 5 IN (0, 4) AND c_nationkey % 3 = 0 AS is_test, c_custkey % 5 <> 2 AS testable, c_custkey % 4 < 2 AS builtin FROM customer""")
def q115(spark: SparkSession, d: str) -> DataFrame:
    """Functions named TestX, Testx, init, TestMain or Test_x, some with a receiver or other parameters; and type names."""
    k = (F.col("c_custkey") % 5).cast("int")
    name = F.element_at(F.array(_said("Test", F.col("c_mktsegment")), _said("Test", F.lower("c_mktsegment")), F.lit("init"), F.lit("TestMain"), _said("Test_", F.col("c_custkey"))), k + 1)
    kind = F.when(F.col("c_nationkey") % 3 == 1, "*testing.B").otherwise("*testing.T")
    one = F.struct(F.lit("t").alias("name"), kind.alias("type"))
    functions = table(spark, d, "customer").select("c_custkey", name.alias("name"), F.when(F.col("c_nationkey") % 3 == 2, "*S").alias("receiver"), F.array(one).alias("params"),
                                                   F.element_at(F.array(*map(F.lit, ("uintptr", "error", "Error", "pkg.string"))), (F.col("c_custkey") % 4).cast("int") + 1).alias("type"))
    from ..sources import gosource

    kept = gosource.testable(functions).select(F.col("c_custkey").alias("k"), F.lit(True).alias("testable"))
    out = functions.select("c_custkey", naturalness.is_test_function(F.col("name"), F.col("receiver"), F.col("params")).alias("is_test"), scalars.is_builtin(F.col("type")).alias("builtin"))
    return out.join(kept, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", "is_test", F.coalesce("testable", F.lit(False)).alias("testable"), "builtin")


@_query("q116_validation_summaries", """SELECT p_partkey, p_size % 4 NOT IN (0, 1) AS valid, CASE p_size % 4 WHEN 0 THEN '❌ Compilation error:' || chr(10) || p_name WHEN 1 THEN '⚠️  Tests failed (' || p_size || ' passed, 2 failed):' || chr(10) || p_type
    WHEN 2 THEN '⚠️  Tests passed but DATA RACE detected (' || p_size || ' passed, 1.5s):' || chr(10) || p_brand ELSE '✅ All tests passed (' || p_size || ' passed, 1.5s)' END AS summary FROM part""")
def q116(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 4
    r = table(spark, d, "part").select("p_partkey", (k != 0).alias("compile_ok"), (k > 1).alias("tests_ok"), (k == 2).alias("has_races"), F.col("p_size").alias("passed"), F.lit(2).alias("failed"), F.lit("1.5s").alias("duration"),
                                       F.col("p_name").alias("compile_error"), F.col("p_type").alias("test_error"), F.col("p_brand").alias("races"))
    return r.select("p_partkey", testevents.is_valid(r["compile_ok"], r["tests_ok"]).alias("valid"), testevents.validation_summary(r).alias("summary"))


@_query("q117_case_names", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '<unnamed>' ELSE p_name END AS name FROM part")
def q117(spark: SparkSession, d: str) -> DataFrame:
    field = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    fields = F.array(field(F.lit("want"), F.col("p_brand")), field(F.when(F.col("p_size") % 3 == 0, "got").otherwise("name"), F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", stores.case_name(fields).alias("name"))


@_query("q118_gotest_assertions", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'equal' WHEN 1 THEN 'error' WHEN 2 THEN 'equal' WHEN 3 THEN 'bool' WHEN 4 THEN 'other' ELSE 'error' END AS kind, doc_id % 6 IN (1, 5) OR doc_id % 6 IN (2, 3, 4) AND doc_id % 5 = 0 AS is_error FROM documents""")
def q118(spark: SparkSession, d: str) -> DataFrame:
    """DeepEqual, NilError, Check of a comparison, of a name, of a call, ErrorType; a message argument is an error now and then."""
    k = (F.col("doc_id") % 6).cast("int")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), k + 1)
    args = F.array(F.lit("t"), pick("x", "f()", "len(x) == 3", "ok", "cmp.Contains(x, y)", "z"), F.when(F.col("doc_id") % 5 == 0, "loadErr").otherwise("msg"))
    calls = table(spark, d, "documents").select("doc_id", F.lit("assert").alias("receiver"), pick("DeepEqual", "NilError", "Check", "Assert", "Check", "ErrorType").alias("method"), args.alias("args"))
    return naturalness.classify(calls, gotest_tools=True).select("doc_id", "kind", "is_error")


@_query("q119_branch_lines", """SELECT c_custkey, array_to_string(list_concat(['Condition: `x > ' || c_nationkey || '`', CASE WHEN c_custkey % 2 = 0 THEN 'Else branch' ELSE 'Else-if: `' || c_mktsegment || '`' END], ['Switch statement', 'Case: `' || c_custkey || '`']), '|') AS branches FROM customer""")
def q119(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.col("c_custkey") % 2 == 0, "} else {").otherwise(_said("} else if ", F.col("c_mktsegment"), " {"))
    body = _said("\tif x > ", F.col("c_nationkey"), " {\n\t\ty()\n\t", other, "\n\t}\n\tswitch x {\n\tcase ", F.col("c_custkey"), ":\n\t}\n")
    return table(spark, d, "customer").select("c_custkey", F.array_join(patterns.branch_lines(body), "|").alias("branches"))


@_query("q120_report_files", """SELECT 'out/testgen-report-' || strftime(TIMESTAMP '2024-01-01' + to_seconds((o_orderkey * 37)::BIGINT), '%Y-%m-%d-%H%M%S') || '.json' AS path, 'p' || o_custkey AS project, o_totalprice AS duration FROM orders
    UNION ALL SELECT 'out/n' || n_nationkey || '/repo.json', n_name, n_regionkey FROM nation""")
def q120(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs, nations as repositories: their JSON is written and its paths and values read back."""
    o, n = table(spark, d, "orders"), table(spark, d, "nation")
    at = F.timestamp_seconds(F.col("o_orderkey") * 37 + 1_704_067_200)  # from 2024 on, UTC
    runs = reports.report_texts(o.select(_said("p", F.col("o_custkey")).alias("project_name"), at.alias("timestamp"), F.col("o_totalprice").alias("duration_seconds")), "out")
    repos = reports.repo_manifests(n.select(F.struct(_said("n", F.col("n_nationkey")).alias("name"), F.col("n_name").alias("url")).alias("repo"), F.col("n_regionkey").cast("double").alias("duration")), "out")
    a = runs.select("path", F.from_json("value", "project_name string, duration_seconds double").alias("r")).select("path", F.col("r.project_name").alias("project"), F.col("r.duration_seconds").alias("duration"))
    b = repos.select("path", F.from_json("value", "repo struct<name: string, url: string>, duration double").alias("r")).select("path", F.col("r.repo.url").alias("project"), F.col("r.duration").alias("duration"))
    return a.unionByName(b)
