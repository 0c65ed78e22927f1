"""Queries over the driver's tables, one per operator, with the SQL that checks each.

The tables hold no code-change data, so each query feeds an operator with columns in the same roles: an order is a file, its
lines are source lines, a user's events are a test run, a market segment or event type is a configuration.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import globs, scalars
from ..operators import coverage, graphs, metrics, patterns, stores, testevents
from ..sources import reports, text

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name], _ORACLE[name] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    from . import gosources, recorded, rest, scale, streams  # noqa: F401  (they add their queries to these)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLE)


# --- metrics -----------------------------------------------------------------------------------------------------------

#: FNV-1a of a string as DuckDB SQL.
_FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, strlen({0}) + 1), lambda i: ascii(substr({0}, i, 1))::UBIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
_RANK = "CASE {0} " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(scalars.CONFIG_NAMES)) + " ELSE 1000 + (" + _FNV + ") % 1000 END"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """events as runs: configuration = event type, counter = user_id mod 7, metrics missing where they are large."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("config"), (F.col("user_id") % 7).alias("gen"), (F.col("user_id") % 3).alias("val"),
        F.when(F.col("value") <= 100, F.col("value")).alias("cov"), F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("mut"))


@_query("q01_average_per_config", """
    SELECT event_type AS config, sum(user_id % 7)::BIGINT AS gen, sum(user_id % 3)::BIGINT AS val,
           avg(CASE WHEN value <= 100 THEN value END) AS cov, avg(CASE WHEN user_id % 2 = 0 THEN value END) AS mut
    FROM events GROUP BY event_type""")
def q01(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_per_config(_runs(spark, d), counters=("gen", "val"), sums=(), metrics=("cov", "mut"))


_STATUSES = ["F", "O", "P"]


@_query("q02_build_matrix", """
    SELECT n_name AS repo, """ + ", ".join(f"arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = '{s}') AS \"{s}\"" for s in _STATUSES) + """
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def q02(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    runs = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("repo"), F.col("o_orderstatus").alias("config"), F.col("o_orderkey").alias("seq"), "o_totalprice")
    return metrics.build_matrix(runs, "o_totalprice", _STATUSES)


@_query("q03_build_totals", """
    SELECT count(*)::INTEGER AS files_processed, sum(l_linenumber)::BIGINT AS tests_generated, sum(l_linenumber % 3)::BIGINT AS tests_validated,
           avg(CASE WHEN l_discount > 0 THEN l_discount END) AS diff_coverage_pct,
           sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END), 0)::DOUBLE * 100.0 AS mutation_score_pct,
           NULL::DOUBLE AS branch_coverage_pct, avg(CASE WHEN l_linenumber > 2 THEN l_tax END) AS assertion_ratio,
           sum(l_linenumber) / sum(l_linenumber % 3)::DOUBLE AS token_efficiency_tokens_per_test
    FROM lineitem""")
def q03(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: c.cast("int")
    zero, none = F.lit(0), F.lit(None).cast("double")
    nat = F.struct(F.when(F.col("l_linenumber") > 2, 1).otherwise(0).alias("test_count"), F.col("l_tax").alias("assertion_ratio"),
                   *[none.alias(n) for n in ("no_assertions_pct", "duplicate_assertions_pct", "nil_only_assertions_pct", "error_assertions_pct", "test_name_score", "var_name_score")])
    files = table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("tests_total"), (F.col("l_linenumber") % 3).alias("tests_passed"), F.col("l_discount").alias("diff_coverage_pct"),
        one(F.col("l_returnflag") == "R").alias("mutation_killed"), one(F.col("l_linestatus") == "F").alias("mutation_total"),
        zero.alias("branches_covered"), zero.alias("branches_total"), zero.alias("error_paths_covered"), zero.alias("error_paths_total"),
        F.col("l_linenumber").cast("bigint").alias("prompt_tokens"), F.lit(0).cast("bigint").alias("completion_tokens"), nat.alias("naturalness"))
    return metrics.build_totals(files).select("files_processed", "tests_generated", "tests_validated", "diff_coverage_pct", "mutation_score_pct", "branch_coverage_pct", "assertion_ratio", "token_efficiency_tokens_per_test")


@_query("q04_unpivot_metrics", """
    SELECT p_brand AS config, metric, avg(value) AS value, count(value) AS n FROM (
      SELECT p_brand, 'p_size' AS metric, CASE WHEN p_size > 10 THEN p_size::DOUBLE END AS value FROM part
      UNION ALL SELECT p_brand, 'p_retailprice', p_retailprice FROM part) GROUP BY ALL""")
def q04(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("config"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"), "p_retailprice")
    return metrics.unpivot_metrics(p, ("config",), ("p_size", "p_retailprice")).groupBy("config", "metric").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


@_query("q34_all_matrices", """
    SELECT metric, repo, arg_max_null(value, seq) FILTER (config = 'FURNITURE') AS "FURNITURE", arg_max_null(value, seq) FILTER (config = 'BUILDING') AS "BUILDING" FROM (
      SELECT n_name AS repo, c_mktsegment AS config, c_custkey AS seq, 'bal' AS metric, c_acctbal AS value FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT n_name, c_mktsegment, c_custkey, 'half', CASE WHEN c_acctbal > 0 THEN c_acctbal / 2 END FROM customer JOIN nation ON c_nationkey = n_nationkey)
    GROUP BY metric, repo""")
def q34(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    runs = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("repo"), F.col("c_mktsegment").alias("config"), F.col("c_custkey").alias("seq"), F.col("c_acctbal").alias("bal"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 2).alias("half"))
    return metrics.all_matrices(runs, ["FURNITURE", "BUILDING"], metrics=("bal", "half"))


@_query("q25_file_report", """
    SELECT o_orderkey, CASE WHEN p = 0 THEN 'failed' WHEN c < 80 AND c > 0 THEN 'partial' ELSE 'success' END AS status,
           coalesce(o_totalprice / nullif(p, 0), 0) AS per_test FROM (
      SELECT o_orderkey, o_totalprice, count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*)::DOUBLE * 100.0 AS c, count(*) FILTER (l_returnflag = 'N') AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)""")
def q25(spark: SparkSession, d: str) -> DataFrame:
    o, i = table(spark, d, "orders"), table(spark, d, "lineitem")
    covered = scalars.percent(F.count_if(F.col("l_returnflag") == "R"), F.count("*"), 100)
    tests = i.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(covered.alias("diff_coverage_pct"), F.count_if(F.col("l_returnflag") == "N").alias("tests_passed"))
    files = o.select("o_orderkey", F.col("o_totalprice").alias("prompt_tokens"), F.lit(0).alias("completion_tokens")).join(tests, "o_orderkey")
    return metrics.file_report(files).select("o_orderkey", "status", F.col("token_efficiency_tokens_per_test").alias("per_test"))


@_query("q26_config_rank", f"""
    SELECT n_name, ({_FNV.format('n_name')})::BIGINT AS h, ({_RANK.format('n_name')})::BIGINT AS config_rank FROM nation
    UNION ALL SELECT 'no-types', ({_FNV.format("'no-types'")})::BIGINT, 1 UNION ALL SELECT '', 2166136261, 1261""")
def q26(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select("n_name").union(spark.sql("SELECT * FROM VALUES ('no-types'), ('')"))
    return names.select("n_name", scalars.fnv1a32(F.col("n_name")).alias("h"), scalars.config_rank(F.col("n_name")).cast("bigint").alias("config_rank"))


@_query("q35_run_plan", "SELECT r_name AS repo, n_name AS config FROM region, nation")
def q35(spark: SparkSession, d: str) -> DataFrame:
    return metrics.run_plan(table(spark, d, "region").select(F.col("r_name").alias("repo")), table(spark, d, "nation").select(F.col("n_name").alias("config")))


# --- lines and coverage ------------------------------------------------------------------------------------------------


@_query("q05_line_numbering", """
    SELECT conv_id::VARCHAR AS path, turn, 1 + coalesce(sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_no
    FROM conversations WHERE role <> 'system'""")
def q05(spark: SparkSession, d: str) -> DataFrame:
    """A conversation as a hunk: system turns are deleted lines, which advance no new number."""
    line = F.concat(F.when(F.col("role") == "system", "-").otherwise(" "), F.col("turn").cast("string"))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    diff = turns.select(F.col("conv_id").cast("string").alias("path"), F.concat(F.lit("diff --git a/c b/c\n@@ -1 +1 @@\n"), F.array_join(F.transform("t", lambda t: t["line"]), "\n")).alias("value"))
    return text.diff_lines(diff).where("type <> 'deleted'").select("path", F.col("content").cast("bigint").alias("turn"), F.col("new_no").cast("bigint").alias("new_no"))


@_query("q06_text_lines", """
    SELECT doc_id, i - 1 AS pos, md5(l[i]) AS line_md5 FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l, unnest(range(1, len(string_split_regex(text, '\\r?\\n')) + 1)) AS i FROM documents)""")
def q06(spark: SparkSession, d: str) -> DataFrame:
    rows = text.lines(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("value")))
    return rows.select(F.col("path").alias("doc_id"), F.col("pos").cast("bigint").alias("pos"), F.md5("line").alias("line_md5"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as coverage blocks: from the line's number over a third of its quantity, run if it was returned."""
    i = table(spark, d, "lineitem")
    return i.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + (F.col("l_quantity") % 3).cast("int") - 1).alias("end_line"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("cnt"))


_COVERED = """cov AS (SELECT DISTINCT l_orderkey AS file, unnest(range(l_linenumber, l_linenumber + (l_quantity::INTEGER % 3)::INTEGER)) AS line FROM lineitem WHERE l_returnflag = 'R')"""


@_query("q07_diff_coverage", f"""
    WITH {_COVERED}, ch AS (SELECT o_orderkey AS file, unnest(range(1, 8)) AS line FROM orders)
    SELECT ch.file, count(*) AS total, count(cov.line) AS hit, count(cov.line)::DOUBLE / count(*)::DOUBLE * 100.0 AS pct FROM ch LEFT JOIN cov USING (file, line) GROUP BY ch.file""")
def q07(spark: SparkSession, d: str) -> DataFrame:
    changed = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("line"))
    return coverage.diff_coverage(changed, coverage.covered_lines(_blocks(spark, d))).select("file", "total", "hit", "pct")


@_query("q08_functions_by_lines", """
    SELECT o_orderkey AS file, o_orderpriority AS name FROM orders WHERE EXISTS (
      SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber BETWEEN o_custkey % 5 + 1 AND o_custkey % 5 + 2 AND l_returnflag = 'R')""")
def q08(spark: SparkSession, d: str) -> DataFrame:
    """An order's function spans two lines; changed lines are those of returned items."""
    o, i = table(spark, d, "orders"), table(spark, d, "lineitem")
    functions = o.select(F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 5 + 1).alias("start_line"), (F.col("o_custkey") % 5 + 2).alias("end_line"))
    changed = i.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"))
    return coverage.functions_by_lines(functions, changed).select("file", "name")


@_query("q09_branch_coverage", f"""
    WITH {_COVERED}, b AS (SELECT l_orderkey AS file, l_linenumber AS line, l_linestatus = 'F' AS err FROM lineitem)
    SELECT b.file, count(*) AS total, count(cov.line) AS covered, count(*) FILTER (err) AS error_total, count(*) FILTER (err AND cov.line IS NOT NULL) AS error_covered,
           count(cov.line)::DOUBLE / count(*)::DOUBLE * 100.0 AS pct,
           CASE WHEN count(*) FILTER (err) = 0 THEN 100.0 ELSE count(*) FILTER (err AND cov.line IS NOT NULL)::DOUBLE / (count(*) FILTER (err))::DOUBLE * 100.0 END AS error_pct
    FROM b LEFT JOIN cov USING (file, line) GROUP BY b.file""")
def q09(spark: SparkSession, d: str) -> DataFrame:
    branches = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_linestatus") == "F").alias("is_error_path"))
    return coverage.branch_coverage(branches, coverage.covered_lines(_blocks(spark, d)))


@_query("q36_total_coverage", f"""
    WITH {_COVERED}, ch AS (SELECT o_orderkey AS file, unnest(range(1, 8)) AS line FROM orders)
    SELECT count(*) AS total, count(cov.line) AS covered, count(*) - count(cov.line) AS uncovered, count(cov.line)::DOUBLE / count(*)::DOUBLE * 100.0 AS pct FROM ch LEFT JOIN cov USING (file, line)""")
def q36(spark: SparkSession, d: str) -> DataFrame:
    return coverage.total_coverage(q07(spark, d))


@_query("q37_coverage_gaps", f"""
    WITH {_COVERED}, ch AS (SELECT o_orderkey AS file, unnest(range(1, 8)) AS line FROM orders), un AS (SELECT ch.* FROM ch LEFT JOIN cov USING (file, line) WHERE cov.line IS NULL)
    SELECT o_orderkey AS file, o_orderpriority AS name, count(*) AS n, sum(line)::BIGINT AS line_sum FROM orders JOIN un ON un.file = o_orderkey AND line BETWEEN o_custkey % 5 + 1 AND o_custkey % 5 + 2 GROUP BY ALL""")
def q37(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    functions = o.select(F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 5 + 1).alias("start_line"), (F.col("o_custkey") % 5 + 2).alias("end_line"))
    changed = o.select(F.col("o_orderkey").alias("file"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("line"))
    uncovered = changed.join(coverage.covered_lines(_blocks(spark, d)), ["file", "line"], "left_anti")
    gaps = coverage.coverage_gaps(functions, uncovered)
    return gaps.select("file", "name", F.size("lines").cast("bigint").alias("n"), F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("line_sum"))


@_query("q32_executable_lines", r"""
    WITH l AS (SELECT doc_id AS file, i AS line, string_split(text, chr(10))[i] AS t FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    x AS (SELECT DISTINCT file, line FROM l WHERE line % 5 IN (1, 2, 3) AND trim(t, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) NOT IN ('{', '}'))
    SELECT file, line FROM l SEMI JOIN x USING (file, line)""")
def q32(spark: SparkSession, d: str) -> DataFrame:
    """All lines of all texts changed; of every five lines the first three are an executable range."""
    source = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).select("file", (F.col("p") + 1).cast("bigint").alias("line"), "text")
    ranges = source.where("line % 5 = 1").select("file", F.col("line").alias("start_line"), (F.col("line") + 2).alias("end_line"))
    return coverage.executable_changed_lines(source.select("file", "line"), ranges, source)


# --- test events -------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as a test's: purchase = pass, error = fail, signup = skip for every fourth user, view = output."""
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "error", "fail").when((F.col("event_type") == "signup") & (F.col("user_id") % 4 == 0), "skip").when(F.col("event_type") == "view", "output").otherwise("run")
    return e.select(F.col("event_id").alias("seq"), action.alias("Action"), F.lit("pkg").alias("Package"), F.concat(F.lit("T"), (F.col("user_id") % 20).cast("string"), F.lit("/"), F.col("user_id").cast("string")).alias("Test"), F.col("value").alias("Elapsed"), F.col("props").alias("Output"))


_FOLD = """fold AS (SELECT 'T' || (user_id % 20) || '/' || user_id AS test,
      coalesce(arg_max(event_type = 'purchase', event_id) FILTER (event_type IN ('purchase', 'error')), false) AS passed, coalesce(bool_or(event_type = 'signup' AND user_id % 4 = 0), false) AS skipped,
      coalesce(arg_max(value, event_id) FILTER (event_type IN ('purchase', 'error') OR event_type = 'signup' AND user_id % 4 = 0), 0) AS elapsed, min(event_id) AS first_seq,
      count(*) FILTER (event_type = 'view' AND props <> '') AS n_output, md5(coalesce(string_agg(props, '' ORDER BY event_id) FILTER (event_type = 'view' AND props <> ''), '')) AS output_md5
    FROM events GROUP BY user_id)"""


@_query("q10_event_fold", f"WITH {_FOLD} SELECT * FROM fold")
def q10(spark: SparkSession, d: str) -> DataFrame:
    f = testevents.fold_events(_events(spark, d))
    return f.select("test", "passed", "skipped", "elapsed", "first_seq", F.size("output").cast("bigint").alias("n_output"), F.md5(F.array_join("output", "")).alias("output_md5"))


@_query("q11_failing_tests", f"""
    WITH {_FOLD}, r AS (SELECT split_part(test, '/', 1) AS top, split_part(test, '/', 2) AS sub, passed, first_seq FROM fold WHERE NOT skipped),
    a AS (SELECT top, bool_and(NOT passed) AS all_failing FROM r GROUP BY top)
    SELECT top AS name, CASE WHEN all_failing THEN 'remove_function' ELSE 'remove_cases' END AS action, CASE WHEN NOT all_failing THEN string_agg(sub, ',' ORDER BY first_seq) END AS cases
    FROM r JOIN a USING (top) WHERE NOT passed GROUP BY top, all_failing""")
def q11(spark: SparkSession, d: str) -> DataFrame:
    tests = testevents.results(testevents.fold_events(_events(spark, d)).withColumn("skipped", F.col("skipped")))
    return testevents.prune_plan(tests).withColumn("cases", F.array_join("cases", ","))


@_query("q38_test_counts", f"WITH {_FOLD} SELECT count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM fold WHERE NOT skipped")
def q38(spark: SparkSession, d: str) -> DataFrame:
    return testevents.test_counts(testevents.fold_events(_events(spark, d)))


@_query("q12_expected_got", r"""
    SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, 'want' AS expected, regexp_extract(url, '/(\d+)', 1) AS got,
           coalesce(nullif(regexp_extract('x_test.go:' || regexp_extract(url, '/(\d+)', 1) || ':', '(\w+_test\.go:\d+):', 1), ''), '') AS line FROM pages""")
def q12(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", r"/(\d+)", 1).alias("n"))
    message = F.concat(F.lit("got "), F.col("n"), F.lit(", want want"))
    pair = scalars.expected_and_got(message)
    return p.select("page_id", F.regexp_extract("url", r"://([^/?#]+)", 1).alias("host"), pair["expected"].alias("expected"), pair["got"].alias("got"), scalars.source_line(F.concat(F.lit("x_test.go:"), F.col("n"), F.lit(":"))).alias("line"))


@_query("q13_islands", """
    SELECT conv_id::VARCHAR AS path, 'T' || island AS name, string_agg('turn ' || turn, '; ' ORDER BY turn) AS error FROM (
      SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations) WHERE island > 0 GROUP BY ALL""")
def q13(spark: SparkSession, d: str) -> DataFrame:
    """A conversation as a log: a test starts at each user turn and fails before the next, its turns being its messages."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("n", F.sum((F.col("role") == "user").cast("int")).over(w)).where("n > 0").withColumn("last", F.coalesce(F.lead("n").over(w) != F.col("n"), F.lit(True)))
    name = F.concat(F.lit("T"), F.col("n").cast("string"))
    said = F.concat(F.when(F.col("role") == "user", F.concat(F.lit("=== RUN   "), name, F.lit("\n"))).otherwise(""), F.lit("    turn "), F.col("turn").cast("string"), F.when(F.col("last"), F.concat(F.lit("\n--- FAIL: "), name, F.lit(" (0.00s)"))).otherwise(""))
    logs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("line")))).alias("t")).select(F.col("conv_id").cast("string").alias("path"), F.array_join(F.transform("t", lambda t: t["line"]), "\n").alias("value"))
    return testevents.error_context(logs).select("path", "name", "error")


@_query("q33_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def q33(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as reports of one folder: the one written last."""
    return reports.latest(table(spark, d, "events"), ["user_id"], "event_id").select("user_id", "event_type")


# --- stores and sets ---------------------------------------------------------------------------------------------------


@_query("q14_dedup_keep_first", r"""
    SELECT doc_id, row_number() OVER (PARTITION BY lang, f ORDER BY doc_id) = 1 AS kept FROM (
      SELECT doc_id, lang, 'text=' || regexp_replace(text, '\s+', ' ', 'g') || '|source=' || (doc_id % 2) AS f FROM documents)""")
def q14(spark: SparkSession, d: str) -> DataFrame:
    field = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    docs = table(spark, d, "documents").withColumn("fields", F.array(field("name", F.col("doc_id").cast("string")), field("text", F.regexp_replace("text", r"\s+", " ")), field("source", (F.col("doc_id") % 2).cast("string"))))
    return stores.keep_first(docs, ["lang"], stores.case_fingerprint(F.col("fields")), "doc_id").select("doc_id", "kept")


@_query("q15_classify", """
    WITH base AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN text || '.' ELSE text END AS b FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l USING (doc_id) WHERE d.lang <> 'de')
    SELECT d.doc_id, CASE WHEN base.doc_id IS NULL THEN 'new' WHEN b = text THEN 'unchanged' ELSE 'changed' END AS status FROM documents d LEFT JOIN base USING (doc_id)""")
def q15(spark: SparkSession, d: str) -> DataFrame:
    """All documents against an older version of them: one language came later, documents of low quality were changed."""
    docs = table(spark, d, "documents")
    low = table(spark, d, "labels").where("quality = 0").select("doc_id").distinct().withColumn("low", F.lit(True))
    base = docs.where("lang <> 'de'").join(low, "doc_id", "left").select("doc_id", F.when(F.col("low"), F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"), F.lit(1).alias("pos"))
    return stores.classify(docs.select("doc_id", "text"), base, ["doc_id"], "text").select("doc_id", "status")


@_query("q16_cache_lookup", """
    SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = d.doc_id % 2) AS hit FROM documents d""")
def q16(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "documents").select(F.col("doc_id").alias("key"), (F.col("doc_id") % 2).cast("int").alias("hash"))
    hits, misses = stores.lookup(wanted, table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("hash")))
    return hits.withColumn("hit", F.lit(True)).union(misses.withColumn("hit", F.lit(False))).select(F.col("key").alias("doc_id"), "hit")


@_query("q17_store_put_prune", """
    WITH old AS (SELECT user_id AS key, arg_max(event_type, event_id) AS hash, max(ts) AS ts FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
    new AS (SELECT user_id AS key, arg_max(event_type, event_id) AS hash, max(ts) AS ts FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0 GROUP BY ALL),
    both_ AS (SELECT * FROM old WHERE key NOT IN (SELECT key FROM new) UNION ALL SELECT * FROM new)
    SELECT key, hash FROM both_ WHERE key % 10 <> 7 AND ts >= TIMESTAMP '2024-01-20'""")
def q17(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    entries = lambda rows: rows.groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", "event_id").alias("hash"), F.max("ts").alias("timestamp"))
    cache = stores.put(entries(e.where("event_id % 2 = 0")), entries(e.where("event_id % 2 = 1 and user_id % 3 = 0")))
    kept = stores.prune(cache.where("key % 10 <> 7"), F.lit("2024-02-19").cast("timestamp"), 30)
    return kept.select("key", "hash")


@_query("q18_merge", """
    SELECT coalesce(s, c) AS path, CASE WHEN s IS NOT NULL THEN 'supplier' || (s % 2) ELSE 'customer' END AS alias
    FROM (SELECT DISTINCT s_nationkey AS s FROM supplier WHERE s_nationkey < 15) FULL JOIN (SELECT DISTINCT c_nationkey AS c FROM customer WHERE c_nationkey > 5) ON s = c""")
def q18(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").where("s_nationkey < 15").select(F.col("s_nationkey").alias("path")).distinct().withColumn("alias", F.concat(F.lit("supplier"), (F.col("path") % 2).cast("string")))
    c = table(spark, d, "customer").where("c_nationkey > 5").select(F.col("c_nationkey").alias("path")).distinct().withColumn("alias", F.lit("customer"))
    return stores.merge_imports(s, c)


@_query("q39_new_names", "SELECT c_custkey, c_nationkey AS name FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def q39(spark: SparkSession, d: str) -> DataFrame:
    existing = table(spark, d, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("name"))
    generated = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("name"), F.col("c_custkey").alias("pos"))
    return stores.new_names(existing, generated).select("c_custkey", "name")


@_query("q19_content_hash", """
    SELECT p_partkey, sha256(p_name || p_brand || p_type || least(p_brand || ':' || p_type, p_name || ':x') || greatest(p_brand || ':' || p_type, p_name || ':x')) AS h FROM part""")
def q19(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n, s: F.struct(n.alias("name"), s.alias("source"))
    types = F.array(t(F.col("p_name"), F.lit("x")), t(F.col("p_brand"), F.col("p_type")))
    return table(spark, d, "part").select("p_partkey", scalars.content_hash(F.col("p_name"), F.col("p_brand"), F.col("p_type"), types).alias("h"))


# --- names, text, patterns ---------------------------------------------------------------------------------------------


@_query("q20_similarity", """
    WITH f AS (SELECT list(lower(r_name)) AS names FROM region), t AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS a FROM part)
    SELECT p_partkey, list_max(list_transform(names, lambda n: CASE WHEN a = n THEN 1.0::DOUBLE WHEN a = '' THEN 0.0 ELSE 1.0 - levenshtein(a, n)::DOUBLE / greatest(length(a), length(n)) END)) * 100 AS score FROM t, f""")
def q20(spark: SparkSession, d: str) -> DataFrame:
    focal = table(spark, d, "region").agg(F.collect_list(F.lower("r_name")).alias("names"))  # five names
    parts = table(spark, d, "part").select("p_partkey", F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("a")).join(F.broadcast(focal), how="cross")
    return parts.select("p_partkey", (F.array_max(F.transform("names", lambda n: scalars.similarity(F.col("a"), n))) * 100).alias("score"))


@_query("q21_name_tokens", r"""
    SELECT c_custkey, array_to_string(regexp_extract_all(regexp_replace('Test' || replace(c_name, '#', '_') || 'BazQux', '^Test', ''), '[A-Z]+[^A-Z_]*|[^A-Z_]+'), ',') AS tokens FROM customer""")
def q21(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("Test"), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit("BazQux"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(scalars.test_name_tokens(name), ",").alias("tokens"))


@_query("q22_patterns", """
    SELECT page_id, array_to_string(list_filter([CASE WHEN contains(html, '<script') THEN 'time_now' END, CASE WHEN contains(html, '<table') THEN 'file_io' END, CASE WHEN contains(url, 'm.') THEN 'json_encoding' END], lambda k: k IS NOT NULL), ',') AS kinds FROM pages""")
def q22(spark: SparkSession, d: str) -> DataFrame:
    """What a page holds decides which calls a function's body has; the page itself is a comment in it."""
    call = lambda c, text: F.when(c, text).otherwise("")
    body = F.concat(F.lit("/* "), F.replace("html", F.lit("*/"), F.lit("")), F.lit(" */\n"), call(F.col("html").contains("<script"), "x := time.Now()\n"), call(F.col("html").contains("<table"), "os.Stat(x)\n"), call(F.col("url").contains("m."), "json.Marshal(x)\n"))
    pages = table(spark, d, "pages").select("page_id", body.alias("body"), F.expr("cast(array() as array<struct<name:string,type:string>>)").alias("params"), F.expr("cast(array() as array<string>)").alias("returns"))
    return patterns.detect(pages, F.array(F.lit("encoding/json"))).select("page_id", F.array_join("kinds", ",").alias("kinds"))


@_query("q23_globs", r"""
    SELECT page_id, p, regexp_matches(p, '^vendor') OR regexp_full_match(regexp_extract(p, '[^/]*$'), '[^/]*\.pb\.go|[^/]*_generated\.go|[^/]*_gen\.go') OR regexp_full_match(p, '[^/]*_mock\.go') OR regexp_full_match(regexp_extract(p, '[^/]*$'), '[^/]*_mock\.go')
           OR (starts_with(p, 'en') AND regexp_full_match(regexp_extract(p, '[^/]*$'), '1[^/]*')) AS excluded
    FROM (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS p FROM pages)""")
def q23(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"://[^/]*/([^?#]*)", 1).alias("p"))
    return p.select("page_id", "p", globs.excluded(F.col("p"), ["*_mock.go", "en/**/1*"]).alias("excluded"))


@_query("q24_budget", """
    SELECT doc_id, strlen(text) // 4 AS tokens, md5(CASE WHEN len(l) > 6 THEN array_to_string(l[1:3] || [chr(9) || '// ... ' || (len(l) - 6) || ' lines truncated ...'] || l[-3:], chr(10)) ELSE text END) AS body_md5
    FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""")
def q24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scalars.estimate_tokens(F.col("text")).alias("tokens"), F.md5(scalars.truncate_body(F.col("text"), 6)).alias("body_md5"))


@_query("q40_normalise", r"""
    SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '//')), chr(10))) AS m FROM documents""")
def q40(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(scalars.normalise_lines(F.col("text"))).alias("m"))


# --- graphs, mutants, naturalness --------------------------------------------------------------------------------------


@_query("q27_implementors", """
    WITH need AS (SELECT DISTINCT p_brand AS interface, p_type || p_size // 2 AS method FROM part), have AS (SELECT DISTINCT l_suppkey AS type, p_type || p_size // 2 AS method FROM lineitem JOIN part ON l_partkey = p_partkey),
    needs AS (SELECT interface, count(*) AS n FROM need GROUP BY interface), met AS (SELECT interface, type, count(*) AS n FROM need JOIN have USING (method) GROUP BY interface, type)
    SELECT interface, type FROM met JOIN needs USING (interface, n)""")
def q27(spark: SparkSession, d: str) -> DataFrame:
    """A brand needs its types of parts, sizes two by two; which suppliers delivered all of them."""
    p, i = table(spark, d, "part"), table(spark, d, "lineitem")
    method = F.concat("p_type", F.floor(F.col("p_size") / 2).cast("string")).alias("method")
    have = i.join(p, i.l_partkey == p.p_partkey).select(F.col("l_suppkey").alias("type"), method)
    return graphs.implementors(p.select(F.col("p_brand").alias("interface"), method), have)


@_query("q28_embedded_methods", """
    WITH RECURSIVE e AS (SELECT n_name AS name, CASE WHEN n_nationkey > 0 THEN n_nationkey // 2 END AS up FROM nation), ee AS (SELECT e.name, n.n_name AS embedded FROM e LEFT JOIN nation n ON n.n_nationkey = e.up),
    r(root, name, depth) AS (SELECT name, name, 0 FROM ee UNION ALL SELECT r.root, ee.embedded, r.depth + 1 FROM r JOIN ee ON ee.name = r.name WHERE ee.embedded IS NOT NULL AND r.depth < 10),
    f AS (SELECT root AS interface, 'm' || n_regionkey AS method, r.name AS signature, depth, row_number() OVER (PARTITION BY root, n_regionkey ORDER BY depth, r.name) AS rn FROM r JOIN nation ON n_name = r.name)
    SELECT interface, method, signature FROM f WHERE rn = 1""")
def q28(spark: SparkSession, d: str) -> DataFrame:
    """A nation embeds the one with half its key; its method is named after its region."""
    n = table(spark, d, "nation")
    up = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("embedded"))
    embeds = n.join(up, (F.col("k") == F.floor(F.col("n_nationkey") / 2)) & (F.col("n_nationkey") > 0), "left").select(F.col("n_name").alias("name"), "embedded")
    return graphs.embedded_methods(embeds, n.select(F.col("n_name").alias("name"), F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("method"), F.col("n_name").alias("signature")))


@_query("q29_used_types", """
    WITH refs AS (SELECT DISTINCT l_orderkey AS func, l_partkey AS type FROM lineitem WHERE l_partkey % 3 <> 0), known AS (SELECT p_partkey AS type FROM part WHERE p_partkey % 3 <> 0),
    far AS (SELECT DISTINCT func, (type * 2) % 1000 + 1 AS type FROM refs), u AS (SELECT func, type, 0 AS hop FROM refs SEMI JOIN known USING (type) UNION ALL SELECT func, type, 1 FROM far SEMI JOIN known USING (type))
    SELECT func, type, min(hop)::INTEGER AS hop FROM u GROUP BY ALL""")
def q29(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("func"), F.col("l_partkey").alias("type"))
    parts = table(spark, d, "part")
    known = parts.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("type"))
    fields = parts.select(F.col("p_partkey").alias("type"), ((F.col("p_partkey") * 2) % 1000 + 1).alias("field_type"))
    return graphs.used_types(refs, fields, known)


@_query("q41_called_functions", "SELECT DISTINCT o_custkey AS caller, o_orderkey % 2000 AS callee FROM orders WHERE o_custkey <> o_orderkey % 2000 AND o_orderkey % 2000 IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def q41(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "orders").select(F.col("o_custkey").alias("caller"), (F.col("o_orderkey") % 2000).alias("callee"))
    return graphs.called_functions(calls, table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("name")))


@_query("q30_mutation_by_type", """
    SELECT l_returnflag AS type, count(*) FILTER (l_linestatus = 'F') AS killed, count(*) AS total, count(*) FILTER (l_linestatus = 'F')::DOUBLE / count(*)::DOUBLE * 100.0 AS score FROM lineitem WHERE l_tax <> 0.08 GROUP BY l_returnflag""")
def q30(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import mutation

    m = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("type"), (F.col("l_linestatus") == "F").alias("killed"), F.when(F.col("l_tax") == 0.08, "x").otherwise("").alias("error"))
    return mutation.by_type(m)


@_query("q31_naturalness", """
    WITH t AS (SELECT role AS file, conv_id AS test, count(*) AS n, count(*) <> count(DISTINCT length(text) % 5) AS dup, bool_and(turn % 2 = 0) AS nil, bool_or(length(text) > 500) AS err FROM conversations GROUP BY ALL)
    SELECT file, count(*) AS test_count, sum(n) / count(*)::DOUBLE AS assertion_ratio, 0.0::DOUBLE AS no_assertions_pct, count(*) FILTER (dup) * 100.0 / count(*)::DOUBLE AS duplicate_assertions_pct,
           count(*) FILTER (nil) * 100.0 / count(*)::DOUBLE AS nil_only_assertions_pct, count(*) FILTER (err) * 100.0 / count(*)::DOUBLE AS error_assertions_pct FROM t GROUP BY file""")
def q31(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import naturalness

    c = table(spark, d, "conversations")
    asserts = c.select(F.col("role").alias("file"), F.col("conv_id").alias("test"), (F.length("text") % 5).cast("string").alias("signature"), F.when(F.col("turn") % 2 == 0, "nil").otherwise("equal").alias("kind"), (F.length("text") > 500).alias("is_error"))
    return naturalness.per_file(c.select(F.col("role").alias("file"), F.col("conv_id").alias("test")).distinct(), asserts)
