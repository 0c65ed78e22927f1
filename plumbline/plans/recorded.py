"""Queries over what tools record: diffs, profiles, test events, logs, reports, stores, settings and Go sources.

The tables hold none of these, so each query writes its texts out of table columns, in the recorded format, and has the
real reader or operator read them back; the SQL that checks it comes from the columns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import coverage, metrics, mutation, naturalness, patterns, stores, testevents
from ..sources import reports, scratch, text
from .catalogue import _query, table

_ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
_ITEMS = f"li AS (SELECT *, 'o' || l_orderkey || '.go' AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ITEM_ORDER)}) - 1 AS i FROM lineitem)"


def _texts(rows: DataFrame, path: Column, order: tuple[str, ...], line: Column, head: Column | None = None) -> DataFrame:
    """(path, value): the lines of each path in order, after a head."""
    by = rows.select(path.alias("path"), F.struct(*order, line.alias("line")).alias("x"), *([head.alias("head")] if head is not None else []))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    if head is None:
        return by.groupBy("path").agg(body.alias("value"))
    return by.groupBy("path").agg(F.concat(F.first("head"), body).alias("value"))


# --- diffs and profiles ------------------------------------------------------------------------------------------------


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """An order is a changed file with one hunk: returned items are added lines, accepted ones deleted, the others context."""
    i = table(spark, d, "lineitem")
    key = F.col("l_orderkey").cast("string")
    mark = F.when(F.col("l_returnflag") == "R", "+").when(F.col("l_returnflag") == "A", "-").otherwise(" ")
    sizes = i.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("old"), F.count_if(F.col("l_returnflag") != "A").alias("new"))
    name = F.concat(F.lit("o"), key, F.lit(".go"))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nindex 12..34 100644\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -"),
                    (F.col("l_orderkey") % 50 + 1).cast("string"), F.lit(","), F.col("old").cast("string"), F.lit(" +"), (F.col("l_orderkey") % 30 + 1).cast("string"), F.lit(","), F.col("new").cast("string"), F.lit(" @@ func F"), key, F.lit("()\n"))
    return _texts(i.join(sizes, "l_orderkey"), F.concat(F.lit("d"), key), _ITEM_ORDER, F.concat(mark, F.lit("p"), F.col("l_partkey").cast("string")), head)


_DIFF = f"""{_ITEMS}, df AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 'added' WHEN 'A' THEN 'deleted' ELSE 'context' END AS type,
    l_orderkey % 50 + 1 + coalesce(sum((l_returnflag <> 'R')::INTEGER) OVER w, 0) AS o, l_orderkey % 30 + 1 + coalesce(sum((l_returnflag <> 'A')::INTEGER) OVER w, 0) AS n
    FROM li WINDOW w AS (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@_query("q42_diff_lines", f"""WITH {_DIFF} SELECT file, type, 'p' || l_partkey AS content, 1 AS hunk, CASE WHEN type <> 'added' THEN o ELSE 0 END::INTEGER AS old_no, CASE WHEN type <> 'deleted' THEN n ELSE 0 END::INTEGER AS new_no FROM df""")
def q42(spark: SparkSession, d: str) -> DataFrame:
    return text.diff_lines(_diffs(spark, d)).select("file", "type", "content", "hunk", "old_no", "new_no")


@_query("q43_hunks", """SELECT 'd' || l_orderkey AS path, (l_orderkey % 50 + 1)::INTEGER AS old_start, count(*) FILTER (l_returnflag <> 'R')::INTEGER AS old_count, (l_orderkey % 30 + 1)::INTEGER AS new_start,
    count(*) FILTER (l_returnflag <> 'A')::INTEGER AS new_count, 'func F' || l_orderkey || '()' AS header FROM lineitem GROUP BY l_orderkey""")
def q43(spark: SparkSession, d: str) -> DataFrame:
    return text.hunks(_diffs(spark, d)).select("path", "old_start", "old_count", "new_start", "new_count", "header")


@_query("q44_changed_lines", f"WITH {_DIFF} SELECT file, n::INTEGER AS line FROM df WHERE type = 'added'")
def q44(spark: SparkSession, d: str) -> DataFrame:
    return text.changed_lines(text.diff_lines(_diffs(spark, d))).select("file", "line")


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's profile: a block for each of its items, over a third of the quantity, run if the item is open."""
    i = table(spark, d, "lineitem")
    number = lambda c: c.cast("int").cast("string")
    line = F.concat(F.lit("example.com/m/o"), F.col("l_orderkey").cast("string"), F.lit(".go:"), number(F.col("l_linenumber")), F.lit(".2,"), number(F.col("l_linenumber") + F.col("l_quantity") % 3), F.lit(".9 "), number(F.col("l_quantity")), F.when(F.col("l_linestatus") == "O", " 3").otherwise(" 0"))
    return _texts(i, F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), ("l_orderkey", *_ITEM_ORDER), line, F.lit("mode: count\n"))


@_query("q45_coverage_blocks", """SELECT 'example.com/m/o' || l_orderkey || '.go' AS file, l_linenumber AS start_line, 2 AS start_col, (l_linenumber + l_quantity::INTEGER % 3)::INTEGER AS end_line, 9 AS end_col,
    l_quantity::INTEGER AS num_stmt, CASE WHEN l_linestatus = 'O' THEN 3 ELSE 0 END AS cnt FROM lineitem""")
def q45(spark: SparkSession, d: str) -> DataFrame:
    return text.coverage_blocks(_profiles(spark, d))


@_query("q46_profile_coverage", f"""WITH {_DIFF}, cov AS (SELECT DISTINCT 'o' || l_orderkey || '.go' AS file, unnest(range(l_linenumber, l_linenumber + l_quantity::INTEGER % 3 + 1)) AS line FROM lineitem WHERE l_linestatus = 'O'),
    ch AS (SELECT file, n AS line FROM df WHERE type = 'added')
    SELECT ch.file, count(*) AS total, count(cov.line) AS hit, count(cov.line)::DOUBLE / count(*)::DOUBLE * 100.0 AS pct FROM ch LEFT JOIN cov USING (file, line) GROUP BY ch.file""")
def q46(spark: SparkSession, d: str) -> DataFrame:
    """From the texts of diffs and profiles to the coverage of each changed file, profile names matched by their ends."""
    # both are read several times, their texts once
    changed = scratch.stage(text.changed_lines(text.diff_lines(_diffs(spark, d))).select("file", "line"), "changed")
    blocks = coverage.match_files(scratch.stage(text.coverage_blocks(_profiles(spark, d)).select("file", "start_line", "end_line", "cnt"), "blocks"), changed.select("file").distinct())
    return coverage.diff_coverage(changed, coverage.covered_lines(blocks)).select("file", "total", "hit", "pct")


@_query("q47_profile_exact_match", f"""WITH {_ITEMS} SELECT file, l_linenumber AS start_line, count(*) AS n FROM (SELECT 'example.com/m/o' || l_orderkey || '.go' AS file, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE o_orderstatus = 'F' GROUP BY ALL""")
def q47(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("example.com/m/o"), F.col("o_orderkey").cast("string"), F.lit(".go")).alias("file"))
    return coverage.match_files(text.coverage_blocks(_profiles(spark, d)), files, "exact").groupBy("file", "start_line").agg(F.count("*").alias("n"))


@_query("q48_summary_line", """SELECT l_orderkey, 'Diff coverage: ' || printf('%.1f', c::DOUBLE / n * 100.0) || '% (' || c || '/' || n || ' changed lines covered)' AS line
    FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS c FROM lineitem GROUP BY l_orderkey)""")
def q48(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("c"))
    return sums.select("l_orderkey", coverage.summary_line(F.col("n"), F.col("c"), scalars.percent(F.col("c"), F.col("n"), 100)).alias("line"))


@_query("q49_text_executable_lines", """WITH l AS (SELECT doc_id AS file, i AS line, trim(string_split(text, chr(10))[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
    SELECT file, line::INTEGER AS line FROM l WHERE t NOT IN ('', '{', '}', '})', '),', ')') AND NOT starts_with(t, '//') AND NOT starts_with(t, 'package ') AND NOT starts_with(t, 'import "')""")
def q49(spark: SparkSession, d: str) -> DataFrame:
    """Every line of a document as a changed one; the texts open no comment or import blocks."""
    lines = text.lines(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("value"))).select(F.col("path").alias("file"), (F.col("pos") + 1).alias("line"), F.col("line").alias("text"))
    return coverage.text_executable_lines(lines, lines)


# --- test events and logs ----------------------------------------------------------------------------------------------


def _streams(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as a test event stream; clicks are the compiler's lines between."""
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "output").otherwise("run")
    event = F.to_json(F.struct(action.alias("Action"), F.lit("example.com/p").alias("Package"), F.concat(F.lit("Test/"), (F.col("event_id") % 3).cast("string")).alias("Test"), F.col("value").alias("Elapsed"), F.when(F.col("event_type") == "view", F.concat(F.col("props"), F.lit("\n"))).alias("Output")))
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("# note "), F.col("event_id").cast("string"))).otherwise(event)
    return _texts(e, F.concat(F.lit("u"), F.col("user_id").cast("string")), ("event_id",), line)


_STREAM = """st AS (SELECT 'u' || user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_id, event_type, value, props,
    CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'error' THEN 'fail' WHEN 'view' THEN 'output' ELSE 'run' END AS action, 'Test/' || event_id % 3 AS test FROM events)"""


@_query("q50_read_events", f"WITH {_STREAM} SELECT path, seq, action AS \"Action\", 'example.com/p' AS \"Package\", test AS \"Test\", value AS \"Elapsed\", CASE WHEN event_type = 'view' THEN props || chr(10) END AS \"Output\" FROM st WHERE event_type <> 'click'")
def q50(spark: SparkSession, d: str) -> DataFrame:
    return text.events(_streams(spark, d)).drop("Time")


@_query("q51_side_output", f"WITH {_STREAM} SELECT path, seq, '# note ' || event_id AS line FROM st WHERE event_type = 'click'")
def q51(spark: SparkSession, d: str) -> DataFrame:
    return text.side_output(_streams(spark, d))


@_query("q52_stream_results", f"""WITH {_STREAM} SELECT path, test AS name, coalesce(arg_max(action = 'pass', seq) FILTER (action IN ('pass', 'fail')), false) AS passed, min(seq) AS first_seq FROM st WHERE event_type <> 'click' GROUP BY ALL""")
def q52(spark: SparkSession, d: str) -> DataFrame:
    return testevents.fold_events(text.events(_streams(spark, d)), ("path",)).select("path", F.col("test").alias("name"), "passed", "first_seq")


@_query("q53_failure_summary", f"""WITH {_STREAM} SELECT first_seq AS place, 'FAIL ' || path || test || coalesce(': ' || m, '') AS line FROM (
    SELECT path, test, min(seq) AS first_seq, coalesce(arg_max(action = 'pass', seq) FILTER (action IN ('pass', 'fail')), false) AS passed, arg_min(props, seq) FILTER (event_type = 'view') AS m FROM st WHERE event_type <> 'click' GROUP BY ALL) WHERE NOT passed""")
def q53(spark: SparkSession, d: str) -> DataFrame:
    events = text.events(_streams(spark, d)).withColumn("Test", F.concat("path", "Test"))
    return testevents.summarise_failures(testevents.fold_events(events))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    """A user's purchases and errors as a text log of passed and failed tests, errors with a message."""
    e = table(spark, d, "events").where("event_type in ('purchase', 'error')")
    i = F.col("event_id").cast("string")
    failed = F.concat(F.lit("=== RUN   T"), i, F.lit("\n    x_test.go:"), (F.col("event_id") % 90 + 1).cast("string"), F.lit(": got "), F.col("user_id").cast("string"), F.lit(", want w"), i, F.lit("\n    more of "), i, F.lit("\n--- FAIL: T"), i, F.lit(" (0.01s)"))
    passed = F.concat(F.lit("=== RUN   T"), i, F.lit("\n--- PASS: T"), i, F.lit(" (0.00s)"))
    return _texts(e, F.concat(F.lit("u"), F.col("user_id").cast("string")), ("event_id",), F.when(F.col("event_type") == "error", failed).otherwise(passed))


_LOG = "lg AS (SELECT 'u' || user_id AS path, 'T' || event_id AS name, event_type = 'purchase' AS passed, event_id, user_id FROM events WHERE event_type IN ('purchase', 'error'))"


@_query("q54_text_results", f"WITH {_LOG} SELECT path, name, passed, (row_number() OVER (PARTITION BY path ORDER BY NOT passed, event_id) - 1)::INTEGER AS place FROM lg")
def q54(spark: SparkSession, d: str) -> DataFrame:
    return testevents.text_results(_logs(spark, d))


@_query("q55_feedback_from_text", f"""WITH {_LOG} SELECT path, name, passed, CASE WHEN passed THEN '' ELSE 'w' || event_id END AS expected, CASE WHEN passed THEN '' ELSE user_id::VARCHAR END AS got,
    CASE WHEN passed THEN '' ELSE 'x_test.go:' || (event_id % 90 + 1) || ': got ' || user_id || ', want w' || event_id || '; more of ' || event_id END AS error, CASE WHEN passed THEN '' ELSE 'x_test.go:' || (event_id % 90 + 1) END AS line FROM lg""")
def q55(spark: SparkSession, d: str) -> DataFrame:
    return testevents.feedback_from_text(_logs(spark, d)).drop("place")


@_query("q56_feedback_from_events", """WITH f AS (SELECT user_id, coalesce(arg_max(event_type = 'purchase', event_id) FILTER (event_type IN ('purchase', 'error')), false) AS passed, min(event_id) AS first_seq,
      string_agg('u_test.go:' || event_id || ': got ' || event_id % 7 || ', want 3', '; ' ORDER BY event_id) FILTER (event_type = 'view') AS error, min(event_id) FILTER (event_type = 'view') AS e FROM events GROUP BY user_id)
    SELECT 'U' || user_id AS name, passed, CASE WHEN passed OR e IS NULL THEN '' ELSE '3' END AS expected, CASE WHEN passed OR e IS NULL THEN '' ELSE (e % 7)::VARCHAR END AS got, CASE WHEN passed OR e IS NULL THEN '' ELSE error END AS error,
           CASE WHEN passed OR e IS NULL THEN '' ELSE 'u_test.go:' || e END AS line, first_seq FROM f""")
def q56(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "output").otherwise("run")
    said = F.concat(F.lit("    u_test.go:"), F.col("event_id").cast("string"), F.lit(": got "), (F.col("event_id") % 7).cast("string"), F.lit(", want 3\n"))
    rows = e.select(F.col("event_id").alias("seq"), action.alias("Action"), F.lit("p").alias("Package"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("Test"), F.col("value").alias("Elapsed"), F.when(F.col("event_type") == "view", said).alias("Output"))
    return testevents.feedback_from_events(testevents.fold_events(rows))


@_query("q57_kept_cases", """WITH fold AS (SELECT 'T' || user_id % 20 AS top, user_id, coalesce(arg_max(event_type = 'purchase', event_id) FILTER (event_type IN ('purchase', 'error')), false) AS passed FROM events GROUP BY user_id),
    a AS (SELECT top, bool_and(NOT passed) AS all_failing FROM fold GROUP BY top), c AS (SELECT c_custkey, 'T' || c_custkey % 20 AS func, c_custkey AS name FROM customer)
    SELECT c_custkey FROM c LEFT JOIN a ON func = top LEFT JOIN fold ON user_id = name AND fold.top = func WHERE NOT (coalesce(all_failing, false) OR coalesce(NOT passed, false))""")
def q57(spark: SparkSession, d: str) -> DataFrame:
    """A customer is a table case of one of twenty test functions; what failed for the user of that number goes."""
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "error", "fail").otherwise("run")
    rows = e.select(F.col("event_id").alias("seq"), action.alias("Action"), F.lit("p").alias("Package"), F.concat(F.lit("T"), (F.col("user_id") % 20).cast("string"), F.lit("/case_"), F.col("user_id").cast("string")).alias("Test"), F.col("value").alias("Elapsed"), F.lit("").alias("Output"))
    plan = testevents.prune_plan(testevents.results(testevents.fold_events(rows)))
    cases = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("T"), (F.col("c_custkey") % 20).cast("string")).alias("func"), F.concat(F.lit("case "), F.col("c_custkey").cast("string")).alias("name"))
    return testevents.kept_cases(cases, plan).select("c_custkey")


@_query("q58_race_details", """SELECT 'c' || c_custkey AS path, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'WARNING: DATA RACE' || chr(10) || 'Write by ' || c_name || chr(10) || '  m()' || chr(10) || '  x.go:' || c_nationkey || chr(10) END AS details FROM customer""")
def q58(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    race = F.concat(F.lit("=== RUN T\n==\nWARNING: DATA RACE\nWrite by "), F.col("c_name"), F.lit("\n  m()\n  x.go:"), F.col("c_nationkey").cast("string"), F.lit("\n\nafter\n\n"))
    logs = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.when(F.col("c_nationkey") % 2 == 0, "ok\n\nfine").otherwise(race).alias("value"))
    return testevents.race_details(logs)


@_query("q59_informative_lines", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'x.go:1: undefined: ' || h || chr(10) || '--- FAIL: T (0s)' || chr(10) || 'FAIL' WHEN 1 THEN 'Error Trace: ' || h ELSE 'ok ' || h || chr(10) || ' fine' END AS told,
    (CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END)::INTEGER AS failed, page_id % 3 = 2 AS json FROM (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS h FROM pages)""")
def q59(spark: SparkSession, d: str) -> DataFrame:
    h = F.regexp_extract("url", r"://([^/?#]+)", 1)
    log = (F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  x.go:1: undefined: "), h, F.lit("\nok\n--- FAIL: T (0s)\nFAIL\n"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("\tError Trace: "), h, F.lit("\nok")))
           .otherwise(F.concat(F.lit("ok "), h, F.lit("\n fine"))))
    json = testevents.is_json_stream(F.when(F.col("page_id") % 3 == 2, F.lit('x {"Time":"2024"')).otherwise(F.lit("ok")))
    return table(spark, d, "pages").select("page_id", testevents.informative_lines(log).alias("told"), testevents.count_status_lines(log, "FAIL").alias("failed"), json.alias("json"))


# --- settings, reports, stores -----------------------------------------------------------------------------------------


@_query("q60_env_entries", """WITH l AS (SELECT 'n' || lpad(c_nationkey::VARCHAR, 2, '0') AS path, c_custkey, 'K' || c_custkey % 400 AS key, c_name || ' = x' AS value FROM customer WHERE c_custkey % 5 <> 0)
    SELECT key, arg_min(value, path || lpad(c_custkey::VARCHAR, 12, '0')) AS value FROM l WHERE key NOT IN (SELECT 'K' || s_suppkey FROM supplier) GROUP BY key""")
def q60(spark: SparkSession, d: str) -> DataFrame:
    """A nation's customers as an environment file: every fifth a comment, values quoted or not; suppliers' keys are set already."""
    c = table(spark, d, "customer")
    value = F.concat(F.col("c_name"), F.lit(" = x"))
    line = F.concat(F.when(F.col("c_custkey") % 5 == 0, "#").otherwise(" "), F.lit("K"), (F.col("c_custkey") % 400).cast("string"), F.lit(" = "), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value), F.lit(" \n"))
    texts = _texts(c, F.concat(F.lit("n"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")), ("c_custkey",), line)
    return text.env_entries(texts, table(spark, d, "supplier").select(F.concat(F.lit("K"), F.col("s_suppkey").cast("string")).alias("key")))


def _report_texts(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as a run report: totals over orders, a file for each, the segment as configuration."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    file = F.struct(F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".go"))).alias("file"), F.col("o_orderpriority").alias("status"), (F.col("o_orderkey") % 7).cast("int").alias("tests_total"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("diff_coverage_pct"))
    by = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("int").alias("n"), F.max("o_totalprice").alias("top"), F.array_sort(F.collect_list(F.struct("o_orderkey", file.alias("f")))).alias("fs")).join(c, "c_custkey")
    totals = F.struct(F.col("n").alias("files_processed"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("diff_coverage_pct"), F.struct(F.col("top").alias("assertion_ratio")).alias("naturalness"))
    config = F.struct(F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise("").alias("ablation_config"))
    value = F.to_json(F.struct(F.col("c_acctbal").alias("duration_seconds"), totals.alias("totals"), config.alias("config"), F.transform("fs", lambda x: x["f"]).alias("files")))
    return by.select(F.concat(F.lit("out/n"), F.col("c_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("path"), value.alias("value"))


@_query("q61_flat_reports", """SELECT 'n' || c_nationkey AS repo, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE 'c' || c_custkey END AS config, n::INTEGER AS files_processed, 0 AS tests_generated, 0 AS tests_validated, c_acctbal AS duration_sec,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS diff_cov_pct, NULL::DOUBLE AS mutation_pct, top AS assertion_ratio FROM customer JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def q61(spark: SparkSession, d: str) -> DataFrame:
    return reports.flat_reports(_report_texts(spark, d)).select("repo", "config", "files_processed", "tests_generated", "tests_validated", "duration_sec", "diff_cov_pct", "mutation_pct", "assertion_ratio")


@_query("q62_report_files", """SELECT 'n' || c_nationkey AS repo, 'o' || o_orderkey || '.go' AS file, o_orderpriority AS status, (o_orderkey % 7)::INTEGER AS tests_total, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS diff_coverage_pct
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 <> 0""")
def q62(spark: SparkSession, d: str) -> DataFrame:
    return reports.files_of(reports.parse_reports(_report_texts(spark, d))).select("repo", "file", "status", "tests_total", "diff_coverage_pct")


@_query("q63_report_matrices", """WITH r AS (SELECT 'n' || c_nationkey AS repo, c_mktsegment AS config, 'out/n' || c_nationkey || '/c' || c_custkey || '.json' AS seq, c_acctbal AS dur, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS cov
      FROM customer WHERE c_custkey % 3 > 0 AND c_custkey IN (SELECT o_custkey FROM orders)),
    l AS (SELECT repo, config, seq, 'diff_cov_pct' AS metric, cov AS value FROM r UNION ALL SELECT repo, config, seq, 'duration_sec', dur FROM r)
    SELECT metric, repo, arg_max_null(value, seq) FILTER (config = 'BUILDING') AS "BUILDING", arg_max_null(value, seq) FILTER (config = 'MACHINERY') AS "MACHINERY" FROM l GROUP BY ALL""")
def q63(spark: SparkSession, d: str) -> DataFrame:
    flat = reports.flat_reports(_report_texts(spark, d)).where(~F.col("config").rlike(r"^c\d+$"))
    return metrics.all_matrices(flat, ["BUILDING", "MACHINERY"]).where("metric in ('diff_cov_pct', 'duration_sec')")


@_query("q64_cache_store", """SELECT 'n' || n_nationkey || '.go::F' || c_custkey AS key, md5(c_name) AS hash, 'n' || n_nationkey || '_test.go' AS test_file, 2 AS n_funcs, c_mktsegment AS model, TIMESTAMP '2024-01-01' + to_days((c_custkey % 90)::INTEGER) AS timestamp
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q64(spark: SparkSession, d: str) -> DataFrame:
    """A nation's customers as a function store, written as the store's JSON and read back."""
    return reports.parse_cache(reports.cache_texts(_cache(spark, d).withColumn("part", F.split_part("key", F.lit("."), F.lit(1))), "part")).select("key", "hash", "test_file", F.size("generated_funcs").alias("n_funcs"), "model", "timestamp")


def _cache(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    file = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    name = F.concat(F.lit("F"), F.col("c_custkey").cast("string"))
    return c.select(scalars.cache_key(F.concat(file, F.lit(".go")), name).alias("key"), F.md5("c_name").alias("hash"), F.concat(file, F.lit("_test.go")).alias("test_file"), F.array(name, F.col("c_name")).alias("generated_funcs"), F.col("c_mktsegment").alias("model"),
                    F.dateadd(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 90).cast("int")).cast("timestamp").alias("timestamp"))


@_query("q65_store_views", """WITH c AS (SELECT *, TIMESTAMP '2024-01-01' + to_days((c_custkey % 90)::INTEGER) AS ts FROM customer)
    SELECT 'invalidate' AS view, count(*) AS n, count(*) FILTER (ts < TIMESTAMP '2024-02-15') AS expired FROM c WHERE c_nationkey <> 3 UNION ALL
    SELECT 'remove', count(*), count(*) FILTER (ts < TIMESTAMP '2024-02-15') FROM c WHERE NOT (c_nationkey = 19 AND c_custkey = 1) UNION ALL SELECT 'prune', count(*), 0 FROM c WHERE ts >= TIMESTAMP '2024-02-15'""")
def q65(spark: SparkSession, d: str) -> DataFrame:
    cache, now = _cache(spark, d), F.lit("2024-03-16").cast("timestamp")
    views = {"invalidate": stores.invalidate(cache, "n3.go"), "remove": stores.remove(cache, "n19.go::F1"), "prune": stores.prune(cache, now, 30)}
    out = [stores.stats(v, now).select(F.lit(k).alias("view"), F.col("total").alias("n"), "expired") for k, v in views.items()]
    return out[0].union(out[1]).union(out[2])


@_query("q66_dataset_errors", """SELECT c_custkey::INTEGER AS place, CASE WHEN c_custkey % 11 = 0 THEN 'name is required' WHEN c_custkey % 13 = 0 THEN 'name must not contain path separators' WHEN c_custkey % 17 = 0 THEN 'url is required' WHEN c_custkey % 19 = 0 THEN 'base is required'
    WHEN c_custkey % 23 = 0 THEN 'head is required' ELSE 'duplicate name' END AS error FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 17 = 0 OR c_custkey % 19 = 0 OR c_custkey % 23 = 0 OR c_custkey % 2 = 1 AND (c_custkey - 1) % 11 <> 0 AND (c_custkey - 1) % 13 <> 0""")
def q66(spark: SparkSession, d: str) -> DataFrame:
    """Customers as repositories of a dataset; two neighbours share a name."""
    k = F.col("c_custkey")
    unless = lambda n, c: F.when(k % n != 0, c)
    name = F.when(k % 11 == 0, " ").when(k % 13 == 0, F.concat(F.lit("a/"), k.cast("string"))).otherwise(F.concat(F.lit("r"), F.floor(k / 2).cast("string")))
    return reports.dataset_errors(table(spark, d, "customer").select(k.cast("int").alias("place"), name.alias("name"), unless(17, F.col("c_name")).alias("url"), unless(19, F.lit("b")).alias("base"), unless(23, F.lit("h")).alias("head")))


@_query("q67_classify_keys", """WITH cur AS (SELECT l_suppkey AS s, l_partkey AS p, max(l_quantity) AS body FROM lineitem GROUP BY ALL), base AS (SELECT l_suppkey AS s, l_partkey AS p, max(l_quantity) AS body FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
    SELECT 'S' || s || '.F' || p AS key, CASE WHEN base.s IS NULL THEN 'new' ELSE 'changed' END AS status FROM cur LEFT JOIN base USING (s, p) WHERE base.s IS NULL OR base.body <> cur.body""")
def q67(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's parts as methods of a type; the base lacks what was returned. What is new or changed needs tests."""
    i = table(spark, d, "lineitem").select(F.concat(F.lit("*S"), F.col("l_suppkey").cast("string")).alias("receiver"), F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("name"), "l_quantity", "l_returnflag")
    version = lambda rows: stores.with_function_key(rows.groupBy("receiver", "name").agg(F.max("l_quantity").alias("body")).withColumn("pos", F.lit(1)))
    return stores.needs_tests(stores.classify(version(i), version(i.where("l_returnflag <> 'R'")), ["key"])).select("key", "status")


# --- names, text, rates ------------------------------------------------------------------------------------------------


@_query("q68_text_functions", r"""SELECT p_partkey, split_part(p_name, ' ', 1) || ',' || split_part(p_name, ' ', 2) || '|' || p_type AS csv, p_brand || '|' || p_type AS words, 'pkg/' || p_size || '_test.go' AS test_path, 'd' || CASE WHEN p_size % 2 = 0 THEN '' ELSE '/' || p_size END AS joined,
    'Set' || p_size AS receiver, 'Item' || p_size || ',Other' AS types, '(a, b' || p_size || ')' AS args, 'x := ' || p_size AS code, CASE WHEN p_size % 2 = 0 THEN 'linux && ' || p_size ELSE '' END AS tag,
    p_brand || chr(10) || p_type AS solid, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 8) || '...' ELSE p_name END AS cut,
    CASE WHEN p_size < 10 THEN p_size * 100 || 'ms' WHEN p_size < 30 THEN printf('%.1f', p_size * 2.0::DOUBLE) || 's' ELSE p_size || 'm ' || p_size || 's' END AS duration, printf('%.1f', least(100, p_size * 3)::DOUBLE) || '%' AS bar,
    CASE WHEN p_size % 3 = 0 THEN '✅' WHEN p_size % 3 = 1 THEN '❌' ELSE '❓' END AS mark, 'a\_' || p_size || '\&\#\%' AS latex FROM part""")
def q68(spark: SparkSession, d: str) -> DataFrame:
    size, n = F.col("p_size"), F.col("p_size").cast("string")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    millis = F.when(size < 10, size * 100).when(size < 30, size * 2000).otherwise(size * 60_000 + size * 1000)
    duration = scalars.duration_text(millis)
    return table(spark, d, "part").select(
        "p_partkey",
        F.concat(F.array_join(scalars.split_csv(F.concat_ws(" , ", F.split("p_name", " "))), ","), F.lit("|"), F.col("p_type")).alias("csv"), F.array_join(scalars.split_spaces(said("  ", F.col("p_brand"), " \t ", F.col("p_type"), " ")), "|").alias("words"),
        scalars.test_file_path(said("pkg/", n, ".go")).alias("test_path"), scalars.join_path(F.lit("d"), F.when(size % 2 == 1, n)).alias("joined"), scalars.base_receiver(said("*Set", n, "[K, V]")).alias("receiver"),
        F.array_join(scalars.exported_type_names(said("map[string]*Item", n, "[Other]")), ",").alias("types"), scalars.call_arguments(said("(a int, b", n, " string) error")).alias("args"), scalars.strip_code_fence(said("```go\nx := ", n, "\n```\n")).alias("code"),
        scalars.build_tag(F.when(size % 2 == 0, said("// c\n//go:build linux && ", n, "\n\npackage p\n")).otherwise("package p\n//go:build no\n")).alias("tag"), scalars.without_blank_lines(said(F.col("p_brand"), "\n\t \n\n", F.col("p_type"))).alias("solid"),
        scalars.truncate_bytes(F.col("p_name"), 8).alias("cut"), duration.alias("duration"), scalars.bar_width(size * 3).alias("bar"),
        scalars.lookup(scalars.STATUS_MARKS, F.when(size % 3 == 0, "success").when(size % 3 == 1, "failed").otherwise("x"), scalars.NO_MARK).alias("mark"), scalars.escape_latex(said("a_", n, "&#%")).alias("latex"))


@_query("q69_test_name_scores", """WITH f AS (SELECT DISTINCT lower(n_name) AS n FROM nation), t AS (SELECT c_nationkey AS file, 'nation' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'x' END AS a FROM customer)
    SELECT file, avg(s) * 100 AS test_name_score FROM (SELECT file, a, max(CASE WHEN a = n THEN 1.0::DOUBLE ELSE 1.0 - levenshtein(a, n)::DOUBLE / greatest(length(a), length(n)) END) AS s FROM t, f GROUP BY file, a) JOIN t USING (file, a) GROUP BY file""")
def q69(spark: SparkSession, d: str) -> DataFrame:
    focal = table(spark, d, "nation").agg(scalars.focal_index(F.collect_list("n_name")).alias("names"))  # twenty-five names
    tests = table(spark, d, "customer").select(F.col("c_nationkey").alias("file"), F.concat(F.lit("TestNation"), F.when(F.col("c_custkey") % 2 == 1, "x").otherwise("")).alias("test"))
    return naturalness.name_scores(tests.join(F.broadcast(focal), how="cross"), F.col("names"))


@_query("q70_variable_scores", """SELECT c_nationkey AS file, avg(CASE WHEN lower(c_mktsegment) = 'building' THEN 1.0::DOUBLE ELSE 1.0 - levenshtein(lower(c_mktsegment), 'building')::DOUBLE / greatest(length(c_mktsegment), 8) END) * 100 AS var_name_score FROM customer WHERE c_custkey % 4 > 1 GROUP BY c_nationkey""")
def q70(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    return naturalness.variable_scores(table(spark, d, "customer").select(F.col("c_nationkey").alias("file"), F.when(k == 0, "err").otherwise(F.col("c_mktsegment")).alias("name"), F.when(k != 1, "Building").alias("label")))


@_query("q71_assertion_kinds", """WITH c AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'assert' WHEN 1 THEN 'require' WHEN 2 THEN 't' WHEN 3 THEN 'x' WHEN 4 THEN 'assert' WHEN 5 THEN 't' WHEN 6 THEN 'a' ELSE 'r' END AS receiver,
      CASE doc_id % 8 WHEN 0 THEN 'Equal' WHEN 1 THEN 'NoError' WHEN 2 THEN 'Errorf' WHEN 3 THEN 'Equal' WHEN 4 THEN 'Panics' WHEN 5 THEN 'Log' WHEN 6 THEN 'Len' ELSE 'Contains' END AS method FROM documents)
    SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'equal' WHEN 1 THEN 'error' WHEN 2 THEN 'fatal' WHEN 4 THEN 'panic' WHEN 6 THEN 'len' ELSE 'contains' END AS kind, doc_id % 8 = 1 OR doc_id % 8 = 2 AND doc_id % 3 > 0 AS is_error FROM c WHERE doc_id % 8 NOT IN (3, 5)""")
def q71(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("doc_id") % 8).cast("int")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), k + 1)
    argument = F.element_at(F.array(F.lit("got"), F.lit("saveErr"), F.lit("err.Error()")), (F.col("doc_id") % 3).cast("int") + 1)
    calls = table(spark, d, "documents").select("doc_id", pick("assert", "require", "t", "x", "assert", "t", "a", "r").alias("receiver"), pick("Equal", "NoError", "Errorf", "Equal", "Panics", "Log", "Len", "Contains").alias("method"), F.array(F.lit('"m"'), argument).alias("args"))
    return naturalness.classify(calls).select("doc_id", "kind", "is_error")


@_query("q72_mutation_score", """SELECT count(*) AS total, count(*) FILTER (l_linestatus = 'F' AND l_tax <> 0.08) AS killed, count(*) FILTER (l_linestatus <> 'F' AND l_tax <> 0.08) AS survived, count(*) FILTER (l_tax = 0.08) AS errors,
    count(*) FILTER (l_linestatus = 'F' AND l_tax <> 0.08)::DOUBLE / (count(*) FILTER (l_tax <> 0.08))::DOUBLE * 100.0 AS score FROM lineitem""")
def q72(spark: SparkSession, d: str) -> DataFrame:
    return mutation.score(table(spark, d, "lineitem").select((F.col("l_linestatus") == "F").alias("killed"), F.when(F.col("l_tax") == 0.08, "x").alias("error")))


@_query("q73_mutant_operators", """WITH m AS (SELECT p_partkey, ['+', '<', '==', '&&', '/', '%'][p_size % 6 + 1] AS op FROM part)
    SELECT p_partkey, op, CASE op WHEN '+' THEN 'arithmetic' WHEN '/' THEN 'arithmetic' WHEN '<' THEN 'comparison' WHEN '==' THEN 'comparison' WHEN '&&' THEN 'logical' ELSE 'other' END AS kind,
           CASE op WHEN '+' THEN '-' WHEN '/' THEN '*' WHEN '<' THEN '<=' WHEN '==' THEN '!=' WHEN '&&' THEN '||' END AS replacement, CASE WHEN p_partkey % 2 = 0 THEN 'false' ELSE '1' END AS returned FROM m""")
def q73(spark: SparkSession, d: str) -> DataFrame:
    op = F.element_at(F.array(*map(F.lit, ("+", "<", "==", "&&", "/", "%"))), F.col("p_size") % 6 + 1)
    kind = mutation.kind_of(F.col("op"))
    return table(spark, d, "part").select("p_partkey", op.alias("op")).select("p_partkey", "op", kind.alias("kind"), mutation.replacement(kind, F.col("op")).alias("replacement"), mutation.replacement(F.lit("return"), F.when(F.col("p_partkey") % 2 == 0, "true").otherwise("0")).alias("returned"))


@_query("q74_select_configs", """SELECT row_number() OVER (ORDER BY n) - 1 AS place, n AS name FROM (SELECT DISTINCT c_mktsegment AS n FROM customer WHERE c_mktsegment < 'F' OR c_mktsegment > 'L')""")
def q74(spark: SparkSession, d: str) -> DataFrame:
    configs = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    names = [r[0] for r in configs.where("name < 'F' or name > 'L'").orderBy("name").collect()]  # a handful of names
    found, missing = metrics.select_configs(configs, [*names, "none"])
    assert missing == ["none"]
    return found.select((F.row_number().over(metrics.Window.orderBy("name")) - 1).cast("bigint").alias("place"), "name")


@_query("q75_run_outcomes", "SELECT count(*) FILTER (value < 50) AS ok, count(*) FILTER (value >= 50) AS failed FROM events")
def q75(spark: SparkSession, d: str) -> DataFrame:
    return metrics.run_outcomes(table(spark, d, "events").select(F.when(F.col("value") < 50, 0).otherwise(1).alias("exit_code")))


@_query("q76_prompt_budget", """WITH r AS (SELECT doc_id, text, strlen(text) // 4 > 600 AS over, string_split(text, chr(10)) AS l FROM documents)
    SELECT doc_id, over AS truncated, md5(CASE WHEN over AND len(l) > 6 THEN array_to_string(l[1:3] || [chr(9) || '// ... ' || (len(l) - 6) || ' lines truncated ...'] || l[-3:], chr(10)) ELSE text END) AS body_md5,
           CASE WHEN over THEN 2 ELSE 3 END AS callees, CASE WHEN over THEN 1 ELSE 2 END AS names FROM r""")
def q76(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"), F.array("text").alias("bodies"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("callees"), F.array(F.lit("x"), F.lit("y")).alias("test_names"))
    out = patterns.enforce_budget(requests, max_tokens=1000, overhead=300, reserve=100, body_lines=6, callees=2, names=1)
    return out.select("doc_id", "truncated", F.md5(F.get("bodies", 0)).alias("body_md5"), F.size("callees").alias("callees"), F.size("test_names").alias("names"))
