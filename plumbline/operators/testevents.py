"""Test results from event streams and from text logs, and the feedback and pruning derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import expected_and_got, source_line
from .scans import ordered, running


def fold_events(events: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row a (package, test): last pass or fail, sticky skip, last elapsed, outputs in order, first place seen.

    Aggregates only: the fold does not depend on partitioning, and it runs unchanged on a stream.
    """
    keys = [*extra, "package", "test"]
    rows = events.where(F.coalesce("Test", F.lit("")) != "").withColumn("package", F.coalesce("Package", F.lit(""))).withColumn("test", F.col("Test"))
    decided, ended = F.col("Action").isin("pass", "fail"), F.col("Action").isin("pass", "fail", "skip")
    printed = (F.col("Action") == "output") & (F.coalesce("Output", F.lit("")) != "")
    out = rows.groupBy(*keys).agg(
        F.coalesce(F.max_by(F.col("Action") == "pass", F.when(decided, F.col("seq"))), F.lit(False)).alias("passed"),
        F.coalesce(F.bool_or(F.col("Action") == "skip"), F.lit(False)).alias("skipped"),
        F.coalesce(F.max_by(F.coalesce("Elapsed", F.lit(0.0)), F.when(ended, F.col("seq"))), F.lit(0.0)).alias("elapsed"),
        F.array_sort(F.collect_list(F.when(printed, F.struct("seq", "Output")))).alias("_out"), F.min("seq").alias("first_seq"))
    return out.withColumn("output", F.transform("_out", lambda o: o["Output"])).drop("_out")


def text_results(logs: DataFrame) -> DataFrame:
    """(path, name, passed, place) of text logs, (path, value) or (path, seq, line): place puts all passes first, then all
    failures; of lines it is no number of tests but a struct of that order."""
    value = F.concat("line", F.lit("\n")) if "line" in logs.columns else F.col("value")

    def named(status: str) -> Column:
        return F.regexp_extract_all(value, F.lit(rf"--- {status}: (\S+)\s"), F.lit(1))

    if "line" in logs.columns:
        told = F.explode(F.arrays_zip(named("PASS").alias("p"), named("FAIL").alias("f")))
        rows = logs.where(F.col("line").contains("--- ")).select("path", "seq", told.alias("r"))
        both = F.explode(F.array(F.struct(F.col("r.p").alias("name"), F.lit(True).alias("passed")), F.struct(F.col("r.f").alias("name"), F.lit(False).alias("passed"))))
        return rows.select("path", "seq", both.alias("r")).where("r.name is not null").select("path", "r.name", "r.passed", F.struct((~F.col("r.passed")).alias("failed"), "seq").alias("place"))
    mark = lambda names, passed: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(passed).alias("passed")))
    rows = logs.select("path", F.posexplode(F.concat(mark(named("PASS"), True), mark(named("FAIL"), False))).alias("place", "r"))
    return rows.select("path", "r.name", "r.passed", "place")


def is_json_stream(text: Column) -> Column:
    return text.contains('{"Action":') | text.contains('{"Time":')


def results(folded: DataFrame) -> DataFrame:
    """Results that were not skipped."""
    return folded.where("not skipped").select("package", F.col("test").alias("name"), "passed", "first_seq")


def top_level(name: Column) -> Column:
    return F.split_part(name, F.lit("/"), F.lit(1))


def failing_top_level(tests: DataFrame) -> DataFrame:
    return tests.where("not passed").select(top_level(F.col("name")).alias("name")).distinct()


def failing_subtests(tests: DataFrame, order: str = "first_seq") -> DataFrame:
    """(name, subtests) of top-level tests with failing sub-tests, these in order."""
    sub = F.expr("substring(name, instr(name, '/') + 1)")
    rows = tests.where("not passed and instr(name, '/') > 0").select(top_level(F.col("name")).alias("top"), F.struct(F.col(order).alias("o"), sub.alias("s")).alias("x"))
    return rows.groupBy("top").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("subtests")).withColumnRenamed("top", "name")


def all_subtests_failing(tests: DataFrame) -> DataFrame:
    """(name, all_failing) by top-level test: whether every sub-test failed; true without sub-tests."""
    is_sub = F.instr("name", "/") > 0
    return tests.groupBy(top_level(F.col("name")).alias("top")).agg(F.coalesce(F.bool_and(F.when(is_sub, ~F.col("passed"))), F.lit(True)).alias("all_failing")).withColumnRenamed("top", "name")


def test_counts(folded: DataFrame) -> DataFrame:
    return folded.where("not skipped").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def count_status_lines(text: Column, status: str) -> Column:
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: x.contains(f"--- {status}:")))


def is_valid(compiled: Column, passed: Column) -> Column:
    return compiled & passed


def validation_summary(r: DataFrame) -> Column:
    """One text a validation result (compile_ok, tests_ok, has_races, passed, failed, duration, compile_error, test_error, races)."""
    many = lambda c: r[c].cast("string")
    raced = F.concat(F.lit("⚠️  Tests passed but DATA RACE detected ("), many("passed"), F.lit(" passed, "), r["duration"], F.lit("):\n"), r["races"])
    failed = F.concat(F.lit("⚠️  Tests failed ("), many("passed"), F.lit(" passed, "), many("failed"), F.lit(" failed):\n"), r["test_error"])
    good = F.concat(F.lit("✅ All tests passed ("), many("passed"), F.lit(" passed, "), r["duration"], F.lit(")"))
    return F.when(~r["compile_ok"], F.concat(F.lit("❌ Compilation error:\n"), r["compile_error"])).when(~r["tests_ok"], failed).when(r["has_races"], raced).otherwise(good)


# --- feedback ----------------------------------------------------------------------------------------------------------


def first_message(output: Column) -> Column:
    """First output line that says something: not blank, not a marker."""
    told = F.filter(F.transform(output, lambda o: F.regexp_replace(o, r"^\s+|\s+$", "")), lambda o: (o != "") & ~o.startswith("=== ") & ~o.startswith("--- "))
    return F.get(told, 0)


def summarise_failures(folded: DataFrame) -> DataFrame:
    """(place, line): FAIL name: message, in the order in which tests were first seen."""
    failed = folded.where("not skipped and not passed").withColumn("m", first_message(F.col("output")))
    line = F.concat(F.lit("FAIL "), F.col("test"), F.coalesce(F.concat(F.lit(": "), F.col("m")), F.lit("")))
    return failed.select(F.col("first_seq").alias("place"), line.alias("line"))


def feedback_from_events(folded: DataFrame) -> DataFrame:
    """(name, passed, expected, got, error, line, first_seq); only a test's own outputs count."""
    told = F.filter(F.transform("output", lambda o: F.regexp_replace(o, r"^\s+|\s+$", "")), lambda o: (o != "") & ~o.startswith("=== ") & ~o.startswith("--- "))
    rows = folded.where("not skipped").withColumn("_t", F.when(F.col("passed"), F.expr("cast(array() as array<string>)")).otherwise(told)).withColumn("_m", F.array_join("_t", " ")).withColumn("_p", expected_and_got(F.col("_m")))
    return rows.select(F.col("test").alias("name"), "passed", "_p.expected", "_p.got", F.array_join("_t", "; ").alias("error"), source_line(F.col("_m")).alias("line"), "first_seq")


def error_context(logs: DataFrame) -> DataFrame:
    """(path, name, expected, got, error, line) of failing tests of text logs: (path, value), or (path, seq, line) of read_lines.

    A test's messages are the lines between its RUN marker and its result: islands numbered by a running count of markers, by
    a scan over the parts of a log, so that many tasks work on one log.
    """
    rows = ordered(logs).withColumn("t", F.regexp_replace("line", r"^\s+|\s+$", ""))
    run, result = F.col("t").startswith("=== RUN"), F.col("t").rlike(r"^--- (FAIL|PASS):")
    rows = rows.where(run | (F.col("t") != "") & ~F.col("t").startswith("===")).select("path", "part", "row", "single", "t")
    rows = running(rows, {"started": run, "marks": run | result}).withColumn("island", F.col("marks") - result.cast("int"))
    is_message = (F.col("started") > 0) & ~F.col("t").startswith("===") & ~result
    closes, place = F.when(result, F.col("t")), F.struct("part", "row")
    by = rows.groupBy("path", "island").agg(F.array_sort(F.collect_list(F.when(is_message, F.struct("part", "row", "t")))).alias("m"), F.max(closes).alias("end"), F.max(F.when(result, place)).alias("at"))
    parts = F.split(F.col("end"), r"\s+")
    failed = by.where(F.col("end").startswith("--- FAIL:") & (F.size("m") > 0) & (F.size(parts) >= 3)).withColumn("texts", F.transform("m", lambda x: x["t"]))
    joined = F.array_join("texts", " ")
    out = failed.select("path", parts[2].alias("name"), "at", expected_and_got(joined).alias("_p"), F.array_join("texts", "; ").alias("error"), source_line(joined).alias("line"))
    last = out.groupBy("path", "name").agg(F.max_by(F.struct("_p", "error", "line"), "at").alias("x"))
    return last.select("path", "name", "x._p.expected", "x._p.got", "x.error", "x.line")


def feedback_from_text(logs: DataFrame) -> DataFrame:
    r = text_results(logs).join(error_context(logs), ["path", "name"], "left")
    blank = {c: "" for c in ("expected", "got", "error", "line")}
    return r.select("path", "name", "passed", *[F.when(F.col("passed"), F.lit("")).otherwise(F.col(c)).alias(c) for c in blank], "place").fillna(blank)


def informative_lines(text: Column) -> Column:
    """Lines of a text log that tell of failures, one for each reason to list them; the whole text if there are none."""
    def told(x: Column) -> Column:
        located = x.contains(": ") & (x.contains(".go:") | x.contains("cannot") | x.contains("undefined"))
        reasons = (located, x.startswith("--- FAIL:"), x.contains("Error Trace:") | x.contains("Error:"), x.startswith("FAIL"))
        return F.array_compact(F.array(*[F.when(r, x) for r in reasons]))

    lines = F.flatten(F.transform(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), told))
    return F.when(F.size(lines) == 0, text).otherwise(F.array_join(lines, "\n"))


def race_details(logs: DataFrame, limit: int = 30) -> DataFrame:
    """(path, details): lines from a race warning to the blank line after it, once more than three lines are held in all.

    The end of a block depends on how many lines were taken before, so the lines of a log are folded in one expression.
    """
    start = F.expr("named_struct('on', false, 'out', cast(array() as array<string>))")

    def step(acc: Column, line: Column) -> Column:
        on = acc["on"] | line.contains("WARNING: DATA RACE")
        out = F.when(on, F.concat(acc["out"], F.array(line))).otherwise(acc["out"])
        ends = (F.trim(line) == "") & (F.size(out) > 3)
        return F.struct((on & ~ends).alias("on"), out.alias("out"))

    taken = F.aggregate(F.split("value", "\n", -1), start, step, lambda acc: acc["out"])
    shown = F.when(F.size("_r") > limit, F.concat(F.slice("_r", 1, limit), F.array(F.lit("... (truncated)")))).otherwise(F.col("_r"))
    return logs.select("path", taken.alias("_r")).select("path", F.array_join(shown, "\n").alias("details"))


def prune_plan(tests: DataFrame, order: str = "first_seq") -> DataFrame:
    """(name, action, cases) by failing top-level test: remove the function if all sub-tests fail or there are none, else its failing cases."""
    top = failing_top_level(tests).join(all_subtests_failing(tests), "name").join(failing_subtests(tests, order), "name", "left")
    whole = F.col("all_failing") | F.col("subtests").isNull()
    return top.select("name", F.when(whole, "remove_function").otherwise("remove_cases").alias("action"), F.when(~whole, F.col("subtests")).alias("cases"))


def kept_cases(cases: DataFrame, plan: DataFrame) -> DataFrame:
    """Table cases that stay: anti-join on (function, name), where blanks and underscores are the same."""
    same = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    gone = plan.where("action = 'remove_cases'").select(F.col("name").alias("_f"), F.explode("cases").alias("_c")).select("_f", same(F.col("_c")).alias("_c"))
    functions = plan.where("action = 'remove_function'").select(F.col("name").alias("_f"))
    out = cases.join(functions, cases["func"] == F.col("_f"), "left_anti")
    return out.join(gone, (out["func"] == gone["_f"]) & (same(out["name"]) == gone["_c"]), "left_anti")
