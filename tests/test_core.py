"""Fixtures with known results: sources, coverage, events, metrics, names, stores."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import globs, golang, scalars
from plumbline.operators import coverage, graphs, metrics, mutation, naturalness, patterns, render, stores, testevents
from plumbline.sources import gosource, reports, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


DIFF = """diff --git a/calc.go b/calc.go
index 1..2 100644
--- a/calc.go
+++ b/calc.go
@@ -1,8 +1,12 @@
 package calc
 
+import "errors"
+
 func Add(a, b int) int {
-\treturn a + b
+\tif a == 0 {
+\t\treturn b
+\t}
 }
\\ No newline at end of file
@@ -20 +24,2 @@ func X
 a
+b
diff --git a/gone.go b/kept.go
@@ -1 +1 @@
-x
+y
"""


def test_diff_lines_are_numbered(spark):
    d = text.diff_lines(spark.createDataFrame([("d", DIFF)], "path string, value string"))
    added = [(r.file, r.line) for r in text.changed_lines(d).orderBy("pos").collect()]
    assert added == [("calc.go", n) for n in (3, 4, 6, 7, 8)] + [("calc.go", 25), ("kept.go", 1)]
    assert {r.old_no for r in d.where("type = 'deleted'").collect()} == {4, 1}
    h = text.hunks(spark.createDataFrame([("d", DIFF)], "path string, value string")).orderBy("pos").collect()
    assert [(r.old_start, r.old_count, r.new_start, r.new_count) for r in h] == [(1, 8, 1, 12), (20, 1, 24, 2), (1, 1, 1, 1)]


PROFILE = """mode: set
m/calc.go:9.30,13.2 3 1
m/calc.go:17.2,18.9 1 2
m/calc.go:22.1,25.3 2 0
m/calc.go:26.1,26.9 1 1
m/calc.go:30.1,28.9 1 1
c:/m/other.go:1.1,2.2 1 0
"""


def test_profile_and_diff_coverage(spark):
    blocks = text.coverage_blocks(spark.createDataFrame([("p", PROFILE)], "path string, value string"))
    assert blocks.count() == 6 and blocks.where("file = 'c:/m/other.go'").count() == 1
    covered = coverage.covered_lines(blocks)
    assert sorted(r.line for r in covered.collect()) == [9, 10, 11, 12, 13, 17, 18, 26]
    changed = spark.createDataFrame([("m/calc.go", n) for n in (9, 10, 13, 22, 23)], "file string, line int")
    r = coverage.diff_coverage(changed, covered).first()
    assert (r.covered, r.uncovered, r.pct) == ([9, 10, 13], [22, 23], 60.0)
    t = coverage.total_coverage(spark.createDataFrame([(4, 3), (2, 2)], "total int, hit int")).first()
    assert (t.total, t.covered, t.uncovered, round(t.pct, 2)) == (6, 5, 1, 83.33)
    assert coverage.total_coverage(spark.createDataFrame([], "total int, hit int")).first().pct == 100.0


def test_profile_matching_by_suffix_and_exact(spark):
    blocks = spark.createDataFrame([("m/calc.go", 1), ("m/mycalc.go", 2), ("m/x.go", 3)], "file string, start_line int")
    files = spark.createDataFrame([("src/calc.go",)], "file string")
    assert sorted(r.start_line for r in coverage.match_files(blocks, files).collect()) == [1, 2]
    assert coverage.match_files(blocks, spark.createDataFrame([("m/x.go",)], "file string"), "exact").count() == 1


@pytest.mark.parametrize("line", ["a.go:1.2,3.4 5", "nocolon 1 2", "a.go:1.2 3 4", "a.go:1.2,3.4 5 x"])
def test_malformed_profiles_fail(spark, line):
    bad = spark.createDataFrame([("p", "mode: set\n" + line)], "path string, value string")
    with pytest.raises(Exception, match="malformed"):
        text.coverage_blocks(bad).collect()
    assert text.coverage_blocks(bad, strict=False).count() == 0


def test_branch_coverage(spark):
    branches = spark.createDataFrame([("f", 5, True), ("f", 10, False), ("f", 15, False)], "file string, line int, is_error_path boolean")
    covered = spark.createDataFrame([("f", 5), ("f", 15)], "file string, line int")
    r = coverage.branch_coverage(branches, covered).first()
    assert (r.covered, r.total, round(r.pct, 2), r.error_pct) == (2, 3, 66.67, 100.0)


EVENTS = "\n".join([
    "# pkg", "undefined: bar", '{"Action":"start","Package":"p"}', '{"Action":"run","Package":"p","Test":"TestA"}', '{"Action":"output","Package":"p","Test":"TestA","Output":"a1\\n"}',
    '{"Action":"run","Package":"p","Test":"TestB"}', '{"Action":"output","Package":"p","Test":"TestB","Output":"    b_test.go:7: expected \\"x\\", got \\"y\\"\\n"}', '{"Action":"output","Package":"p","Test":"TestA","Output":"a2\\n"}',
    '{"Action":"fail","Package":"p","Test":"TestB","Elapsed":0.5}', '{"Action":"pass","Package":"p","Test":"TestA","Elapsed":0.1}', '{"Action":"skip","Package":"p","Test":"TestC"}', '{broken json', '{"Action":1,"Test":"T"}', ""])


def test_event_source_and_fold(spark):
    raw = spark.createDataFrame([("e", EVENTS)], "path string, value string")
    assert text.events(raw).count() == 9
    assert [r.line for r in text.side_output(raw).orderBy("seq").collect()] == ["# pkg", "undefined: bar", "{broken json", '{"Action":1,"Test":"T"}']
    folded = testevents.fold_events(text.events(raw).repartition(3))
    rows = {r.test: r for r in folded.collect()}
    assert rows["TestA"].passed and rows["TestA"].output == ["a1\n", "a2\n"] and rows["TestA"].elapsed == 0.1
    assert not rows["TestB"].passed and rows["TestC"].skipped
    assert [r.test for r in folded.orderBy("first_seq").collect()] == ["TestA", "TestB", "TestC"]
    fb = {r.name: r for r in testevents.feedback_from_events(folded).collect()}
    assert (fb["TestB"].expected, fb["TestB"].got, fb["TestB"].line) == ("x", "y", "b_test.go:7") and "TestC" not in fb
    assert testevents.test_counts(folded).first() == (1, 1)
    assert testevents.summarise_failures(folded).first().line.startswith("FAIL TestB: b_test.go:7")
    assert render.compact_feedback([fb["TestB"]]) == 'FAIL TestB: expected "x", got "y" (b_test.go:7)\n'


LOG = """=== RUN   TestReverse
=== RUN   TestReverse/simple
=== RUN   TestReverse/unicode_string
    r_test.go:20: got "a", want "b"
--- FAIL: TestReverse (0.00s)
    --- PASS: TestReverse/simple (0.00s)
    --- FAIL: TestReverse/unicode_string (0.00s)
=== RUN   TestCapitalize
    c_test.go:9: expected "HELLO", got "hello"
--- FAIL: TestCapitalize (0.00s)
=== RUN   TestOk
--- PASS: TestOk (0.00s)
"""


def test_text_logs_and_prune_plan(spark):
    logs = spark.createDataFrame([("l", LOG)], "path string, value string")
    r = testevents.text_results(logs).withColumnRenamed("place", "first_seq")
    assert {x.name for x in testevents.failing_top_level(r).collect()} == {"TestReverse", "TestCapitalize"}
    assert testevents.failing_subtests(r).collect() == [("TestReverse", ["unicode_string"])]
    assert dict(testevents.all_subtests_failing(r).collect()) == {"TestReverse": False, "TestCapitalize": True, "TestOk": True}
    plan = {x.name: (x.action, x.cases) for x in testevents.prune_plan(r).collect()}
    assert plan == {"TestReverse": ("remove_cases", ["unicode_string"]), "TestCapitalize": ("remove_function", None)}
    ctx = {x.name: x for x in testevents.error_context(logs).collect()}
    assert (ctx["TestCapitalize"].expected, ctx["TestCapitalize"].got, ctx["TestCapitalize"].line) == ("HELLO", "hello", "c_test.go:9")
    cases = spark.createDataFrame([("TestReverse", "simple"), ("TestReverse", "unicode string"), ("TestCapitalize", "x")], "func string, name string")
    assert [c.name for c in testevents.kept_cases(cases, testevents.prune_plan(r)).collect()] == ["simple"]


def test_race_details(spark):
    log = "x\nWARNING: DATA RACE\nA\nB\n\nC\n"
    assert testevents.race_details(spark.createDataFrame([("l", log)], "path string, value string")).first().details == "WARNING: DATA RACE\nA\nB\n"


def _runs(spark):
    rows = [("a", "full", 1, 1, 1, 80.0, 90.0, 1), ("b", "full", 2, 5, 4, 100.0, 70.0, 2), ("a", "no-types", 1, 3, 2, 60.0, None, 3)]
    return spark.createDataFrame(rows, "repo string, config string, files_processed int, tests_generated int, tests_validated int, diff_cov_pct double, mutation_pct double, seq int")


def test_average_and_matrix(spark):
    runs = _runs(spark)
    s = metrics.average_per_config(runs, sums=(), metrics=("diff_cov_pct", "mutation_pct")).collect()
    assert [(r.config, r.tests_generated, r.diff_cov_pct, r.mutation_pct) for r in s] == [("full", 6, 90.0, 80.0), ("no-types", 3, 60.0, None)]
    m = metrics.build_matrix(runs, "diff_cov_pct").collect()
    assert [r.asDict() for r in m] == [{"repo": "a", "full": 80.0, "no-types": 60.0}, {"repo": "b", "full": 100.0, "no-types": None}]


def test_totals(spark):
    nat = "struct<test_count:int,assertion_ratio:double,no_assertions_pct:double,duplicate_assertions_pct:double,nil_only_assertions_pct:double,error_assertions_pct:double,test_name_score:double,var_name_score:double>"
    cols = "tests_total int, tests_passed int, diff_coverage_pct double, mutation_killed int, mutation_total int, branches_covered int, branches_total int, error_paths_covered int, error_paths_total int, prompt_tokens bigint, completion_tokens bigint, naturalness " + nat
    rows = [(5, 4, 80.0, 3, 5, 5, 10, 1, 3, 1000, 500, (2, 1.0, 0.0, 0.0, 0.0, 0.0, 50.0, 10.0)), (3, 2, 60.0, 2, 4, 3, 5, 0, 0, 500, 300, (0, 9.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)), (0, 0, 0.0, 0, 0, 0, 0, 0, 0, 0, 0, None)]
    t = metrics.build_totals(spark.createDataFrame(rows, cols)).first()
    assert (t.tests_generated, t.tests_validated, t.diff_coverage_pct, t.mutation_score_pct, t.branch_coverage_pct) == (8, 6, 70.0, 5 / 9 * 100, 8 / 15 * 100)
    assert t.token_efficiency_tokens_per_test == 2300 / 6 and t.assertion_ratio == 1.0 and t.test_count == 2
    empty = metrics.build_totals(spark.createDataFrame([], cols)).first()
    assert empty.mutation_score_pct is None and empty.token_efficiency_tokens_per_test is None and empty.diff_coverage_pct is None


def test_reports_on_disk(spark, tmp_path):
    def put(path, config, diff):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"duration_seconds": 2.5, "totals": {"files_processed": 1, "tests_generated": 3, "tests_validated": 2, "diff_coverage_pct": diff, "naturalness": {"assertion_ratio": 1.5}}, "files": [{"file": "a.go", "status": "success"}, {"file": ""}], "config": {"ablation_config": config}}, indent=1))

    put(tmp_path / "r1/full.json", "full", 80.0)
    put(tmp_path / "r1/zzz.json", "", None)
    put(tmp_path / "r1/repo.json", "phantom", 1.0)
    put(tmp_path / "r1/index.json", "phantom", 1.0)
    put(tmp_path / "r2/no-types.json", "no-types", 60.0)
    rows = reports.load_all(spark, str(tmp_path)).collect()
    assert [(r.repo, r.config, r.diff_cov_pct, r.assertion_ratio) for r in rows] == [("r1", "full", 80.0, 1.5), ("r1", "zzz", None, 1.5), ("r2", "no-types", 60.0, 1.5)]
    assert [r.config for r in reports.load_reports(spark, str(tmp_path / "r1")).collect()] == ["full", "zzz"]
    assert reports.report_files(spark, f"{tmp_path}/r2/*.json").count() == 1
    summary = metrics.average_per_config(reports.load_all(spark, str(tmp_path)))
    md = render.summary_markdown(summary)
    assert md.split("\n")[2].startswith("| full | 1 | 3 | 2 | 80.0% | — | — | — | — | 1.50 |") and md.split("\n")[1].count("|") == 16
    assert render.summary_csv(summary).split("\n")[1].startswith("full,1,3,2,80.0000,,,,,1.5000,")
    assert "no-types & 1 & 3 & 2 & 60.0\\% " not in render.summary_latex(summary) and "no-types & 1 & 3 & 2 & 60.0%" in render.summary_latex(summary)
    runs = reports.load_all(spark, str(tmp_path))
    m = metrics.build_matrix(runs, "diff_cov_pct")
    assert "| r1 | 80.0% | — |" in render.matrix_markdown(m, "diff_cov_pct") and "r2,," in render.matrix_csv(m)
    dumped = json.loads(render.dump(summary, metrics.all_matrices(runs, metrics.ranked_configs(runs))))
    assert dumped["matrices"]["diff_cov_pct"]["repos"] == ["r1", "r2"] and len(dumped["matrices"]) == 13


def test_scalars(spark):
    s = F.lit
    r = one(spark, h=scalars.fnv1a32(s("repo")), e=scalars.fnv1a32(s("")), k=scalars.config_rank(s("no-types")), c=scalars.config_rank(s("custom")), sim=scalars.similarity(s("user"), s("users")),
            none=scalars.similarity(s(""), s("abc")), tok=scalars.test_name_tokens(s("TestFooBar_BazQux")), score=scalars.test_name_score(s("TestUser_Create"), F.array(s("usercreate"))),
            body=scalars.truncate_body(s("\n".join(map(str, range(10)))), 6), tokens=scalars.estimate_tokens(s("é" * 4)), norm=scalars.normalise_lines(s(" a \n\n// c\nb")), fence=scalars.strip_code_fence(s("```go\nx\n```")),
            tag=scalars.build_tag(s("// c\n//go:build linux\n\npackage p\n")), args=scalars.call_arguments(s("(a int, b string) error")), dur=scalars.duration_text(s(125000)), tex=scalars.escape_latex(s("a_b&c")))
    assert (r.h, r.e, r.k, r.c) == (3551840925, 2166136261, 1, 1000 + 542584942 % 1000)
    assert (r.sim, r.none, r.tok, round(r.score, 6)) == (0.8, 0.0, ["Foo", "Bar", "Baz", "Qux"], 90.0)
    assert r.body == "0\n1\n2\n\t// ... 4 lines truncated ...\n7\n8\n9" and r.tokens == 2 and r.norm == "a\nb" and r.fence == "x"
    assert (r.tag, r.args, r.dur, r.tex) == ("linux", "(a, b)", "2m 5s", "a\\_b\\&c")


@pytest.mark.parametrize(("path", "pattern", "expected"), [
    ("vendor/a/b.go", "vendor/**", True), ("vendorx/b.go", "vendor/**", True), ("a/x_mock.go", "*_mock.go", True), ("a/b/c.go", "generated/**", False), ("a/b.go", "**/b.go", True), ("a/b.go", "a/**/c/**", False), ("a.go", "?.go", True), ("ab.go", "[a-b].go", False)])
def test_globs(spark, path, pattern, expected):
    assert one(spark, m=globs.matches(F.lit(path), pattern)).m is expected


def test_excludes(spark):
    r = one(spark, a=globs.excluded(F.lit("x.pb.go")), b=globs.excluded(F.lit("a.go"), (), ["b*.go"]), c=globs.excluded(F.lit("b1.go"), (), ["b*.go"]))
    assert (r.a, r.b, r.c) == (True, True, False)


def test_stores(spark):
    base = spark.createDataFrame([("Add", "a", 1), ("Subtract", "b", 2), ("Add", "a2", 3)], "name string, body string, pos int")
    cur = spark.createDataFrame([("Add", "a2", 1), ("Subtract", "x", 2), ("Multiply", "m", 3)], "name string, body string, pos int")
    c = stores.classify(cur, base, ["name"])
    assert {r.name: r.status for r in c.collect()} == {"Add": "unchanged", "Subtract": "changed", "Multiply": "new"}
    assert [r.name for r in stores.needs_tests(c).collect()] == ["Subtract", "Multiply"]
    assert {r.status for r in stores.classify(cur, base.limit(0), ["name"]).collect()} == {"new"}
    cache = spark.createDataFrame([("a.go::F", "1", "2024-01-01"), ("b.go::G", "2", "2024-03-01")], "key string, hash string, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    hits, misses = stores.lookup(spark.createDataFrame([("a.go::F", "1"), ("b.go::G", "x")], "key string, hash string"), cache)
    assert hits.count() == 1 and misses.first().key == "b.go::G"
    after = stores.put(cache, spark.createDataFrame([("a.go::F", "9", "2024-04-01"), ("a.go::F", "8", "2024-03-01")], "key string, hash string, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp")))
    assert {r.key: r.hash for r in after.collect()} == {"a.go::F": "9", "b.go::G": "2"}
    assert stores.invalidate(after, "a.go").count() == 1 and stores.remove(after, "b.go::G").count() == 1
    now = F.to_timestamp(F.lit("2024-03-15"))
    assert stores.stats(cache, now).first() == (2, 1) and stores.prune(cache, now, 30).count() == 1
    field = lambda k, v: {"key": k, "value": v}
    cases = spark.createDataFrame([("T", 0, [field("name", "a"), field("in", "1")]), ("T", 1, [field("name", "b"), field("in", "1")]), ("T", 2, [field("in", "2")])], "func string, idx int, fields array<struct<key:string,value:string>>")
    kept = stores.keep_first(cases, ["func"], stores.case_fingerprint(F.col("fields"))).orderBy("idx").withColumn("name", stores.case_name(F.col("fields"))).collect()
    assert [(r.kept, r.name) for r in kept] == [(True, "a"), (False, "b"), (True, "<unnamed>")]
    assert stores.keep_first(cases.join(spark.createDataFrame([(0,), (2,)], "idx int"), "idx"), ["func"], stores.case_fingerprint(F.col("fields"))).where("not kept").count() == 0
    m = stores.merge_imports(spark.createDataFrame([("fmt", "f")], "path string, alias string"), spark.createDataFrame([("fmt", ""), ("os", "")], "path string, alias string"))
    assert m.collect() == [("fmt", "f"), ("os", "")]


def test_graphs(spark):
    needed = spark.createDataFrame([("RW", "Read"), ("RW", "Write"), ("R", "Read")], "interface string, method string")
    have = spark.createDataFrame([("File", "Read"), ("File", "Write"), ("Str", "Read"), ("Str", "Read")], "type string, method string")
    assert sorted(map(tuple, graphs.implementors(needed, have).collect())) == [("R", "File"), ("R", "Str"), ("RW", "File")]
    embeds = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("C", None)], "name string, embedded string")
    methods = spark.createDataFrame([("A", "m", "A.m"), ("B", "m", "B.m"), ("C", "n", "C.n")], "name string, method string, signature string")
    assert sorted(map(tuple, graphs.embedded_methods(embeds, methods).where("interface = 'A'").collect())) == [("A", "m", "A.m"), ("A", "n", "C.n")]


def test_mutation(spark):
    m = spark.createDataFrame([(1, "comparison", True, "", "Abs", 1, "<", "<="), (2, "comparison", False, "", "Abs", 2, ">", ">="), (3, "arithmetic", True, "", "Add", 3, "+", "-"), (4, "return", True, "", "F", 4, "nil", "x"), (5, "logical", False, "bad", "F", 5, "&&", "||")],
                              "id int, type string, killed boolean, error string, func_name string, line int, original string, replacement string")
    s = mutation.score(m).first()
    assert (s.killed, s.survived, s.errors, s.score) == (3, 1, 1, 75.0)
    assert [r.type for r in mutation.by_type(m).collect()] == ["arithmetic", "comparison", "return"]
    md = render.mutation_markdown(m)
    assert "75.0%" in md and "| 2 | Abs | 2 | comparison | `>` | `>=` |" in md and "| comparison | 1 | 2 | 50% |" in md
    r = one(spark, a=mutation.replacement(F.lit("comparison"), F.lit("==")), b=mutation.replacement(F.lit("return"), F.lit("nil")), c=mutation.kind_of(F.lit("&&")))
    assert (r.a, r.b, r.c) == ("!=", 'fmt.Errorf("mutant")', "logical")


GO = '''package calc

import (
	"fmt"
	e "errors"
)

// Store keeps things.
type Store struct {
	mu   sync.Mutex
	A, B int `json:"a"`
}

type Reader interface {
	Read(p []byte) (n int, err error)
	io.Closer
}

// Add adds.
func Add(a, b int) (int, error) {
	if err := check(a); err != nil {
		return 0, err
	} else if a > b {
		x := NewThing(a)
		fmt.Println(x)
	} else {
		return a + b, nil
	}
	for _, v := range []int{1, 2} {
		fmt.Println(v)
	}
	switch a {
	case 1:
		return 1, nil
	default:
	}
	select {
	case <-done:
		return a, nil
	}
	return a, nil
}

func (s *Store[T]) Get(fn func(int) error, xs ...string) map[string]int { return nil }
'''
GO_TEST = '''package calc

func TestAdd(t *testing.T) {
	tests := []struct {
		name string
		in   int
	}{
		{name: "a", in: 1},
		{name: "b b", in: 2},
	}
	assert.Equal(t, 1, Add(2))
	assert.Equal(t, 1, Add(2))
	assert.Nil(t, err)
}

func TestNone(t *testing.T) {}
'''


def test_go_source_tables(spark):
    files = spark.createDataFrame([("calc.go", GO), ("calc_test.go", GO_TEST)], "path string, value string")
    src, tests = gosource.go_files(files), gosource.go_files(files, tests=True)
    f = {r.name: r for r in gosource.functions(src).collect()}
    assert f["Add"].signature == "func Add(a int, b int) (int, error)" and (f["Add"].start_line, f["Add"].end_line) == (20, 42) and f["Add"].doc == "Add adds."
    assert f["Get"].receiver == "*Store[T]" and f["Get"].returns == ["map[string]int"] and f["Get"].params[1].type == "...string"
    t = {r.name: r for r in gosource.types(src).collect()}
    assert [x.name for x in t["Store"].fields] == ["mu", "A", "B"] and t["Reader"].embedded == ["io.Closer"] and t["Reader"].methods[0].name == "Read"
    b = [(r.kind, r.line, r.is_error_path) for r in gosource.branches(src).orderBy("pos").collect()]
    assert b == [("if", 22, True), ("else-if", 24, False), ("else", 27, False), ("switch-case", 34, False), ("default", 35, False), ("select-case", 39, False)]
    kinds = [r.type for r in gosource.mutants(src).where("func = 'Add'").orderBy("id").collect()]
    assert kinds.count("comparison") == 2 and kinds.count("arithmetic") == 1 and "return" in kinds
    assert {(r.receiver, r.method) for r in gosource.calls(src).where("func = 'Add'").collect()} == {("", "check"), ("", "NewThing"), ("fmt", "Println")}
    assert [(r.name, r.label) for r in gosource.locals_(src).where("func = 'Add'").collect()] == [("err", "check"), ("x", "Thing")]
    assert [[x.value for x in r.fields] for r in gosource.table_cases(tests).orderBy("pos").collect()] == [['"a"', "1"], ['"b b"', "2"]]
    asserts = gosource.assertions(tests)
    listed = gosource.functions(tests).select("file", F.col("name").alias("test"))
    n = naturalness.per_file(listed, asserts).first()
    assert (n.test_count, n.assertion_ratio, n.no_assertions_pct, n.duplicate_assertions_pct) == (2, 1.5, 50.0, 50.0)
    lines = {n for r in gosource.executable_ranges(src).collect() for n in range(r.start_line, r.end_line + 1)}
    assert lines == {*range(20, 42), 44}
    assert gosource.testable(gosource.functions(src)).count() == 2
    fn = gosource.functions(src).where("name = 'Get'").union(gosource.functions(src).where("name = 'Add'"))
    hints = {r.name: r.kinds for r in patterns.detect(fn, F.array(F.lit("encoding/json"), F.lit("net/http"))).collect()}
    assert hints == {"Get": [], "Add": []}
    conc = patterns.concurrency(fn, F.array(F.lit("sync.Mutex"))).withColumn("h", patterns.concurrency_hint(F.col("concurrency"))).collect()
    assert all(r.concurrency.is_concurrent and r.concurrency.has_mutex and "Concurrency in use" in r.h for r in conc)


def test_patterns(spark):
    schema = "name string, body string, params array<struct<name:string,type:string>>, returns array<string>"
    rows = [("h", "x", [("w", "http.ResponseWriter")], []), ("c", "<-ctx.Done()", [("ctx", "context.Context")], []), ("d", "", [("db", "*sql.DB")], []), ("e", 'fmt.Errorf("%w", err); os.OpenFile(p)', [], []), ("j", "json.Marshal(x)", [], ["http.Handler"])]
    got = {r.name: r.kinds for r in patterns.detect(spark.createDataFrame(rows, schema), F.array(F.lit("net/http"), F.lit("encoding/json"))).collect()}
    assert got == {"h": ["http_handler"], "c": ["context"], "d": ["database"], "e": ["file_io", "errors_wrap"], "j": ["http_handler", "json_encoding"]}


def test_go_edits():
    assert golang.normalise("a := 1 // x\n\n b()") == golang.normalise("a  :=  1\nb()")
    assert "b b" not in golang.remove_cases(GO_TEST, "TestAdd", {"b_b"}) and '"a"' in golang.remove_cases(GO_TEST, "TestAdd", {"b_b"})
    assert "TestNone" not in golang.remove_functions(GO_TEST, {"TestNone"})
    assert "a - b" in golang.apply_mutant(GO, "arithmetic", 27, "+", "-")
    merged, new, old = golang.merge('package p\n\nimport "os"\n\nfunc A() {}\n', 'package p\n\nimport "fmt"\n\nfunc A() {}\n\nfunc B() { fmt.Println() }\n')
    assert new == ["B"] and old == ["A"] and merged.count("func A") == 1 and '"fmt"' in merged and '"os"' in merged
    assert "ReadFunc func(p []byte) (int, error)" in golang.mock("Reader", [("Read", "Read(p []byte) (int, error)")])
    assert golang.split_outside("a, f(b, c), d") == ["a", "f(b, c)", "d"]
    assert 'import (\n\t"fmt"\n)' in golang.extract_functions(GO, ["Add"]) and "Get" not in golang.extract_functions(GO, ["Add"])


def test_dataset_and_config(spark, tmp_path):
    good = tmp_path / "d.yml"
    good.write_text("workdir: w\nrepos:\n  - name: a\n    url: u\n    base: b\n    head: h\n    exclude: [x, y]\n")
    df, work = reports.load_dataset(spark, str(good))
    assert df.first().exclude == ["x", "y"] and work == str(tmp_path / "w")
    for bad, message in (("repos: []\n", "no repos"), ("repos:\n  - name: a\n    url: u\n    base: b\n", "head is required"), ("repos:\n  - name: a/b\n    url: u\n", "path separators"),
                         ("repos:\n  - {name: a, url: u, base: b, head: h}\n  - {name: a, url: u, base: b, head: h}\n", "duplicate name") if _has_yaml() else ("repos: []\n", "no repos")):
        good.write_text(bad)
        with pytest.raises(ValueError, match=message):
            reports.load_dataset(spark, str(good))
    (tmp_path / ".plumbline.yml").write_text("exclude: '*.x'\nmax_retries: 0\ncoverage_threshold: 50\n")
    sub = tmp_path / "a/b"
    sub.mkdir(parents=True)
    c = reports.load_config(str(sub))
    assert (c.exclude, c.max_retries, c.coverage_threshold, c.errors()) == (["*.x"], 3, 50, [])
    assert reports.Config(max_retries=0, report_format="x").errors() == ["max_retries must be >= 1", "report_format must be one of: text, html, json"]


def _has_yaml():
    try:
        import yaml  # noqa: F401
    except ImportError:
        return False
    return True


def test_cache_store_and_env(spark, tmp_path):
    assert reports.load_cache(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "c.json").write_text(json.dumps({"entries": {"a.go::F": {"hash": "1", "test_file": "t", "generated_funcs": ["T"], "model": "m", "timestamp": "2024-01-01T00:00:00Z"}}}))
    c = reports.load_cache(spark, str(tmp_path / "c.json"))
    assert c.first().hash == "1"
    reports.save_cache(c, str(tmp_path / "out"))
    assert reports.load_cache(spark, str(tmp_path / "out")).first().generated_funcs == ["T"]
    env = spark.createDataFrame([("e", "# c\nA=1\nB=\"x y\"\nC='q=r'\nA=2\nbad\n")], "path string, value string")
    assert {r.key: r.value for r in text.env_entries(env).collect()} == {"A": "1", "B": "x y", "C": "q=r"}
    assert text.env_entries(env, spark.createDataFrame([("A",)], "key string")).count() == 2


def test_stream_fold_equals_batch(spark, tmp_path):
    from plumbline.streaming import events as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/e.json").write_text(EVENTS.replace('{broken json\n{"Action":1,"Test":"T"}\n', ""))
    q = stream.run_to(stream.fold_stream(stream.read_stream(spark, str(tmp_path / "in"))), "folded", str(tmp_path / "cp"))
    q.awaitTermination(120)
    batch = testevents.fold_events(text.events(text.read_texts(spark, str(tmp_path / "in"))))
    pick = lambda df: sorted((r.test, r.passed, r.skipped, tuple(r.output)) for r in df.collect())
    assert pick(spark.table("folded")) == pick(batch)


def test_text_executable_lines(spark):
    src = "package p\n\nimport (\n\t\"fmt\"\n)\n\n/* a\nb */\nfunc F() {\n\t// c\n\tx()\n}\n"
    rows = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(src.split("\n"))], "file string, line int, text string")
    changed = rows.where("line <> 5").select("file", "line")
    assert sorted(r.line for r in coverage.text_executable_lines(rows.select("file", "line"), rows).collect()) == [9, 11]
    assert not coverage.text_executable_lines(changed, rows).count()  # the import block is never seen to end


def test_closure_of_diamonds_and_cycles(spark):
    """A chain of forty diamonds has 2^40 paths; every name is met once."""
    edges = [e for i in range(40) for e in ((f"n{i}", f"a{i}"), (f"n{i}", f"b{i}"), (f"a{i}", f"n{i + 1}"), (f"b{i}", f"n{i + 1}"))] + [("n40", None), ("x", "y"), ("y", "x")]
    found = graphs.reachable(spark.createDataFrame(edges, "name string, embedded string")).where("root in ('n0', 'x')").collect()
    got = {(r.root, r.name): r.depth for r in found}
    assert len(found) == len(got) == 40 * 3 + 1 + 2 and got["n0", "n40"] == 80 and got["x", "y"] == 1


def test_lines_of_split_files(spark, tmp_path):
    (tmp_path / "log.json").write_text("".join(json.dumps({"Action": "pass" if i % 2 else "fail", "Package": "p", "Test": f"T{i // 100}", "Elapsed": 0.1}) + ("\r\n" if i % 3 else "\n") for i in range(3000)) + "# end\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = text.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        folded = testevents.fold_events(text.events(lines))
        assert sorted((r.test, r.passed) for r in folded.collect()) == sorted((f"T{i}", True) for i in range(30))
        assert [r.line for r in text.side_output(lines).collect()] == ["# end"]
        assert [r.test for r in folded.orderBy("first_seq").collect()] == [f"T{i}" for i in range(30)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(("expression", "expected"), [("err", True), ("E", True), ("ER", True), ("e", True), ("saveErr", True), ("err.Error()", True), ("x.Error()", True), ("f(err)", False), ("x.Err", True), ("errf(a(b))", False), ("err.Unwrap(f(1)).X", True),
                                                      ("got", False), ('"err"', False), ("(err)", False), ("&err", False), ('do("a)b").Err()', True), ("errs", False), ("x.(error)", False)])
def test_error_expressions(spark, expression, expected):
    assert one(spark, r=naturalness.is_error_expression(F.lit(expression))).r is expected


def test_gotest_tools_assertions(spark):
    rows = [("assert", "Check", ["t", "a == b"]), ("assert", "Check", ["t", "ok(x)"]), ("assert", "Assert", ["t", "ok"]), ("assert", "DeepEqual", ["t", "a", "b"]), ("assert", "NilError", ["t", "err"]), ("assert", "Equal", ["t", "1", "2"]), ("x", "Check", ["t", "a"])]
    calls = spark.createDataFrame(rows, "receiver string, method string, args array<string>")
    assert [r.method for r in naturalness.classify(calls).collect()] == ["Equal"]
    assert [(r.method, r.kind, r.is_error) for r in naturalness.classify(calls, gotest_tools=True).collect()] == [("Check", "equal", False), ("Check", "other", False), ("Assert", "bool", False), ("DeepEqual", "equal", False), ("NilError", "error", True), ("Equal", "equal", False)]


@pytest.mark.parametrize(("body", "env", "send", "receive"), [('x := "os.Getenv(1)" // os.Getenv("A")', False, False, False), ('os.Getenv("A")', True, False, False), ("a.os.Getenv()", False, False, False), ("os . LookupEnv (k)", True, False, False),
                                                              ("ch <- 1", False, True, False), ("x := <-ch", False, False, True), ("for v := range ch {}\n<-done", False, False, True), ("f(<-ch)", False, False, True), ("m[k] <- v", False, True, False), ("func f(a chan<- int, b <-chan int) {}", False, False, False)])
def test_calls_and_channels_by_syntax(spark, body, env, send, receive):
    f = spark.createDataFrame([(body, [], [])], "body string, params array<struct<name:string,type:string>>, returns array<string>")
    found = patterns.concurrency(f).first().concurrency.patterns
    assert (one(spark, e=patterns.any_call(F.lit(body), patterns.ENV_CALLS)).e, "channel send" in found, "channel receive" in found) == (env, send, receive)


def test_branch_texts_and_merge():
    source = golang.Source("package p\nfunc F(v any) {\n\tif x := f(); x > 1 {\n\t} else if err != nil {\n\t} else {\n\t}\n\tswitch v.(type) {\n\tcase int, string:\n\t}\n\tswitch a {\n\tcase 1, g(2, 3):\n\t\tif nil != err {\n\t\t}\n\tdefault:\n\t}\n\tselect {\n\tcase m := <-ch:\n\tdefault:\n\t}\n}\n")
    assert source.branch_texts(source.functions[0]) == [
        "Condition: `x > 1`", "Else-if: `err != nil`", "Else branch", "Error check (err != nil)", "Type switch", "Switch statement", "Case: `1`", "Case: `g(2, 3)`", "Default case", "Condition: `nil != err`", "Error check (err != nil)", "Select statement", "Case: `m := <-ch`", "Default case"]
    code, added, skipped = golang.merge("package p\n\nimport \"a\"\n\nvar X = 1\n\nfunc A() {}\n", "package p\n\nimport (\n\t\"b\"\n)\n\nvar (\n\tX = 2\n)\n\nconst Y = 3\n\n// B is.\nfunc B() {}\n\nfunc A() {}\n")
    assert code == "package p\n\nimport (\n\t\"a\"\n\t\"b\"\n)\n\nvar X = 1\n\nfunc A() {}\n\nconst Y = 3\n\n// B is.\nfunc B() {}\n" and added == ["B"] and skipped == ["A"]


def test_pruning_reads_a_file_once(spark, monkeypatch):
    source = GO_TEST + "\n" + "\n".join(f"func TestMore{i}(t *testing.T) {{\n\ttests := []struct{{ name string }}{{\n\t\t{{name: \"a {i}\"}},\n\t\t{{name: \"b\"}},\n\t\t{{name: \"c\"}},\n\t}}\n}}\n" for i in range(3))
    steps, one_by_one = [("TestMore0", {"b"}), ("TestAdd", {"b_b"}), ("TestMore2", {"b"}), ("TestMore2", {"a_2", "x"})], source
    for function, names in steps:
        one_by_one = golang.remove_cases(one_by_one, function, names)
    read, whole = [], golang.Source.__init__
    monkeypatch.setattr(golang.Source, "__init__", lambda self, text: read.append(len(text)) or whole(self, text))
    assert golang.remove_all_cases(source, steps) == one_by_one and '"c"' in one_by_one and one_by_one.count('"b"') == 1
    assert read.count(len(source)) == 1 and sum(read) < 1.5 * len(source)


def test_the_named_function_goes_not_an_equal_text():
    source = "package p\n\nvar x = `\nfunc A() {}\n`\n\n// A is.\nfunc A() {}\n\n// B is.\nfunc B() {}\n"
    assert golang.remove_functions(source, {"A"}) == "package p\n\nvar x = `\nfunc A() {}\n`\n\n// B is.\nfunc B() {}\n"
    assert golang.remove_functions(source, {"A", "B"}) == "package p\n\nvar x = `\nfunc A() {}\n`\n"


def test_a_comment_is_read_without_the_text_before_it():
    import tracemalloc

    source = golang.Source("package p\n" + "var x = 1\n" * 20_000 + "// F does\n// it.\nfunc F() {}\n")
    tracemalloc.start()
    try:
        assert source._doc(source.functions[0].start) == "F does\nit."
        assert tracemalloc.get_traced_memory()[1] < 20_000
    finally:
        tracemalloc.stop()
    assert golang.Source("package p\nfunc A() {} /* a\n*/ func B() {}").functions[1].start_line == 3


def test_lines_of_a_file_are_never_broadcast(spark):
    lines = spark.createDataFrame([("f", 1, "{"), ("f", 2, "x"), ("f", 3, "y"), ("g", 1, "z")], "file string, line int, text string")
    ranges = spark.createDataFrame([("f", 1, 2)], "file string, start_line int, end_line int")
    functions = spark.createDataFrame([("f", "A", 1, 2), ("g", "B", 5, 9)], "file string, name string, start_line int, end_line int")
    branches = spark.createDataFrame([("f", 2, True), ("f", 3, False)], "file string, line int, is_error_path boolean")
    changed = coverage.executable_changed_lines(lines.select("file", "line"), ranges, lines)
    made = {
        "executable": (changed, [("f", 2)]), "diff": (coverage.diff_coverage(lines.select("file", "line"), changed).select("file", "total", "hit"), [("f", 3, 1), ("g", 1, 0)]),
        "branches": (coverage.branch_coverage(branches, changed).select("file", "total", "covered"), [("f", 2, 1)]),
        "functions": (coverage.functions_by_lines(functions, changed).select("file", "name"), [("f", "A")]), "gaps": (coverage.coverage_gaps(functions, changed).select("file", "name"), [("f", "A")])}
    for name, (df, rows) in made.items():
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString(), name
        assert sorted(map(tuple, df.collect())) == rows, name


def test_one_decimal_is_that_of_c(spark):
    values = [0.0, 6.25, 18.75, 0.05, 0.15, 0.25, 0.35, 0.45, 99.95, 100.0, 8.35, 1e-9, 1.0 / 3, *(c / n * 100.0 for n in (16, 32, 48, 80, 2000) for c in range(0, n, max(1, n // 80)))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalars.one_decimal(F.col("v")).alias("s")).collect()
    assert [(r.v, r.s) for r in rows] == [(v, f"{v:.1f}") for v in values]
    line = spark.range(1).select(coverage.summary_line(F.lit(16), F.lit(1), F.lit(6.25))).first()[0]
    assert line == "Diff coverage: 6.2% (1/16 changed lines covered)"


def test_large_versions_and_interfaces_are_not_broadcast(spark):
    rows = spark.createDataFrame([("A", "x", 1), ("B", "y", 2)], "key string, body string, pos int")
    classified = stores.classify(rows, rows.where("key = 'A'"), ["key"])
    assert sorted((r.key, r.status) for r in classified.collect()) == [("A", "unchanged"), ("B", "new")]
    have = spark.createDataFrame([("t", "m"), ("u", "m"), ("u", "n")], "type string, method string")
    met = graphs.implementors(spark.createDataFrame([("i", "m"), ("i", "n")], "interface string, method string"), have)
    assert [tuple(r) for r in met.collect()] == [("i", "u")]
    for df in (classified, met):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_place_are_sorted_by_many_tasks(spark):
    rows = spark.range(2000).select(F.lit(1).alias("pos"), F.col("id").cast("string").alias("key"), F.array("id").alias("a"), F.when(F.col("id") % 2 == 0, "new").otherwise("changed").alias("status"))
    out = stores.needs_tests(rows)
    assert [r.status for r in out.collect()] == ["changed"] * 1000 + ["new"] * 1000 and out.columns == rows.columns
    order = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert any("Sort [_o" in line and "_h" in line for line in order)


def test_a_repeated_name_is_scored_once(spark):
    tests = spark.createDataFrame([("f", "TestAdd")] * 3 + [("f", "TestGot"), ("g", "TestAdd")], "file string, test string")
    names = F.array(F.lit("add"), F.lit("get"))
    one_by_one = tests.withColumn("s", scalars.test_name_score(F.col("test"), names)).groupBy("file").agg(F.avg("s"))
    out = naturalness.name_scores(tests, names)
    assert {f: pytest.approx(s) for f, s in map(tuple, one_by_one.collect())} == dict(map(tuple, out.collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" in plan


def test_chain_sums_are_those_of_all_pairs(spark):
    chains = [(i, i + 1) for i in range(1, 40)] + [(40, None)]  # one chain
    rings = [(50 + i, 50 + (i + 1) % 7) for i in range(7)] + [(60, 61), (61, 60), (70, 70)]  # three rings, one of itself
    tails = [(80, 81), (81, 82), (82, 53), (83, 82), (84, 81), (-3, -2), (-2, 55), (45, 46), (46, 61)] + [(90, 99)]  # into a ring; to a name without a row
    edges = spark.createDataFrame(chains + rings + tails, "name bigint, embedded bigint")
    pairs = graphs.reachable(edges).join(edges.select("name", F.lit(True).alias("row")), "name", "left").withColumn("v", F.when(F.col("row"), F.col("name")).otherwise(0))
    wanted = pairs.groupBy("root").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.sum(F.col("v") * F.col("depth")).alias("weight"))
    assert sorted(map(tuple, graphs.chain_sums(edges).collect())) == sorted(map(tuple, wanted.collect()))
    assert graphs.chain_sums(edges.where("false")).count() == 0
    with pytest.raises(Exception, match="two others"):
        graphs.chain_sums(spark.createDataFrame([(1, 2), (1, 3)], "name bigint, embedded bigint")).count()


def test_go_pieces_are_looked_into_once_and_declarations_when_asked_for(monkeypatch):
    from plumbline.functions import golang

    looked, whole = [], golang._Pieces.__missing__
    monkeypatch.setattr(golang, "_PIECES", golang._Pieces())
    monkeypatch.setattr(golang._Pieces, "__missing__", lambda self, piece: looked.append(piece) or whole(self, piece))
    source = golang.Source("package p\n" + "func (r *T) F(a int) error {\n\treturn nil // why\n}\n" * 50)
    assert len(looked) == len(set(looked)) < 40 and len(source.tokens) == 3 + 50 * 18
    read, plain = [], golang.Source.plain
    monkeypatch.setattr(golang.Source, "plain", lambda self, a, b: read.append(a) or plain(self, a, b))
    assert {(f.name, f.start_line < f.end_line) for f in source.functions} == {("F", True)} and not read
    assert source.functions[1].signature == "func (*T) F(a int) error" and read


def test_pieces_that_are_remembered_are_bounded():
    from plumbline.functions import golang

    pieces = golang._Pieces()
    pieces.MOST = 10
    assert [pieces[f" x{i}"][:3] for i in range(25)] == [("word", f"x{i}", 1) for i in range(25)] and len(pieces) <= 10
    assert pieces["/" + "/" * 200][0] is None and len(pieces) <= 10 and "/" + "/" * 200 not in pieces


def test_merge_reads_each_source_once(monkeypatch):
    from plumbline.functions import golang

    read, whole = [], golang.Source.__init__
    monkeypatch.setattr(golang.Source, "__init__", lambda self, text: read.append(text) or whole(self, text))
    existing, generated = 'package p\n\nimport "os"\n\nfunc A() {}\n', "package p\n\nfunc B() {}\n"
    assert golang.merge(existing, generated) == ('package p\n\nimport (\n\t"os"\n)\n\nfunc A() {}\n\nfunc B() {}\n', ["B"], [])
    assert sorted(read) == sorted([existing, generated])


def test_functions_hold_the_columns_asked_for(spark, monkeypatch):
    from plumbline.plans import gosources
    from plumbline.sources import gosource

    texts = spark.createDataFrame([("a.go", "package p\nfunc F(a int) error {\n\treturn nil\n}\n")], "path string, value string")
    assert gosource.functions(texts, "end_line", "name").collect() == [("a.go", 0, "F", 4)]
    assert gosource.functions(texts).first()["params"][0]["type"] == "int"
    seen, whole = [], gosource.package_index
    monkeypatch.setattr(gosource, "package_index", lambda f: seen.append(f.columns) or whole(f))
    gosources.q94(spark, "/root/testdata/sf0.001")
    assert seen == [["file", "pos", "name"]]


def test_go_sources_keep_their_partitions(spark):
    from plumbline.plans import gosources

    made = gosources._sources(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_large_go_files_are_read_in_pieces(monkeypatch):
    """A task holds the tokens of a piece, not of a file; what is said of the declarations is what the whole file says."""
    block = "// F@ does.\nfunc (r *T) F@(a int) error {\n\tif a > 1 {\n\t\treturn nil\n\t}\n\treturn f(a)\n}\n\n"
    open_ones = ["var s = `\n}\n`\n", "/*\n}\n*/\n", "var t = []int{\n\t1,\n}\n", "func g() {\n\tx := `\n}\nfunc no() {}\n`\n}\n", "type U struct {\n\ta int\n}\n"]
    text = 'package p\n\nimport "fmt"\n\n' + "".join(block.replace("@", str(k)) + open_ones[k % 5] for k in range(400)) + 'import "os"\nfunc last() { "'

    def said(s):
        return [(f.name, f.receiver, f.start_line, f.end_line, f.body, f.doc, f.params, s.branch_texts(f), s.calls(f)) for f in s.functions], s.imports, s.executable_ranges(), [t.source for t in s.types], [(v.name, v.value) for v in s.variables]

    whole, most = said(golang.Source(text)), len(golang.tokenize(text))
    lengths, tokens = [], golang.tokenize
    monkeypatch.setattr(golang, "tokenize", lambda *a: lengths.append(len(out := tokens(*a))) or out)
    for size in (1, 300, golang.PIECE):
        lengths.clear()
        parts = [said(s) for s in golang.sources(text, size)]
        assert tuple([x for p in parts for x in p[i]] for i in range(5)) == whole and max(lengths) < most / 2
    assert [i for s in golang.heads(text) for i in s.imports] == whole[1] == [("fmt", ""), ("os", "")]
    lengths.clear()
    assert [i for s in golang.heads(text.replace('import "os"', "")) for i in s.imports] == [("fmt", "")] and sum(lengths) < most / 20


def test_go_rows_of_pieces_are_numbered_by_file(spark):
    from plumbline.sources import gosource

    text = "package p\n" + "func F() {\n\tg()\n}\n" * 3000
    found = gosource.functions(spark.createDataFrame([("a.go", text)], "path string, value string"), "name", "start_line").collect()
    assert len(text) > 2 * golang.PIECE and [(r["pos"], r["start_line"]) for r in found] == [(i, 2 + 3 * i) for i in range(3000)]
