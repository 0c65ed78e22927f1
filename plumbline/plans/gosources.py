"""Queries over Go sources: parts of a brand and size are the declarations of a file, written out and read by the Go reader.

The SQL comes from the table alone: a part's block has a fixed number of lines, so its place among the parts of its file
gives every line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, graphs, naturalness, patterns, stores
from ..sources import gosource, scratch
from .catalogue import _query, table

_HEAD = 'package p\n\nimport (\n\t"errors"\n\t"fmt"\n\tal "os"\n)\n'
_BLOCK = """
type T@ struct {
	A@ string `json:"a"`
	B, C int
	Base
}

var V@ = #

// F@ does.
func (r *T@) F@(a int, b string) (string, error) {
	if a > # && b != "" {
		return "", errors.New(b)
	} else if err := check(a); err != nil {
		return b, err
	}
	x@ := a + #
	for i := 0; i < x@; i++ {
		fmt.Println(b)
	}
	switch a {
	case #:
		return b, nil
	default:
	}
	return b, nil
}
"""
_TEST_HEAD = 'package p\n\nimport "testing"\n'
_TEST_BLOCK = """
func TestF@(t *testing.T) {
	tests := []struct{ name string; in int }{
		{name: "a@", in: #},
		{name: "b", in: 2},
	}
	for _, tt := range tests {
		got@ := F(tt.in)
		assert.Equal(t, #, got@)
	}
	require.NoError(t, err)
	t.Errorf("x %v", saveErr)
}
"""
#: Lines of the head, and of a block.
_H, _B = _HEAD.count("\n"), _BLOCK.count("\n")
_PARTS = f"""p AS (SELECT p_partkey AS k, p_size AS n, replace(p_brand, '#', '') || '/s' || p_size || '.go' AS file, {_H} + {_B} * (row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1)::INTEGER AS l FROM part)"""


def _sources(spark: SparkSession, d: str, head: str = _HEAD, block: str = _BLOCK, end: str = ".go") -> DataFrame:
    """(path, value). Reading takes far longer than the bytes say, so files keep their partitions, and their text is made there."""
    made = F.replace(F.replace(F.lit(block), F.lit("@"), F.col("p_partkey").cast("string")), F.lit("#"), F.col("p_size").cast("string"))
    path = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/s"), F.col("p_size").cast("string"), F.lit(end))
    parts = table(spark, d, "part").select("p_partkey", "p_size", path.alias("path")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    blocks = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("p_partkey", made.alias("b")))).alias("bs"))
    return blocks.select("path", F.concat(F.lit(head), F.array_join(F.transform("bs", lambda x: x["b"]), "")).alias("value"))


def _each(values: str, columns: str) -> str:
    """SQL: rows of every part, values over k, n and l."""
    return f"WITH {_PARTS}, v AS (SELECT file, k, n, l, unnest([{values}]) AS x FROM p) SELECT {columns} FROM v"


@_query("q77_go_functions", f"""WITH {_PARTS} SELECT file, 'F' || k AS name, '*T' || k AS receiver, l + 11 AS start_line, l + 27 AS end_line, 'func (*T' || k || ') F' || k || '(a int, b string) (string, error)' AS signature, 'F' || k || ' does.' AS doc,
    'a int,b string' AS params, 'string,error' AS returns, 17 AS lines FROM p""")
def q77(spark: SparkSession, d: str) -> DataFrame:
    f = gosource.testable(gosource.functions(gosource.go_files(_sources(spark, d).unionByName(_sources(spark, d, _TEST_HEAD, _TEST_BLOCK, "_test.go")))))
    params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(" "), p["type"])), ",")
    return f.select("file", "name", "receiver", "start_line", "end_line", "signature", "doc", params.alias("params"), F.array_join("returns", ",").alias("returns"), F.size(F.split("body", "\n")).alias("lines"))


@_query("q78_go_types", f"""WITH {_PARTS} SELECT file, 'T' || k AS name, 'struct' AS kind, 'A' || k || ' string,B int,C int' AS fields, 'Base' AS embedded FROM p""")
def q78(spark: SparkSession, d: str) -> DataFrame:
    fields = F.array_join(F.transform("fields", lambda p: F.concat(p["name"], F.lit(" "), p["type"])), ",")
    return gosource.types(_sources(spark, d)).select("file", "name", "kind", fields.alias("fields"), F.array_join("embedded", ",").alias("embedded"))


@_query("q79_go_variables", f"WITH {_PARTS} SELECT file, 'V' || k AS name, n::VARCHAR AS value, false AS is_const FROM p")
def q79(spark: SparkSession, d: str) -> DataFrame:
    return gosource.variables(_sources(spark, d)).select("file", "name", "value", "is_const")


@_query("q80_go_imports", f"WITH {_PARTS} SELECT file, unnest([{{'path': 'errors', 'alias': ''}}, {{'path': 'fmt', 'alias': ''}}, {{'path': 'os', 'alias': 'al'}}], recursive := true) FROM (SELECT DISTINCT file FROM p)")
def q80(spark: SparkSession, d: str) -> DataFrame:
    return gosource.imports(_sources(spark, d)).select("file", "path", "alias")


@_query("q81_go_calls", _each("{'r': 'errors', 'm': 'New', 'a': 'b', 'o': 13}, {'r': '', 'm': 'check', 'a': 'a', 'o': 14}, {'r': 'fmt', 'm': 'Println', 'a': 'b', 'o': 19}", "file, 'F' || k AS func, x.r AS receiver, x.m AS method, x.a AS args, l + x.o AS line"))
def q81(spark: SparkSession, d: str) -> DataFrame:
    return gosource.calls(_sources(spark, d)).select("file", "func", "receiver", "method", F.array_join("args", ",").alias("args"), "line")


_BRANCH_ROWS = "{'t': 'if', 'o': 13, 'e': false}, {'t': 'else-if', 'o': 15, 'e': true}, {'t': 'switch-case', 'o': 23, 'e': false}, {'t': 'default', 'o': 24, 'e': false}"


@_query("q82_go_branches", _each(_BRANCH_ROWS, "file, 'F' || k AS func, x.t AS kind, l + x.o AS line, x.e AS is_error_path"))
def q82(spark: SparkSession, d: str) -> DataFrame:
    return gosource.branches(_sources(spark, d)).select("file", "func", "kind", "line", "is_error_path")


@_query("q83_branch_texts", _each("'Condition: `a > ' || n || ' && b != \"\"`', 'Else-if: `err != nil`', 'Error check (err != nil)', 'Switch statement', 'Case: `' || n || '`', 'Default case'", "file, 'F' || k AS func, x AS text"))
def q83(spark: SparkSession, d: str) -> DataFrame:
    return gosource.branch_texts(_sources(spark, d)).select("file", "func", "text")


@_query("q84_executable_ranges", _each("[11, 11], [13, 13], [15, 15], [12, 16], [17, 17], [19, 19], [18, 20], [23, 23], [21, 25], [26, 26]", "file, l + x[1] AS start_line, l + x[2] AS end_line"))
def q84(spark: SparkSession, d: str) -> DataFrame:
    return gosource.executable_ranges(_sources(spark, d)).select("file", "start_line", "end_line")


@_query("q85_go_mutants", _each("""{'t': 'comparison', 'o': 12, 'a': '>', 'b': '>='}, {'t': 'logical', 'o': 12, 'a': '&&', 'b': '||'}, {'t': 'comparison', 'o': 12, 'a': '!=', 'b': '=='}, {'t': 'return', 'o': 13, 'a': '""', 'b': '"mutant"'},
    {'t': 'comparison', 'o': 14, 'a': '!=', 'b': '=='}, {'t': 'arithmetic', 'o': 17, 'a': '+', 'b': '-'}, {'t': 'comparison', 'o': 18, 'a': '<', 'b': '<='}, {'t': 'return', 'o': 23, 'a': 'nil', 'b': 'fmt.Errorf("mutant")'}, {'t': 'return', 'o': 26, 'a': 'nil', 'b': 'fmt.Errorf("mutant")'}""",
    "file, 'F' || k AS func, x.t AS type, l + x.o AS line, x.a AS original, x.b AS replacement"))
def q85(spark: SparkSession, d: str) -> DataFrame:
    return gosource.mutants(_sources(spark, d)).select("file", "func", "type", "line", "original", "replacement")


@_query("q86_go_locals", f"WITH {_PARTS} SELECT file, 'F' || k AS func, 'err' AS name, 'check' AS label FROM p UNION ALL SELECT replace(file, '.go', '_test.go'), 'TestF' || k, 'got' || k, 'F' FROM p")
def q86(spark: SparkSession, d: str) -> DataFrame:
    return gosource.locals_(_sources(spark, d).unionByName(_sources(spark, d, _TEST_HEAD, _TEST_BLOCK, "_test.go"))).select("file", "func", "name", "label")


def _tests(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d, _TEST_HEAD, _TEST_BLOCK, "_test.go")


_TEST_FILE = "replace(file, '.go', '_test.go') AS file"


@_query("q87_go_assertions", _each("""{'s': 'assert.Equal(t,' || n || ',got' || k || ')', 'd': 'equal', 'e': false}, {'s': 'require.NoError(t,err)', 'd': 'error', 'e': true}, {'s': 't.Errorf("x %v",saveErr)', 'd': 'fatal', 'e': true}""", f"{_TEST_FILE}, 'TestF' || k AS test, x.s AS signature, x.d AS kind, x.e AS is_error"))
def q87(spark: SparkSession, d: str) -> DataFrame:
    return gosource.assertions(_tests(spark, d))


@_query("q88_assertions_per_file", f"""WITH {_PARTS} SELECT {_TEST_FILE}, count(*) AS test_count, 3.0::DOUBLE AS assertion_ratio, 0.0::DOUBLE AS no_assertions_pct, 0.0::DOUBLE AS duplicate_assertions_pct, 0.0::DOUBLE AS nil_only_assertions_pct, 100.0::DOUBLE AS error_assertions_pct FROM p GROUP BY file""")
def q88(spark: SparkSession, d: str) -> DataFrame:
    texts = _tests(spark, d)
    f = gosource.functions(texts)
    tests = f.where(naturalness.is_test_function(F.col("name"), F.col("receiver"), F.col("params"))).select("file", F.col("name").alias("test"))
    return naturalness.per_file(tests, gosource.assertions(texts))


@_query("q89_table_cases", _each("""{'i': 0, 'f': 'in=' || n, 'name': '"a' || k || '"'}, {'i': 1, 'f': 'in=2', 'name': '"b"'}""", f"{_TEST_FILE}, 'TestF' || k AS func, x.i AS idx, x.f AS fingerprint, x.name AS name, x.i = 0 OR n <> 2 AS kept"))
def q89(spark: SparkSession, d: str) -> DataFrame:
    cases = gosource.table_cases(_tests(spark, d))
    kept = stores.keep_first(cases, ["file", "func", "tab"], stores.case_fingerprint(F.col("fields")))
    return kept.select("file", "func", "idx", stores.case_fingerprint(F.col("fields")).alias("fingerprint"), stores.case_name(F.col("fields")).alias("name"), "kept")


@_query("q90_pruned_sources", f"""WITH {_PARTS} SELECT {_TEST_FILE}, md5('{_TEST_HEAD.replace(chr(10), "' || chr(10) || '")}' || coalesce(string_agg(
    replace(replace(CASE WHEN k % 3 = 1 THEN '{_TEST_BLOCK.replace('		{name: "b", in: 2},' + chr(10), '').replace(chr(10), "' || chr(10) || '")}' ELSE '{_TEST_BLOCK.replace(chr(10), "' || chr(10) || '")}' END, '@', k::VARCHAR), '#', n::VARCHAR), '' ORDER BY k) FILTER (k % 3 > 0), '')) AS code FROM p GROUP BY file""")
def q90(spark: SparkSession, d: str) -> DataFrame:
    """A third of the test functions go, another third loses a case."""
    texts = _tests(spark, d)
    tests = gosource.functions(texts).select(F.col("file").alias("path"), "name").withColumn("k", F.regexp_extract("name", r"(\d+)", 1).cast("bigint"))
    plan = tests.where("k % 3 < 2").select("path", "name", F.when(F.col("k") % 3 == 0, "remove_function").otherwise("remove_cases").alias("action"), F.array(F.lit("b")).alias("cases"))
    return gosource.pruned(texts, plan).select(F.col("path").alias("file"), F.md5("value").alias("code"))


@_query("q91_merged_sources", f"""WITH {_PARTS}, g AS (SELECT file, list(k ORDER BY k) AS ks, min(k) AS first FROM p GROUP BY file)
    SELECT {_TEST_FILE}, array_to_string(list_transform(list_filter(ks, lambda k: k % 2 = 1), lambda k: 'G' || k), ',') AS added, array_to_string(list_transform(list_filter(ks, lambda k: k % 2 = 0), lambda k: 'TestF' || k), ',') AS skipped,
           true AS has_import, len(list_filter(ks, lambda k: k % 2 = 1))::INTEGER AS docs, 1 AS decls FROM g""")
def q91(spark: SparkSession, d: str) -> DataFrame:
    """Generated sources bring an import, a constant, new documented functions for odd parts and known ones for even parts."""
    part = table(spark, d, "part")
    k = F.col("p_partkey").cast("string")
    made = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("\n// G"), k, F.lit(" is new.\nfunc G"), k, F.lit("() {}\n"))).otherwise(F.concat(F.lit("\nfunc TestF"), k, F.lit("(t *testing.T) {}\n")))
    path = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/s"), F.col("p_size").cast("string"), F.lit("_test.go"))
    generated = part.groupBy(path.alias("path")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", made.alias("b")))).alias("bs")).select("path", F.concat(F.lit('package p\n\nimport (\n\t"os"\n)\n\nconst Limit = 3\n'), F.array_join(F.transform("bs", lambda x: x["b"]), "")).alias("generated"))
    out = gosource.merged(_tests(spark, d).withColumnRenamed("value", "existing").join(generated, "path"))
    count = lambda text: F.size(F.split("code", text)) - 1
    return out.select(F.col("path").alias("file"), F.array_join("added", ",").alias("added"), F.array_join("skipped", ",").alias("skipped"), F.col("code").contains('import (\n\t"os"\n\t"testing"\n)').alias("has_import"), count(r"// G\d+ is new\.\nfunc G").alias("docs"), count(r"\nconst Limit = 3\n").alias("decls"))


@_query("q92_pattern_hints", f"""WITH {_PARTS} SELECT file, 'F' || k AS name, 'errors_wrap' AS kinds, 'Uses error wrapping/inspection' AS summary FROM p""")
def q92(spark: SparkSession, d: str) -> DataFrame:
    texts = _sources(spark, d)
    imports = gosource.imports(texts).groupBy("file").agg(F.collect_list("path").alias("paths"))
    found = patterns.detect(gosource.functions(texts).join(imports, "file"), F.col("paths"))
    return found.select("file", "name", F.array_join("kinds", ",").alias("kinds"), F.array_join(F.transform("hints", lambda h: h["summary"]), ",").alias("summary"))





@_query("q93_body_patterns", """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'time_now' WHEN 1 THEN 'env_var' WHEN 2 THEN 'file_io' WHEN 3 THEN 'json_encoding' WHEN 4 THEN '' ELSE 'context,io_readwrite' END AS kinds,
    p_size % 6 = 3 AS care, p_size % 6 = 5 AS cancel, CASE WHEN p_size % 6 = 4 THEN 'goroutine launch (go statement),channel send,sync.Mutex,sync/atomic.AddInt64' WHEN p_size % 6 = 2 THEN 'sync.Once (text match)' ELSE '' END AS concurrency FROM part""")
def q93(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of six kinds; what comments and strings name calls nothing."""
    bodies = ["x := time.Now() // os.Getenv(\"A\")", "v := os.Getenv(\"time.Now()\")", "f, err := os.Open(name) // sync.Once", "b, err := json.Marshal(v)", "var m sync.Mutex\ngo work(&m)\natomic.AddInt64(&n, 1)\nch <- 1", "io.Copy(w, r)\nif ctx.Err() != nil { return }"]
    pick = F.element_at(F.array(*map(F.lit, bodies)), F.col("p_size") % 6 + 1)
    pair = lambda n, t: F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"))
    params = F.when(F.col("p_size") % 6 == 5, F.array(pair("ctx", "context.Context"))).otherwise(F.array(pair("a", "int")))
    f = table(spark, d, "part").select("p_partkey", pick.alias("body"), params.alias("params"), F.array(F.lit("error")).alias("returns"))
    found = patterns.concurrency(patterns.detect(f, F.array(F.lit("encoding/json"), F.lit("io"))))
    return found.select("p_partkey", F.array_join("kinds", ",").alias("kinds"), patterns.needs_care(F.col("kinds")).alias("care"), patterns.context_use(F.col("body"))["cancel"].alias("cancel"), F.array_join("concurrency.patterns", ",").alias("concurrency"))


@_query("q94_package_index", f"WITH {_PARTS} SELECT max(file) AS file, 'F' || k AS name FROM p GROUP BY k")
def q94(spark: SparkSession, d: str) -> DataFrame:
    return gosource.package_index(gosource.functions(_sources(spark, d), "name")).select("file", "name")


@_query("q95_changed_functions", f"""WITH {_PARTS} SELECT file, 'F' || k AS name, count(*) AS n FROM (SELECT file, k, unnest(range(l + 11, l + 28)) AS line FROM p) WHERE line % 40 = 0 GROUP BY ALL""")
def q95(spark: SparkSession, d: str) -> DataFrame:
    """Every fortieth line of a file as uncovered: which functions hold them, and how many."""
    texts = _sources(spark, d)
    functions = scratch.stage(gosource.functions(texts, "name", "start_line", "end_line").drop("pos"), "functions")  # read once
    last = F.size(F.split("value", "\n", -1))
    lines = scratch.stage(texts.select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0), last, F.lit(40))).alias("line")).where("line > 0"), "lines")
    gaps = coverage.coverage_gaps(coverage.functions_by_lines(functions, lines), lines)
    return gaps.select("file", "name", F.size("lines").cast("bigint").alias("n"))


@_query("q96_go_coverage", f"""WITH {_PARTS}, r AS (SELECT file, k, l, unnest([11, 12, 13, 14, 15, 17, 18, 19, 21, 22, 23, 24, 26]) AS o FROM p)
    SELECT file, count(*) AS total, count(*) FILTER (k % 2 = 0) AS hit FROM r GROUP BY file""")
def q96(spark: SparkSession, d: str) -> DataFrame:
    """All lines changed, functions of even parts run: coverage over the lines that can run."""
    texts = _sources(spark, d)
    source = texts.select(F.col("path").alias("file"), F.posexplode(F.split("value", "\n", -1)).alias("p", "text")).select("file", (F.col("p") + 1).alias("line"), "text")
    changed = coverage.executable_changed_lines(source.select("file", "line"), gosource.executable_ranges(texts), source)
    ran = gosource.functions(texts).where(F.regexp_extract("name", r"(\d+)", 1).cast("bigint") % 2 == 0).select("file", "start_line", "end_line", F.lit(1).alias("cnt"))
    return coverage.diff_coverage(changed, coverage.covered_lines(ran)).select("file", "total", "hit")


@_query("q97_go_branch_coverage", f"""WITH {_PARTS} SELECT file, 4 * count(*) AS total, 4 * count(*) FILTER (k % 2 = 0) AS covered, count(*) AS error_total, count(*) FILTER (k % 2 = 0) AS error_covered,
    count(*) FILTER (k % 2 = 0)::DOUBLE / count(*)::DOUBLE * 100.0 AS pct, count(*) FILTER (k % 2 = 0)::DOUBLE / count(*)::DOUBLE * 100.0 AS error_pct FROM p GROUP BY file""")
def q97(spark: SparkSession, d: str) -> DataFrame:
    texts = _sources(spark, d)
    ran = gosource.functions(texts).where(F.regexp_extract("name", r"(\d+)", 1).cast("bigint") % 2 == 0).select("file", "start_line", "end_line", F.lit(1).alias("cnt"))
    return coverage.branch_coverage(gosource.branches(texts), coverage.covered_lines(ran))


@_query("q98_changed_bodies", f"""WITH {_PARTS} SELECT file, 'F' || k AS name, CASE WHEN k % 5 = 0 THEN 'new' WHEN n % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS status FROM p""")
def q98(spark: SparkSession, d: str) -> DataFrame:
    """Functions against a base version: every fifth lacks there, others differ by spacing and comments, or by an operator."""
    current = gosource.functions(_sources(spark, d))
    spaced = _BLOCK.replace("\t\treturn b, err", "\n\t\t// why\n\t\treturn  b, err")
    base = gosource.functions(_sources(spark, d, block=spaced))
    base = base.where(F.regexp_extract("name", r"(\d+)", 1).cast("bigint") % 5 > 0).withColumn("body", F.when(F.regexp_extract("file", r"/s(\d+)", 1).cast("int") % 2 == 1, F.replace("body", F.lit("a + "), F.lit("a - "))).otherwise(F.col("body")))
    return stores.classify(gosource.normalised_bodies(current), gosource.normalised_bodies(base), ["file", "name"], "normal").select("file", "name", "status")


@_query("q99_type_methods", f"""WITH {_PARTS} SELECT file, 'T' || k AS type, 'F' || k AS method FROM p""")
def q99(spark: SparkSession, d: str) -> DataFrame:
    """An interface a part, met by the one type that has its method."""
    f = scratch.stage(gosource.functions(_sources(spark, d)).select("file", "name", "receiver"), "functions")  # read once
    own = f.select(F.concat("file", F.lit(":"), F.ltrim("receiver", F.lit("*"))).alias("type"), F.col("name").alias("method"))
    found = graphs.implementors(f.select(F.concat_ws(":", "file", "name").alias("interface"), F.col("name").alias("method")), own)
    return found.select(F.split_part("type", F.lit(":"), F.lit(1)).alias("file"), F.split_part("type", F.lit(":"), F.lit(2)).alias("type"), F.split_part("interface", F.lit(":"), F.lit(2)).alias("method"))
