"""Operators whose plans have to hold on large or lopsided input: scans over parts, interval pieces, rarest methods, doubling."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import globs
from plumbline.operators import affixes, bucketed, coverage, graphs, scans, testevents, versions
from plumbline.sources import text

# --- scans over ordered parts ------------------------------------------------------------------------------------------


def plain_diff(value):
    """(file, old path, hunk, type, content, old number, new number) of a diff, line by line."""
    out, file, hunk = [], None, None
    for line in value.split("\n"):
        if line.startswith("diff --git "):
            m = re.match(r"^diff --git a/(.*) b/(.*)$", line)
            file, hunk = [m[2], m[1], 0] if m else ["", "", 0], None
        elif file is None:
            continue
        elif line.startswith("@@ "):
            m = re.match(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", line)
            file[2] += 1
            hunk = [int(m[1]), int(m[2])]
        elif hunk is None:
            if line.startswith("--- a/"):
                file[1] = line[6:]
            elif line.startswith("+++ b/"):
                file[0] = line[6:]
        elif line:
            kind = {"+": "added", "-": "deleted"}.get(line[0], "context")
            out.append((file[0], file[1], file[2], kind, line[1:] if line[0] in "+- " else line, 0 if kind == "added" else hunk[0], 0 if kind == "deleted" else hunk[1]))
            hunk[0] += kind != "added"
            hunk[1] += kind != "deleted"
    return out


def some_diff(seed, n=120):
    """Lines in any order that a diff can have, with content that looks like a head's, and files without heads or hunks."""
    r, out = random.Random(seed), []
    for i in range(n):
        out.append(r.choice([
            f"diff --git a/o{i}.go b/n{i}.go", f"diff --git a/o{i}.go b/n{i}.go\n--- a/x{i}.go\n+++ b/y{i}.go", f"@@ -{i + 1},3 +{2 * i + 1},4 @@ f", f"@@ -{i} +{i} @@",
            "+new", "-old", " same", "", "\\ No newline", f"--- a/fake{i}.go", f"+++ b/fake{i}.go", "index 1..2", f"-- a/{i}", f"+line {i}", f"-line {i}"]))
    return "\n".join(out)


@pytest.mark.parametrize("size", [1, 3, 7, 1 << 16])
def test_diff_lines_do_not_depend_on_parts(spark, monkeypatch, size):
    monkeypatch.setattr(scans, "PART_LINES", size)
    values = {f"d{i}": some_diff(i) for i in range(8)} | {"empty": "", "none": "no diff\n@@ -1 +1 @@\n+x"}
    got = text.diff_lines(spark.createDataFrame(list(values.items()), "path string, value string").repartition(3))
    by = {}
    for r in got.orderBy("path", "pos").collect():
        by.setdefault(r.path, []).append((r.file, r.old_path, r.hunk, r.type, r.content, r.old_no, r.new_no))
    assert by == {k: w for k, v in values.items() if (w := plain_diff(v))}


def test_diff_of_one_large_file(spark, tmp_path):
    """A file in many parts gives what its text as one value gives, by several tasks."""
    value = "\n".join(some_diff(i, 400) for i in range(40))
    (tmp_path / "big.diff").write_text(value)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = text.read_lines(spark, str(tmp_path / "big.diff"))
        assert rows.select("seq.part").distinct().count() > 5
        got = [(r.file, r.old_path, r.hunk, r.type, r.content, r.old_no, r.new_no) for r in text.diff_lines(rows).orderBy("pos").collect()]
        heads = text.hunks(rows).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == plain_diff(value) and heads == len(re.findall(r"(?m)^@@ ", value))


def plain_context(value):
    """What stands between a test's RUN marker and its failure."""
    out, current, errors = {}, False, []
    for line in value.split("\n"):
        t = line.strip()
        if t.startswith("=== RUN"):
            current, errors = True, []
        elif re.match(r"--- (FAIL|PASS):", t):
            if len(t.split()) >= 3 and t.startswith("--- FAIL:") and errors:
                out[t.split()[2]] = "; ".join(errors)
            errors = []
        elif current and t and not t.startswith("==="):
            errors.append(t)
    return out


def some_log(seed, n=150):
    r = random.Random(seed)
    return "\n".join(r.choice([f"=== RUN   T{i}", f"    x_test.go:{i}: got {i}, want w", "", "=== PAUSE", f"--- FAIL: T{i % 9} (0.1s)", f"  --- PASS: T{i % 9} (0.1s)", f"more {i}", f"--- FAIL: U{i} (0s)"]) for i in range(n))


@pytest.mark.parametrize("size", [1, 4, 1 << 16])
def test_error_context_does_not_depend_on_parts(spark, monkeypatch, size):
    monkeypatch.setattr(scans, "PART_LINES", size)
    logs = {f"l{i}": some_log(i) for i in range(6)}
    got = testevents.error_context(spark.createDataFrame(list(logs.items()), "path string, value string"))
    assert {(r.path, r.name): r.error for r in got.collect()} == {(p, n): e for p, v in logs.items() for n, e in plain_context(v).items()}


def test_feedback_from_one_large_log(spark, tmp_path):
    value = "\n".join(some_log(i, 300) for i in range(30))
    (tmp_path / "big.log").write_text(value)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = text.read_lines(spark, str(tmp_path / "big.log"))
        got = sorted((r.name, r.passed, r.error, r.line) for r in testevents.feedback_from_text(rows).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    whole = testevents.feedback_from_text(spark.createDataFrame([("p", value)], "path string, value string"))
    assert got == sorted((r.name, r.passed, r.error, r.line) for r in whole.collect()) and len(got) > 1000


# --- intervals ---------------------------------------------------------------------------------------------------------


def test_functions_and_gaps_equal_brute_force(spark):
    r = random.Random(4)
    functions = [(f"f{r.randrange(3)}", f"n{i}", s, s + r.choice([-1, 0, 1, 2, 7, 8, 30, 500])) for i in range(300) for s in [r.randrange(0, 700)]]
    functions += functions[:5] + [("f0", "all", 0, 2_000_000_000), ("f9", "far", 1, 5)]
    lines = [(f"f{r.randrange(4)}", r.randrange(0, 1500)) for _ in range(200)] * 2
    f = spark.createDataFrame(functions, "file string, name string, start_line int, end_line int")
    c = spark.createDataFrame(lines, "file string, line int")
    got = sorted(tuple(x) for x in coverage.functions_by_lines(f, c).select("file", "name", "start_line", "end_line").collect())
    assert got == sorted(x for x in functions if any(a == x[0] and x[2] <= b <= x[3] for a, b in lines))
    gaps = {(x.file, x.name): x.lines for x in coverage.coverage_gaps(f, c).collect()}
    want: dict = {}
    for a, name, s, e in functions:
        if own := [b for x, b in sorted(set(lines)) if x == a and s <= b <= e]:
            want.setdefault((a, name), []).extend(own)
    assert gaps == {k: sorted(v) for k, v in want.items()}


def test_one_file_with_most_functions_and_lines(spark):
    """A hundred thousand functions and lines of one file meet by pieces: no pair that isn't one is made."""
    n = 100_000
    f = spark.range(n).select(F.lit("hot").alias("file"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") * 10).alias("start_line"), (F.col("id") * 10 + 6).alias("end_line"))
    c = spark.range(n).select(F.lit("hot").alias("file"), (F.col("id") * 10 + F.col("id") % 10).alias("line"))
    pieces, lines = coverage._dyadic(f, c)
    assert pieces.join(lines, ["file", "piece"]).count() == n * 7 // 10
    assert coverage.functions_by_lines(f, c).count() == n * 7 // 10
    sizes = [x["count"] for x in pieces.groupBy("file", "piece").count().orderBy(F.desc("count")).limit(1).collect()]
    assert sizes == [1]


# --- implementors ------------------------------------------------------------------------------------------------------


def test_implementors_equal_brute_force(spark):
    r = random.Random(5)
    have = {f"t{i}": {f"m{r.randrange(40)}" for _ in range(r.randint(1, 25))} | {"String"} for i in range(150)}
    need = {f"i{i}": {f"m{r.randrange(45)}" for _ in range(r.randint(1, 4))} | ({"String"} if i % 2 else set()) for i in range(80)} | {"only": {"String"}, "none": {"missing", "String"}}
    rows = lambda d, names: spark.createDataFrame([(k, m) for k, v in d.items() for m in v for _ in (0, 1)], names)
    got = {tuple(x) for x in graphs.implementors(rows(need, "interface string, method string"), rows(have, "type string, method string")).collect()}
    assert got == {(i, t) for i, n in need.items() for t, h in have.items() if n <= h}


def test_a_method_of_every_type_makes_no_rows_of_all_types(spark):
    """20,000 types with String, 2,000 interfaces with String and a method of one type each."""
    types = spark.range(20_000).select(F.col("id").alias("type"), F.explode(F.array(F.lit("String"), F.concat(F.lit("m"), "id"))).alias("method"))
    need = spark.range(2000).select(F.col("id").alias("interface"), F.explode(F.array(F.lit("String"), F.concat(F.lit("m"), F.col("id") * 3))).alias("method"))
    out = graphs.implementors(need, types)
    rows = out.collect()
    assert sorted(tuple(x) for x in rows) == [(i, 3 * i) for i in range(2000)]


# --- closure -----------------------------------------------------------------------------------------------------------


def test_a_long_chain_takes_as_many_rounds_as_bits(spark, monkeypatch):
    cuts, cut = [], graphs._cut
    monkeypatch.setattr(graphs, "_cut", lambda df: cuts.append(1) or cut(df))
    n = 600
    edges = spark.range(n).select(F.col("id").alias("name"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("embedded"))
    got = graphs.reachable(edges)
    assert got.where("depth <> name - root").isEmpty() and got.count() == n * (n + 1) // 2 and len(cuts) <= 11


def test_closure_of_random_graphs(spark):
    for seed in range(3):
        r = random.Random(seed)
        edges = {(r.randrange(30), r.randrange(30)) for _ in range(45)} | {(i, None) for i in range(30)}
        steps = {}
        for a, b in edges:
            if b is not None:
                steps.setdefault(a, set()).add(b)
        want = set()
        for root in range(30):
            level, seen, depth = {root}, {root}, 0
            while level:
                want |= {(root, x, depth) for x in level}
                level = {y for x in level for y in steps.get(x, ())} - seen
                seen |= level
                depth += 1
        df = spark.createDataFrame(sorted(edges, key=str), "name int, embedded int")
        assert {tuple(x) for x in graphs.reachable(df).collect()} == want


# --- endings, versions -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", ["1", "7"])
def test_endings_equal_brute_force(spark, parts):
    r = random.Random(6)
    word = lambda n: "".join(r.choices("ab", k=n))
    texts = [word(r.randint(0, 12)) for _ in range(400)] + ["main.go"] * 5 + ["é", None]
    ends = [word(r.randint(0, 9)) for _ in range(150)] + ["main.go", "o", "", "é", None, "zmain.go"]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(x) for x in affixes.ending_with(spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in ends], "end string")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted((t, e) for t in {x for x in texts if x is not None} for e in {x for x in ends if x is not None} if t.endswith(e))


def test_changes_read_only_buckets_that_differ(spark, tmp_path):
    """One of a hundred files changed: a bucket or two of 512 are read, of bodies only those that are listed."""
    rows = spark.range(20_000).select(F.concat(F.lit("f"), F.floor(F.col("id") / 200)).alias("file"), F.concat(F.lit("n"), F.col("id") % 200).alias("name"), F.concat(F.lit("body "), "id").alias("body"), F.lit(1).alias("pos"))
    late = rows.where("file = 'f3' and name like 'n1%'").withColumns({"body": F.lit("new body"), "pos": F.lit(2)})
    added = rows.where("file = 'f3' and name = 'n5'").withColumns({"name": F.lit("n999"), "body": F.lit(None).cast("string")})
    gone = (F.col("file") == "f3") & (F.col("name") == "n7")
    versions.write_version(rows, f"{tmp_path}/old", ["file", "name"], together="file", buckets=512)
    versions.write_version(rows.where(~gone).unionByName(late).unionByName(added), f"{tmp_path}/new", ["file", "name"], together="file", buckets=512)
    assert len(versions.differing(spark, f"{tmp_path}/old", f"{tmp_path}/new")) == 1
    got = versions.changes(spark, f"{tmp_path}/old", f"{tmp_path}/new", ["file", "name"], removed=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans_of = re.findall(r"PartitionFilters: \[[^\]]*bucket[^\]]*\].*?ReadSchema: (struct<[^>]*>)", plan)
    assert len(scans_of) == 3 and sum("body" in x for x in scans_of) == 1  # bodies only to list what differs
    by = {r.name: (r.status, r.body) for r in got.collect()}
    assert by.pop("n999") == ("new", None) and by.pop("n7") == ("removed", None)
    assert set(by.values()) == {("changed", "new body")} and set(by) == {f"n{i}" for i in range(200) if str(i).startswith("1")}
    assert versions.changes(spark, f"{tmp_path}/new", f"{tmp_path}/new", ["file", "name"]).count() == 0
    versions.write_version(rows.limit(0), f"{tmp_path}/none", ["file", "name"], together="file", buckets=512)
    assert versions.changes(spark, f"{tmp_path}/none", f"{tmp_path}/old", ["file", "name"]).where("status = 'new'").count() == 20_000
    assert versions.changes(spark, f"{tmp_path}/old", f"{tmp_path}/none", ["file", "name"]).count() == 0


def test_many_patterns_equal_one_by_one(spark):
    r = random.Random(8)
    piece = lambda: "".join(r.choices("ab*?.", k=r.randint(1, 4)))
    patterns = [r.choice([piece(), f"a/{piece()}", f"b/**/{piece()}", f"{piece()}/**", f"**/{piece()}", f"a/b/{piece()}.go"]) for _ in range(120)] + ["*", "**", "[a-b].go", "a[", "\\*x", "a/**/b/**", "", "vendor/**", "*_gen.go", "x[*].go"]
    paths = ["/".join("".join(r.choices("ab.", k=r.randint(1, 4))) for _ in range(r.randint(1, 3))) + r.choice(["", ".go"]) for _ in range(150)] + ["a.go", "*x", "vendor/a/b.go", "x_gen.go", "x*.go", ""]
    got = {tuple(x) for x in globs.matching(spark.createDataFrame([(p,) for p in paths + [None]], "path string"), spark.createDataFrame([(p,) for p in patterns + [None]], "pattern string")).collect()}
    rows = spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")
    matched = rows.select("path", *[globs.matches(F.col("path"), p).alias(str(i)) for i, p in enumerate(patterns)]).collect()
    want = {(x.path, p) for x in matched for i, p in enumerate(patterns) if x[str(i)]}
    assert got == want and len(got) > 500


def test_bucketed_store(spark, tmp_path):
    """Put and look up against dictionaries; the store's side has no exchange."""
    store = bucketed.Store(spark, "cache_of_test", str(tmp_path / "store"), 8)
    rows = lambda r: spark.createDataFrame([(f"k{i}", h, t) for i, h, t in r], "key string, hash string, t int").withColumn("timestamp", F.timestamp_seconds("t")).drop("t")
    store.create(rows([(i, "a", i) for i in range(300)] + [(5, "b", 900)]))
    store.put(rows([(i, "c", i) for i in range(0, 500, 2)]), F.col("timestamp") >= F.timestamp_seconds(F.lit(100)))
    want = {f"k{i}": "a" for i in range(100, 300)} | {"k5": "b"} | {f"k{i}": "c" for i in range(0, 500, 2)}
    assert {r.key: r.hash for r in store.read().collect()} == want
    asked = rows([(i, h, 0) for i in range(0, 600, 7) for h in "abc"])
    found = store.lookup(asked)
    assert {(r.key, r.hash): r.hit for r in found.collect()} == {(k, h): want.get(k) == h for i in range(0, 600, 7) for k in [f"k{i}"] for h in "abc"}
    for q in (found, store.read().join(asked.hint("merge"), "key", "full")):
        plan = q._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert store.vacuum() == 1 and store.read().count() == len(want)
    spark.sql("DROP TABLE cache_of_test_v1")
