"""Go source files as tables: declarations, calls, branches, executable ranges, assertions, table cases and mutants.

Each table is one `mapInArrow` over (path, value), a row a file in, typed rows out; files are parsed where they are read, a
large one in pieces that end between declarations, and filters on the path belong before, as they cannot be pushed through Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import golang

FUNCTIONS = ("file string, pos int, name string, receiver string, start_line int, end_line int, signature string, params array<struct<name:string,type:string>>, "
             "returns array<string>, body string, doc string, type_params string")
TYPES = ("file string, pos int, name string, kind string, fields array<struct<name:string,type:string,tag:string>>, methods array<struct<name:string,signature:string>>, "
         "embedded array<string>, underlying string, source string, type_params string")
VARIABLES = "file string, pos int, name string, type string, value string, is_const boolean"
IMPORTS = "file string, pos int, path string, alias string"
CALLS = "file string, pos int, func string, receiver string, method string, args array<string>, line int"
BRANCHES = "file string, pos int, func string, kind string, line int, is_error_path boolean"
BRANCH_TEXTS = "file string, pos int, func string, text string"
RANGES = "file string, pos int, start_line int, end_line int"
MUTANTS = "file string, pos int, func string, type string, line int, original string, replacement string"
CASES = "file string, pos int, func string, tab int, idx int, fields array<struct<key:string,value:string>>"
LOCALS = "file string, pos int, func string, name string, label string"


def go_files(texts: DataFrame, tests: bool = False) -> DataFrame:
    """Files named *.go, test files only if asked for."""
    is_test = F.col("path").endswith("_test.go")
    return texts.where(F.col("path").endswith(".go") & (is_test if tests else ~is_test))


def _rows(texts: DataFrame, schema: str, make: Callable[[golang.Source], Iterator[tuple]], pieces: Callable[[str], Iterator[golang.Source]] = golang.sources) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(path, i, *r) for i, r in enumerate(r for source in pieces(text or "") for r in make(source))]
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [()] * len(arrow), arrow)], schema=arrow)

    return texts.select("path", "value").mapInArrow(run, schema)


def functions(texts: DataFrame, *columns: str) -> DataFrame:
    """The functions of files, with file, pos and the columns asked for, else all: what isn't asked for isn't read."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(FUNCTIONS).fields
    wanted = StructType([f for f in fields if not columns or f.name in ("file", "pos", *columns)])
    if unknown := set(columns) - {f.name for f in fields}:
        raise ValueError(f"functions have no {', '.join(sorted(unknown))}")

    def of(f: golang.Function, name: str):
        return [{"name": n, "type": t} for n, t in f.params] if name == "params" else getattr(f, name)

    names = wanted.names[2:]
    return _rows(texts, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted), lambda s: (tuple(of(f, n) for n in names) for f in s.functions))


def testable(funcs: DataFrame) -> DataFrame:
    return funcs.where("name <> 'init'")


def types(texts: DataFrame) -> DataFrame:
    def make(s: golang.Source):
        for t in s.types:
            yield t.name, t.kind, [{"name": n, "type": k, "tag": g} for n, k, g in t.fields], [{"name": n, "signature": g} for n, g in t.methods], t.embedded, t.underlying, t.source, t.type_params

    return _rows(texts, TYPES, make)


def variables(texts: DataFrame) -> DataFrame:
    return _rows(texts, VARIABLES, lambda s: ((v.name, v.type, v.value, v.is_const) for v in s.variables))


def imports(texts: DataFrame) -> DataFrame:
    return _rows(texts, IMPORTS, lambda s: iter(s.imports), golang.heads)


def calls(texts: DataFrame) -> DataFrame:
    return _rows(texts, CALLS, lambda s: ((f.name, *c) for f in s.functions for c in s.calls(f)))


def branches(texts: DataFrame) -> DataFrame:
    return _rows(texts, BRANCHES, lambda s: ((f.name, *b) for f in s.functions for b in s.branches(f)))


def branch_texts(texts: DataFrame) -> DataFrame:
    """(file, pos, func, text) of what the branches of every function ask."""
    return _rows(texts, BRANCH_TEXTS, lambda s: ((f.name, b) for f in s.functions for b in s.branch_texts(f)))


def executable_ranges(texts: DataFrame) -> DataFrame:
    return _rows(texts, RANGES, lambda s: iter(s.executable_ranges()))


def mutants(texts: DataFrame) -> DataFrame:
    """Mutants numbered from 1 in source order by file."""
    return _rows(texts, MUTANTS, lambda s: ((f.name, *m) for f in s.functions for m in s.mutants(f))).withColumn("id", F.col("pos") + 1)


def table_cases(texts: DataFrame) -> DataFrame:
    def make(s: golang.Source):
        for f in s.functions:
            for i, (table, fields, _, _) in enumerate(s.table_cases(f)):
                yield f.name, table, i, [{"key": k, "value": v} for k, v in fields]

    return _rows(texts, CASES, make)


def locals_(texts: DataFrame) -> DataFrame:
    return _rows(texts, LOCALS, lambda s: ((f.name, *v) for f in s.functions for v in s.variables_in(f)))


def assertions(texts: DataFrame) -> DataFrame:
    """(file, test, signature, kind, is_error) of assertions in test functions."""
    from ..operators.naturalness import classify

    found = classify(calls(texts).where(F.col("func").startswith("Test")))
    signature = F.concat("receiver", F.lit("."), "method", F.lit("("), F.array_join("args", ","), F.lit(")"))
    return found.select("file", F.col("func").alias("test"), signature.alias("signature"), "kind", "is_error")


def normalised_bodies(funcs: DataFrame) -> DataFrame:
    """funcs with `normal`: the body without comments and spacing."""
    @F.pandas_udf("string")
    def normal(bodies):
        return bodies.map(golang.normalise)

    return funcs.withColumn("normal", normal("body"))


def package_index(funcs: DataFrame) -> DataFrame:
    """One function a name over a package; the last file and place win."""
    columns = funcs.columns
    return funcs.groupBy("name").agg(F.max_by(F.struct(*columns), F.struct("file", "pos")).alias("f")).select("f.*")


def merged(pairs: DataFrame) -> DataFrame:
    """(path, code, added, skipped) of (path, existing, generated): generated sources merged into existing ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [golang.merge(a or "", b or "") for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = list(zip(*rows)) or [()] * 3
            kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["path", "code", "added", "skipped"])

    return pairs.select("path", "existing", "generated").mapInArrow(run, "path string, code string, added array<string>, skipped array<string>")


def pruned(texts: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, value) without what a plan removes. plan: (path, name, action, cases), as testevents.prune_plan gives for a file."""
    by = plan.groupBy("path").agg(F.collect_list(F.struct("name", "action", "cases")).alias("plan"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, steps in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if cases := [(step["name"], set(step["cases"] or ())) for step in steps or () if step["action"] == "remove_cases"]:
                    text = golang.remove_all_cases(text, cases)
                gone = {step["name"] for step in steps or () if step["action"] == "remove_function"}
                out.append(golang.remove_functions(text, gone) if gone else text)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["path", "value"])

    return texts.join(by, "path", "left").select("path", "value", "plan").mapInArrow(run, "path string, value string")
