"""How natural generated tests look: assertions per test and how names fit what they test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import STANDARD_VARIABLES, similarity, test_name_score

#: Assertion methods by kind, and those of the kind "error" that count as error assertions.
METHODS = {
    "equal": ("Equal", "EqualValues", "Exactly", "Same", "NotSame", "JSONEq", "YAMLEq", "InDelta", "InEpsilon", "NotEqual", "NotEqualValues"),
    "nil": ("Nil", "NotNil", "Empty", "NotEmpty", "Zero", "NotZero"),
    "error": ("Error", "NoError", "ErrorIs", "ErrorAs", "ErrorContains", "EqualError"),
    "bool": ("True", "False"),
    "contains": ("Contains", "NotContains", "Subset", "NotSubset", "ElementsMatch", "Regexp", "NotRegexp"),
    "len": ("Len", "Greater", "GreaterOrEqual", "Less", "LessOrEqual"),
    "panic": ("Panics", "NotPanics", "PanicsWithValue", "PanicsWithError"),
    "other": ("FileExists", "NoFileExists", "DirExists", "NoDirExists"),
    "fatal": ("Fail", "FailNow"),
}
#: Receivers of assertions, and reporting methods of the testing type.
RECEIVERS, REPORTS = ("assert", "require", "a", "r"), ("Error", "Errorf", "Fatal", "Fatalf")


def is_test_function(name: Column, receiver: Column, parameters: Column) -> Column:
    """func TestXxx(t *testing.T) without receiver, not TestMain; parameters: array<struct<name, type>>."""
    one = (F.size(parameters) == 1) & (F.get(parameters, 0)["type"] == "*testing.T")
    return name.rlike(r"^Test(?![\p{Ll}])") & (name != "TestMain") & (F.coalesce(receiver, F.lit("")) == "") & one


#: Further methods of the gotest.tools library by kind, of which those of the kind "error" count as error assertions.
GOTEST_METHODS = {"equal": ("DeepEqual",), "error": ("NilError", "ErrorType"), "check": ("Check", "Assert")}


def _without_strings(text: Column) -> Column:
    return F.regexp_replace(text, r"\"(?:\\.|[^\"\\])*\"|`[^`]*`", "s")


def is_error_expression(text: Column) -> Column:
    """Whether an expression's syntax looks like an error: a name err, e or er, or one that ends in err, or a chain of selectors
    and calls from such a name, or with a selector named Error or ending in Err."""
    chain = _without_strings(text)
    for _ in range(6):  # arguments go, the innermost first
        chain = F.regexp_replace(chain, r"(?<=\w)\([^()]*\)", "")
    lower = F.lower(chain)
    return lower.rlike(r"^(\w*err|e|er)(\.\w+)*$|^\w+(\.\w+)*\.(error|\w*err)(\.\w+)*$")


def classify(calls: DataFrame, gotest_tools: bool = False) -> DataFrame:
    """Calls (receiver, method, args array<string>) that assert, with kind and is_error.

    gotest_tools: also those of that library that no method of the first names hides; the checks of the reference never get
    to them, as they ask for the first names before.
    """
    testing = ((F.col("receiver").isin("t", "tb")) | F.col("receiver").endswith("T")) & F.col("method").isin(*REPORTS)
    pairs = [F.lit(x) for kind, names in METHODS.items() for n in names for x in (n, kind)]
    named = F.when(F.col("receiver").isin(*RECEIVERS), F.try_element_at(F.create_map(*pairs), F.col("method")))
    said = F.exists("args", is_error_expression)
    kind = F.when(testing, F.lit("fatal")).otherwise(named)
    error = F.when(testing, said).otherwise(kind == "error")
    if gotest_tools:
        more = F.try_element_at(F.create_map(*[F.lit(x) for k, names in GOTEST_METHODS.items() for n in names for x in (n, k)]), F.col("method"))
        checked = _without_strings(F.get("args", 1))
        compares = F.regexp_replace(checked, r"\([^()]*\)", "").rlike(r"[-+*/%<>&|^]|==|!=")
        found = F.when(more != "check", more).otherwise(F.when(compares, "equal").when(checked.endswith(")"), "other").otherwise("bool"))
        kind = F.coalesce(kind, F.when(F.col("receiver") == "assert", F.when(more.isNotNull(), found)))
        error = F.coalesce(error, F.when(more == "check", said).otherwise(more == "error"))
    return calls.withColumn("kind", kind).withColumn("is_error", error).where("kind is not null")


def per_test(asserts: DataFrame) -> DataFrame:
    """(file, test, n, has_duplicate, nil_only, has_error); asserts: (file, test, signature, kind, is_error)."""
    signatures = asserts.groupBy("file", "test", "signature").agg(F.count("*").alias("n"), F.bool_and(F.col("kind") == "nil").alias("nil"), F.bool_or("is_error").alias("err"))
    return signatures.groupBy("file", "test").agg(F.sum("n").alias("n"), (F.max("n") >= 2).alias("has_duplicate"), F.bool_and("nil").alias("nil_only"), F.bool_or("err").alias("has_error"))


def per_file(tests: DataFrame, asserts: DataFrame) -> DataFrame:
    """Counts and shares by file; tests: (file, test), with or without assertions."""
    joined = tests.join(per_test(asserts), ["file", "test"], "left")
    share = lambda c: F.count_if(c) * 100.0 / F.count("*")
    return joined.groupBy("file").agg(
        F.count("*").alias("test_count"), (F.coalesce(F.sum("n"), F.lit(0)) / F.count("*")).alias("assertion_ratio"), share(F.col("n").isNull()).alias("no_assertions_pct"),
        share(F.col("has_duplicate")).alias("duplicate_assertions_pct"), share(F.col("nil_only")).alias("nil_only_assertions_pct"), share(F.col("has_error")).alias("error_assertions_pct"))


def name_scores(tests: DataFrame, focal: Column) -> DataFrame:
    """(file, test_name_score): mean over tests; focal: array of lower-cased names. A name that a file has many times is scored once."""
    each = tests.select("file", "test", focal.alias("_f")).groupBy("file", "test", "_f").agg(F.count("*").alias("_n"))
    scored = each.withColumn("_s", test_name_score(F.col("test"), F.col("_f")))
    return scored.groupBy("file").agg((F.sum(F.col("_s") * F.col("_n")) / F.sum(F.when(F.col("_s").isNotNull(), F.col("_n")))).alias("test_name_score"))


def variable_scores(variables: DataFrame) -> DataFrame:
    """(file, var_name_score): mean over variables (file, name, label), idiomatic names left out."""
    scored = variables.where(~F.col("name").isin(*STANDARD_VARIABLES, "_") & (F.coalesce("label", F.lit("")) != ""))
    return scored.groupBy("file").agg((F.avg(similarity(F.lower("name"), F.lower("label"))) * 100).alias("var_name_score"))
