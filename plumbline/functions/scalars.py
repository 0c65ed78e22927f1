"""Scalar functions as Spark column expressions: hashing, names, text and ratios.

Everything here is built from Spark expressions, so it stays inside generated code and is pushed or folded by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- hashing and ranks -------------------------------------------------------------------------------------------------

#: Fixed values of FNV-1a, 32 bits.
FNV_OFFSET, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967296
#: Configurations in the order of presentation.
CONFIG_NAMES = ("full", "no-types", "no-smart-diff", "no-structured-feedback", "no-pruning", "no-coverage", "no-cache")


def fnv1a32(text: Column) -> Column:
    """FNV-1a hash of a string's UTF-8 bytes as bigint."""
    digits = F.hex(F.encode(text, "utf-8"))
    size = F.octet_length(text)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")
        return F.pmod(h.bitwiseXOR(byte) * F.lit(FNV_PRIME).cast("bigint"), F.lit(MASK32).cast("bigint"))

    return F.aggregate(places, F.lit(FNV_OFFSET).cast("bigint"), step)


def config_rank(name: Column, spread: int = 1000) -> Column:
    """Known configurations by place, others after them by hash; spread 100 for single reports, 1000 for summaries."""
    place = F.array_position(F.array(*map(F.lit, CONFIG_NAMES)), name)
    return F.when(place > 0, place - 1).otherwise(spread + F.pmod(fnv1a32(name), F.lit(spread)))


def content_hash(signature: Column, body: Column, receiver: Column, types: Column) -> Column:
    """sha256 over signature, body, receiver and sorted name:source of used types, without separators."""
    parts = F.array_sort(F.transform(types, lambda t: F.concat(t["name"], F.lit(":"), t["source"])))
    return F.sha2(F.concat(signature, body, receiver, F.array_join(parts, "")), 256)


def cache_key(path: Column, function: Column) -> Column:
    return F.concat(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("::"), function)


def function_key(receiver: Column, name: Column) -> Column:
    """Receiver-aware key of a function."""
    return F.when(F.coalesce(receiver, F.lit("")) == "", name).otherwise(F.concat(F.ltrim(receiver, F.lit("*")), F.lit("."), name))


# --- names -------------------------------------------------------------------------------------------------------------

#: Variable names that are idiomatic and not scored.
STANDARD_VARIABLES = ("err", "ok", "got", "want", "t", "b", "tb", "ctx", "cancel", "done", "r", "w")
#: Predeclared type names.
BUILTIN_TYPES = ("bool", "byte", "complex64", "complex128", "error", "float32", "float64", "int", "int8", "int16", "int32", "int64", "rune", "string",
                 "uint", "uint8", "uint16", "uint32", "uint64", "uintptr", "any", "comparable", "interface{}")


def is_builtin(type_name: Column) -> Column:
    return type_name.isin(*BUILTIN_TYPES)


def camel_split(name: Column) -> Column:
    """Words of a camel-case name: cut before each upper-case letter that follows another kind of character."""
    return F.filter(F.split(name, r"(?<=[^\p{Lu}])(?=\p{Lu})"), lambda w: w != "")


def test_name_tokens(name: Column) -> Column:
    bare = F.regexp_replace(name, "^Test", "")
    return F.flatten(F.transform(F.filter(F.split(bare, "_"), lambda p: p != ""), camel_split))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for equal strings, 0 if only one is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


def focal_index(names: Column) -> Column:
    """Lower-cased, trimmed, distinct, non-empty names."""
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.lower(F.trim(n))), lambda n: n != ""))


def test_name_score(test: Column, focal: Column) -> Column:
    """0..100: best similarity of the first token to a focal name, at least 90 if later tokens complete one; null without names."""
    tokens = test_name_tokens(test)
    first = F.lower(F.element_at(tokens, 1))
    best = F.array_max(F.transform(focal, lambda f: similarity(first, f)))
    joined = F.lower(F.array_join(tokens, ""))
    partial = (F.size(tokens) > 1) & F.exists(focal, lambda f: joined.contains(f))
    score = F.when(partial, F.greatest(best, F.lit(0.9))).otherwise(best)
    return F.when((F.size(focal) > 0) & (F.size(tokens) > 0), score * 100)


def base_receiver(receiver: Column) -> Column:
    """Type name of a receiver without pointer and type parameters."""
    return F.regexp_extract(F.ltrim(receiver, F.lit("*")), r"^([^\[]*)", 1)


def exported_type_names(type_text: Column) -> Column:
    """Exported type names inside a type expression, packages left out."""
    found = F.regexp_extract_all(type_text, F.lit(r"(?<![\w.])(\p{Lu}\w*)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda n: ~is_builtin(n)))


def call_arguments(parameters: Column) -> Column:
    """(first word of each parameter) of a text that starts with a parameter list in brackets."""
    end = F.instr(parameters, ")")
    inside = F.substr(parameters, F.lit(2), F.greatest(end - 2, F.lit(0)))
    words = F.filter(F.transform(F.split(inside, ","), lambda p: F.split_part(F.regexp_replace(F.trim(p), r"\s+", " "), F.lit(" "), F.lit(1))), lambda p: p != "")
    return F.when(end < 1, "()").otherwise(F.concat(F.lit("("), F.array_join(words, ", "), F.lit(")")))


# --- text --------------------------------------------------------------------------------------------------------------


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def split_csv(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")


def split_spaces(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")


def truncate_bytes(text: Column, limit: int) -> Column:
    return F.when(F.octet_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def estimate_tokens(text: Column, bytes_per_token: int = 4) -> Column:
    return F.floor(F.octet_length(text) / bytes_per_token).cast("bigint")


def truncate_body(body: Column, limit: int) -> Column:
    """First two thirds and last third (three lines at least) of a long body, with a mark between."""
    tail = max(3, limit - limit * 2 // 3)
    head = limit - tail
    lines = F.split(body, "\n", -1)
    n = F.size(lines)
    mark = F.array(F.concat(F.lit("\t// ... "), (n - head - tail).cast("string"), F.lit(" lines truncated ...")))
    return F.when(n > limit, F.array_join(F.concat(F.slice(lines, 1, head), mark, F.slice(lines, F.lit(-tail), F.lit(tail))), "\n")).otherwise(body)


def normalise_lines(text: Column) -> Column:
    """Trimmed lines without blank ones and line comments."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("//")), "\n")


def without_blank_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\s", "") != ""), "\n")


def strip_code_fence(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(trimmed, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""), r"^\s+|\s+$", "")


def test_file_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.go$", "_test.go")


def join_path(folder: Column, sub: Column) -> Column:
    return F.when(F.coalesce(sub, F.lit("")) == "", folder).otherwise(F.concat_ws("/", folder, sub))


def build_tag(source: Column) -> Column:
    """Expression of the first //go:build or // +build line before the package clause, else empty."""
    head = F.split(source, r"(?m)^\s*package\s", 2)[0]
    return F.rtrim(F.regexp_extract(head, r"(?m)^\s*(?://go:build|// \+build) (.*)$", 1))


def escape_latex(text: Column) -> Column:
    return F.regexp_replace(text, r"([_&#%])", r"\\$1")


def duration_text(millis: Column) -> Column:
    """123ms, 4.5s or 2m 3s."""
    whole = F.floor(millis / 1000).cast("bigint")
    return (F.when(millis < 1000, F.concat(millis.cast("bigint").cast("string"), F.lit("ms")))
            .when(millis < 60_000, F.concat(F.format_string("%.1f", millis / 1000), F.lit("s")))
            .otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s"))))


def bar_width(value: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))), F.lit("%"))


#: Marks and colours of a file's status, with those of any other.
STATUS_MARKS, NO_MARK = {"success": "✅", "partial": "⚠️", "failed": "❌"}, "❓"
STATUS_COLOURS, NO_COLOUR = {"success": "#22c55e", "partial": "#f59e0b", "failed": "#ef4444"}, "#6b7280"


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


# --- failure messages --------------------------------------------------------------------------------------------------

#: How failure messages name what was expected and what came (pattern, group of expected, group of got), quoted forms first.
_PAIRS = (
    (r'(?i)(?:expected|want)\s+"([^"]*)",?\s+(?:got|but got)\s+"([^"]*)"', 1, 2),
    (r'(?i)got\s+"([^"]*)",?\s+want\s+"([^"]*)"', 2, 1),
    (r"(?i)(?:expected|want)\s+([^\s,]+),?\s+(?:got|but got)\s+([^\s,]+)", 1, 2),
    (r"(?i)got\s+([^\s,]+),?\s+want\s+([^\s,]+)", 2, 1),
)


def expected_and_got(message: Column) -> Column:
    """struct(expected, got) by the first form that fits, empty strings else."""
    out = F.struct(F.lit("").alias("expected"), F.lit("").alias("got"))
    for pattern, e, g in reversed(_PAIRS):
        hit = F.struct(F.regexp_extract(message, pattern, e).alias("expected"), F.regexp_extract(message, pattern, g).alias("got"))
        out = F.when(message.rlike(pattern), hit).otherwise(out)
    return out


def source_line(message: Column) -> Column:
    return F.regexp_extract(message, r"(\w+_test\.go:\d+):", 1)


# --- ratios ------------------------------------------------------------------------------------------------------------


def one_decimal(value: Column) -> Column:
    """A number of at least 0 and below 2^53 with one decimal, as C's %.1f writes it: its binary value rounded, halves to even.
    (format_string rounds the decimal digits that it is shown with, and halves up.)"""
    whole = F.floor(value)
    part = ((value - whole) * float(2**57)).cast("bigint") * 20  # 20/2^57 parts; exact for all that is not rounded to 0.0
    tenths = F.call_function("shiftright", part, F.lit(58))
    rest, half = part - F.call_function("shiftleft", tenths, F.lit(58)), F.lit(2**57)
    up = ((rest > half) | ((rest == half) & (tenths % 2 == 1))).cast("bigint")
    all_tenths = whole * 10 + tenths + up
    return F.concat(F.floor(all_tenths / 10).cast("string"), F.lit("."), (all_tenths % 10).cast("string"))


def percent(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole * 100; `empty` where there is nothing to divide by (100 for coverage, null for rates)."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double")) * 100.0
    return ratio if empty is None else F.when(whole == 0, F.lit(float(empty))).otherwise(ratio)
