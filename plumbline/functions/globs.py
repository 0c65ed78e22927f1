"""Path patterns: *, ? and [...] inside a path segment, and one ** with the reference semantics of prefix and base name."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is left out unless configured otherwise.
DEFAULT_EXCLUDES = ("*.pb.go", "*_generated.go", "*_gen.go", "vendor/**")


def to_regex(pattern: str) -> str | None:
    """Java regular expression of a pattern without **; null if it is malformed, which matches nothing."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def compiled(pattern: str) -> str | None:
    """One Java regular expression for a whole path; null for a pattern that matches nothing.

    A pattern without a slash may also match the path's last segment; ** stands for any depth: what is before it starts the path,
    what is after it matches the last segment.
    """
    if pattern in ("*", "**"):
        return "(?s).*"
    before, deep, after = pattern.partition("**")
    if not deep:
        rx = to_regex(pattern)
        return rx and (rx if "/" in pattern else f"^(?s:.*/)?{rx[1:]}")
    after = after.removeprefix("/")
    if "**" in after:
        return None
    head = before.removesuffix("/").replace("\\E", "\\E\\\\E\\Q")
    start = f"^(?=\\Q{head}\\E)" if head else "^"
    if after in ("", "*"):
        return start
    rx = to_regex(after)
    return rx and "/" not in after and f"{start}(?s:.*/)?{rx[1:]}" or None


def matches(path: Column, pattern: str) -> Column:
    rx = compiled(pattern)
    return path.rlike(rx) if rx else F.lit(False)


def _any(path: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches, as one expression."""
    known = [rx for p in patterns if (rx := compiled(p))]
    return path.rlike("|".join(f"(?:{rx})" for rx in known)) if known else F.lit(False)


def excluded(path: Column, exclude: list[str] = (), include_only: list[str] = ()) -> Column:
    """Default and own excludes come first, then the whitelist if there is one."""
    out = _any(path, [*DEFAULT_EXCLUDES, *exclude])
    return out | ~_any(path, include_only) if include_only else out


def literals(pattern: str) -> tuple[str, str]:
    """(kind, literal): text that a path must have where the pattern matches: at its `end`, at the `start` of the path or of its
    last segment (`base`); the longest there is, or `none`."""
    def fixed(text: str, from_end: bool) -> str:
        parts = re.split(r"[*?\[\\]", text)
        if len(parts) > 1 and from_end and ("[" in text or "\\" in text):
            return ""  # what follows a bracket may belong to it
        return parts[-1 if from_end else 0]

    before, deep, after = pattern.partition("**")
    after = after.removeprefix("/") if deep else after
    last = after if deep else pattern
    found = [("end", fixed(last, True) if last != "*" else "")]
    if deep:
        found.append(("start", before.removesuffix("/")))
        found.append(("base", fixed(after, False) if after != "*" else ""))
    else:
        found.append(("start" if "/" in pattern else "base", fixed(pattern, False)))
    kind, literal = max(found, key=lambda x: len(x[1]))
    return (kind, literal) if literal else ("none", "")


def matching(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, pattern) of each different path (path) with each pattern (pattern) that matches it.

    Patterns are an index by what is literal in them: paths meet those whose literal they start or end with, found by an ordered
    merge, and only these are compared as patterns. Patterns without anything literal, few as a rule, meet all paths, as they
    match most.
    """
    from ..operators import affixes

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [p for p in batch.column(0).to_pylist() if p is not None]
            rows = [(p, rx, *literals(p)) for p in given if (rx := compiled(p))]
            yield pa.record_batch([pa.array(c, pa.string()) for c in (list(zip(*rows)) or [()] * 4)], names=["pattern", "rx", "kind", "literal"])

    index = patterns.select("pattern").distinct().mapInArrow(read, "pattern string, rx string, kind string, literal string")
    every = paths.select("path").where("path is not null").distinct().withColumn("base", F.substring_index("path", "/", -1))
    of = lambda kind: index.where(F.col("kind") == kind).select("pattern", "rx", "literal")
    met = affixes.starting_with(every.select(F.col("path").alias("text")), of("start").select(F.col("literal").alias("start"))).select(F.col("text").alias("path"), F.col("start").alias("literal")).join(of("start"), "literal")
    ends = affixes.ending_with(every.select(F.col("path").alias("text")), of("end").select(F.col("literal").alias("end"))).select(F.col("text").alias("path"), F.col("end").alias("literal")).join(of("end"), "literal")
    bases = affixes.starting_with(every.select(F.col("base").alias("text")), of("base").select(F.col("literal").alias("start"))).select(F.col("text").alias("base"), F.col("start").alias("literal")).join(of("base"), "literal").join(every, "base")
    free = every.crossJoin(of("none"))
    tried = reduce(DataFrame.unionByName, [x.select("path", "pattern", "rx") for x in (met, ends, bases, free)])
    return tried.where(F.call_function("rlike", F.col("path"), F.col("rx"))).select("path", "pattern")
