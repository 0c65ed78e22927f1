"""Line and branch coverage of a change.

Blocks become lines (`sequence` + `explode`), so joins are equi-joins on (file, line); functions, which are longer and nested,
become dyadic intervals. Lines are many times what they are exploded from, which is all that Spark's estimate of their size sees,
so their joins name a method that broadcasts neither side. Two ways of matching profile files
to source files: `suffix` (the profile's path ends with the file's name, as base names are first joined by equality) and
`exact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import one_decimal, percent


def covered_lines(blocks: DataFrame) -> DataFrame:
    """(file, line) of lines in a block that ran. An interval that ends before it starts has no lines."""
    ran = blocks.where((F.col("cnt") > 0) & (F.col("start_line") <= F.col("end_line")))
    return ran.select("file", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()


def match_files(blocks: DataFrame, files: DataFrame, mode: str = "suffix") -> DataFrame:
    """Blocks under the names of `files` (file). suffix: a block's path ends with the file's base name, on any boundary.

    Each different base name of the profile is matched once: cut to the lengths that wanted names have, it meets them in an
    equi-join (`affixes.ending_with` does the same for names of any length by one sort); paths are joined on whole names then."""
    if mode == "exact":
        return blocks.join(files.select("file").distinct(), "file")
    base = lambda c: F.substring_index(c, "/", -1)
    names = files.select(F.col("file").alias("wanted"), base("file").alias("end")).distinct()
    profile = blocks.withColumnRenamed("file", "profile").withColumn("own", base("profile"))
    lengths = F.coalesce(names.agg(F.collect_set(F.length("end"))).scalar(), F.expr("cast(array() as array<int>)"))  # few
    cut = profile.select("own").distinct().select("own", F.explode(lengths).alias("n")).where(F.col("n") <= F.length("own")).select("own", F.right("own", F.col("n")).alias("end"))
    wanted = cut.join(names, "end").select("own", F.col("wanted").alias("file"))
    return profile.join(wanted, "own").drop("profile", "own")


def diff_coverage(changed: DataFrame, covered: DataFrame) -> DataFrame:
    """(file, changed, covered, uncovered, total, hit, pct) by file; changed: (file, line)."""
    hit = covered.select("file", "line").distinct().withColumn("hit", F.lit(True))
    joined = changed.select("file", "line").join(hit.hint("merge"), ["file", "line"], "left")
    lists = joined.groupBy("file").agg(
        F.array_sort(F.collect_list("line")).alias("changed"), F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("line")))).alias("covered"),
        F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("line")))).alias("uncovered"), F.count("*").alias("total"), F.count("hit").alias("hit"))
    return lists.withColumn("pct", percent(F.col("hit"), F.col("total"), 100))


def total_coverage(by_file: DataFrame, total: str = "total", hit: str = "hit") -> DataFrame:
    """Ratio of sums over files; 100 when nothing changed."""
    sums = by_file.agg(F.coalesce(F.sum(total), F.lit(0)).alias("total"), F.coalesce(F.sum(hit), F.lit(0)).alias("covered"))
    return sums.withColumn("uncovered", F.col("total") - F.col("covered")).withColumn("pct", percent(F.col("covered"), F.col("total"), 100))


def summary_line(total: Column, covered: Column, pct: Column) -> Column:
    return F.concat(F.lit("Diff coverage: "), one_decimal(pct), F.lit("% ("), covered.cast("string"), F.lit("/"), total.cast("string"), F.lit(" changed lines covered)"))


def branch_coverage(branches: DataFrame, covered: DataFrame, by: list[str] = ("file",)) -> DataFrame:
    """Covered branches and error paths. A branch is covered if its first line ran; without branches a rate is 100."""
    hit = covered.select("file", "line").distinct().withColumn("hit", F.lit(True))
    joined = branches.where("line > 0").join(hit.hint("merge"), ["file", "line"], "left")
    error = F.col("is_error_path")
    out = joined.groupBy(*by).agg(F.count("*").alias("total"), F.count("hit").alias("covered"), F.count_if(error).alias("error_total"), F.count_if(error & F.col("hit").isNotNull()).alias("error_covered"))
    return out.withColumn("pct", percent(F.col("covered"), F.col("total"), 100)).withColumn("error_pct", percent(F.col("error_covered"), F.col("error_total"), 100))


#: Bits of a line number.
_BITS = 32


def _piece(level: Column, index: Column) -> Column:
    """Number of the dyadic interval of 2^level lines at that index, different for each."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(_BITS) - level) + index


def _pieces(start: Column, end: Column) -> Column:
    """The dyadic intervals (level, piece) that make up [start, end], two of a level at most: none overlaps another."""
    first, after = F.greatest(start.cast("bigint"), F.lit(0)), end.cast("bigint") + 1

    def of(k: Column) -> Column:
        low = F.call_function("shiftright", first + F.call_function("shiftleft", F.lit(1).cast("bigint"), k) - 1, k)
        high = F.call_function("shiftright", after, k)
        side = lambda index, odd: F.when((low < high) & (odd % 2 == 1), F.struct(k.alias("level"), _piece(k, index).alias("piece")))
        return F.array(side(low, low), side(high - 1, high))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(after - first)) - 1), of)))


def _dyadic(functions: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """functions with a row for each `piece` of theirs, and (file, piece, line) of lines: a line is in a function if and only if
    they meet in one piece, and they meet in one only. So the interval becomes part of an equi-key, and a file that holds most
    functions and lines is dealt by piece. Lines have a piece for each level that functions have, 32 at most."""
    cut = functions.where("start_line <= end_line").withColumn("_p", F.explode(_pieces(F.col("start_line"), F.col("end_line")))).select(*functions.columns, F.col("_p.level").alias("level"), F.col("_p.piece").alias("piece"))
    levels = F.coalesce(cut.agg(F.collect_set("level")).scalar(), F.expr("cast(array() as array<int>)"))
    near = lines.select("file", "line", F.explode(levels).alias("level"))
    return cut.drop("level"), near.select("file", "line", _piece(F.col("level"), F.call_function("shiftright", F.col("line").cast("bigint"), F.col("level"))).alias("piece"))


def functions_by_lines(functions: DataFrame, changed: DataFrame) -> DataFrame:
    """Functions that hold a changed line, by dyadic pieces of their intervals."""
    own = functions.withColumn("_own", F.monotonically_increasing_id())  # repeated functions are rows of their own
    pieces, lines = _dyadic(own, changed)
    return pieces.join(lines.select("file", "piece").hint("merge"), ["file", "piece"], "left_semi").select(*own.columns).dropDuplicates(["_own"]).drop("_own")


def coverage_gaps(functions: DataFrame, uncovered: DataFrame) -> DataFrame:
    """(file, name, lines) of functions with uncovered lines, by dyadic pieces; uncovered: (file, line)."""
    pieces, lines = _dyadic(functions.select("file", "name", "start_line", "end_line"), uncovered.select("file", "line").distinct())
    return pieces.join(lines.hint("merge"), ["file", "piece"]).groupBy("file", "name").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def executable_changed_lines(changed: DataFrame, executable: DataFrame, source: DataFrame) -> DataFrame:
    """Changed lines that can run: in an executable range and not only a brace; all lines of files without source.

    executable: (file, start_line, end_line). source: (file, line, text), line numbers from 1.
    """
    lines = executable.where("start_line <= end_line").select("file", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    plain = source.where(~F.regexp_replace("text", r"^\s+|\s+$", "").isin("{", "}")).select("file", "line")
    keep = lines.join(plain.hint("merge"), ["file", "line"], "left_semi")
    known = source.select("file").distinct().hint("merge")
    return changed.join(known, "file", "left_semi").join(keep.hint("merge"), ["file", "line"], "left_semi").unionByName(changed.join(known, "file", "left_anti"))


#: Whole lines that are never code.
_NEVER_CODE = ("", "{", "}", "})", "),", ")")


def text_executable_lines(changed: DataFrame, source: DataFrame) -> DataFrame:
    """(file, line) of changed lines that text alone shows to be code, for sources that cannot be parsed.

    Comment and import blocks are followed through the changed lines of a file only, in one fold over them. Lines that the
    source does not have stay. changed: (file, line); source: (file, line, text).
    """
    rows = changed.select("file", "line").distinct().join(source.select("file", "line", F.regexp_replace("text", r"^\s+|\s+$", "").alias("t")), ["file", "line"], "left")
    by_file = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "t"))).alias("lines"))
    start = F.expr("named_struct('comment', false, 'imports', false, 'out', cast(array() as array<int>))")

    def step(acc: Column, x: Column) -> Column:
        t = x["t"]
        opens, closes = t.startswith("/*"), t.contains("*/")
        begins = t.startswith("import (")
        plain = t.isin(*_NEVER_CODE) | t.startswith("//") | t.startswith("package ") | t.startswith('import "')
        skipped = acc["comment"] | opens | acc["imports"] | begins | plain
        comment = F.when(acc["comment"], ~closes).otherwise(opens & ~closes)
        free = ~acc["comment"] & ~opens
        imports = F.when(free & acc["imports"], t != ")").when(free, begins).otherwise(acc["imports"])
        out = F.when(F.coalesce(skipped, F.lit(False)), acc["out"]).otherwise(F.concat(acc["out"], F.array(x["line"].cast("int"))))
        return F.struct(F.coalesce(comment, acc["comment"]).alias("comment"), F.coalesce(imports, acc["imports"]).alias("imports"), out.alias("out"))

    return by_file.select("file", F.explode(F.aggregate("lines", start, step, lambda acc: acc["out"])).alias("line"))
