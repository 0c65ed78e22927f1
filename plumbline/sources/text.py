"""Line-oriented sources, whose lines know their place: diffs, coverage profiles, test events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import inside, ordered, parts_before
from . import schemas


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, value), a row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def lines(texts: DataFrame) -> DataFrame:
    """(path, pos, line); a carriage return before the line end goes."""
    return texts.select("path", F.posexplode(F.split("value", "\r?\n", -1)).alias("pos", "line"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, seq, line, single) of files of any size, which Spark splits and reads in parts.

    seq orders the lines of a file: where their part starts, then their place in it. It is no number of lines. single: whether
    the file is one part.
    """
    rows = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.col("_metadata.file_path").alias("path"), place.alias("seq"), F.regexp_replace("value", "\r$", "").alias("line"), (F.col("_metadata.file_block_length") == F.col("_metadata.file_size")).alias("single"))


# --- unified diffs -----------------------------------------------------------------------------------------------------

_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"


def _count(match: Column) -> Column:
    return F.coalesce(F.nullif(match, F.lit("")).try_cast("int"), F.lit(1))


_COUNTED = ("n_file", "n_hunk", "n_old", "n_new")


def diff_lines(texts: DataFrame) -> DataFrame:
    """Every line of every hunk with its old and new number, of texts or of read_lines.

    An added line advances only the new number, a deleted one only the old, an empty line neither, any other both. Of a file's
    head the last line that names a path counts, else the first line of all. Lines are numbered by a scan over the parts of a
    diff, so one diff of any size is read by many tasks.
    """
    rows = ordered(texts, "\r?\n")
    return _numbered(_marked(rows.where("single"))).unionByName(_numbered(_carried(_marked(rows.where("not single")))))


def _marked(rows: DataFrame) -> DataFrame:
    """rows with what their part shows up to them: counts of files, hunks, old and new lines, and the last line of each kind with
    the counts at it. Whether a line that looks like a head's is one shows only after the part's first mark: `known`."""
    line, mark = F.col("line"), F.substring("line", 1, 1)
    is_file, is_hunk = line.startswith("diff --git "), line.rlike("^@@ ")
    plain = ~is_file & ~is_hunk & (line != "")
    counted = dict(zip(_COUNTED, (is_file, is_hunk, plain & (mark != "+"), plain & (mark != "-"))))
    rows = rows.withColumns({"plain": plain} | {n: F.sum(c.cast("bigint")).over(inside()) for n, c in counted.items()})
    start = lambda g: F.regexp_extract("line", _HUNK, g).try_cast("int")
    named = lambda g: F.regexp_extract("line", r"^diff --git a/(.*) b/(.*)$", g)

    def last(condition: Column, *values: Column | str) -> Column:
        return F.last(F.when(condition, F.struct(*values)), True).over(inside())

    rows = rows.withColumns({"file": last(is_file, "n_hunk", named(1).alias("old"), named(2).alias("new")), "hunk": last(is_hunk, *_COUNTED, start(1).alias("old"), start(3).alias("new"))})
    in_hunk = F.coalesce(F.col("hunk.n_file") == F.col("n_file"), F.lit(False))
    known = F.col("file").isNotNull().alias("known")
    return rows.withColumns({k: last(line.startswith(m) & ~in_hunk, "n_file", known, F.substring("line", len(m) + 1, 1 << 30).alias("path")) for k, m in (("old", "--- a/"), ("new", "+++ b/"))})


def _carried(rows: DataFrame) -> DataFrame:
    """Rows of _marked with counts and marks of the whole path, by what earlier parts end with: a row a part."""
    ends = rows.groupBy("path", "part").agg(F.max_by(F.struct(*_COUNTED, "file", "hunk", "old", "new"), "row").alias("x")).select("path", "part", "x.*")
    ends = ends.withColumns({f"_{n}": F.coalesce(F.sum(n).over(parts_before()), F.lit(0)) for n in _COUNTED})
    shifted = lambda s, c, *kept: F.when(F.col(s).isNotNull(), F.struct(*[(F.col(f"{s}.{n}") + F.col(f"_{n}")).alias(n) for n in c], *[F.col(f"{s}.{k}").alias(k) for k in kept]))
    marks = {"file": shifted("file", ["n_hunk"], "old", "new"), "hunk": shifted("hunk", _COUNTED, "old", "new")}
    ends = ends.withColumns({f"_{k}": F.last(v, True).over(parts_before()) for k, v in marks.items()})
    opened = F.coalesce(F.col("_hunk.n_file") == F.col("_n_file"), F.lit(False))  # the part starts inside a hunk
    paths = {k: F.when(F.col(f"{k}.known") | ~opened, shifted(k, ["n_file"], "known", "path")) for k in ("old", "new")}
    ends = ends.withColumns({f"_{k}": F.last(v, True).over(parts_before()) for k, v in paths.items()})
    rows = rows.join(ends.select("path", "part", *[f"_{n}" for n in (*_COUNTED, "file", "hunk", "old", "new")]), ["path", "part"])
    return rows.withColumns({k: F.coalesce(v, F.col(f"_{k}")) for k, v in (marks | paths).items()}).withColumns({n: F.col(n) + F.col(f"_{n}") for n in _COUNTED})


def _numbered(rows: DataFrame) -> DataFrame:
    mark = F.substring("line", 1, 1)
    content = rows.where(F.col("plain") & (F.col("hunk.n_file") == F.col("n_file")) & (F.col("n_file") > 0))
    kind = F.when(mark == "+", "added").when(mark == "-", "deleted").otherwise("context")
    number = lambda k, other: F.when(kind != other, F.col(f"hunk.{k}") + F.col(f"n_{k}") - 1 - F.col(f"hunk.n_{k}")).otherwise(0).cast("int")
    path = lambda k: F.when(F.col(f"{k}.n_file") == F.col("n_file"), F.col(f"{k}.path")).otherwise(F.col(f"file.{k}"))
    text = F.when(mark.isin("+", "-", " "), F.substring("line", 2, 1 << 30)).otherwise(F.col("line"))
    return content.select("path", path("new").alias("file"), path("old").alias("old_path"), (F.col("hunk.n_hunk") - F.col("file.n_hunk")).cast("int").alias("hunk"), "pos", kind.alias("type"), text.alias("content"),
                          number("old", "added").alias("old_no"), number("new", "deleted").alias("new_no"))


def hunks(texts: DataFrame) -> DataFrame:
    """(path, pos, old_start, old_count, new_start, new_count, header) of every well-formed hunk header, of texts or of read_lines."""
    rows = ordered(texts, "\r?\n").where(F.col("line").rlike(_HUNK))
    at = lambda g: F.regexp_extract("line", _HUNK, g)
    return rows.select("path", "pos", at(1).try_cast("int").alias("old_start"), _count(at(2)).alias("old_count"), at(3).try_cast("int").alias("new_start"), _count(at(4)).alias("new_count"), F.trim(at(5)).alias("header"))


def changed_lines(diff: DataFrame) -> DataFrame:
    """(file, line, pos) of added lines."""
    return diff.where((F.col("type") == "added") & (F.col("new_no") > 0)).select("file", F.col("new_no").alias("line"), "pos")


# --- coverage profiles -------------------------------------------------------------------------------------------------

_BLOCK = r"^(.*):(\d+)\.(\d+),(\d+)\.(\d+)\s+(\d+)\s+(\d+)$"


def coverage_blocks(texts: DataFrame, strict: bool = True) -> DataFrame:
    """Blocks of coverage profiles, of texts or of read_lines; a malformed line fails the read, or is left out if not strict. The last colon splits off the file."""
    rows = (texts if "line" in texts.columns else lines(texts)).withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").startswith("mode:"))
    good = F.col("line").rlike(_BLOCK)
    if strict:
        rows = rows.withColumn("line", F.when(good, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("malformed coverage line: "), F.col("line")))))
    else:
        rows = rows.where(good)
    names = ("start_line", "start_col", "end_line", "end_col", "num_stmt", "cnt")
    return rows.select(F.regexp_extract("line", _BLOCK, 1).alias("file"), *[F.regexp_extract("line", _BLOCK, i + 2).cast("int").alias(n) for i, n in enumerate(names)])


# --- test events -------------------------------------------------------------------------------------------------------


def _decoded(texts: DataFrame) -> DataFrame:
    rows = texts if "line" in texts.columns else lines(texts).withColumn("seq", F.col("pos").cast("bigint"))
    rows = rows.where(F.trim("line") != "")
    e = F.from_json("line", f"{schemas.EVENT}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    # a strict decoder refuses numbers where text belongs, which from_json would turn into text
    number = r'"(?:Action|Package|Test|Output|Time)"\s*:\s*[-0-9tf\[{]'
    return rows.withColumn("e", e).withColumn("ok", F.col("line").startswith("{") & F.col("e").isNotNull() & F.col("e._bad").isNull() & ~F.col("line").rlike(number))


def events(texts: DataFrame) -> DataFrame:
    """(path, seq, Time, Action, Package, Test, Elapsed, Output) of the lines that are events, of texts or of read_lines."""
    return _decoded(texts).where("ok").select("path", "seq", "e.Time", "e.Action", "e.Package", "e.Test", "e.Elapsed", "e.Output")


def has_tests(texts: DataFrame) -> DataFrame:
    """(path, has_tests) of every path with a line: whether some event belongs to a test."""
    of = F.col("ok") & (F.coalesce("e.Test", F.lit("")) != "")
    return _decoded(texts).groupBy("path").agg(F.bool_or(F.coalesce(of, F.lit(False))).alias("has_tests"))


def side_output(texts: DataFrame) -> DataFrame:
    """(path, seq, line) of the other lines: compiler messages and broken JSON."""
    return _decoded(texts).where("not ok").select("path", "seq", "line")


# --- environment files -------------------------------------------------------------------------------------------------


def env_entries(texts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(key, value) of KEY=VALUE lines; blank lines and comments are skipped, one pair of quotes goes, existing keys win."""
    rows = lines(texts).withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").contains("="))
    parts = F.split("line", "=", 2)
    value = F.trim(parts[1])
    rows = rows.select("path", "pos", F.trim(parts[0]).alias("key"), value.alias("v")).withColumn("value", F.when(F.col("v").rlike(r"^\".*\"$|^'.*'$") & (F.length("v") >= 2), F.expr("substring(v, 2, length(v) - 2)")).otherwise(F.col("v")))
    first = rows.where("key <> ''").groupBy("key").agg(F.min_by("value", F.struct("path", "pos")).alias("value"))
    return first if existing is None else first.join(existing.select("key"), "key", "left_anti")
