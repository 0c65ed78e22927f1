"""Running values along ordered lines, as a parallel prefix scan.

The lines of a path come in parts: those of a file in the parts in which Spark reads it, those of a text value in parts of
PART_LINES. Windows run inside a part; what each part adds up to is summed over the parts before it, a row a part, and joined
back by (path, part), by which the lines are already dealt. So no task gets a whole file, however large it is; and where a path
has one part only, as nearly all have, there is nothing to join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a text value that form a part.
PART_LINES = 1 << 16


def ordered(texts: DataFrame, ends: str = "\n") -> DataFrame:
    """The lines of texts (path, value), or those of text.read_lines (path, seq, line, single), as rows with part and row, which
    order the lines of a path, pos, the same in one, and single: whether the path has one part only."""
    if "seq" in texts.columns:
        single = F.col("single") if "single" in texts.columns else F.lit(False)
        return texts.withColumns({"part": F.col("seq.part"), "row": F.col("seq.row"), "pos": F.col("seq"), "single": single}).drop("seq")
    lines = F.split("value", ends, -1)
    rows = texts.where("value is not null").select("path", (F.size(lines) <= PART_LINES).alias("single"), F.posexplode(lines).alias("pos", "line"))
    return rows.withColumns({"part": F.floor(F.col("pos") / PART_LINES), "row": F.col("pos").cast("bigint")})


def inside():
    """Rows of a part so far, this one included."""
    return Window.partitionBy("path", "part").orderBy("row")


def parts_before():
    """Parts of a path before this one."""
    return Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def running(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """rows (path, part, row, single, ...) with the sum of each column from the first row of the path to this one."""
    total = rows.where("not single").groupBy("path", "part").agg(*[F.sum(c.cast("bigint")).alias(f"_{n}") for n, c in sums.items()])
    offset = total.select("path", "part", *[F.coalesce(F.sum(f"_{n}").over(parts_before()), F.lit(0)).alias(f"_{n}") for n in sums])
    own = rows.withColumns({n: F.sum(c.cast("bigint")).over(inside()) for n, c in sums.items()})
    return own.join(offset, ["path", "part"], "left").withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in sums}).drop(*[f"_{n}" for n in sums])
