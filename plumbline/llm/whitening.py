"""Embedding whitening by TSQR: centred rows, a QR of each partition, a tree of QRs of their R factors, an SVD of the last R.

Entries become whole numbers, x = floor(SCALE * c) + SHIFT, so sums are exact and rows are centred by exact differences: a mean
is a whole number and a remainder, x - mean never subtracts large rounded numbers. With the right singular vectors V and values
s of the centred rows, V's columns are the components and s^2 / n their eigenvalues; no covariance is formed, which would square
the condition. Signs are fixed: the entry of a component that is largest in size, the first of ties, is positive.

What travels: of each partition its sums (two numbers a dimension) and its R (dimensions^2 numbers); both are merged in a tree,
MERGE at a time, so the driver gets one R and a row a dimension, however many partitions there are.

Defined cases: rows whose vector is null, empty, or has null or non-finite entries are left out, as are those with an entry whose
x is beyond 2^62; vectors of another length than most of the rest (of ties the longer) are left out too; components without variance
(beyond the rank of the centred rows) have no rows, so equal vectors only, or one row, give none; components of equal eigenvalues
are any basis of their space; a deviation beyond a long is null; repeated rows and ids are rows of their own, a null vec_id is
returned as it is; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 32
#: R factors that one task merges, at most and by their bytes, and rows that are taken together.
MERGE, HELD, ROWS = 16, 1 << 27, 2048
#: Singular values below this share of the largest, times the dimension, are no variance but rounding.
EPS = 8 * np.finfo(np.float64).eps


def entries(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, usable, x) of a list column: x has the whole-number entries of all rows that aren't null, row after row."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    there = ~vectors.is_null().to_numpy(zero_copy_only=False)
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()  # without those of null rows
    c = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(SCALE * c) + SHIFT
        good = np.isfinite(c) & (np.abs(x) < 2.0**62)  # differences of two are longs too
    ends = np.cumsum(lengths)
    bad = np.concatenate(([0], np.cumsum(~good)))
    usable = there & (lengths > 0) & (bad[ends] == bad[ends - lengths])
    whole = np.floor(np.where(good, SCALE * c, 0)).astype(np.int64) + SHIFT
    return lengths, usable, whole


def matrix(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are used, their x as a matrix)."""
    lengths, usable, x = entries(vectors)
    rows = np.flatnonzero(usable & (lengths == length))
    start = np.cumsum(lengths)[rows] - length
    return rows, x[start[:, None] + np.arange(length)]


@dataclass
class Centre:
    """Exact sums of n rows, as mean = whole + rest / n of each dimension."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def differences(self, x: np.ndarray) -> np.ndarray:
        """x - S/n."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of (n*x - S)^2 of each row, exact; null where it is no long."""
        fits = np.square(self.n * self.differences(x)).sum(1) < 2.0**63 * (1 - 1e-9)
        out = np.square(self.n * (np.where(fits[:, None], x, self.whole) - self.whole) - self.rest).sum(1)
        return pa.array(out, pa.int64(), mask=~fits)


def sums(spark: SparkSession, rows: DataFrame) -> tuple[int, Centre] | None:
    """The length of the vectors that are used and their exact sums, of rows (id, vector)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            lengths, usable, x = entries(batch.column(1))
            starts = np.cumsum(lengths) - lengths
            for length in np.unique(lengths[usable]).tolist():
                part = x[starts[usable & (lengths == length)][:, None] + np.arange(length)]
                high = part >> 31  # two halves, so no sum of a partition leaves a long
                was = found.setdefault(length, [0, np.zeros(length, np.int64), np.zeros(length, np.int64)])
                found[length] = [was[0] + len(part), was[1] + high.sum(0), was[2] + (part - (high << 31)).sum(0)]
        for length, (n, high, low) in found.items():
            yield pa.record_batch([pa.array([length], pa.int32()), pa.array([n], pa.int64()), pa.array([high], pa.list_(pa.int64())), pa.array([low], pa.list_(pa.int64()))], names=["length", "n", "high", "low"])

    parts, path = common.stage(spark, rows.mapInArrow(add, "length int, n bigint, high array<bigint>, low array<bigint>"), "sums", free=False)
    length = parts.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if length is None:
        return None
    of = parts.where(F.col("length") == length.length).select(F.posexplode(F.arrays_zip("high", "low")).alias("at", "s"))
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("s.high", "s.low")]
    got = of.groupBy("at").agg(exact[0].alias("high"), exact[1].alias("low")).orderBy("at").collect()  # a row a dimension
    common.drop(spark, path)
    total = [(int(r.high) << 31) + int(r.low) for r in got]
    parts_of = [divmod(s, length.n) for s in total]
    return length.length, Centre(length.n, np.array([q for q, _ in parts_of], np.int64), np.array([r for _, r in parts_of], np.int64))


def _merged(spark: SparkSession, parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray], width: int) -> np.ndarray:
    """One matrix of parts (place, m), m the bytes of matrices of that width: neighbours are merged in tasks, round by round."""
    several = max(2, min(MERGE, HELD // (8 * width * width)))
    parts, path = common.stage(spark, parts, "factors", free=False)

    def combine(key: tuple, table: pa.Table) -> pa.Table:
        found = [np.frombuffer(m.as_py(), np.float64).reshape(-1, width) for m in table.sort_by("place").column("m")]
        return pa.table({"place": pa.array([key[0].as_py()], pa.int64()), "m": pa.array([np.ascontiguousarray(merge(found)).tobytes()], pa.binary())})

    while parts.agg(F.max("place")).first()[0] > 0:
        merged = parts.groupBy(F.floor(F.col("place") / several).alias("node")).applyInArrow(combine, "place bigint, m binary")
        done = path
        parts, path = common.stage(spark, merged, "factors", free=False)
        common.drop(spark, done)
    out = np.frombuffer(parts.first().m, np.float64).reshape(-1, width)
    common.drop(spark, path)
    return out


def _part(place: int, m: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([place], pa.int64()), pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())], names=["place", "m"])


def _used(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, x) of the rows that are used, at most ROWS at once."""
    for batch in batches:
        for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
            rows, x = matrix(part.column(1), length)
            if len(rows):
                yield part.column(0).take(pa.array(rows)), x


def _r_of(found: list[np.ndarray]) -> np.ndarray:
    out = found[0]
    for m in found[1:]:
        out = np.linalg.qr(np.vstack([out, m]), mode="r")
    return out


def factor(spark: SparkSession, rows: DataFrame, length: int, centre: Centre) -> np.ndarray:
    """R of the centred rows: a QR of each partition, taken a block of rows at a time, then of the factors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, length))
        for _, x in _used(batches, length):
            r = np.linalg.qr(np.vstack([r, centre.differences(x)]), mode="r")
        if len(r):
            yield _part(TaskContext.get().partitionId(), r)

    return _merged(spark, rows.mapInArrow(run, "place bigint, m binary"), _r_of, length)


@dataclass
class Whitening:
    """How vectors of one length are whitened: components as columns, their eigenvalues, and their sum over all dimensions."""

    length: int
    centre: Centre
    components: np.ndarray
    values: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.differences(x) @ self.components / np.sqrt(self.values)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """vectors: (id, vector). None where no component has variance."""
    spark = vectors.sparkSession
    found = sums(spark, vectors)
    if found is None:
        return None
    length, centre = found
    _, s, v = np.linalg.svd(factor(spark, vectors, length, centre))
    rank = int((s > s[0] * EPS * length).sum()) if s[0] > 0 else 0
    if rank == 0:
        return None
    k = min(components, rank)
    v = v[:k].T
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(k)])
    return Whitening(length, centre, v, np.square(s[:k]) / centre.n, float(np.square(s).sum() / centre.n))


def _moments_of(found: list[np.ndarray]) -> np.ndarray:
    """Merge (count, mean, centred products), a matrix each: the first row has the mean, the second the count."""
    mean, n, m = found[0][0], found[0][1, 0], found[0][2:]
    for other in found[1:]:
        more = other[1, 0]
        step = other[0] - mean
        m = m + other[2:] + np.outer(step, step) * (n * more / (n + more))
        mean, n = mean + step * (more / (n + more)), n + more
    return np.vstack([mean, np.full_like(mean, n), m])


def identity_error(vectors: DataFrame, how: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance, measured over all of them, minus the identity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: np.ndarray | None = None
        for _, x in _used(batches, how.length):
            w = how.apply(x)
            mean = w.mean(0)
            own = np.vstack([mean, np.full_like(mean, len(w)), (w - mean).T @ (w - mean)])
            now = own if now is None else _moments_of([now, own])
        if now is not None:
            yield _part(TaskContext.get().partitionId(), now)

    k = len(how.values)
    all_of = _merged(vectors.sparkSession, vectors.mapInArrow(run, "place bigint, m binary"), _moments_of, k)
    return float(np.abs(all_of[2:] / how.centre.n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per used row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[vector].alias("vector"))
    kind, spark = rows.schema["vec_id"].dataType, vectors.sparkSession
    ddl = f"vec_id {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    how = fit(rows, components)
    if how is None:
        return spark.createDataFrame([], ddl)
    error, k = identity_error(rows, how), len(how.values)
    schema = pa.schema([("vec_id", to_arrow_type(kind)), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), *((c, pa.float64()) for c in ("whitened", "explained", "identity_error"))])
    shared = spark.sparkContext.broadcast(how)  # dimensions x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = shared.value
        for ids, x in _used(batches, how.length):
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.record_batch([
                ids.take(each).cast(schema.field(0).type), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), how.centre.n)), how.centre.deviation(x).take(each),
                pa.array(how.apply(x).ravel()), pa.array(np.tile(how.values / how.trace, len(x))), pa.array(np.full(len(each), error))], schema=schema)

    return rows.mapInArrow(run, ddl)
