"""What several operators share: staged tables, row numbers, ASCII word rules and 64-bit word hashes."""

from __future__ import annotations

import atexit
import contextlib
import gc
import hashlib
import tempfile
import time
import uuid
import zlib
from collections.abc import Iterator
from contextvars import ContextVar
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

#: ASCII white space, which separates words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_WORD_MULT = np.uint64(0x9E3779B97F4A7C15)
_PAIR_MULT = np.uint64(0xBF58476D1CE4E5B9)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where executors are threads of the driver, as in
    tests, a temporary folder stands in for it; on a cluster without the setting there is no folder to use."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("plumbline.shared.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("plumbline.shared.dir", base)
    return base.rstrip("/")


#: Rows in an Arrow batch where whole texts travel, instead of Spark's default of ten times as many.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(docs: DataFrame) -> DataFrame:
    """docs, after Spark's default batch size, if nobody has set another, is brought down to what long texts allow.

    Arrow holds a batch beside the heap on both sides of the pipe; ten thousand long texts are too much for small executors.
    """
    conf = docs.sparkSession.conf
    if int(conf.get(BATCH_SETTING, "10000")) == 10_000:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return docs


#: Staged tables that are still there, by the application that made them: path, and a weak reference to what plans that read
#: the table share.
_staged: dict[str, dict[str, Any]] = {}
#: The paths staged inside the innermost making() of this thread.
_making: ContextVar[list[str] | None] = ContextVar("making", default=None)


def stage(spark: SparkSession, df: DataFrame, name: str, free: bool = True) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes by drop(), by sweep() once no DataFrame can read it any more, or by release(), at the latest when the driver
    ends.
    """
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    adopt(spark, path, out)
    if free:
        sweep(spark)
    return out, path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


def adopt(spark: SparkSession, path: str, read: DataFrame) -> None:
    """Treat the table at path like a staged one, for as long as plans of `read`, which reads it, are there."""
    if not _staged:
        atexit.register(_at_end)
    # the file index: every plan made from `read` holds this very object
    index = read._jdf.queryExecution().analyzed().relation().location()
    _staged.setdefault(spark.sparkContext.applicationId, {})[path] = spark._jvm.java.lang.ref.WeakReference(index)
    if (made := _making.get()) is not None:
        made.append(path)


def staged(spark: SparkSession) -> list[str]:
    """Paths of the staged tables that are still there, the oldest first."""
    return list(_staged.get(spark.sparkContext.applicationId, {}))


@contextlib.contextmanager
def making() -> Iterator[list[str]]:
    """Gives the paths of the tables that this thread stages inside, as they are staged."""
    token = _making.set([])
    try:
        yield _making.get()
    finally:
        _making.reset(token)


def release(spark: SparkSession) -> None:
    """Remove the staged tables of this application. Results of the operators can't be read any more after that."""
    drop(spark, *staged(spark))


def _at_end() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        if (spark := SparkSession.getActiveSession()) is not None:
            release(spark)


def sweep(spark: SparkSession) -> None:
    """Have Spark's context cleaner drop the shuffle files of plans that nothing refers to any more, and drop the staged tables
    that no DataFrame of any thread can read any more.

    Both learn of them from the garbage collector, which finds the last of them on its second run.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    drop(spark, *[path for path, index in list(_staged.get(spark.sparkContext.applicationId, {}).items()) if index.get() is None])


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove staged tables that no later plan reads."""
    known = _staged.get(spark.sparkContext.applicationId, {})
    for p in paths:
        if known.pop(p, None) is not None:
            remove(spark, p)


def remove(spark: SparkSession, where: str) -> None:
    """Delete a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (stem, *(f"{stem}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


#: Order of rows without doc_id: after all others.
LAST = np.iinfo(np.int64).max


def numbered(docs: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """(uid, doc, row) of docs as a staged table, and its path.

    uid is the row's own number, fixed when it is written, so rows with equal ids, or none, are never taken for each other;
    row has the given columns (else all), where no name can clash with another; doc is a number with the order of doc_id,
    whatever its type, LAST for null. Whole numbers are their own order; others, and a column that holds LAST itself, are
    numbered by a sort of the different values.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    whole = isinstance(kind, (ByteType, ShortType, IntegerType, LongType))
    row = F.struct(*[docs[c] for c in columns or docs.columns]).alias("row")
    own = F.coalesce(docs["doc_id"].cast("bigint") if whole else F.lit(None), F.lit(LAST)).alias("doc")
    rows, path = stage(spark, docs.select(F.monotonically_increasing_id().alias("uid"), own, row), "rows")  # docs are read once
    if whole and (not isinstance(kind, LongType) or rows.where((F.col("doc") == LAST) & F.col("row.doc_id").isNotNull()).isEmpty()):
        return rows, path
    # partitions of a sort are in order, and so are these numbers
    different = rows.select(F.col("row.doc_id").alias("id")).where("id is not null").distinct()
    ranks, ranks_path = stage(spark, different.orderBy("id").select("id", F.monotonically_increasing_id().alias("doc")), "order")
    placed = rows.drop("doc").join(ranks, F.col("row.doc_id") == F.col("id"), "left")
    out = stage(spark, placed.select("uid", F.coalesce("doc", F.lit(LAST)).alias("doc"), "row"), "rows")
    drop(spark, path, ranks_path)
    return out


def fields(row: Column, docs: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """The columns of docs out of numbered()'s row."""
    return [row.getField(c).alias(c) for c in columns or docs.columns]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bits of a filter of keys, at most (32 MB where nothing else is said), bits for each key, and bytes of a part of it.
MAX_BITS, BITS_A_KEY, PART = 1 << 28, 16, 1 << 17


def _bit_places(keys: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix64(keys.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return [(x & np.uint64(size - 1)).astype(np.int64) for x in (h, h >> np.uint64(32))]


def key_filter(keys: DataFrame, bits_a_key: int = BITS_A_KEY, max_bits: int = MAX_BITS) -> Broadcast:
    """Broadcast bits that tell which keys are surely not among the given ones (one bigint column), so that rows of others need
    not be shuffled to find out. Bounded by max_bits; with more keys it lets more through, and results don't depend on it."""
    spark, n, size = keys.sparkSession, keys.count(), 1 << 20
    while size < bits_a_key * n and size < max_bits:
        size *= 2

    def parts(bits: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, part in bits.items():
            if part.any():
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["part", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in _bit_places(batch.column(0).to_numpy(zero_copy_only=False), size):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from parts({i: bits[i * PART : (i + 1) * PART] for i in range(size // 8 // PART)})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                now = np.frombuffer(zlib.decompress(part.as_py()), np.uint8)
                bits[i] = bits[i] | now if i in bits else now
        yield from parts(bits)

    schema = "part int, bits binary"
    out = np.zeros(size // 8, np.uint8)
    for r in keys.mapInArrow(mark, schema).repartition("part").mapInArrow(join, schema).collect():  # max_bits / 8 bytes at most
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return spark.sparkContext.broadcast(out)


def likely(df: DataFrame, key: str, known: Broadcast, wanted: bool = True) -> DataFrame:
    """The rows of df whose key the filter lets through, or (wanted=False) the others."""
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(known.value, batch.column(at).to_numpy(zero_copy_only=False)) == wanted))

    return bounded(df).mapInArrow(run, df.schema)


def without(rows: DataFrame, gone: DataFrame, made: list[str]) -> DataFrame:
    """rows (uid, ...) whose uid is not in gone (uid). Only rows that may be among them are shuffled; the others, as a rule most,
    pass where they are read. made: the tables that were staged to work out gone; they go as soon as it is written."""
    spark, earlier = rows.sparkSession, list(made)
    gone, _ = stage(spark, gone, "gone")
    drop(spark, *earlier)
    known = key_filter(gone)
    return likely(rows, "uid", known, False).union(likely(rows, "uid", known).join(gone, "uid", "left_anti").select(*rows.columns))


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where a key is surely not among those of the filter."""
    a, b = _bit_places(keys, 8 * len(bits))
    return ((bits[a >> 3] >> (a & 7)) & (bits[b >> 3] >> (b & 7)) & 1).astype(bool)


#: 64 random bits for each byte value, and an odd multiplier with its inverse modulo 2^64.
_BYTES = np.frombuffer(hashlib.shake_128(b"plumbline word hashes").digest(2048), np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
#: Bytes hashed at once, and the length from which a word is hashed on its own.
PIECE, LONG_WORD = 1 << 18, 512


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: the next `done` powers are the first ones times base^done
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, the same in every process, in a few vector steps over its bytes.

    A word's hash is the sum of table[byte] * step^place, taken from running sums over the text, then mixed with its length.
    """
    if len(raw) > PIECE:
        parts, at = [], 0
        while at < len(raw):
            cut = len(raw) if len(raw) - at <= PIECE else max(raw.rfind(bytes([s]), at, at + PIECE) for s in SPACES)
            if cut < 0:  # a word longer than a piece
                cut = next((i for i in range(at + PIECE, len(raw)) if raw[i] in SPACES), len(raw))
            piece = raw[at:cut]
            parts.append(word_hashes(piece) if len(piece) <= PIECE else np.array([_long_word(w) for w in piece.split()], np.uint64))
            at = cut + 1
        return np.concatenate(parts)
    codes = np.frombuffer(raw, np.uint8)
    word = np.concatenate(([False], ~_IS_SPACE[codes], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTES[codes] * _powers(_STEP, PIECE)[: len(codes)], out=sums[1:])
    out = mix64((sums[ends] - sums[starts]) * _powers(_BACK, PIECE)[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        out[i] = _long_word(raw[starts[i] : ends[i]])
    return out


def _long_word(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every window of k consecutive word hashes (none when there are fewer than k)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    done, width = 0, 1
    # powers of two: a window of 2w is two windows of w, so k words take about 2 log2(k) vector steps
    power = h
    left = k
    while left:
        if left & 1:
            out = mix64(out * _WORD_MULT + power[done : done + n] + np.uint64(width))
            done += width
        left >>= 1
        if left:
            power = mix64(power[: len(power) - width] * _PAIR_MULT + (power[width:] ^ np.uint64(width)))
            width *= 2
    return out


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
