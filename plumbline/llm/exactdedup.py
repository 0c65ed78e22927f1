"""Exact dedup by an extendible-hash index on shared files.

1. Map tasks normalise every text, hash it and write segments to the shared folder. A text already met in the task, byte for
   byte, is written as a reference to the first one, so a group with a third of all rows leaves each task as one text; the
   task remembers at most LOCAL_BYTES of texts, which bounds memory and changes nothing else.
2. The index is a folder: a directory, which says which prefixes of keys belong to which bucket, and a folder of files for each
   bucket. It starts from one bucket and doubles until none is overfull by the counts of the new keys. A prefix that is overfull
   at DEPTH bits is spread over more files by as many of the next bits as its count asks for, which key and count tell anyone
   who places an entry, so the directory stays small and files do at any size of the input.
3. Owner tasks get ranges of whole buckets, that is of keys, in key order, together with what those buckets hold already. They
   chain entries whose 64-bit keys collide, compare their bytes, and write the new entries into their bucket's folder: a chain's
   first one with its bytes, the others as references to it.
4. Group sizes and keepers are summed by entry, then by chain. What goes to a chain's task is a row for each map task that met
   the text, whatever the number of copies.

An index that is kept (`Index`) takes further rows: only buckets that the new keys fall into are read. A bucket that is overfull
after that splits on its next bit: its files alone are read again and written to two new folders, then the directory changes.

Defined cases: null counts as the empty text; texts of any length are compared whole; of rows with equal text the one with the
smallest doc_id, of any type that can be ordered, stays, null ids last, ties by place in the input (so of fully repeated rows
one stays); empty tables give no rows; extra columns, whatever their names, are kept by `deduplicate` and ignored by `groups`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Entries in a bucket before it splits, and bits of a key that the directory tells apart.
CAPACITY, DEPTH = 4096, 14
#: Bytes of texts that a map task remembers.
LOCAL_BYTES = 48_000_000
_SPACES = bytes.maketrans(common.SPACES, b" " * len(common.SPACES))
_RUN = re.compile(rb"  +")


def normalise(text: str | None) -> bytes:
    """UTF-8 with each run of ASCII white space as one space."""
    return _RUN.sub(b" ", text.encode("utf-8", "surrogatepass").translate(_SPACES)) if text else b""


def directory(counts: dict[int, int], depth: int, capacity: int) -> list[int]:
    """prefix of `depth` bits -> bucket, by doubling: a bucket over capacity splits on its next bit, lower half first."""
    return slots(split({0: (0, 1 << depth)}, counts, capacity), depth)


def split(buckets: dict[int, tuple[int, int]], counts: dict[int, int], capacity: int) -> dict[int, tuple[int, int]]:
    """Ranges of prefixes [low, high) by bucket, after those with more than capacity entries were halved until they fit or have
    one prefix only. Halves get new numbers, so files of a bucket never change their meaning."""
    out, new = dict(buckets), max(buckets) + 1
    places = sorted(counts)
    sums = [0, *accumulate(counts[p] for p in places)]
    held = lambda low, high: sums[bisect_left(places, high)] - sums[bisect_left(places, low)]
    overfull = [b for b, (low, high) in out.items() if held(low, high) > capacity]
    while overfull:
        low, high = out[b := overfull.pop()]
        if high - low == 1:
            continue
        del out[b]
        for half in ((low, (low + high) // 2), ((low + high) // 2, high)):
            out[new] = half
            if held(*half) > capacity:
                overfull.append(new)
            new += 1
    return out


def slots(buckets: dict[int, tuple[int, int]], depth: int) -> list[int]:
    """The bucket of every prefix."""
    out = [0] * (1 << depth)
    for b, (low, high) in buckets.items():
        out[low:high] = [b] * (high - low)
    return out


def deeper(count: int, capacity: int) -> int:
    """Further bits that a prefix with so many entries splits on."""
    return (-(-max(count, 1) // capacity) - 1).bit_length()


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth).cast("int")


def _array(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _place(table: list[int], counts: dict[int, int], depth: int, capacity: int) -> Column:
    """struct(range, next bits) of `key`; it has the order of keys, read as numbers without sign, and keeps a bucket together."""
    order = {b: i for i, b in enumerate(dict.fromkeys(table))}  # buckets are ranges of prefixes
    prefix = _prefix(depth) + 1
    bits = F.element_at(_array([deeper(counts.get(p, 0), capacity) for p in range(1 << depth)]), prefix)
    rest = F.shiftrightunsigned(F.shiftleft("key", depth), 1)  # the following bits, from the 63rd down
    return F.struct(F.element_at(_array([order[b] for b in table]), prefix).alias("bucket"), F.call_function("shiftright", rest, 63 - bits).alias("bits"))


def _segments(rows: DataFrame) -> DataFrame:
    """rows: uid, doc_id, text. The key is the first 64 bits of the sha; ref is the uid of an equal text's entry in the task."""
    kind = rows.schema["doc_id"].dataType

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, tuple[bytes, int]] = OrderedDict()
        held = 0
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                out = []
                for uid, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                    body = normalise(text.as_py())
                    sha = hashlib.sha256(body).digest()
                    key = int.from_bytes(sha[:8], "big", signed=True)
                    first = seen.get(key)
                    if first is not None and first[0] == body:
                        seen.move_to_end(key)
                        out.append((key, first[1], None, sha))
                        continue
                    out.append((key, None, body, sha))
                    if first is None and len(body) < LOCAL_BYTES // 8:
                        seen[key] = (body, uid)
                        held += len(body) + 200
                        while held > LOCAL_BYTES:
                            held -= len(seen.popitem(last=False)[1][0]) + 200
                columns = list(zip(*out)) or [()] * 4
                yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary())))], names=["uid", "doc_id", "key", "ref", "body", "sha"])

    return rows.mapInArrow(write, f"uid bigint, doc_id {kind.simpleString()}, key bigint, ref bigint, body binary, sha binary")


_ENTRY = "key bigint, uid bigint, chain_run int, chain bigint, body binary"


def _owners(entries: DataFrame, run: int) -> DataFrame:
    """(bucket, run, _ENTRY) of the run's entries, which arrive in key order, those of earlier runs first.

    entries: bucket, run, key, uid, body."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chain = None, []
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                out = []
                for bucket, of, key, uid, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    if key != current:
                        current, chain = key, []
                    first = next((c for b, c in chain if b == body), None)
                    if first is None:
                        chain.append((body, (of, uid)))
                    if of == run:
                        out.append((bucket, run, key, uid, *(first or (run, uid)), None if first else body))
                columns = list(zip(*out)) or [()] * 7
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["bucket", "run", "key", "uid", "chain_run", "chain", "body"])

    return entries.mapInArrow(compare, f"bucket int, run int, {_ENTRY}")


class Index:
    """An extendible-hash index of texts in a folder that driver and executors share.

    <path>/directory/<n>: (bucket, low, high, runs), the ranges of prefixes; the one with the largest n counts.
    <path>/buckets/bucket=<b>/run=<r>: the entries of a bucket, by the run that added them. <path>/sums/run=<r>: (chain, keeper, n).
    One writer at a time; folders that the directory does not name are left over from a writer that was lost, and never read.
    """

    def __init__(self, spark: SparkSession, path: str, capacity: int | None = None, depth: int = DEPTH):
        self.spark, self.path, self.capacity, self.depth = spark, path, CAPACITY if capacity is None else capacity, depth

    def _fs(self, where: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{where}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _clear(self, pattern: str) -> None:
        """Remove what a lost writer left."""
        fs, path = self._fs(pattern)
        for found in fs.globStatus(path) or ():
            fs.delete(found.getPath(), True)

    def directory(self) -> tuple[dict[int, tuple[int, int]], int]:
        """Ranges of prefixes by bucket, and the number of runs so far; one bucket and none if there is no index yet."""
        fs, path = self._fs("directory")
        names = [int(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
        if not names:
            return {0: (0, 1 << self.depth)}, 0
        rows = self.spark.read.parquet(f"{self.path}/directory/{max(names)}").collect()  # at most 2^depth rows
        return {r.bucket: (r.low, r.high) for r in rows}, rows[0].runs

    def _save(self, buckets: dict[int, tuple[int, int]], runs: int) -> None:
        fs, path = self._fs("directory")
        n = 1 + max([int(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else [-1])
        rows = [(b, low, high, runs) for b, (low, high) in buckets.items()]
        self.spark.createDataFrame(rows, "bucket int, low int, high int, runs int").coalesce(1).write.parquet(f"{self.path}/directory/{n}")

    def entries(self, runs: int) -> DataFrame:
        """bucket, run, _ENTRY of what finished runs wrote; a filter on bucket reads only that bucket's folder."""
        rows = self.spark.read.schema(f"{_ENTRY}, bucket int, run int").parquet(f"{self.path}/buckets")
        return rows.where(F.col("run") < runs)

    def add(self, rows: DataFrame) -> DataFrame:
        """Adds rows (uid, doc_id, text), read once, and returns of each: uid, doc_id, sha, and of its group with all earlier
        runs: keeper (no_id, doc_id, run, uid), group_size, and `kept`, whether the row is the keeper."""
        spark = common.bounded(rows).sparkSession
        buckets, run = self.directory()
        for left in (f"buckets/bucket=*/run={run}", f"sums/run={run}"):
            self._clear(left)
        found, _ = common.stage(spark, _segments(rows), "dedup-segments")
        keyed = found.where("body is not null").select(F.lit(run).alias("run"), "key", "uid", "body")
        counts = {r["p"]: r["n"] for r in keyed.groupBy(_prefix(self.depth).alias("p")).agg(F.count("*").alias("n")).collect()}  # at most 2^depth rows
        if not run:
            buckets = split(buckets, counts, self.capacity)
        table = slots(buckets, self.depth)
        if run:
            touched = sorted({table[p] for p in counts})
            keyed = keyed.unionByName(self.entries(run).where(F.col("bucket").isin(touched) & F.col("body").isNotNull()).select("run", "key", "uid", "body"))
        place = _place(table, counts, self.depth, self.capacity)
        owned = keyed.select(F.element_at(_array(table), _prefix(self.depth) + 1).alias("bucket"), "run", "key", "uid", "body", place.alias("place"))
        owned = owned.repartitionByRange("place").sortWithinPartitions("place", "key", "run", "uid").drop("place")
        _owners(owned, run).write.partitionBy("bucket", "run").mode("append").option("compression", "zstd").parquet(f"{self.path}/buckets")
        # rows of one map task and text have one rep; only reps go on to their chain
        members = found.select("uid", "doc_id", "sha", F.coalesce("ref", "uid").alias("rep"))
        keeper = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", F.lit(run).alias("run"), "uid")
        reps = members.groupBy("rep").agg(F.min(keeper).alias("keeper"), F.count("*").alias("n"))
        chains = self.entries(run + 1).where(F.col("run") == run).select(F.col("uid").alias("rep"), F.struct("chain_run", "chain").alias("chain"))
        reps, reps_path = common.stage(spark, reps.join(chains, "rep"), "dedup-reps")
        own = reps.groupBy("chain").agg(F.min("keeper").alias("keeper"), F.sum("n").alias("n"))
        own.write.option("compression", "zstd").parquet(f"{self.path}/sums/run={run}")
        known = spark.read.schema(own.schema).parquet(*[f"{self.path}/sums/run={r}" for r in range(run + 1)])
        sums = known.groupBy("chain").agg(F.min("keeper").alias("keeper"), F.sum("n").alias("group_size"))
        judged, _ = common.stage(spark, reps.select("rep", "chain").join(sums, "chain").drop("chain"), "dedup-groups")
        common.drop(spark, reps_path)
        self._grow(buckets, run + 1, None if not run else set(touched))
        is_keeper = (F.col("keeper.run") == run) & (F.col("keeper.uid") == F.col("uid"))
        return members.join(judged, "rep").select("uid", "doc_id", "sha", "keeper", "group_size", is_keeper.alias("kept"))

    def _grow(self, buckets: dict[int, tuple[int, int]], runs: int, touched: set[int] | None) -> None:
        """Split the overfull among the touched buckets, whose files alone are read, and write the directory."""
        if touched:
            rows = self.entries(runs).where(F.col("bucket").isin(sorted(touched)))
            sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > self.capacity).collect()  # at most 2^depth rows
            over = [r.bucket for r in sizes if buckets[r.bucket][1] - buckets[r.bucket][0] > 1]
            if over:
                rows = self.entries(runs).where(F.col("bucket").isin(over))
                counts = {r["p"]: r["n"] for r in rows.groupBy(_prefix(self.depth).alias("p")).agg(F.count("*").alias("n")).collect()}
                newest = max(buckets)
                buckets = split(buckets, counts, self.capacity)
                table = slots(buckets, self.depth)
                for b in buckets:
                    if b > newest:
                        self._clear(f"buckets/bucket={b}")
                again = rows.withColumn("bucket", F.element_at(_array(table), _prefix(self.depth) + 1))
                again.repartitionByRange("bucket", "key").write.partitionBy("bucket", "run").mode("append").option("compression", "zstd").parquet(f"{self.path}/buckets")
                self._save(buckets, runs)
                for b in over:
                    self._clear(f"buckets/bucket={b}")
                return
        self._save(buckets, runs)


def groups(docs: DataFrame) -> DataFrame:
    """Per row: uid (its place in the input), doc_id, keep_id, group_size, kept, text_sha256."""
    return _grouped(docs.select(F.monotonically_increasing_id().alias("uid"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text")))


def _grouped(rows: DataFrame) -> DataFrame:
    """rows: uid, doc_id, text; read once. The index is made for this call and goes with its staged tables."""
    path = common.new_path(rows.sparkSession, "dedup-index")
    index = Index(rows.sparkSession, path)
    out = index.add(rows)
    common.remove(rows.sparkSession, path)  # what the result reads has been taken out of it
    return out.select("uid", "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept."""
    rows, _ = common.numbered(docs)
    with common.making() as made:
        gone = _grouped(rows.select("uid", *common.fields(F.col("row"), docs, ["doc_id", "text"]))).where("not kept").select("uid")
        return common.without(rows.select("uid", "row"), gone, made).select(*common.fields(F.col("row"), docs))
