"""Merkle manifest of a dataset: a digest tree of the documents of each source, and one over the sources' roots.

A row is a leaf. Leaves of a source stand in the order of doc_id; while there are several nodes, every ARITY consecutive ones
(the last run may have fewer, even one) become the digest of their digests. The roots of the sources, in the order of the
sources, give the dataset's root the same way. Digests are sha256; what is hashed are digests as hexadecimal text.

Method: a sort by (source, doc_id) numbers the leaves; partitions only tell how many rows of a source end in them. Leaves are
then dealt by aligned block of ARITY^LEVELS, so a source of any size is spread over many tasks, and a task walks its block
twice. The first walk leaves the block's root and its top subtree (at most ARITY digests). Of the roots, levels above are made
by grouping runs, a round a level, and the proofs of blocks come down the same levels by joins. In the second walk each block
starts with those: a fractal traversal, that for each level keeps the subtree that the current leaf hangs in (`existing`) and
the next one as far as it is known (`desired`); the top one is the block's own from the first walk. It gives one authentication
path after the other and holds two subtrees of ARITY^(LEVELS - 1) leaves at most, however many rows there are.

Defined cases: a null source is a source of its own, before all others; a null doc_id comes before all others of its source and
is never tampered with; rows with equal ids stand in the order of their digests; a null in any column is marked as such and is
not the empty text; repeated rows are leaves of their own with proofs of their own; texts of any length are hashed whole; a
source's only leaf is its root, as is the only source's root the dataset's, with nothing in the proof; an empty table gives no
rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Nodes of a run, and levels of a block.
ARITY, LEVELS = 16, 3

_UPPER = "array<struct<at: int, others: string>>"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256))


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, changed): changed is the leaf after its text was tampered with, null where it was not."""
    d = docs.select(*[docs[c].alias(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    # bytewise order of the names, null first
    tree = F.coalesce(F.concat(F.lit("."), F.col("source").cast("string")), F.lit(""))
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return d.select(tree.alias("tree"), "doc_id", digest(*head, F.col("text")).alias("leaf"), F.when(tampered(F.col("doc_id")), digest(*head, lowered)).alias("changed"))


def ranked(spark: SparkSession, rows: DataFrame, order: list[str]) -> tuple[DataFrame, str]:
    """rows with `rank`, their place in their tree in that order, as a staged table, and its path.

    Rows are sorted once and counted while they are written; only the first tree of a partition can have rows in earlier
    ones, so what has to be added is a number a partition, which is all that the driver sees.
    """
    # by a number of their own at last, so that rows that are equal in everything can go to different tasks
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).orderBy("tree", *order, "tie").drop("tie")
    names = placed.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, at, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            place, ahead = [], []
            for t in batch.column(0).to_pylist():
                if t != tree:
                    first, tree, at = tree is None, t, 0
                place.append(at)
                ahead.append(first)
                at += 1
            yield pa.record_batch([*batch.columns, pa.array([part] * len(place), pa.int32()), pa.array(place, pa.int64()), pa.array(ahead, pa.bool_())], names=[*names, "part", "at", "first"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    out, path = common.stage(spark, placed.mapInArrow(number, f"{kinds}, part int, at bigint, first boolean"), "leaves", free=False)
    name = F.sha2("tree", 256)
    summary = out.groupBy("part").agg(
        F.min_by(name, "tree").alias("head"), F.max_by(name, "tree").alias("tail"), F.count_if("first").alias("of_head"), F.max_by("at", F.struct("tree", "at")).alias("of_tail")).orderBy("part").collect()
    before, tree, seen = {}, None, 0  # a number a partition
    for s in summary:
        before[s.part] = seen if s.head == tree else 0
        seen = before[s.part] + s.of_head if s.head == s.tail else s.of_tail + 1
        tree = s.tail
    if not any(before.values()):
        return out.withColumn("rank", F.col("at")), path
    added = F.broadcast(spark.createDataFrame(list(before.items()), "part int, added bigint"))
    return out.join(added, "part").withColumn("rank", F.col("at") + F.when(F.col("first"), F.col("added")).otherwise(0)), path


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _raise(levels: list[list[str]], k: int, arity: int) -> None:
    """Hash the run of level k into the level above."""
    if k + 1 == len(levels):
        levels.append([])
    elif len(levels[k + 1]) == arity:
        _raise(levels, k + 1, arity)
    levels[k + 1].append(sha("".join(levels[k])))
    levels[k] = []


def top_of(digests: Iterator[str], inner: bool, arity: int = ARITY, high: int = LEVELS) -> tuple[int, list[str], str]:
    """Height, top run and root of a block, holding one run of each level. inner: the block is not its tree's first."""
    levels: list[list[str]] = [[]]
    for d in digests:
        if len(levels[0]) == arity:  # only now, as a last full run may be the top
            _raise(levels, 0, arity)
        levels[0].append(d)
    for k in range(high - 1):
        if inner or k + 1 < len(levels):
            _raise(levels, k, arity)
    top = levels[-1]
    return (0, top, top[0]) if len(levels) == 1 and len(top) == 1 and not inner else (len(levels), top, sha("".join(top)))


def block_tops(rows: DataFrame, arity: int = ARITY, high: int = LEVELS) -> DataFrame:
    """(tree, block, height, top, digest) of rows (tree, block, rank, leaf): the first walk.

    A tree's only block is as high as its leaves need; blocks of a larger tree are all `high`, the last one too.
    """
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("height", pa.int32()), ("top", pa.list_(pa.string())), ("digest", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = groupby(_rows(batches), key=lambda r: r[:2])
        yield from _batches(((*key, *top_of((r[3].hex() for r in rest), key[1] > 0, arity, high)) for key, rest in blocks), schema)

    dealt = rows.select("tree", "block", "rank", "leaf").repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
    return dealt.mapInArrow(walk, "tree string, block bigint, height int, top array<string>, digest string")


def proved(spark: SparkSession, nodes: DataFrame, made: list[str], arity: int = ARITY) -> DataFrame:
    """(tree, place, root, upper) of nodes (tree, place, digest): what leads from each node to its tree's root.

    A round a level: up by grouping runs (`arity` nodes at most), down again by joins of each run with its own node's proof.
    """
    levels, now = [], nodes
    while True:
        runs = now.groupBy("tree", F.floor(F.col("place") / arity).alias("run")).agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("nodes"))
        runs, path = common.stage(spark, runs, "level", free=False)
        made.append(path)
        levels.append(runs)
        more = runs.where((F.col("run") > 0) | (F.size("nodes") > 1))
        if more.isEmpty():
            break
        now = more.select("tree", F.col("run").alias("place"), F.sha2(F.array_join(F.col("nodes.digest"), ""), 256).alias("digest"))
    out = None
    for runs in reversed(levels):
        alone = (F.col("run") == 0) & (F.size("nodes") == 1)
        done = runs.where(alone).select("tree", F.lit(0).cast("bigint").alias("place"), F.col("nodes")[0]["digest"].alias("root"), F.array().cast(_UPPER).alias("upper"))
        if out is not None:
            above = out.withColumnRenamed("place", "run")
            every = runs.where(~alone).join(above, ["tree", "run"]).select("tree", "root", "upper", "nodes", F.posexplode("nodes").alias("at", "node"))
            others = F.array_join(F.transform(F.filter("nodes", lambda n: n["place"] != F.col("node.place")), lambda n: n["digest"]), "")
            done = done.unionByName(every.select("tree", F.col("node.place").alias("place"), "root", F.concat(F.array(F.struct("at", others.alias("others"))), "upper").alias("upper")))
        out = done
    return out


def traverse(rows: Iterator[tuple], height: int, top: list[str], arity: int = ARITY) -> Iterator[tuple[tuple, list[list[str]]]]:
    """Each row of a block, its leaf at [2], with the runs of all its levels, the lowest first: the second walk.

    existing[k][0] is the run of level k that the current leaf hangs in, and those behind it are the desired ones that are
    complete; open_[k] is the one that grows by a leaf read for a leaf given out.
    """
    below = max(0, height - 1)
    existing: list[deque[list[str]]] = [deque() for _ in range(below)]
    open_: list[list[str]] = [[] for _ in range(below)]
    ahead: deque[tuple] = deque()

    def close(k: int) -> None:
        run, open_[k] = open_[k], []
        existing[k].append(run)
        if k + 1 < below:
            open_[k + 1].append(sha("".join(run)))
            if len(open_[k + 1]) == arity:
                close(k + 1)

    def read() -> bool:
        row = next(rows, None)
        if row is None:
            for k in range(below):
                if open_[k]:
                    close(k)
            return False
        ahead.append(row)
        if below:
            open_[0].append(row[2].hex())
            if len(open_[0]) == arity:
                close(0)
        return True

    given, more = 0, True
    while True:
        while more and not (ahead and all(existing)):
            more = read()
        if not ahead:
            return
        yield ahead.popleft(), [*(runs[0] for runs in existing), *([top] if height else [])]
        given += 1
        for k in range(below):
            if given % arity ** (k + 1) == 0:
                existing[k].popleft()
        if more:
            more = read()


def steps_of(rows: Iterator[tuple], height: int, top: list[str], upper: list[tuple[str, str]], arity: int = ARITY) -> Iterator[tuple[tuple, list[tuple[str, str]], str]]:
    """Each row of a block, what stands before and after its nodes on the way to the root, and all that in one."""
    steps: list[tuple[str, str]] = []
    run = tail = ""
    for i, (row, runs) in enumerate(traverse(rows, height, top, arity)):
        if i % arity == 0:  # all levels but the lowest change with the run only
            places = [(i // arity**k) % arity for k in range(height)]
            steps = [("".join(r[:at]), "".join(r[at + 1 :])) for r, at in list(zip(runs, places))[1:]] + upper
            tail = "".join(x for step in steps for x in step)
            run = "".join(runs[0]) if runs else ""
        at = 64 * (i % arity)
        own = [(run[:at], run[at + 64 :])] if runs else []
        yield row, [*own, *steps], (run[:at] + run[at + 64 :] if runs else "") + tail


def fold(digest: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its proof lead to."""
    for before, after in steps:
        digest = sha(before + digest + after)
    return digest


def _walked(docs: DataFrame, emit: Callable[..., tuple], schema: pa.Schema, ddl: str, arity: int, high: int) -> DataFrame:
    """emit(doc_id, leaf, changed leaf or None, subroot, root, steps, proof text) of every row of docs."""
    spark, made = docs.sparkSession, []
    hashed, hashed_path = common.stage(spark, leaves(docs), "hashed", free=False)  # a sort reads its input twice
    rows, _ = ranked(spark, hashed, ["doc_id", "leaf"])
    common.drop(spark, hashed_path)
    size = arity**high
    rows = rows.select("tree", F.floor(F.col("rank") / size).alias("block"), F.pmod("rank", F.lit(size)).alias("rank"), "doc_id", "leaf", "changed")
    tops, tops_path = common.stage(spark, block_tops(rows, arity, high), "blocks", free=False)
    lower = proved(spark, tops.select("tree", F.col("block").alias("place"), "digest"), made, arity)
    lower, lower_path = common.stage(spark, lower, "proofs", free=False)
    roots = lower.where("place = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    placed, placed_path = ranked(spark, roots, ["name"])
    upper = proved(spark, placed.select("tree", F.col("rank").alias("place"), "digest"), made, arity).select("place", F.col("root").alias("whole"), F.col("upper").alias("over"))
    over = placed.select(F.col("name").alias("tree"), F.col("rank").alias("place")).join(upper, "place").drop("place")
    heads = tops.drop("digest").join(lower.withColumnRenamed("place", "block"), ["tree", "block"]).join(over, "tree").select(
        "tree", "block", F.lit(-1).cast("bigint").alias("rank"), F.struct("height", "top", "root", "whole", F.concat("upper", "over").alias("upper")).alias("head"))
    heads, _ = common.stage(spark, heads, "heads", free=False)  # results read these and the leaves
    common.drop(spark, tops_path, lower_path, placed_path, *made)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for _, rest in groupby(_rows(batches), key=lambda r: r[:2]):
                head = next(rest)[6]
                upper = [(u["others"][: 64 * u["at"]], u["others"][64 * u["at"] :]) for u in head["upper"]]
                found = ((r[3], r[2], r[4], r[5]) for r in rest)  # doc_id, rank, leaf, changed
                for (doc_id, _, leaf, changed), steps, text in steps_of(found, head["height"], head["top"], upper, arity):
                    yield emit(doc_id, leaf.hex(), changed.hex() if changed is not None else None, head["root"], head["whole"], steps, text)

        yield from _batches(out(), schema)

    dealt = rows.unionByName(heads, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
    return dealt.mapInArrow(walk, ddl)


def _kind(docs: DataFrame) -> tuple[pa.DataType, str]:
    return to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()


def proofs(docs: DataFrame, arity: int = ARITY, high: int = LEVELS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root and the proof, a list of what stands before and after on each level.

    docs: doc_id, source, lang, n_chars, text."""
    kind, ddl = _kind(docs)
    step = pa.struct([("before", pa.string()), ("after", pa.string())])
    schema = pa.schema([("doc_id", kind), *((c, pa.string()) for c in ("leaf", "subroot", "root")), ("proof", pa.list_(step))])

    def emit(doc_id, leaf, changed, subroot, root, steps, text) -> tuple:
        return doc_id, leaf, subroot, root, [{"before": b, "after": a} for b, a in steps]

    return _walked(docs, emit, schema, f"doc_id {ddl}, leaf string, subroot string, root string, proof array<struct<before: string, after: string>>", arity, high)


def audit(docs: DataFrame, arity: int = ARITY, high: int = LEVELS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, the digest of its proof, and the root that its leaf, tampered with in every fifth
    row or so (by crc32 of doc_id: A-Z of the text in lower case), and the proof lead to: verified where that is the root."""
    kind, ddl = _kind(docs)
    schema = pa.schema([("doc_id", kind), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def emit(doc_id, leaf, changed, subroot, root, steps, text) -> tuple:
        folded = fold(changed or leaf, steps)
        return doc_id, leaf, subroot, root, sha(text), folded, folded == root

    return _walked(docs, emit, schema, f"doc_id {ddl}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", arity, high)
