"""Connected components of a verified similarity, from candidate buckets, without all pairs of a bucket.

Rows (key, node, size) say that a node carries a key; two nodes can only be linked if they share one. Small buckets give
all their pairs. Larger ones first give each member's neighbours in size order and one head, a number of pairs in
proportion to the bucket; pairs are verified and their components found. Only where a bucket still holds more than one
component are its members outside the main one compared, in blocks, with all members that stream past; what leaves a task
are links that join components, never pairs. Every pair that shares a key is thus either verified or already inside one
component: no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Members up to which a bucket gives all its pairs, neighbours given in larger ones, and rows of one bucket held at once.
SMALL, NEAR, BLOCK = 8, 3, 1 << 16
#: Members outside the main component that a task holds while the bucket streams past.
OUTSIDERS = 1500
#: Edges of which a task makes stars at once.
HELD = 1 << 18
Compatible = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Of sizes and keys: whether a member may be one of those that a bucket is there for. A link of two others shares another bucket.
Anchored = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Rows as they are dealt out: part, and the key that it is a part of. Key 0 stands for "as the part", and compresses; a row
#: whose key is given and equals its part says that other parts hold members of the bucket too.
DEALT = "part bigint, node bigint, size int, key bigint"


def _bucket_pairs(compatible: Compatible, anchored: Anchored | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def made(kind: int, key: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(x), kind, np.int8)), pa.array(key), pa.array(x), pa.array(y)], names=["kind", "key", "x", "y"])

    def of(part: np.ndarray, node: np.ndarray, size: np.ndarray, key: np.ndarray, open_part: int | None) -> Iterator[pa.RecordBatch]:
        """open_part: its bucket is larger than what is given here."""
        marked = part[key == part] if len(part) else part
        first = np.ones(len(part), bool)
        first[1:] = (part[1:] != part[:-1]) | (node[1:] != node[:-1])
        part, node, size, key = part[first], node[first], size[first], key[first]
        if not len(part):
            return
        key = np.where(key == 0, part, key)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        lengths = np.diff(np.concatenate((starts, [len(part)])))
        if anchored is not None:  # a bucket that is whole here and has no such member has nothing to tell
            own = anchored(size, key)
            useful = np.logical_or.reduceat(own, starts) | (part[starts] != key[starts]) | np.isin(part[starts], marked)
            if open_part is not None:
                useful |= part[starts] == open_part
            held = np.repeat(useful, lengths)
            part, node, size, key, own = part[held], node[held], size[held], key[held], own[held]
            if not len(part):
                return
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            lengths = lengths[useful]
        big = (lengths > SMALL) | (part[starts] != key[starts])  # a part of a salted bucket is never the whole of it
        if open_part is not None:
            big |= part[starts] == open_part
        if len(marked):
            big |= np.isin(part[starts], marked)
        run = np.repeat(np.arange(len(starts)), lengths)
        is_big, xs, ys = big[run], [], []
        for d in range(1, SMALL):
            if len(part) > d:
                i = np.flatnonzero((run[d:] == run[:-d]) & (~is_big[d:] | (d <= NEAR)))
                xs.append(i)
                ys.append(i + d)
        members = np.flatnonzero(is_big)
        if len(members):
            # one head for each bucket, another place in each, so that buckets of one cluster link it together; where only some
            # members are what the bucket is there for, one of these
            heads, many = np.arange(len(part)), lengths
            if anchored is not None:
                n = np.add.reduceat(own.astype(np.int64), starts)
                heads = np.lexsort((~own, run))  # of each bucket, those first, in their order
                many = np.where(n > 0, n, lengths)
            place = (common.mix64(part[starts].view(np.uint64)) % many.astype(np.uint64)).astype(np.int64)
            xs.append(members)
            ys.append(heads[starts + place][run[members]])
        x, y = np.concatenate(xs or [members]), np.concatenate(ys or [members])
        ok = (node[x] != node[y]) & compatible(size[x], size[y])
        if anchored is not None:
            ok &= own[x] | own[y]
        a, b = node[x[ok]], node[y[ok]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        if pairs.shape[1]:
            yield made(0, np.zeros(pairs.shape[1], np.int64), pairs[0], pairs[1])
        if len(members):
            yield made(1, key[members], node[members], size[members].astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)]
        open_part = None
        for batch in batches:
            now = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
            yield from of(*(c[:cut] for c in now), open_part)
            held = [c[cut:] for c in now]
            open_part = open_part if open_part == held[0][0] else None
            if len(held[0]) > BLOCK:  # a bucket too large to hold: go on from its last rows
                open_part = int(held[0][0])
                yield from of(*held, open_part)
                held = [c[-1 - NEAR :] for c in held]
        yield from of(*held, open_part)

    return run


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node, other node) for each other node of each component of these edges."""
    nodes, ends = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = np.split(ends.ravel(), 2)
    label = np.arange(len(nodes))
    while len(a):
        p, q = label[a], label[b]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(after := label[label], label):
            label = after
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (x, y) as stars around smallest nodes, HELD edges of a task at a time."""
    xs, ys, n = [], [], 0

    def out() -> pa.RecordBatch:
        x, y = _forest(np.concatenate(xs), np.concatenate(ys))
        return pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    for batch in batches:
        xs.append(batch.column(0).to_numpy(zero_copy_only=False))
        ys.append(batch.column(1).to_numpy(zero_copy_only=False))
        n += batch.num_rows
        if n >= HELD:
            yield out()
            xs, ys, n = [], [], 0
    if n:
        yield out()


def components_of(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, comp) of every node with an edge; comp is the smallest node reachable. edges: (x, y), read from a table.

    Each task makes stars of its edges. Then nodes hang themselves and their other neighbours on the smallest one seen, and what
    hangs on a node moves to what that one hangs on, until only stars are left; so the rounds grow with the logarithm of a
    component's size. As a task gives a node once for each HELD edges at most, no node has many rows where nodes are dealt.
    Every round is a table in the shared folder.
    """
    current, paths = edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y"), []
    while True:
        stars = current.mapInArrow(_forests, "x bigint, y bigint").withColumn("low", F.min("x").over(Window.partitionBy("y")))
        hung, path = common.stage(spark, stars.select(F.col("low").alias("x"), F.when(F.col("x") == F.col("low"), F.col("y")).otherwise(F.col("x")).alias("y")), "edges", free=False)
        ends = hung.select(F.col("y").alias("node"), "x", F.lit(0).alias("inner")).union(hung.select(F.col("x").alias("node"), F.lit(None).cast("bigint").alias("x"), F.lit(1).alias("inner")))
        placed, placed_path = common.stage(spark, ends.groupBy("node").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.max("inner").alias("inner")), "components", free=False)
        common.drop(spark, *paths)
        if placed.where("low <> high OR (low IS NOT NULL AND inner = 1)").isEmpty():
            common.drop(spark, path)
            return placed.select("node", F.coalesce("low", "node").alias("comp")), [placed_path]
        above = placed.where("low IS NOT NULL").select(F.col("node").alias("x"), F.col("low").alias("top"))
        moved = hung.join(above, "x", "left").select(F.coalesce("top", "x").alias("x"), "y")
        current, moved_path = common.stage(spark, moved, "edges", free=False)
        common.drop(spark, path, placed_path)
        paths = [moved_path]


def salted(rows: DataFrame) -> DataFrame:
    """DEALT of rows (key, node, size, salts): salts is the number of parts that a bucket known to be hot is dealt to.

    A salted bucket is never whole in one place: its parts have names of their own and are checked against each other later.
    """
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("key", "node"), "salts")).otherwise(F.lit(0)).cast("int").alias("salt")
    rows = rows.select("key", "node", F.col("size").cast("int").alias("size"), "salts", salt)
    part = F.when(F.col("salts") > 1, F.xxhash64("key", "salt")).otherwise(F.col("key"))
    return rows.select(part.alias("part"), "node", "size", F.when(F.col("salts") > 1, F.col("key")).otherwise(F.lit(0)).cast("bigint").alias("key"))


def first_round(spark: SparkSession, dealt: DataFrame, compatible: Compatible, anchored: Anchored | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(pairs (x, y), members (key, node, size) of large buckets, path of the table that holds both).

    dealt: DEALT, in any number of copies. compatible: whether two sizes may link, on arrays.
    anchored: what tells of members that a bucket is there for, where not all are.
    """
    buckets = dealt.repartition("part").sortWithinPartitions("part", "size", "node").mapInArrow(_bucket_pairs(compatible, anchored), "kind byte, key bigint, x bigint, y bigint")
    found, path = common.stage(spark, buckets, "buckets")
    pairs = found.where("kind = 0").select("x", "y").distinct()
    return pairs, found.where("kind = 1").select("key", F.col("x").alias("node"), F.col("y").cast("int").alias("size")), path


def open_members(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, node, size, comp, main) of buckets that hold more than one component; main is the one with most members."""
    placed = members.distinct().join(comps, "node", "left").select("key", "node", "size", F.coalesce("comp", "node").alias("comp"))
    counts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mains = counts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("key", "main")
    return placed.join(mains, "key")


def against_outsiders(rows: DataFrame, carried: DataFrame, on: list[str], matcher, what: str = "links") -> DataFrame:
    """Compares the members of open buckets; rows as of open_members, joined on `on` with what `carried` holds of them.

    Members outside a bucket's main component are a query set: in blocks of OUTSIDERS they are held by a task, and all
    members of the bucket stream past. matcher(queries) gives a function from a batch of members to a boolean matrix
    members x queries. Result, by `what`: "links" (x, y), only those that join components which the task has not joined
    yet; or "members" (key, node) with a match in another component.
    """
    outside = F.col("comp") != F.col("main")
    blocks = rows.groupBy("key").agg(F.ceil(F.count_if(outside) / OUTSIDERS).cast("int").alias("blocks"))
    wide = rows.join(blocks, "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")) == F.col("block")
    placed = wide.select("key", "block", "node", "size", "comp", "main", (outside & own).cast("int").alias("query"))
    # what is carried is the bulk: it joins when all else is known, and is dealt once
    full = placed.join(carried, on).select("key", "block", "node", "size", "comp", *[c for c in carried.columns if c not in on], "query")
    dealt = full.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("query"), "node")

    def out(a: list, b: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, queries, match, parent, nodes, comps = None, [], None, {}, None, None

        def root(c: int) -> int:
            while parent.setdefault(c, c) != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for whole in batches:
            keys = np.stack([whole.column(0).to_numpy(), whole.column(1).to_numpy().astype(np.int64)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if current != (now := tuple(keys[a].tolist())):
                    current, queries, match, parent = now, [], None, {}
                part = whole.slice(a, b - a)
                n = int(part.column(part.num_columns - 1).to_numpy().sum())  # queries come first
                if n or match is None:  # and meet those of an earlier batch as they stream past
                    queries.append(part.slice(0, n))
                    held = pa.Table.from_batches(queries).combine_chunks().to_batches()
                    held = held[0] if held else queries[0]
                    match, nodes, comps = matcher(held), held.column(2).to_numpy(), held.column(4).to_numpy()
                xs, ys = [], []
                for piece in (part.slice(i, 512) for i in range(0, part.num_rows, 512)):
                    member, comp = piece.column(2).to_numpy(), piece.column(4).to_numpy()
                    hit = match(piece) & (comp[:, None] != comps[None, :])
                    if what == "members":
                        found = np.concatenate((member[hit.any(axis=1)], nodes[hit.any(axis=0)]))
                        xs += [current[0]] * len(found)
                        ys += found.tolist()
                        continue
                    i, j = np.nonzero(hit)
                    if len(i):
                        _, first = np.unique(np.stack([comp[i], comps[j]]), axis=1, return_index=True)
                        for k in first.tolist():
                            p, q = root(int(comp[i[k]])), root(int(comps[j[k]]))
                            if p != q:
                                parent[p] = q
                                xs.append(member[i[k]])
                                ys.append(nodes[j[k]])
                if xs:
                    yield out(xs, ys)

    found = dealt.mapInArrow(run, "x bigint, y bigint")
    return found if what == "links" else found.select(F.col("x").alias("key"), F.col("y").alias("node")).distinct()


def join_components(spark: SparkSession, comps: DataFrame, paths: list[str], links: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, comp) with more links (x, y) between components, and the paths of what it reads."""
    more, path = common.stage(spark, links, "links")
    if more.isEmpty():
        common.drop(spark, path)
        return comps, paths
    out = components_of(spark, comps.where("node <> comp").select(F.col("node").alias("x"), F.col("comp").alias("y")).union(more.select("x", "y")))
    common.drop(spark, path, *paths)
    return out
