"""N-gram Jaccard join with multiple global orders.

A document's set holds the hashes of its distinct k-word shingles (the whole word sequence where it has fewer words). If
two sets reach the similarity, each shares a token with the other inside its prefix, the first n - ceil(t n) + 1 tokens,
under *every* total order of tokens. Three orders are used. All put frequent tokens last, as told by a sketch of counts
over all documents, so prefixes hold rare tokens and buckets stay small; below that each order is a different hash.
Candidates share a prefix token under the first order; the second, with longer prefixes of which more must be shared, and
the third are intersected with that before the texts are read and the sets compared exactly. Members of large buckets are
compared by the first two only, as the third beside them takes more memory than an executor has to spare.

The sketch is broadcast, so its size is bounded: up to 2^31 bytes of text it has a counter for each 64 bytes, beyond that
2^25 counters. A counter's mean is taken off it, so at any size it tells by how much a token stands out of the others: those
with over 2^-25 of all occurrences, of which there can't be more than counters, come last and are dealt to parts. It orders
tokens and deals them; no result depends on it.

Documents with equal sets are one node from the start, and `linking` finds components without making all pairs of a bucket.
Of the candidates each node is first compared with one, and only what that leaves in different components with the others.

Defined cases: null and empty texts have an empty set and are linked with nothing; very long texts are compared whole;
documents with equal sets are one component; a component is named by its smallest doc_id, of any type that can be ordered; a
null doc_id never names a component that has another id; repeated rows each give a row; rows that share a doc_id, or have
none, are told apart by numbers of their own; empty tables give no rows; extra columns, whatever their names, are ignored by
`groups` and kept by `deduplicate`. Sets are compared as sets of 64-bit hashes; if
two different ones had the same 64-bit name the job would fail instead of taking them for one.
"""

from __future__ import annotations

import hashlib
import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, frequency, linking

#: Words of a shingle and the similarity in hundredths, where no contract says otherwise.
WORDS, PERCENT = 5, 80
#: Bytes of text for each counter of the frequency sketch.
BYTES_A_CELL = 64
#: A token counted over 2^HOT_LEVEL times more than the mean is dealt to parts of about that size.
HOT_LEVEL = 14
#: Different sets that a map task remembers, so that it gives out a repeated set's tokens once.
REMEMBERED = 500_000
#: Shared values of two batches that are counted in one step.
HITS = 1 << 20
_HALVES = struct.Struct("<qq")
_ORDERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A5A5A55A5A5A5B))


def tokens(text: str | None, k: int) -> np.ndarray:
    """Ascending distinct 64-bit shingle hashes of a text; words are lower-cased (A-Z)."""
    words = common.word_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else ()
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(common.window_hashes(words, min(k, len(words))))


def names_of(tokens: np.ndarray) -> tuple[int, int]:
    """A set's 64-bit name, and another that tells whether two sets share the first."""
    return _HALVES.unpack(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(found: np.ndarray, levels: np.ndarray, size: int, order: int) -> np.ndarray:
    """Places of a set's first tokens under one of the three orders: rare tokens first, then by the order's own hash."""
    own = found if order == 0 else common.mix64(found ^ _ORDERS[order - 1])
    return np.argpartition(levels.astype(np.uint64) << np.uint64(56) | own >> np.uint64(8), size - 1)[:size]


def _signatures(docs: DataFrame, k: int, percent: int, levels) -> DataFrame:
    """Per row (uid, text): uid, node, name, n, and where the task meets the set first its prefix under the first order with its
    tokens' levels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = OrderedDict()
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                nodes, names, sizes, a, hot = [], [], [], [], []
                for text in batch.column(1):
                    found = tokens(text.as_py(), k)
                    n = len(found)
                    sizes.append(n)
                    node, name = names_of(found) if n else (None, None)
                    nodes.append(node)
                    names.append(name)
                    if not n or node in seen:
                        a.append(None)
                        hot.append(None)
                        continue
                    seen[node] = None
                    if len(seen) > REMEMBERED:
                        seen.popitem(last=False)
                    level = frequency.levels_of(found, levels.value)
                    first = prefix(found, level, prefix_size(n, percent), 0)
                    a.append(found[first].view(np.int64))
                    hot.append(level[first].view(np.int8))
                yield pa.record_batch([batch.column(0), pa.array(nodes, pa.int64()), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(a, pa.list_(pa.int64())), pa.array(hot, pa.list_(pa.int8()))], names=["uid", "node", "name", "n", "a", "hot"])

    return docs.select("uid", "text").mapInArrow(run, "uid bigint, node bigint, name bigint, n int, a array<bigint>, hot array<tinyint>")


def _texts(docs: DataFrame, wanted: DataFrame, k: int, percent: int, levels) -> DataFrame:
    """(node, text, b, lb, c, lc) of the wanted (node, rep): what the second and third order need.

    If sets reach the similarity, their first n - ceil(t n) + l tokens share l or more, whatever the order. With l the size of
    a plain prefix that is about half of them, a far stronger condition than one shared token. b is such a longer prefix, c a
    plain one, 32 bits a token; lb and lc are the numbers that must be shared (less what 32 bits make equal).
    """
    # as many as there are sets with candidates, which grow with the input: one plan at every size, without a broadcast
    rows = docs.select("uid", "text").join(wanted.withColumnRenamed("rep", "uid").hint("merge"), "uid").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                nodes, texts, others, least = [], [], ([], []), ([], [])
                for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = tokens(text, k)
                    nodes.append(node)
                    texts.append(text)
                    level, p = frequency.levels_of(found, levels.value), prefix_size(len(found), percent)
                    for i in (0, 1):
                        size = p if i else min(len(found), 2 * p - 1)
                        own = common.mix64(found ^ _ORDERS[i])[prefix(found, level, size, i + 1)]
                        own = np.unique((own & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
                        others[i].append(own)
                        least[i].append(size - p + 1 - (size - len(own)))
                columns = [pa.array(x, pa.list_(pa.int32())) for x in others], [pa.array(x, pa.int32()) for x in least]
                yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(texts, pa.string()), columns[0][0], columns[1][0], columns[0][1], columns[1][1]], names=["node", "text", "b", "lb", "c", "lc"])

    return rows.mapInArrow(run, "node bigint, text string, b array<int>, lb int, c array<int>, lc int")


def _admissible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs that share enough prefix tokens under the second and under the third order too."""
    def side(name: str) -> DataFrame:
        return texts.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("b", "lb", "c", "lc")])

    def enough(c: str) -> F.Column:
        return F.size(F.array_intersect(f"{c}_x", f"{c}_y")) >= F.least(f"l{c}_x", f"l{c}_y")

    return pairs.join(side("y"), "y").join(side("x"), "x").where(enough("b") & enough("c")).select("x", "y")


def prefix_matcher(queries: pa.RecordBatch):
    """The second order's condition between members of a bucket. Columns: key, block, node, size, comp, b, lb, query."""
    count, need = _shared_with(queries.column(5)), queries.column(6).to_numpy()
    return lambda members: count(members.column(5)) >= np.minimum(members.column(6).to_numpy()[:, None], need[None, :])


def _shared_with(column: pa.Array):
    """Function from a column of arrays to the matrix of numbers of values that each shares with each of this column's."""
    token, place, _ = _flat(column)
    order = np.argsort(token, kind="stable")
    token, place, n = token[order], place[order], len(column)

    def count(other: pa.Array) -> np.ndarray:
        t, at, _ = _flat(other)
        low = np.searchsorted(token, t, "left")
        hits = np.searchsorted(token, t, "right") - low
        upto, out, a = np.cumsum(hits), np.zeros(len(other) * n, np.int64), 0
        while a < len(t):  # near copies share nearly all: their hits are the product of both sides and are not held at once
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right")))
            some = hits[a:b]
            offsets = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
            out += np.bincount(np.repeat(at[a:b] * n, some) + place[np.repeat(low[a:b], some) + offsets], minlength=len(out))
            a = b
        return out.reshape(len(other), n)

    return count


def _similar(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets reach the similarity."""
    def side(name: str) -> DataFrame:
        return texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))

    rows = pairs.join(side("y"), "y").join(side("x"), "x").select("x", "y", "text_x", "text_y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = OrderedDict(), 0
        for batch in batches:
            keep, xs, ys = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (x, y) in enumerate(zip(xs, ys)):
                sets = []
                for node, column in ((x, 2), (y, 3)):
                    if node not in known:
                        known[node] = tokens(batch.column(column)[i].as_py(), k)
                        held += len(known[node])
                        while held > 2_000_000 and len(known) > 2:
                            held -= len(known.popitem(last=False)[1])
                    known.move_to_end(node)
                    sets.append(known[node])
                both = len(np.intersect1d(*sets, assume_unique=True))
                keep.append(100 * both >= percent * (len(sets[0]) + len(sets[1]) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(compare, "x bigint, y bigint")


def _differences(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(node, main, delta): tokens in just one of the two sets, of pairs (node, main)."""
    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    rows = pairs.join(side("main"), "main").join(side("node"), "node").select("node", "main", "text_node", "text_main")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        main, base = None, np.empty(0, np.uint64)
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                out = []
                for i, m in enumerate(batch.column(1).to_pylist()):
                    if m != main:
                        main, base = m, tokens(batch.column(3)[i].as_py(), k)
                    out.append(np.setxor1d(tokens(batch.column(2)[i].as_py(), k), base, assume_unique=True).view(np.int64))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["node", "main", "delta"])

    return rows.mapInArrow(run, "node bigint, main bigint, delta array<bigint>")


def matcher(percent: int):
    """Compares sets by their differences from one and the same set: what two sets differ in is the difference of those.

    Differences of near copies are short, so an index of the queries' tokens and counts of what members share with them
    give every intersection exactly. Columns: key, block, node, size, comp, delta, query.
    """
    def of(queries: pa.RecordBatch):
        count, size = _shared_with(queries.column(5)), queries.column(3).to_numpy().astype(np.int64)
        length = np.asarray(pa.compute.list_value_length(queries.column(5))).astype(np.int64)

        def match(members: pa.RecordBatch) -> np.ndarray:
            own = np.asarray(pa.compute.list_value_length(members.column(5))).astype(np.int64)
            differ = own[:, None] + length[None, :] - 2 * count(members.column(5))
            total = members.column(3).to_numpy().astype(np.int64)[:, None] + size[None, :]
            both = (total - differ) // 2
            return 100 * both >= percent * (total - both)

        return match

    return of


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, the row of each, and the number in each row."""
    length = np.asarray(pa.compute.list_value_length(column)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(length)), length), length


def groups(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, cells: int | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id. cells: counters of the sketch, else as the size of the texts asks."""
    rows, _ = common.numbered(docs, ["doc_id", "text"])
    return _placed(rows, k, percent, cells).select("doc_id", "n_shingles", "component_id")


def _placed(rows: DataFrame, k: int, percent: int, cells: int | None = None) -> DataFrame:
    """uid, doc_id, n_shingles, component_id, kept (the first row of its component). rows: as of common.numbered."""
    spark = common.bounded(rows).sparkSession
    docs = rows.select("uid", F.col("row.text").alias("text"))
    if cells is None:
        cells = frequency.cells_for(int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_A_CELL)
    levels = spark.sparkContext.broadcast(frequency.sketch(spark, docs.select("text"), lambda text: tokens(text, k), cells))
    signatures, _ = common.stage(spark, _signatures(docs, k, percent, levels), "jaccard-signatures")
    tagged = signatures.where("a is not null").select("node", "n", F.explode(F.arrays_zip("a", "hot")).alias("t"))
    salts = F.when(F.col("t.hot") > HOT_LEVEL, F.expr(f"shiftleft(1, cast(t.hot AS int) - {HOT_LEVEL})")).otherwise(1)
    keyed = tagged.select(F.col("t.a").alias("key"), "node", F.col("n").alias("size"), salts.alias("salts"))

    def compatible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(a, b).astype(np.int64) >= percent * np.maximum(a, b).astype(np.int64)

    pairs, members, found_path = linking.first_round(spark, linking.salted(keyed), compatible)
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("node")).union(members.select("node")).distinct()
    reps = signatures.where("node is not null").groupBy("node").agg(F.min("uid").alias("rep"), (F.min("name") != F.max("name")).alias("shared"))
    reps = reps.where(F.when(F.col("shared"), F.raise_error(F.lit("two different sets share a 64-bit name"))).otherwise(F.lit(True))).drop("shared")
    texts, texts_path = common.stage(spark, _texts(docs, reps.join(nodes, "node"), k, percent, levels), "jaccard-texts")
    pairs, pairs_path = common.stage(spark, _admissible(pairs, texts), "pairs")
    links, links_path = common.stage(spark, _similar(pairs.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), texts, k, percent), "links")
    comps, comps_paths = linking.components_of(spark, links)
    comps, comps_paths = linking.join_components(spark, comps, comps_paths, _similar(_apart(pairs, comps), texts, k, percent))
    # members of open buckets that pass the second order's condition with some member of another component
    every, every_path = common.stage(spark, linking.open_members(members, comps), "open")
    carried = common.likely(texts.select("node", "b", "lb"), "node", common.key_filter(every.select("node").distinct()))
    near = linking.against_outsiders(every, carried, ["node"], prefix_matcher, "members")
    rest, rest_path = common.stage(spark, every.join(near, ["key", "node"]), "near")
    ends = rest.select("node", "main").distinct()
    compared = common.likely(texts.select("node", "text"), "node", common.key_filter(ends.select("node").union(ends.select("main")).distinct()))
    differences, differences_path = common.stage(spark, _differences(ends, compared, k), "differences")
    across = linking.against_outsiders(rest, differences, ["node", "main"], matcher(percent))
    comps, _ = linking.join_components(spark, comps, comps_paths, across)
    common.drop(spark, found_path, texts_path, pairs_path, links_path, every_path, rest_path, differences_path)
    named = signatures.select("uid", "node", F.col("n").cast("bigint").alias("n_shingles")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = named.join(rows.select("uid", "doc", F.col("row.doc_id").alias("doc_id")), "uid")
    first, _ = common.stage(spark, named.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc", "uid", "doc_id")).alias("first")), "firsts")
    placed = named.join(first, "comp", "left")
    own = F.col("first").isNull()
    return placed.select("uid", "doc_id", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), (own | (F.col("uid") == F.col("first.uid"))).alias("kept"))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs of nodes that are not in one component."""
    def of(name: str) -> DataFrame:
        return comps.select(F.col("node").alias(name), F.col("comp").alias(f"comp_{name}"))

    placed = pairs.join(of("x"), "x", "left").join(of("y"), "y", "left")
    return placed.where(F.coalesce("comp_x", "x") != F.coalesce("comp_y", "y")).select("x", "y")


def deduplicate(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id, of several the first in the input; documents without
    words all stay. Each row is judged by itself, whatever happens to others with its doc_id or without one."""
    rows, _ = common.numbered(docs)
    with common.making() as made:
        gone = _placed(rows, k, percent).where("not kept").select("uid")
        return common.without(rows.select("uid", "row"), gone, made).select(*common.fields(F.col("row"), docs))
