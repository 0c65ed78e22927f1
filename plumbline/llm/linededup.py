"""Line dedup by a segment-partition edit join.

Two lines are near-duplicates if they are equal, or both have at least MIN_CHARS characters and an edit distance of at most
EDITS. A line of length l is cut into EDITS+1 segments; a line within the distance has one of them as a substring close to
its place. Each line is entered under its own segments and under those substrings that a shorter or equally long line's
segments could be, for each such length and at the few places that matter, so near-duplicates meet in a bucket. Lines of LONG
characters and more are cut alike within a range of lengths, from both ends, and enter about four buckets in place of twelve. Pairs are
verified by an edit distance that follows diagonals; `linking` finds classes (chains of near-duplicates) without making all
pairs of a bucket. Of each class the first line stays: smallest doc_id, then first in the input, then first in the text.

Where a segment is common (the time stamp of a log, a form's heading and its end) and its lines are of many classes, all lines
of such buckets, each once, are entered again under the rarest of their grams: an edit touches at most q grams of q characters,
so of the q*EDITS+1 that are rarest, by a count over these lines, two near-duplicates share one. What common segments have in
common is not rare. Buckets of few classes, and those of grams that are common all the same, are compared in blocks behind a
filter of character counts.

Defined cases: null and empty texts have no lines to remove; lines of ASCII white space only always stay; lengths count
code points; very long lines are compared whole, in steps that double; null ids come last; doc_id may be of
any type that can be ordered; rows with one doc_id, repeated ones too, are documents of their own, in the order in which the
input is read; empty tables give no rows; extra columns, whatever their names, are ignored by `summarise`, kept by `remove`.
Equal lines are told by 128-bit names,
of which `linking` uses the first half.
"""

from __future__ import annotations

import hashlib
import struct
from collections import OrderedDict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, frequency, linking

#: Largest edit distance of near-duplicates, and the length from which lines can be near-duplicates without being equal.
EDITS, MIN_CHARS = 2, 20
_HALVES = struct.Struct("<qq")
#: Different lines that a map task remembers, so that it enters a repeated line once.
REMEMBERED = 400_000
#: Lines outside a bucket's main class from which its lines are told apart by grams.
CROWD = 64
#: Length from which lines are entered by ranges of lengths; a range is a SPREAD-th of its shortest length wide.
LONG, SPREAD = 64, 8


def line_name(line: str) -> tuple[int, int]:
    """128 bits that name a line, in two halves: its node and a second name."""
    return _HALVES.unpack(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest())


def lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def is_blank(line: str) -> bool:
    return not line.strip(" \t\n\r\x0b\x0c")


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of edits+1 segments, the longer ones last."""
    size, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        n = size + (i >= edits + 1 - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(segment, indexed length, start, size) of the substrings that a line of this length is entered under.

    A substring at the place of segment i is worth a look only if at most i edits fit before it and edits-i after it.
    """
    out = []
    for other in range(max(edits + 1, length - edits), length + 1):
        shift = length - other
        for i, (at, size) in enumerate(segments(other, edits)):
            low, high = max(at - i, at + shift - (edits - i), 0), min(at + i, at + shift + (edits - i), length - size)
            out += [(i, other, start, size) for start in range(low, high + 1)]
    return out


@cache
def ranges(edits: int) -> np.ndarray:
    """The shortest lengths of the ranges, up to more than any line has."""
    out = [LONG]
    while out[-1] < 1 << 32:
        out.append(out[-1] + max(out[-1] // SPREAD, edits + 1))
    return np.array(out, np.int64)


def range_probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(segment, range, start, size) of the substrings that a line of at least LONG characters is entered under.

    All lines of a range, and those up to `edits` longer than its longest, are cut by its shortest length, in stretches that
    don't overlap: those of the first half have their places from the start, the others from the end. Of two lines within the
    distance, the shorter has a stretch i without an edit, with i edits before it and at most edits-i after it, which the other
    has up to r = min(i, edits-i) places away. The segment leaves r characters of its stretch over and is entered at each
    of its r+1 places there, so whichever line has it further on meets the other's first place.
    """
    starts = ranges(edits)
    own = int(np.searchsorted(starts, length, "right")) - 1
    out = []
    for j in (own - 1, own):
        if j < 0 or length >= starts[j + 1] + edits:
            continue
        left = [min(i, edits - i) for i in range(edits + 1)]
        size = (int(starts[j]) - sum(left)) // (edits + 1)
        for i, r in enumerate(left):
            first = i <= edits - i
            at = sum(left[:i]) + i * size if first else length - sum(left[i:]) - (edits + 1 - i) * size + r
            out += [(i, j, at + d if first else at - d, size) for d in range(r + 1)]
    return out


def _alike(a: str, b: str, i: int, j: int) -> int:
    """How many characters a from i on and b from j on have in common, by steps that double and then halve."""
    n = min(len(a) - i, len(b) - j)
    if n <= 0 or a[i] != b[j]:
        return 0
    low, step = 1, 8
    while low < n and a[i + low : i + min(low + step, n)] == b[j + low : j + min(low + step, n)]:
        low = min(low + step, n)
        step *= 2
    high = min(low + step, n)
    while low < high:
        middle = (low + high + 1) // 2
        if a[i + low : i + middle] == b[j + low : j + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def distance_within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most `limit`: how far e edits lead on each diagonal of a band, for e up to the limit.

    A step along a diagonal takes all characters that are the same at once, so a pair takes (limit+1)^2 of them, however long.
    """
    goal = len(b) - len(a)
    if abs(goal) > limit:
        return False
    reach = {0: _alike(a, b, 0, 0)}  # diagonal (place in b less place in a) -> place in a
    for e in range(limit + 1):
        if reach.get(goal, -1) >= len(a):
            return True
        if e == limit:
            return False
        now = {}
        for d in range(-e - 1, e + 2):
            # a character replaced, left out of a, put in from b; a diagonal counts that can still lead to the ends
            i = max(reach.get(d, -2) + 1, reach.get(d + 1, -2) + 1, reach.get(d - 1, -1))
            i = min(i, len(a), len(b) - d)
            if i >= max(0, -d) and abs(goal - d) < limit - e:
                now[d] = i + _alike(a, b, i, i + d)
        reach = now
    return False


def _plans(edits: int):
    """(seed, last bits, start, size) of a length's keys, remembered."""
    plans: dict[int, list[tuple[int, int, int, int]]] = {}

    def of(length: int) -> list[tuple[int, int, int, int]]:
        if (plan := plans.get(length)) is None:
            if len(plans) > 5000:
                plans.clear()
            plan = [(other << 4 | i, other, at, size) for i, other, at, size in probes(length, edits) if other < LONG] if length < LONG + edits else []
            if length >= LONG:
                plan += [((j + 1) << 40 | i, j & 1, at, size) for i, j, at, size in range_probes(length, edits)]
            plans[length] = plan
        return plan

    return of


def _last_bits(edits: int) -> int:
    """The bits of a key that hold the last ones of the length whose segments it names: enough to tell lengths within edits apart.
    From LONG on they hold whether the range's number is odd, which tells it from the next."""
    return (1 << edits.bit_length()) - 1


def _anchored(edits: int):
    """Of sizes and keys of _keys: whether the line is entered under what its own length or range is cut into."""
    def of(size: np.ndarray, key: np.ndarray) -> np.ndarray:
        odd = (np.searchsorted(ranges(edits), size, "right") - 1) & 1
        return (np.where(size < LONG, size, odd) - key) & _last_bits(edits) == 0

    return of


class Dealer:
    """Collects (key, node, size) rows and gives them out as linking.DEALT, a key's rows of many spread over parts.

    Of a key with over 1/HOT of the rows at hand all go to parts by node, and one of them to the key's own part as well, marked
    with the key, so that this part knows that it is not the whole bucket. It takes no count over all tasks: a key that is
    common in the input is common in nearly every task, and what few rows of it others hold go to its own part.
    """

    ROWS, HOT, PARTS = 500_000, 256, 256

    def __init__(self):
        self.keys, self.nodes, self.sizes, self.counts = [], [], [], []

    def add(self, keys: list[int], node: int, size: int) -> None:
        self.keys += keys
        self.nodes.append(node)
        self.sizes.append(size)
        self.counts.append(len(keys))

    def full(self) -> bool:
        return len(self.keys) >= self.ROWS

    def deal(self) -> list[np.ndarray]:
        """part, node, size, key (0: as the part), and the place of each row among those added; marked copies last."""
        key = np.array(self.keys, np.uint64)
        key = np.where(key == 0, np.uint64(1 << 63), key)  # keeps a key's last bits
        row = np.arange(len(key))
        node, size = (np.repeat(np.array(x, t), self.counts) for x, t in ((self.nodes, np.int64), (self.sizes, np.int32)))
        for x in (self.keys, self.nodes, self.sizes, self.counts):
            x.clear()
        different, first, where, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        common_ones = n > max(len(key) // self.HOT, self.HOT)
        hot = common_ones[where]
        salt = common.mix64(node.view(np.uint64)) % np.uint64(self.PARTS)
        part = np.where(hot, common.mix64(key + common.mix64(salt + np.uint64(1))), key)
        named = np.where(hot, key, 0)
        mark = first[common_ones]
        out = [np.concatenate((x, y)) for x, y in zip((part.view(np.int64), node, size, named.view(np.int64), row), (key[mark].view(np.int64), node[mark], size[mark], key[mark].view(np.int64), mark))]
        return out


def _keys(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """linking.DEALT of every line that can have a near-duplicate, repeated ones once for each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        plan_of, digest, dealer, last = _plans(edits), xxhash.xxh3_64_intdigest, Dealer(), _last_bits(edits)
        seen: OrderedDict[int, None] = OrderedDict()

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c) for c in dealer.deal()[:4]], names=["part", "node", "size", "key"])

        for batch in batches:
            for text in batch.column(0):
                for line in lines_of(text.as_py()):
                    if len(line) < min_chars or is_blank(line):
                        continue
                    node, _ = line_name(line)
                    if node in seen:
                        continue
                    seen[node] = None
                    if len(seen) > REMEMBERED:
                        seen.popitem(last=False)
                    dealer.add([digest(line[at : at + size], seed) & ~last | bits & last for seed, bits, at, size in plan_of(len(line))], node, len(line))
                if dealer.full():
                    yield flush()
        if dealer.keys:
            yield flush()

    return docs.select("text").mapInArrow(run, linking.DEALT)


def _lines(docs: DataFrame, wanted) -> DataFrame:
    """(node, name, line), repeated lines once for each task, without most of those that are not wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, None] = OrderedDict()
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                nodes, names, lines = [], [], []
                for text in batch.column(0):
                    for line in lines_of(text.as_py()):
                        if is_blank(line):
                            continue
                        node, name = line_name(line)
                        if node in seen:
                            continue
                        seen[node] = None
                        if len(seen) > REMEMBERED:
                            seen.popitem(last=False)
                        nodes.append(node)
                        names.append(name)
                        lines.append(line)
                found = pa.record_batch([pa.array(nodes, pa.int64()), pa.array(names, pa.int64()), pa.array(lines, pa.string())], names=["node", "name", "line"])
                yield found.filter(pa.array(common.may_hold(wanted.value, np.array(nodes, np.int64))))

    return docs.select("text").mapInArrow(run, "node bigint, name bigint, line string")


def _near(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    def side(name: str) -> DataFrame:
        return lines.select(F.col("node").alias(name), F.col("line").alias(f"line_{name}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [distance_within(a.as_py(), b.as_py(), edits) for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("y"), "y").join(side("x"), "x").select("x", "y", "line_x", "line_y").mapInArrow(compare, "x bigint, y bigint")


def _counts(lines: list[str]) -> np.ndarray:
    """How often characters of each of 16 kinds occur, a row for each line. An edit changes two of them by one."""
    out = np.zeros((len(lines), 16), np.int32)
    for i, line in enumerate(lines):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i] = np.bincount(codes * np.uint32(2654435761) >> np.uint32(28), minlength=16)
    return np.minimum(out, np.iinfo(np.int16).max).astype(np.int16)


def matcher(edits: int):
    """Columns: key, block, node, size, comp, line, query."""
    def of(queries: pa.RecordBatch):
        lines, sizes, comps = queries.column(5).to_pylist(), queries.column(3).to_numpy(), queries.column(4).to_numpy()
        counts = _counts(lines)

        def match(members: pa.RecordBatch) -> np.ndarray:
            own, comp, texts = members.column(3).to_numpy(), members.column(4).to_numpy(), members.column(5).to_pylist()
            out = (np.abs(own[:, None] - sizes[None, :]) <= edits) & (comp[:, None] != comps[None, :])
            differ = np.zeros(out.shape, np.int32)
            for a, b in zip(_counts(texts).T, counts.T):
                differ += np.abs(a[:, None] - b[None, :])
            out &= differ <= 2 * edits
            for i, j in zip(*map(np.ndarray.tolist, np.nonzero(out))):
                out[i, j] = distance_within(texts[i], lines[j], edits)
            return out

        return match

    return of


def gram_length(least: int, edits: int) -> int:
    """Characters of a gram: of `least` characters' grams, edits must leave some untouched; six at most."""
    return max(q for q in range(1, 7) if q == 1 or least - q + 1 > q * edits)


def grams(line: str, q: int) -> np.ndarray:
    """Names of a line's grams; a gram that occurs again has another name, the same in every line."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = np.sort(common.window_hashes(common.mix64(codes + np.uint64(1)), q))
    first = np.concatenate(([True], found[1:] != found[:-1]))
    start = np.flatnonzero(first)
    times = np.arange(len(found)) - np.repeat(start, np.diff(np.append(start, len(found))))
    return common.mix64(found + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _gram_keys(lines: DataFrame, q: int, edits: int, levels) -> DataFrame:
    """linking.DEALT of lines (node, line) under their q*edits+1 rarest grams: lines within the distance share one of these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer()

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c) for c in dealer.deal()[:4]], names=["part", "node", "size", "key"])

        for batch in batches:
            for node, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                line = line.as_py()
                found = grams(line, q)
                size = min(len(found), q * edits + 1)
                first = found[np.argpartition(frequency.levels_of(found, levels.value).astype(np.uint64) << np.uint64(56) | found >> np.uint64(8), size - 1)[:size]]
                dealer.add(first.tolist(), node, len(line))
                if dealer.full():
                    yield flush()
        if dealer.keys:
            yield flush()

    return lines.select("node", "line").mapInArrow(run, linking.DEALT)


def near_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(node, name, comp) of lines with a near-duplicate. docs: text."""
    spark, least = common.bounded(docs).sparkSession, max(min_chars, edits + 1)

    def compatible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.abs(a - b) <= edits

    # the shorter line of a link meets the other by its own segments; longer lines that only look for such have nothing in common
    pairs, members, found_path = linking.first_round(spark, _keys(docs, edits, least), compatible, _anchored(edits))
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("node")).union(members.select("node")).distinct()
    lines, lines_path = common.stage(spark, _lines(docs, common.key_filter(nodes)).join(nodes, "node").dropDuplicates(["node"]), "line-texts")
    links, links_path = common.stage(spark, _near(pairs, lines, edits), "links")
    comps, comps_paths = linking.components_of(spark, links)
    rest, path = common.stage(spark, linking.open_members(members, comps), "open")
    paths = [found_path, lines_path, links_path, path]
    crowded = rest.groupBy("key").agg(F.count_if(F.col("comp") != F.col("main")).alias("outside")).where(F.col("outside") > CROWD).select("key")
    if not crowded.isEmpty():
        few = rest.join(crowded, "key", "left_anti")
        # each line once, however many common segments it has
        apart = rest.join(crowded, "key").select("node").distinct()
        own, own_path = common.stage(spark, lines.join(apart.hint("merge"), "node"), "crowded-lines")
        q = gram_length(least, edits)
        levels = spark.sparkContext.broadcast(frequency.sketch(spark, own.select("line"), lambda line: grams(line, q), frequency.cells_for(own.count() * 32)))
        pairs, members, found_path = linking.first_round(spark, _gram_keys(own, q, edits, levels), compatible)
        comps, comps_paths = linking.join_components(spark, comps, comps_paths, _near(pairs, own, edits))
        more, path = common.stage(spark, linking.open_members(members, comps), "open")
        paths += [own_path, found_path, path]
        rest = few.unionByName(more)
    comps, comps_paths = linking.join_components(spark, comps, comps_paths, linking.against_outsiders(rest, lines.select("node", "line"), ["node"], matcher(edits)))
    named, _ = common.stage(spark, comps.join(lines.select("node", "name"), "node").select("node", "name", "comp"), "classes")
    common.drop(spark, *paths, *comps_paths)
    return named


def _occurrences(rows: DataFrame) -> DataFrame:
    """(doc, uid, pos, node, name) of every line that is not blank. rows: doc, uid, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                docs, uids, places, nodes, names = [], [], [], [], []
                for doc, uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    for i, line in enumerate(lines_of(text.as_py())):
                        if not is_blank(line):
                            docs.append(doc)
                            uids.append(uid)
                            places.append(i)
                            node, name = line_name(line)
                            nodes.append(node)
                            names.append(name)
                columns = [pa.array(x, t) for x, t in ((docs, pa.int64()), (uids, pa.int64()), (places, pa.int32()), (nodes, pa.int64()), (names, pa.int64()))]
                yield pa.record_batch(columns, names=["doc", "uid", "pos", "node", "name"])

    return rows.mapInArrow(run, "doc bigint, uid bigint, pos int, node bigint, name bigint")


def _removed(rows: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(uid, gone): places of the lines that go, a row for each document that loses any. rows: as of common.numbered."""
    spark = rows.sparkSession
    texts = rows.select("doc", "uid", F.col("row.text").alias("text"))
    classes = near_classes(texts.select("text"), edits, min_chars)
    # what these joins add to a document or line grows with the input: one plan at every size, without broadcasts
    # lines without a near-duplicate are told apart by both halves of their names
    named = _occurrences(texts).join(classes.hint("merge"), ["node", "name"], "left").select("doc", "uid", "pos", F.coalesce("comp", "node").alias("comp"), F.when(F.col("comp").isNull(), F.col("name")).alias("alone"))
    named, named_path = common.stage(spark, named, "lines")
    place = F.struct("doc", "uid", "pos")
    first, first_path = common.stage(spark, named.groupBy("comp", "alone").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("comp", F.col("alone").alias("other"), "first"), "firsts")
    later = named.join(first.hint("merge"), "comp").where(F.col("alone").eqNullSafe(F.col("other")) & (place != F.col("first")))
    gone, _ = common.stage(spark, later.groupBy("uid").agg(F.collect_set("pos").alias("gone")), "lines-gone")
    common.drop(spark, named_path, first_path)
    return gone


def _kept(text: str | None, gone: list[int] | None) -> tuple[int, list[str]]:
    lines = lines_of(text)
    if not gone:
        return len(lines), lines
    dropped = set(gone)
    return len(lines), [x for i, x in enumerate(lines) if i not in dropped]


def summarise(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 (kept lines joined by line ends, UTF-8)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(1), batch.column(2)):
                n, kept = _kept(text.as_py(), gone.as_py())
                out.append((n, n - len(kept), hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest()))
            columns = list(zip(*out)) or [()] * 3
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])

    rows, _ = common.numbered(docs, ["doc_id", "text"])
    found = rows.join(_removed(rows, edits, min_chars).hint("merge"), "uid", "left").select(*common.fields(F.col("row"), docs, ["doc_id", "text"]), "gone")
    return found.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines bigint, n_removed bigint, kept_sha256 string")


def remove(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the text's kept lines, all other columns as they are."""
    rows, _ = common.numbered(docs)
    found = rows.join(_removed(rows, edits, min_chars).hint("merge"), "uid", "left").select(*common.fields(F.col("row"), docs), F.col("gone").alias(common.free_name(docs, "gone")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() if not g.as_py() else "\n".join(_kept(t.as_py(), g.as_py())[1]) for t, g in zip(batch.column(at), batch.column(batch.num_columns - 1))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string())).select(range(batch.num_columns - 1))

    return found.mapInArrow(run, docs.schema)
