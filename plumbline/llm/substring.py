"""Substring dedup by level-wise doubling.

Windows grow from a quarter of the length over twice that to the whole length (50 words: 13, 26, 50), and at each level only
what is repeated is extended to the next.

1. Of a window of `length` words the first of its quarter windows with the smallest hash is its start: the words alone decide
   it, so equal windows have equal starts. Starts that occur in one document only end here, and all windows with them.
2. A surviving start is extended to twice its length: to the right if its window has the room, else to the left, which the
   window's words decide again. What occurs in one document only ends here.
3. Around the survivors every window of the whole length is looked up, and gets the smallest doc_id that has it; where that is
   smaller than the document's own, its words go.

There the doubling ends, though candidates survive: a longer repeat is a union of repeated windows of this length, so no
further level could remove another word.

Before anything is shuffled a task compares its own rows: what it can decide itself stays there, and each window leaves it
once a document, its places merged, so neither a passage that a third of all documents share nor a text of one repeated word
is more than a row for each task.

Defined cases: null and empty texts have no words; documents with fewer than `length` words lose nothing; texts of any length
are compared whole; documents are compared by doc_id, of any type that can be ordered, null ids count as larger than any
other and equal to each other; rows with one doc_id are one document, which never removes its own words; repeated rows each
give a row; empty tables give no rows; extra columns, whatever their names, are ignored by `repeats`, kept by `remove`. Words
are compared by hashes of 64 bits, windows by 80.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a repeated passage.
LENGTH = 50
#: Rows that a task compares at once.
ROWS = 1_500_000
_SECOND = np.uint64(0x8CB92BA72F3D8DD7)
_UPPER = np.uint64(0xFFFFFFFF00000000)


def sliding(a: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every w consecutive values."""
    n, width = len(a) - w + 1, 1
    if n <= 0:
        return a[:0]
    while 2 * width <= w:
        a = best(a[: len(a) - width], a[width:])
        width *= 2
    return best(a[:n], a[w - width : w - width + n])


def levels(length: int) -> tuple[int, int]:
    """Words of a start, and of its extension."""
    start = -(-length // 4)
    return start, min(2 * start, length)


def starts_of(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the start windows; for every window of `length` words the place of its start; and of its extension."""
    short, double = levels(length)
    first = common.window_hashes(h, short)
    place = sliding(first & _UPPER | np.arange(len(first), dtype=np.uint64), length - short + 1, np.minimum)
    place = (place & ~_UPPER).astype(np.int64)
    window = np.arange(len(place))
    return first, place, np.where(place - window + double <= length, place, place + short - double)


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal values."""
    cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return cuts, np.concatenate((cuts[1:] - 1, [len(at) - 1]))


def candidates(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's starts, each different one once: hash, and the hashes of its extensions to the right and the left (or 0)."""
    first, place, extended = starts_of(h, length)
    twice = common.window_hashes(h, levels(length)[1])
    low, high = _runs(place)  # windows with one start are neighbours
    at = place[low]
    right = np.where(extended[high] == at, twice[np.minimum(at, len(twice) - 1)], 0)
    left = np.where(extended[low] != at, twice[extended[low]], 0)
    key = first[at]
    _, one = np.unique(common.mix64(common.mix64(key) + right) + left, return_index=True)
    return key[one], right[one], left[one]


_KEYED = "kind byte, k bigint, a bigint, b bigint, doc bigint, uid bigint"


def _settle(columns: list[np.ndarray]) -> pa.RecordBatch:
    """kind 0: ask whether another document has k; 1: k occurs here, no answer wanted; 2: k is known to be repeated."""
    k, a, b, doc, uid = columns
    order = np.lexsort((doc, k))
    k, a, b, doc, uid = (c[order] for c in (k, a, b, doc, uid))
    low, high = _runs(k)
    repeated = doc[high] != doc[low]
    kind = np.repeat(np.where(repeated, 2, 0), high - low + 1).astype(np.int8)
    seen = k[low[repeated]]
    none = np.zeros(len(seen), np.int64)
    out = [np.concatenate((x, y)) for x, y in zip((kind, k, a, b, doc, uid), (np.ones(len(seen), np.int8), seen, none, none, none, none))]
    return pa.record_batch([pa.array(c) for c in out], names=["kind", "k", "a", "b", "doc", "uid"])


def _gathered(waiting: list[tuple], settle: Callable) -> Iterator[pa.RecordBatch]:
    if waiting:
        yield settle([np.concatenate(c) for c in zip(*waiting)])
        waiting.clear()


def _starts(rows: DataFrame, length: int) -> DataFrame:
    """_KEYED of every start; a and b are the extensions' hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            for doc, uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                hashes = common.word_hashes((text.as_py() or "").encode("utf-8", "surrogatepass"))
                if len(hashes) < length:
                    continue
                found = [x.view(np.int64) for x in candidates(hashes, length)]
                n = len(found[0])
                waiting.append((*found, np.full(n, doc, np.int64), np.full(n, uid, np.int64)))
                held += n
                if held > ROWS:
                    yield from _gathered(waiting, _settle)
                    held = 0
        yield from _gathered(waiting, _settle)

    return rows.mapInArrow(run, _KEYED)


def _extensions(rows: DataFrame) -> DataFrame:
    """_KEYED of the extensions of surviving starts. rows: a, b, doc, uid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            a, b, doc, uid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for k in (a, b):
                some = k != 0
                n = int(some.sum())
                if n:
                    waiting.append((k[some], np.zeros(n, np.int64), np.zeros(n, np.int64), doc[some], uid[some]))
                held += n
            if held > ROWS:
                yield from _gathered(waiting, _settle)
                held = 0
        yield from _gathered(waiting, _settle)

    return rows.mapInArrow(run, _KEYED)


def _answered(asked: DataFrame) -> DataFrame:
    """(k, a, b, doc, uid) of the asking rows whose k another row has too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if not len(now[0]):
                continue
            if held is not None:
                now = [np.concatenate((a, b)) for a, b in zip(held, now)]
            k = now[1]
            cut = int(np.searchsorted(k, k[-1], side="left"))
            if len(k) - cut > ROWS:  # many of one key: two rows of it tell that it is repeated
                yield pick(now)
                held = [c[-2:] for c in now]
                held[0] = np.ones(2, np.int8)
                continue
            yield pick([c[:cut] for c in now])
            held = [c[cut:] for c in now]
        if held is not None:
            yield pick(held)

    def pick(now: list[np.ndarray]) -> pa.RecordBatch:
        kind, k, *_ = now
        same = k[1:] == k[:-1] if len(k) else np.zeros(0, bool)
        repeated = np.zeros(len(k), bool)
        repeated[1:] |= same
        repeated[: len(same)] |= same
        ok = repeated & (kind == 0)
        return pa.record_batch([pa.array(c[ok]) for c in now[1:]], names=["k", "a", "b", "doc", "uid"])

    columns = ["kind", "k", "a", "b", "doc", "uid"]
    return asked.select(*columns).repartition("k").sortWithinPartitions("k").mapInArrow(run, "k bigint, a bigint, b bigint, doc bigint, uid bigint")


def _survivors(keyed: DataFrame, name: str, *done: str) -> tuple[DataFrame, str]:
    """(k, a, b, doc, uid) of what more than one document has, and the path of the table that it reads. done: tables that only
    keyed reads."""
    spark = keyed.sparkSession
    found, path = common.stage(spark, keyed, name)
    common.drop(spark, *done)
    return found.where("kind = 2").select("k", "a", "b", "doc", "uid").union(_answered(found.where("kind < 2"))), path


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """Words [s, |e|) of a document: e > 0: they go; e < 0: they go if a smaller document has window h. rows: doc, uid, text, ks.

    A window is named by 80 bits, h and the upper 16 of x; x holds s below them. Equal windows of a document that touch or
    overlap are one row. Few columns, as these are the operator's most rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            for doc, uid, text, ks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                hashes = common.word_hashes((text.as_py() or "").encode("utf-8", "surrogatepass"))
                _, _, extended = starts_of(hashes, length)
                twice = common.window_hashes(hashes, levels(length)[1]).view(np.int64)
                at = np.flatnonzero(np.isin(twice, ks.values.to_numpy())[extended])
                if not len(at):
                    continue
                h = common.window_hashes(hashes, length)[at].view(np.int64)
                g = (common.window_hashes(common.mix64(hashes ^ _SECOND), length)[at] >> np.uint64(48)).astype(np.int64)
                waiting.append((h, g, np.full(len(at), doc, np.int64), np.full(len(at), uid, np.int64), at))
                held += len(at)
                if held > ROWS:
                    yield from settle([np.concatenate(c) for c in zip(*waiting)])
                    waiting, held = [], 0
        if held:
            yield from settle([np.concatenate(c) for c in zip(*waiting)])

    def merged(h: np.ndarray, g: np.ndarray, doc: np.ndarray, uid: np.ndarray, at: np.ndarray, sign: int) -> pa.RecordBatch:
        """Rows in order of h, g, uid, at; those of one window and row that touch become one."""
        cuts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (uid[1:] != uid[:-1]) | (at[1:] > at[:-1] + length))))
        last = np.concatenate((cuts[1:] - 1, [len(h) - 1]))
        x = (g[cuts].astype(np.uint64) << np.uint64(48) | at[cuts].astype(np.uint64)).view(np.int64)
        return pa.record_batch([pa.array(c) for c in (h[cuts], doc[cuts], uid[cuts], x, (sign * (at[last] + length)).astype(np.int32))], names=["h", "doc", "uid", "x", "e"])

    def settle(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, g, doc, uid, at = columns
        order = np.lexsort((at, uid, doc, g, h))
        h, g, doc, uid, at = (c[order] for c in columns)
        low = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
        gone = doc > np.repeat(doc[low], np.diff(np.concatenate((low, [len(h)]))))
        ask = ~gone
        yield merged(h[ask], g[ask], doc[ask], uid[ask], at[ask], -1)
        doc, uid, at = doc[gone], uid[gone], at[gone]
        if len(doc):
            order = np.lexsort((at, uid))
            doc, uid, at = doc[order], uid[order], at[order]
            zero = np.zeros(len(doc), np.int64)
            known = merged(zero, zero, doc, uid, at, 1)
            spread = common.mix64(known.column(2).to_numpy().view(np.uint64) + known.column(3).to_numpy().view(np.uint64)).view(np.int64)
            yield known.set_column(0, "h", pa.array(spread))  # any partition will do

    return rows.mapInArrow(run, "h bigint, doc bigint, uid bigint, x bigint, e int")


def _later(windows: DataFrame) -> DataFrame:
    """(uid, s, e): runs that are known to go, and of every window that was asked for all rows but its smallest document's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # window and smallest document where the batch before ended
        for batch in batches:
            h, doc, uid, x, e = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            known, asked = e > 0, e < 0
            out = [(uid[known], x[known], e[known])]
            h, doc, uid, x, e = h[asked], doc[asked], uid[asked], x[asked], e[asked]
            if len(h):
                g = x >> 48
                low = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
                smallest = doc[low]
                if last is not None and last[:2] == (h[0], g[0]):
                    smallest = np.concatenate(([last[2]], smallest[1:]))
                ok = doc > np.repeat(smallest, np.diff(np.concatenate((low, [len(h)]))))
                last = (h[-1], g[-1], smallest[-1])
                out.append((uid[ok], x[ok], -e[ok]))
            uid, x, e = (np.concatenate(c) for c in zip(*out))
            yield pa.record_batch([pa.array(uid), pa.array((x & 0xFFFFFFFF).astype(np.int32)), pa.array(e)], names=["uid", "s", "e"])

    ordered = windows.repartition("h").sortWithinPartitions("h", F.shiftright("x", 48), "doc")
    return ordered.select("h", "doc", "uid", "x", "e").mapInArrow(run, "uid bigint, s int, e int")


def _covered(rows: DataFrame, length: int) -> DataFrame:
    """(uid, runs): word runs that go, one row for each document that loses any. rows: as of common.numbered."""
    spark = common.bounded(rows).sparkSession
    texts = rows.select("doc", "uid", F.col("row.text").alias("text"))
    starts, starts_path = _survivors(_starts(texts, length), "substring-starts")
    doubled, doubled_path = _survivors(_extensions(starts.select("a", "b", "doc", "uid")), "substring-doubled", starts_path)
    lists = doubled.groupBy("uid").agg(F.collect_set("k").alias("ks"))
    gone = _later(_windows(texts.join(lists, "uid").select("doc", "uid", "text", "ks"), length))
    covered, _ = common.stage(spark, gone.groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("runs")), "substring-runs")
    common.drop(spark, doubled_path)
    return covered


def kept_words(text: str | None, runs: list[dict] | None) -> tuple[int, list[bytes]]:
    """Number of words, and those outside the runs."""
    found = common.words_of(text)
    if not runs:
        return len(found), found
    edges = np.zeros(len(found) + 1, np.int64)
    np.add.at(edges, [r["s"] for r in runs], 1)
    np.add.at(edges, [r["e"] for r in runs], -1)
    stay = np.cumsum(edges[:-1]) == 0
    return len(found), [found[i] for i in np.flatnonzero(stay)]


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1), batch.column(2)):
                n, kept = kept_words(text.as_py(), runs.as_py())
                out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*out)) or [()] * 3
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows, _ = common.numbered(docs, ["doc_id", "text"])
    found = rows.join(_covered(rows, length), "uid", "left").select(*common.fields(F.col("row"), docs, ["doc_id", "text"]), "runs")
    return found.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs whose text is what stays, its words joined by a space where any word went; all other columns as they are."""
    rows, _ = common.numbered(docs)
    found = rows.join(_covered(rows, length), "uid", "left").select(*common.fields(F.col("row"), docs), F.col("runs").alias(common.free_name(docs, "runs")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() if not r.as_py() else b" ".join(kept_words(t.as_py(), r.as_py())[1]).decode("utf-8", "surrogatepass") for t, r in zip(batch.column(at), batch.column(batch.num_columns - 1))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string())).select(range(batch.num_columns - 1))

    return found.mapInArrow(run, docs.schema)
