"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over token windows.

A text's words are its runs of digits, lower-cased letters and non-ASCII characters. Every window of `n` consecutive item
words is a test n-gram; an item with fewer words, but not none, is one window. A document word inside an occurrence of a
window is hit.

1. The benchmark's windows are written as a table of hash, words and item. Their hashes are broadcast as a set of bits, whose
   size is bounded whatever the benchmark's (MAX_BITS, 128 MB; a small benchmark's is 128 KB), so any benchmark takes one scan.
2. Each document's windows are looked up in the set where the text is read. A window that may be in it leaves the scan with its
   words, once for a document, its places merged.
3. These are verified word by word: a join on hash and words keeps what the benchmark has, and another names its items. The
   benchmark's side is there once for each of PARTS, and candidates are dealt to these by their row.

Defined cases: null and empty texts have no words and are never contaminated; texts and items of any length are scanned whole;
null items and items without words have no window; items with one id count once, a null id as the empty string; documents that
repeat, or share a doc_id, or have none, are rows of their own; an empty table gives no rows, an empty benchmark no hits; extra
columns, whatever their names, pass through `remove` untouched and are ignored by `judge`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the rule: words of a window, and the share of hit words (1/20) from which a document is contaminated.
N, SHARE = 13, 20
#: Bits of the broadcast set for each test n-gram, and in all.
BITS_A_GRAM, MAX_BITS = 64, 1 << 30
#: Parts that the candidates of each n-gram are dealt to, so that a passage of a third of all documents is no one task's.
PARTS = 16
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c if c >= 0x80 or c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_RUNS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text, lower-cased (A-Z), with a space for each byte outside words; as long as the original's."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE) if text else b""


def hashes_of(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the windows of `size` words, different for each size."""
    return common.mix64(common.window_hashes(words, size) + np.uint64(size))


def _grams(benchmark: DataFrame, n: int) -> DataFrame:
    """(h, size, gram, item) of every test n-gram; gram: its words between spaces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                hs, sizes, grams, items = [], [], [], []
                for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw = normalise(text)
                    words = raw.split()
                    size = min(n, len(words))
                    if not size:
                        continue
                    h = hashes_of(common.word_hashes(raw), size).view(np.int64)
                    _, first = np.unique(h, return_index=True)
                    hs.append(h[first])
                    grams += [b" ".join(words[i : i + size]) for i in first.tolist()]
                    sizes += [size] * len(first)
                    items += [item] * len(first)
                yield pa.record_batch([pa.array(np.concatenate(hs) if hs else [], pa.int64()), pa.array(sizes, pa.int32()), pa.array(grams, pa.binary()), pa.array(items, pa.string())], names=["h", "size", "gram", "item"])

    rows = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"), benchmark["text"].alias("text"))
    return common.bounded(rows).mapInArrow(run, "h bigint, size int, gram binary, item string")


def _scanned(texts: DataFrame, sizes: list[int], known) -> DataFrame:
    """(uid, n_words, h, gram, runs): a row without h for each document, and one for each window of it that may be in the set."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                out = []
                for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    raw = normalise(text.as_py())
                    words = common.word_hashes(raw)
                    out.append((uid, len(words), None, None, None))
                    split = None
                    for size in sizes:
                        h = hashes_of(words, size) if len(words) >= size else words[:0]
                        at = np.flatnonzero(common.may_hold(known.value, h))
                        if not len(at):
                            continue
                        split = split or raw.split()
                        at = at[np.lexsort((at, h[at]))]
                        first = np.concatenate(([True], h[at][1:] != h[at][:-1]))
                        cuts = np.flatnonzero(first | np.concatenate(([True], at[1:] > at[:-1] + size)))
                        ends = at[np.concatenate((cuts[1:] - 1, [len(at) - 1]))] + size
                        own = np.flatnonzero(first[cuts])
                        for low, high in zip(own.tolist(), [*own[1:].tolist(), len(cuts)]):
                            s = int(at[cuts[low]])
                            runs = [{"s": a, "e": b} for a, b in zip(at[cuts[low:high]].tolist(), ends[low:high].tolist())]
                            out.append((uid, None, int(h[s].view(np.int64)), b" ".join(split[s : s + size]), runs))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), _RUNS)
                columns = list(zip(*out)) or [()] * 5
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["uid", "n_words", "h", "gram", "runs"])

    return common.bounded(texts).mapInArrow(scan, "uid bigint, n_words bigint, h bigint, gram binary, runs array<struct<s:bigint,e:bigint>>")


def _judged(rows: DataFrame, benchmark: DataFrame, n: int, share: int) -> DataFrame:
    """uid, n_words, n_hit, n_items, items_sha256, contaminated, runs. rows: as of common.numbered."""
    spark = rows.sparkSession
    grams, _ = common.stage(spark, _grams(benchmark, n), "test-grams")
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # n of them at most
    known = common.key_filter(grams.select("h").distinct(), BITS_A_GRAM, MAX_BITS)
    scanned, _ = common.stage(spark, _scanned(rows.select("uid", F.col("row.text").alias("text")), sizes, known), "scanned")
    own, every = F.pmod("uid", F.lit(PARTS)).alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).alias("part")
    hits = scanned.where("h is not null").select("uid", "h", "gram", "runs", own).join(grams.select("h", "gram").distinct().select("h", "gram", every), ["h", "gram", "part"], "left_semi")
    runs = hits.groupBy("uid").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))
    items = hits.select("uid", "h", "gram", "part").join(grams.select("h", "gram", "item").distinct().select("h", "gram", "item", every), ["h", "gram", "part"]).select("uid", "item").distinct()
    items = items.groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = scanned.where("h is null").select("uid", "n_words").join(runs, "uid", "left").join(items, "uid", "left")
    out = out.withColumn("runs", _merged_runs(F.coalesce("runs", _none("struct<s:bigint,e:bigint>")))).withColumn("items", F.coalesce("items", _none("string")))
    hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r["e"] - r["s"])
    out = out.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("bigint")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).select("uid", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "runs")


def _none(kind: str):
    return F.expr(f"cast(array() as array<{kind}>)")


def judge(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = SHARE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, runs (hit word runs)."""
    rows, _ = common.numbered(docs, ["doc_id", "text"])
    judged = _judged(rows, benchmark, n, share)
    return rows.select("uid", F.col("row.doc_id").alias("doc_id")).join(judged, "uid").drop("uid")


def _merged_runs(column):
    """Sorted runs, overlapping ones trimmed so that each word counts once."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)").alias("out"))

    def step(acc, r):
        s = F.greatest(r["s"], acc["at"])
        more = F.array(F.struct(s.alias("s"), r["e"].alias("e")))
        return F.when(r["e"] > acc["at"], F.struct(r["e"].alias("at"), F.concat(acc["out"], more).alias("out"))).otherwise(acc)

    return F.aggregate(column, zero, step, lambda acc: acc["out"])


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", n: int = N, share: int = SHARE) -> DataFrame:
    """docs without contaminated documents, or (what="spans") with their hit word runs cut out of the text."""
    if what not in ("documents", "spans"):
        raise ValueError(f"what: documents or spans, not {what}")
    rows, _ = common.numbered(docs)
    with common.making() as made:
        bad = _judged(rows, benchmark, n, share).where("contaminated").select("uid", "runs")
        if what == "documents":
            return common.without(rows.select("uid", "row"), bad.select("uid"), made).select(*common.fields(F.col("row"), docs))
    found = rows.join(bad, "uid", "left").select(*common.fields(F.col("row"), docs), F.col("runs").alias(common.free_name(docs, "runs")))
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(batch.num_columns - 1)
            texts = [cut_words(t.as_py(), np.array([(x["s"], x["e"]) for x in r.as_py()], np.int64)) if r.is_valid else t.as_py() for t, r in zip(batch.column(at), runs)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string())).select(range(batch.num_columns - 1))

    return common.bounded(found).mapInArrow(cut, docs.schema)


def cut_words(text: str, runs: np.ndarray) -> str:
    """The text without the bytes from the first to the last word of each run."""
    raw, flat = text.encode("utf-8", "surrogatepass"), np.frombuffer(normalise(text), np.uint8) != 32
    edges = np.diff(np.concatenate(([0], flat.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out, at = [], 0
    for s, e in runs.tolist():
        out.append(raw[at : starts[s]])
        at = int(ends[e - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
