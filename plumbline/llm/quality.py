"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (shares of character classes, word and line statistics) are binned by quantiles; trees of fixed
depth are grown on histograms of gradients and kept as flat arrays, so scoring is a few vectorised numpy steps a level.

The model is fitted on the driver, on at most SAMPLE labelled rows chosen by a hash of doc_id among those whose
crc32(doc_id) mod 5 is not 0; only their statistics are collected (about 30 numbers a row). Labels, lang, source and doc_id
are never inputs of a score.

Defined cases: null counts as the empty text, which has all statistics 0 and a score like any other; null labels are not
learned from, repeated labels each count; a label whose doc_id has several texts is learned with the one of the smallest
hash; without labels every score is 0.5, with labels of one kind it is their smoothed
share; a null doc_id counts as held out; texts of any length are measured whole, and repeated rows and equal texts get equal
scores; of splits with equal gains the first statistic and border is taken; empty tables give no rows; extra columns, whatever
their names, are ignored or, by `keep`, passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
#: Shape of the model.
TREES, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 64, 0.15, 1.0, 10.0
THRESHOLD = 0.3
#: Characters whose shares are statistics of their own.
MARKS = "!?.,;:#$%&*|<>{}[]()=+-_/\\@\"'"


def _classes() -> np.ndarray:
    """byte -> class counts: upper, lower, digit, space, line end, other ASCII, non-ASCII, then each of MARKS."""
    out = np.zeros((256, 7 + len(MARKS)), np.float64)
    for b in range(256):
        c = chr(b)
        kind = 6 if b >= 128 else 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace() else 5
        out[b, kind] = 1
        if c in MARKS:
            out[b, 7 + MARKS.index(c)] = 1
    return out


_CLASSES = _classes()
N_STATISTICS = _CLASSES.shape[1] + 9


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of N_STATISTICS numbers for each text."""
    histograms, rest = np.zeros((len(texts), 256)), np.zeros((len(texts), 9))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        histograms[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, lines = raw.split(), raw.split(b"\n")
        n = len(words) or 1
        different = set(words)
        # words that end in a mark, and words without a lower-case letter, show decoration and shouting
        rest[i] = (
            np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n, max(map(len, words), default=0), len(different) / n,
            len(lines) / n, len(set(lines)) / len(lines), sum(map(len, different)) / max(1, len(different)), sum(1 for w in lines if w.endswith(b".")) / len(lines))
    sizes = np.maximum(histograms.sum(1, keepdims=True), 1)
    return np.hstack([histograms @ _CLASSES / sizes, rest])


@dataclass
class Model:
    """Flat complete trees: inner node i has children 2i+1 and 2i+2; row goes right where its bin is over `split`."""

    edges: list[np.ndarray]  # ascending bin borders of each statistic
    feature: np.ndarray  # trees x inner nodes
    split: np.ndarray
    leaf: np.ndarray  # trees x 2^DEPTH
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int16) if len(x) else np.zeros((0, len(self.edges)), np.int16)

    def margin(self, binned: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(binned), self.base), np.arange(len(binned))
        inner = self.feature.shape[1]
        for feature, split, leaf in zip(self.feature, self.split, self.leaf):
            node = np.zeros(len(binned), np.int64)
            while_inner = inner
            while while_inner:
                node = 2 * node + 1 + (binned[rows, feature[node]] > split[node])
                while_inner >>= 1
            out += leaf[node - inner]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.bins(statistics(texts)))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Model:
    inner = 2**depth - 1
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(N_STATISTICS)]
    if len(x) == 0 or y.min() == y.max():
        return Model(edges, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, inner + 1)), base)
    empty = Model(edges, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, inner + 1)), base)
    binned = empty.bins(x).astype(np.int64)
    n, width = len(x), N_STATISTICS * BINS
    cell = binned + np.arange(N_STATISTICS) * BINS
    margin, features, splits, leaves = np.full(n, base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node, feature, split = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * width + cell).ravel()
            shape = (count, N_STATISTICS, BINS)
            gs = np.bincount(at, np.repeat(g, N_STATISTICS), count * width).reshape(shape).cumsum(2)
            hs = np.bincount(at, np.repeat(h, N_STATISTICS), count * width).reshape(shape).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
            gain[(hs < LEAST / 4) | (ht - hs < LEAST / 4)] = 0
            best = gain.reshape(count, -1).argmax(1)
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            feature[first : first + count] = np.where(good, best // BINS, 0)
            split[first : first + count] = np.where(good, best % BINS, BINS)  # BINS: all rows go left
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > split[node])
        leaf_of = node - inner
        leaf = RATE * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + L2)
        margin += leaf[leaf_of]
        features.append(feature)
        splits.append(split)
        leaves.append(leaf)
    return Model(edges, np.array(features), np.array(splits), np.array(leaves), base)


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: (doc_id, quality 0/1). Statistics of the sampled rows are made where their texts are read."""
    usable = labels.where((fold(F.col("doc_id")) != 0) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    chosen = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).withColumn("row", F.monotonically_increasing_id())
    # at most `sample` rows of two numbers: the broadcast is bounded
    rows = common.bounded(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", "row", F.xxhash64("text").alias("fp"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                x = statistics(part.column(2).to_pylist())
                yield pa.record_batch([part.column(0).cast(pa.string()), part.column(1), pa.array(list(x), pa.list_(pa.float64())), part.column(3), part.column(4)], names=["id", "quality", "x", "row", "fp"])

    measured = rows.mapInArrow(measure, "id string, quality int, x array<double>, row bigint, fp bigint")
    # a row for each label, however many rows have its doc_id
    one = measured.groupBy("row").agg(F.min_by(F.struct("id", "quality", "x"), "fp").alias("m")).select("m.*")
    got = one.toPandas().sort_values(["id", "quality"])
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, N_STATISTICS))
    return fit(x, got["quality"].to_numpy(np.float64))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                yield pa.record_batch([part.column(0), pa.array(model.value.score(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs whose score reaches the threshold, all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                yield part.filter(pa.array(model.value.score(part.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
