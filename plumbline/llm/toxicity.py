"""Toxicity: logistic regression, learned by FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are 32-bit hashes of its words, of neighbouring pairs and of pairs with one or two words between, each
counted once however often it occurs, so a word weighs the same in a short and in a long text. Words are runs of letters and
digits, A-Z in lower case; marks between them don't matter. Every coordinate has a learning rate of its own, and the L1 term
keeps nearly all weights at exactly 0: what is broadcast are the few others, as two sorted arrays.

The model is fitted on the driver, in EPOCHS rounds in the order of a hash of doc_id, on at most SAMPLE labelled rows among
those whose crc32(doc_id) mod 4 is not 2, chosen by that hash. Their features are made where the texts are read, at most
FEATURES for a row, those with the smallest hashes, so SAMPLE * FEATURES * 4 bytes bound what the driver gets. Features of
fewer than LEAST sampled rows are not learned. Scoring has no such bounds: it reads all words of every text. Labels, lang,
source and doc_id are never inputs of a score.

Defined cases: null counts as the empty text, which has no features and gets the score of the intercept alone; null labels are
not learned from, repeated labels each count; a label whose doc_id has several texts is learned with the one of the smallest
hash; without labels every score is 0.5, with labels of one kind it is their smoothed share; a null doc_id counts as not held
out; repeated rows and equal texts get equal scores, texts of any length are read whole; empty tables give no rows; extra
columns, whatever their names, are ignored or, by `keep`, passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the model is fitted on, and features of each of them, at most.
SAMPLE, FEATURES = 16_000, 1 << 15
#: The learner: rate, its smoothing, L1 and L2 strength, rounds, and sampled rows that a feature must have.
ALPHA, BETA, L1, L2, EPOCHS, LEAST = 0.5, 1.0, 5.0, 0.1, 6, 3
THRESHOLD = 0.3

#: ASCII letters in lower case, digits as they are, all other ASCII characters as spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_KINDS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA5A3564E27F8865D, 0xCFD1A2B86E9FB0C1)]


def features(text: str | None) -> np.ndarray:
    """Hashes of the words, neighbouring pairs and skip-grams of a text, repeated ones repeated."""
    h = common.word_hashes(text.encode("utf-8", "surrogatepass").translate(_PLAIN)) if text else np.empty(0, np.uint64)
    pairs = [common.mix64(h[: len(h) - gap] * kind + h[gap:]) for gap, kind in enumerate(_KINDS, 1) if len(h) > gap]
    return (np.concatenate([h, *pairs]) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Model:
    """Features with a weight other than 0, ascending, their weights, and the intercept."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 16, bool)  # by their lower bits: most features of a text end here
        self.seen[self.feature & 0xFFFF] = True

    def margin(self, text: str | None) -> float:
        x = features(text)
        x = np.unique(x[self.seen[x & 0xFFFF]])
        if not len(x) or not len(self.feature):
            return self.bias
        at = np.minimum(np.searchsorted(self.feature, x), len(self.feature) - 1)
        return self.bias + float(self.weight[at[self.feature[at] == x]].sum())

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.array([self.margin(t) for t in texts], np.float64).clip(-700, 700)))


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal's closed form: 0 while |z| stays below L1, else shrunk by the coordinate's own rate."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _frequent(rows: list[np.ndarray]) -> np.ndarray:
    """Features of LEAST rows or more, ascending; a sixteenth of them is counted at once, which bounds memory."""
    edges, out = np.arange(17, dtype=np.int64) << 28, []
    cuts = [np.searchsorted(x, edges) for x in rows]
    for i in range(16):
        found, count = np.unique(np.concatenate([x[c[i] : c[i + 1]] for x, c in zip(rows, cuts)]), return_counts=True)
        out.append(found[count >= LEAST])
    return np.concatenate(out)


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """rows: different features of each row, ascending."""
    share = (y.sum() + 1) / (len(y) + 2)
    nothing = Model(np.empty(0, np.uint32), np.empty(0), float(np.log(share / (1 - share))))
    if not len(rows) or y.min() == y.max():
        return nothing
    known = _frequent(rows)
    if not len(known):
        return nothing
    at = []
    for i, x in enumerate(rows):
        place = np.minimum(np.searchsorted(known, x), len(known) - 1).astype(np.int32)
        at.append(place[known[place] == x])
    z, n = np.zeros(len(known)), np.zeros(len(known))
    bias, bias_n = nothing.bias, 0.0  # the intercept is neither shrunk nor cut
    for _ in range(EPOCHS):
        for a, label in zip(at, y):
            w = weights(z[a], n[a])
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -700, 700))) - label
            grown = n[a] + g * g
            z[a] += g - (np.sqrt(grown) - np.sqrt(n[a])) / ALPHA * w
            n[a] = grown
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    w = weights(z, n)
    return Model(known[w != 0], w[w != 0], float(bias))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: (doc_id, toxic 0/1). Features of the sampled rows are made where their texts are read."""
    usable = labels.where((fold(F.col("doc_id")) != 2) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample).withColumn("row", F.monotonically_increasing_id())
    # at most `sample` rows of three numbers: the broadcast is bounded
    rows = common.bounded(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("row", "toxic", F.xxhash64("text").alias("fp"), "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                x = [np.unique(features(t))[:FEATURES].tobytes() for t in part.column(3).to_pylist()]
                yield pa.record_batch([*part.columns[:3], pa.array(x, pa.binary())], names=["row", "toxic", "fp", "x"])

    measured = rows.mapInArrow(measure, "row bigint, toxic int, fp bigint, x binary")
    # a row for each label, however many rows have its doc_id
    got = measured.groupBy("row").agg(F.min_by(F.struct("toxic", "x"), "fp").alias("m")).select("row", "m.toxic", "m.x").toArrow()
    order = np.argsort(got.column("row").to_numpy(), kind="stable")
    x = [v for chunk in got.column("x").chunks for v in _views(chunk)]
    return fit([x[i] for i in order], got.column("toxic").to_numpy().astype(np.float64)[order])


def _views(column: pa.Array) -> Iterator[np.ndarray]:
    """The numbers of each row of a binary column, without a copy."""
    _, places, data = column.buffers()
    ends = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield np.frombuffer(data, np.uint8)[a:b].view(np.uint32) if b > a else np.empty(0, np.uint32)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(model.value.score(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs whose score is below the threshold, all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.score(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
