"""A sketch of how often tokens occur, to order them by rarity; bounded, so it can be broadcast."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Counters, at most, and how many of them travel together; the broadcast has one byte for each, and so has a task.
MAX_CELLS, CHUNK = 1 << 25, 1 << 18


def cells_for(wanted: int) -> int:
    return min(MAX_CELLS, (wanted // CHUNK + 1) * CHUNK)


class Counters:
    """Exact counts of cells in a byte each: what a byte can't hold is kept by cell, which takes 256 tokens a carry."""

    def __init__(self, cells: int):
        self.low, self.high = np.zeros(cells, np.uint8), {}

    def add(self, at: np.ndarray) -> None:
        at, n = np.unique(at, return_counts=True)
        sums = self.low[at] + n
        self.low[at] = sums & 255
        for i in np.flatnonzero(sums > 255).tolist():
            self.high[int(at[i])] = self.high.get(int(at[i]), 0) + int(sums[i] >> 8)

    def chunk(self, i: int) -> np.ndarray:
        out = self.low[i * CHUNK : (i + 1) * CHUNK].astype(np.uint64)
        for cell, n in self.high.items():
            if cell // CHUNK == i:
                out[cell % CHUNK] += np.uint64(256 * n)
        return out


def sketch(spark: SparkSession, texts: DataFrame, tokens: Callable[[str | None], np.ndarray], cells: int) -> np.ndarray:
    """log2 of the count of tokens in each cell over the mean of cells, rounded up, over all texts (one column)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(cells)
        for batch in batches:
            for text in batch.column(0):
                counters.add(_cells(tokens(text.as_py()), cells))
        yield from chunks((i, counters.chunk(i)) for i in range(-(-cells // CHUNK)))

    def chunks(parts: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for i, part in parts:
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = _unpacked(blob.as_py())
                sums[i] = part + sums[i] if i in sums else part
        yield from chunks(sorted(sums.items()))

    schema = "chunk int, counts binary"
    parts = texts.mapInArrow(count, schema)
    rows = parts.repartition("chunk").mapInArrow(add, schema).collect()  # `cells` counters in all
    out, unpacked = np.zeros(cells, np.uint8), [(r["chunk"] * CHUNK, _unpacked(bytes(r["counts"]))) for r in rows]
    mean = sum(float(counts.sum()) for _, counts in unpacked) / cells
    for at, counts in unpacked:
        out[at : at + len(counts)] = np.ceil(np.log2(np.maximum(counts - np.floor(mean), 1)))
    return out


def levels_of(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Of each token, by the cell that it falls in."""
    return levels[_cells(found, len(levels))]


def _packed(counts: np.ndarray) -> bytes:
    """Length, a bit for each counter that is not 0, and these less one, all low bytes first: most are 0 or 1."""
    some = counts > 0
    rest = np.minimum(counts[some] - 1, 2**32 - 1).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(counts).to_bytes(4, "little") + zlib.compress(np.packbits(some).tobytes() + rest.tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    size, raw = int.from_bytes(blob[:4], "little"), zlib.decompress(blob[4:])
    bits = -(-size // 8)
    out = np.zeros(size, np.uint64)
    rest = np.ascontiguousarray(np.frombuffer(raw[bits:], np.uint8).reshape(4, -1).T).view("<u4").ravel()
    out[np.unpackbits(np.frombuffer(raw[:bits], np.uint8), count=size).astype(bool)] = rest.astype(np.uint64) + np.uint64(1)
    return out


def _cells(found: np.ndarray, cells: int) -> np.ndarray:
    """Cell of each token: its upper 32 bits scaled to the number of cells."""
    return ((found >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
