"""Whitening against a plain eigendecomposition of the exact covariance."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import whitening

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain(rows):
    """x as whole numbers, their means, deviations, eigenvalues and components of rows (id, vector)."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, total = len(x), x.sum(0)
    off = n * x - total
    centred = (off / n).astype(np.float64)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return off, centred, e[::-1], u[:, ::-1]


def check(rows, out, components=32):
    off, centred, e, u = plain(rows)
    k = min(components, int((e > e[0] * 1e-12).sum()))
    assert len(out) == len(rows) * k and {r.n for r in out} == {len(rows)}
    got: dict = {}
    for r in out:
        got.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(got) == list(range(1, k + 1))
    for c, by in got.items():
        want = centred @ u[:, c - 1] / math.sqrt(e[c - 1])
        have = np.array([by[i][0].whitened for i, _ in rows])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        assert all(by[i][0].deviation == sum(v * v for v in off[j]) for j, (i, _) in enumerate(rows))
        assert abs(by[rows[0][0]][0].explained - e[c - 1] / e.sum()) < 1e-12
    assert len({r.identity_error for r in out}) == 1 and 0 <= out[0].identity_error < 1e-9


def some_vectors(n, d, seed=1):
    r = np.random.default_rng(seed)
    scale = np.linspace(3, 0.5, d)
    return [(i, [float(np.float32(c)) for c in r.normal(size=d) * scale + 5]) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "parts"), [(200, 5, 7), (300, 40, 3), (90, 40, 40), (12, 20, 5)])
def test_against_an_eigendecomposition(spark, n, d, parts):
    """More and fewer dimensions than components, partitions with fewer rows than dimensions, fewer rows than dimensions."""
    rows = some_vectors(n, d)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(parts)
    check(rows, whitening.whiten(df).collect())


def test_cases(spark):
    good = some_vectors(50, 4, 2)
    bad = [(100, None, 0), (101, [], 0), (102, [1.0, None, 2.0, 3.0], 0), (103, [1.0, float("nan"), 2.0, 3.0], 0), (104, [1.0, float("inf"), 2.0, 3.0], 0), (105, [1.0, 2.0], 0), (106, [1e30, 0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame([(i, v, 0) for i, v in good] + bad, VECTORS)
    wide = df.withColumns({c: F.lit("clash") for c in ("vector", "n", "component", "place", "m", "WHITENED")}).repartition(6)
    check(good, whitening.whiten(wide).collect())
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id > 99 and vec_id < 105")).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(9)], VECTORS)
    assert whitening.whiten(same).collect() == [] and whitening.whiten(same.limit(1)).collect() == []
    two = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (1, [3.0, 2.0], 0)], VECTORS)).collect()
    assert len(two) == 3 and {r.component for r in two} == {1} and [r.vec_id for r in two].count(None) == 2


def test_lengths_of_most_rows(spark):
    rows = [(i, v) for i, v in some_vectors(30, 3)]
    other = [(100 + i, v) for i, v in some_vectors(10, 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + other], VECTORS).repartition(3)
    check(rows, whitening.whiten(df).collect())


def test_a_common_vector_and_large_offsets(spark):
    """A third of the rows is one vector; entries far from 0 lose nothing, as centring is exact."""
    r = random.Random(3)
    rows = [(i, [float(np.float32(2e5 + (0 if i % 3 == 0 else r.random() * (j + 1)))) for j in range(6)]) for i in range(300)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(9)
    check(rows, whitening.whiten(df).collect())


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0], 0), (2, [-1e9, 1.0], 0), (3, [0.0, 2.0], 0)], VECTORS)
    by = {r.vec_id: r.deviation for r in whitening.whiten(df).collect()}
    assert by[1] is None and by[2] is None and by[3] is not None


def test_factors_merge_in_any_number_of_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGE", 2)
    rows = some_vectors(120, 7, 5)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(11)
    check(rows, whitening.whiten(df).collect())
