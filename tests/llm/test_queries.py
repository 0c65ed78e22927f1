"""The registered queries: SQL where there is some, and the pipeline against a brute-force version."""

from __future__ import annotations

import hashlib
import os
import sys
from pathlib import Path

import pytest

from plumbline.llm import jaccard, quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple("NULL" if x is None or x != x else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - {"pipeline"}))
def test_query_equals_sql(spark, duck, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(duck.sql(queries.oracle_sql()[name]).df())


def test_every_operator_has_a_query():
    assert [k.split("_")[0] for k in queries.queries() if k.startswith("op")] == [f"op{i}" for i in range(1, 14)]


def test_quality_query_against_plain_version(spark, duck):
    import zlib

    from tests.llm.test_operators import plain_scores

    docs, labels = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall()), dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    got, want = queries.op5_quality(spark, SF).collect(), plain_scores(docs, labels)
    assert len(got) == len(docs) and all(abs(r.score - want[r.doc_id]) < 1e-9 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    good, bad = ([r.score for r in got if r.held_out and labels.get(r.doc_id) == q] for q in (1, 0))  # a score, few rows: by order
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_sentencepiece_query_against_the_library(spark, duck):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file())
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_sentencepiece(spark, SF).collect()}
    assert got == {i: (len(ids := sp.encode(t or "")), digest(",".join(map(str, ids))), digest(sp.decode(ids))) for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


def test_whitening_query_against_an_eigendecomposition(spark, duck):
    from tests.llm.test_whitening import check

    check(duck.sql("SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id").fetchall(), queries.op11_whitening(spark, SF).collect())


def test_toxicity_query_against_a_plain_fit(spark, duck):
    import math
    import zlib

    import numpy as np

    from plumbline.llm import toxicity
    from tests.llm.test_toxicity import plain_fit

    docs, labels = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall()), dict(duck.sql("SELECT doc_id, toxic FROM labels").fetchall())
    got = queries.op12_toxicity(spark, SF).collect()
    order = spark.createDataFrame([(i,) for i in labels], "doc_id bigint").selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").collect()
    learned = [r.doc_id for r in order if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and labels[r.doc_id] is not None and r.doc_id in docs]
    x = {i: np.unique(toxicity.features(t)).tolist() for i, t in docs.items()}
    bias, weights = plain_fit([x[i] for i in learned], [labels[i] for i in learned])
    want = {i: 1 / (1 + math.exp(-bias - sum(weights.get(f, 0) for f in x[i]))) for i in docs}
    assert len(got) == len(docs) and all(abs(r.score - want[r.doc_id]) < 1e-9 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_pipeline_against_brute_force(spark, duck):
    pipeline = pytest.importorskip("corpus_pipeline")
    import sentencepiece

    sys.path.insert(0, os.path.dirname(__file__))
    from tests.llm.test_operators import brute_components, brute_decontaminate, plain_scores

    docs = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    df = spark.read.parquet(f"{SF}/documents.parquet")
    good = {i for i, x in plain_scores(docs, dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())).items() if x >= quality.THRESHOLD}
    kept = {i: docs[i] for i in sorted(good)}
    import re

    first: dict[str, int] = {}
    for i, t in kept.items():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    kept = {i: kept[i] for i in first.values()}
    kept = {i: kept[i] for i, _, c in brute_components(list(kept.items()), jaccard.WORDS, jaccard.PERCENT) if i == c}
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    clean = [r[0] for r in brute_decontaminate(list(kept.items()), items) if not r[-1]]
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file())
    want = {i: hashlib.sha256(",".join(map(str, sp.encode(kept[i]))).encode()).hexdigest() for i in clean}
    got = {r.doc_id: r.ids_sha256 for r in pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(docs)
    for (name, stage), columns in zip(pipeline.STAGES[:-1], [df.columns] * 4):
        assert stage(spark, df, SF).columns == columns, name


def test_results_of_stages_and_runs_stay_readable(spark):
    """Results that nobody has read yet survive later stages and runs in other threads; their tables go with them."""
    pipeline = pytest.importorskip("corpus_pipeline")
    import gc
    from concurrent.futures import ThreadPoolExecutor

    from plumbline.llm import common

    df = spark.read.parquet(f"{SF}/documents.parquet")
    held = [stage(spark, df, SF).select("doc_id") for _, stage in pipeline.STAGES]  # each from the same input, none read yet
    with ThreadPoolExecutor(2) as pool:
        runs = list(pool.map(lambda _: pipeline.run(spark, SF), range(2)))
    common.sweep(spark)
    alone = [{r.doc_id for r in stage(spark, df, SF).select("doc_id").collect()} for _, stage in pipeline.STAGES]
    assert [{r.doc_id for r in d.collect()} for d in held] == alone
    first, second = ({(r.doc_id, r.ids_sha256) for r in d.collect()} for d in runs)
    assert first == second and first
    del held, runs
    gc.collect()
    common.sweep(spark)
    before = set(common.staged(spark))
    out = pipeline.run(spark, SF)
    kept = set(common.staged(spark)) - before
    n = out.count()
    del out
    common.sweep(spark)
    assert kept and n == len(first) and not kept & set(common.staged(spark))
