"""The Merkle manifest against a plain tree, with small and with the usual runs and blocks."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    text = row[4]
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(nodes, arity):
    """Root of a list of digests, and the steps (before, after) of each."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for k, i in enumerate(at):
            run, j = runs[i // arity], i % arity
            steps[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
        at = [i // arity for i in at]
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], steps


def plain(rows, arity=16):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of every row, sorted as text."""
    by: dict = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append(climb([leaf_of(r) for r in by[s]], arity))
    if not trees:
        return []
    root, upper = climb([t[0] for t in trees], arity)
    out = []
    for s, (subroot, steps), over in zip(order, trees, upper):
        for r, own in zip(by[s], steps):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            d = leaf_of(r, hit)
            for before, after in own + over:
                d = sha(before + d + after)
            out.append((r[0], leaf_of(r), subroot, root, sha("".join(b + a for b, a in own + over)), d, d == root))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def some_rows(n, seed=1, hot=0.5):
    r = random.Random(seed)
    return [(i, "hot" if r.random() < hot else r.choice(["é", "Z", "", "a", f"s{i % 40}"]), r.choice(["en", None]), r.choice([None, i]), r.choice(["Some TEXT", "lower only", "", None, f"É {i}"])) for i in range(n)]


@pytest.mark.parametrize(("arity", "high", "n"), [(16, 3, 300), (2, 1, 37), (2, 2, 100), (3, 2, 200), (3, 3, 64)])
def test_against_a_plain_tree(spark, arity, high, n):
    """Blocks of few leaves give sources of many blocks, and levels above them."""
    rows = some_rows(n)
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert got(merkle.audit(df, arity, high)) == plain(rows, arity)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 10, 16, 17, 27, 28])
def test_heights_of_one_source(n):
    """Blocks of 2^2 leaves: first and only, full, inner and last ones."""
    for inner in (False, True):
        leaves = [sha(str(i)) for i in range(min(n, 9))]
        height, top, digest = merkle.top_of(iter(leaves), inner, 3, 2)
        want = climb(leaves, 3)[0] if not inner else None
        if inner:  # exactly two levels
            runs = [sha("".join(leaves[i : i + 3])) for i in range(0, len(leaves), 3)]
            want = sha("".join(runs))
            assert height == 2 and top == runs
        assert digest == want


def test_traversal_holds_two_subtrees_at_most():
    read = given = 0

    def rows():
        nonlocal read
        for i in range(4**4):
            read += 1
            yield (i, 0, hashlib.sha256(str(i).encode()).digest())

    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(4**4)]
    root, steps = climb(leaves, 4)
    height, top, digest = merkle.top_of(iter(leaves), False, 4, 4)
    assert (height, digest) == (4, root)
    most = 0
    for (row, own, text), want in zip(merkle.steps_of(rows(), height, top, [], 4), steps):
        most = max(most, read - given)
        given += 1
        assert own == want and merkle.fold(leaves[row[0]], own) == root and text == "".join(b + a for b, a in own)
    assert given == 4**4 and most <= 2 * 4**3


def test_cases(spark):
    """Nulls, ties, repeated rows, a single row, an empty table, very long texts and names, clashing columns, other ids."""
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, None, "en", 1, "A" * 1_000_000), (5, "s", "en", 1, "B"), (5, "s", "en", 1, "A"), (5, "s", "en", 1, "A"), (7, "", "", 0, ""), (10, "x" * 10_000, "é", -3, "ÀB")]
    df = spark.createDataFrame(rows, DOCS)
    wide = df.withColumns({c: F.lit("clash") for c in ("tree", "leaf", "rank", "block", "ROOT", "part", "at", "first", "changed", "head", "place")}).repartition(3)
    assert got(merkle.audit(wide)) == plain(rows)
    assert got(merkle.audit(wide, 2, 1)) == plain(rows, 2)
    assert got(merkle.audit(df.limit(0))) == []
    assert got(merkle.audit(df.where("doc_id = 7"))) == plain(rows[6:7])
    named = merkle.audit(df.where("doc_id is not null").withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert named.count() == 6 and named.schema["doc_id"].dataType.simpleString() == "string"


def test_many_equal_rows_spread_over_partitions(spark):
    """A third of the rows is one row: places in a source go on from one partition of the sort to the next."""
    rows = [(3, "s", "en", 1, "same")] * 400 + [(i, f"s{i % 7}", "en", 1, f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    assert got(merkle.audit(df, 4, 2)) == plain(rows, 4)


def test_proofs_lead_to_the_root(spark):
    df = spark.createDataFrame(some_rows(200), DOCS).repartition(4)
    for r in merkle.proofs(df).collect():
        assert merkle.fold(r.leaf, [tuple(s) for s in r.proof]) == r.root
        if r.proof:
            assert merkle.fold(sha("other"), [tuple(s) for s in r.proof]) != r.root
