"""The toxicity learner against a plain one, on held-out rows, and in its defined cases."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import common, toxicity


def plain_features(text):
    """Names of the words, pairs and skip-grams of a text."""
    import re

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
    return w, {(0, a) for a in w} | {(gap, w[i], w[i + gap]) for gap in (1, 2, 3) for i in range(len(w) - gap)}


def test_features_are_words_pairs_and_skip_grams():
    for text in ("You ARE, a moron!!", "a", "", None, "é É x1-y2 \x00 z", "w " * 50, "a b c d a b c d"):
        words, want = plain_features(text)
        got = toxicity.features(text)
        assert len(set(got.tolist())) == len(want)
        assert len(got) == len(words) + sum(max(0, len(words) - gap) for gap in (1, 2, 3))
    assert set(toxicity.features("x moron")) & set(toxicity.features("MORON, y")) and not set(toxicity.features("a b")) & set(toxicity.features("c d"))


def plain_fit(rows, labels):
    """FTRL-proximal a coordinate at a time."""
    count: dict = {}
    for x in rows:
        for f in x:
            count[f] = count.get(f, 0) + 1
    z: dict = {}
    n: dict = {}
    share = (sum(labels) + 1) / (len(labels) + 2)
    bias, bias_n = math.log(share / (1 - share)), 0.0

    def weight(f):
        if abs(z.get(f, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[f] > 0 else -1
        return -(z[f] - sign * toxicity.L1) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, y in zip(rows, labels):
            x = [f for f in x if count[f] >= toxicity.LEAST]
            w = {f: weight(f) for f in x}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - y
            for f in x:
                was = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / toxicity.ALPHA * w[f]
                n[f] = was + g * g
            bias_n += g * g
            bias -= toxicity.ALPHA / (toxicity.BETA + math.sqrt(bias_n)) * g
    return bias, {f: weight(f) for f in z if weight(f)}


def talk(n, seed=1):
    r = random.Random(seed)
    bad = ["moron", "scum", "loser"]
    out = []
    for i in range(n):
        words = [f"w{r.randrange(200)}" for _ in range(r.randint(3, 60))]
        toxic = r.random() < 0.2
        for _ in range(r.randint(1, 4) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(bad).upper() + r.choice(["", "!", ","])
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_fit_equals_a_plain_one():
    rows = talk(150)
    x = [np.unique(toxicity.features(t)) for _, t, _ in rows]
    y = [label for *_, label in rows]
    model = toxicity.fit(x, np.array(y, float))
    bias, weights = plain_fit([v.tolist() for v in x], y)
    assert abs(model.bias - bias) < 1e-9 and model.feature.tolist() == sorted(weights)
    assert np.abs(model.weight - [weights[f] for f in sorted(weights)]).max() < 1e-9
    for _, t, _ in rows[:30]:
        assert abs(model.margin(t) - bias - sum(weights.get(f, 0) for f in set(toxicity.features(t).tolist()))) < 1e-9
    moron = int(toxicity.features("moron")[0])
    assert len(weights) < 60 and weights[moron] > 0.5  # sparse, and it knows why


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(4)
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")


def test_held_out_rows(spark):
    rows = talk(1500)
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    out = [(got[i].score, y) for i, _, y in rows if got[i].held_out]
    assert 250 < len(out) < 500 and all(got[i].predicted == int(got[i].score >= 0.3) for i, *_ in rows)
    good, bad = [s for s, y in out if not y], [s for s, y in out if y]
    assert sum(a > b for a in bad for b in good) / (len(good) * len(bad)) > 0.99
    flipped = spark.createDataFrame([(i, 1 - y if got[i].held_out else y) for i, _, y in rows], "doc_id bigint, toxic int")
    assert {r.doc_id: r.score for r in toxicity.score(docs, flipped).collect()} == {i: r.score for i, r in got.items()}  # never learned from


def test_cases(spark):
    """Nulls, blanks, long texts, repeated ids, no labels, labels of one kind, clashing columns, an empty table."""
    rows = talk(300)
    docs, labels = frames(spark, rows)
    long = "fine " * 200_000 + "moron scum loser"
    more = spark.createDataFrame([(None, "moron scum loser"), (None, None), (900, ""), (900, "moron scum loser"), (901, long), (902, "MORON! scum... loser")], "doc_id bigint, text string")
    noisy = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (10_000, 1)], "doc_id bigint, toxic int"))
    wide = docs.unionByName(more).withColumns({c: F.lit("clash") for c in ("row", "toxic", "fp", "x", "SCORE", "id")})
    out = toxicity.score(wide, noisy).collect()
    assert len(out) == 306 and all(0 <= r.score <= 1 for r in out)
    again = [r for r in out if r.doc_id is None]
    assert not any(r.held_out for r in again) and max(r.score for r in again) > 0.3 > min(r.score for r in again)
    assert next(r for r in out if r.doc_id == 901).predicted == 1 and next(r for r in out if r.doc_id == 902).predicted == 1
    kept = toxicity.keep(wide, noisy)
    assert kept.columns == wide.columns and kept.count() == sum(r.score < 0.3 for r in out)
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.5}
    assert len({r.score for r in toxicity.score(docs, labels.where("toxic = 0")).collect()}) == 1
    assert toxicity.score(docs.limit(0), labels).count() == 0 and toxicity.keep(docs.limit(0), labels).count() == 0


def test_the_sample_is_bounded_and_each_label_counts_once(spark, monkeypatch):
    rows = [(1, f"moron {i}", 1) for i in range(40)] + [(i, f"fine {i}", 0) for i in range(2, 60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 60)], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda x, y: seen.append((x, y)) or toxicity.Model(np.empty(0, np.uint32), np.empty(0), 0.0))
    toxicity.train(docs, labels, sample=20)
    assert len(seen[0][0]) == 20
    toxicity.train(docs, labels)
    assert (seen[1][1] == 1).sum() <= 1 and all(len(x) <= toxicity.FEATURES for x in seen[1][0])
    assert all((np.diff(x.astype(np.int64)) > 0).all() for x in seen[1][0]) and len(common.word_hashes(b"a b")) == 2
