"""Operators against brute force, and their defined cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chatformat, common, decontaminate, exactdedup, frequency, jaccard, linededup, linking, quality, queries, sentencepiece_codec, sharding, substring, urlfilter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(parts)


def corpus(seed=1, n=60):
    """Texts over few words, with exact and near copies, shared passages, nulls and blanks."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices(string.ascii_lowercase + "éü", k=r.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(r.choices(vocabulary, k=k))
    passage, out = text(70), []
    for i in range(n):
        kind = r.random()
        if kind < 0.3 and out:
            base = r.choice(out)[1] or ""
            words = base.split(" ")
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append((i, " ".join(words)))
        elif kind < 0.5:
            out.append((i, text(r.randint(5, 40)) + "\n" + passage + " " + text(r.randint(0, 20))))
        else:
            out.append((i, text(r.randint(1, 120)).replace(" ", "  ", 2) + r.choice(["", "\n", "\t "])))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "word"), (n + 4, "long " * 5000)]


# --- shared -----------------------------------------------------------------------------------------------------------


def test_word_hashes_do_not_depend_on_spacing_or_pieces(monkeypatch):
    words = [w.encode() for w in ("a", "bb", "é" * 40, "x" * 900, "a", "ccc")] * 50
    h = common.word_hashes(b" ".join(words))
    assert len(h) == len(words) and h[0] == h[4] and len(set(h.tolist())) == 5
    assert (common.word_hashes(b"\n\t " + b" \n ".join(words) + b" ") == h).all()
    monkeypatch.setattr(common, "PIECE", 64)
    common._powers.cache_clear()
    assert (common.word_hashes(b" ".join(words)) == h)[[i for i, w in enumerate(words) if len(w) < 64 or len(w) > 512]].all()
    common._powers.cache_clear()


def test_window_hashes():
    h = common.word_hashes(b"a b c d e a b c d f")
    for k in range(1, 11):
        w = common.window_hashes(h, k)
        assert len(w) == 11 - k
        assert (w[0] == w[5]) == (k <= 4) if len(w) > 5 else True
    assert not len(common.window_hashes(h, 11))


# --- 1 sharding --------------------------------------------------------------------------------------------------------


def test_sharding_table_against_plain_turns():
    names, slots = tuple("abcde"), 101
    owner = sharding.fill(names, slots)
    start = [sharding._number(f"{s}/offset") % slots for s in names]
    step = [sharding._number(f"{s}/skip") % (slots - 1) + 1 for s in names]
    lists = [[(a + j * b) % slots for j in range(slots)] for a, b in zip(start, step)]
    taken: dict[int, int] = {}
    for i in itertools.cycle(range(5)):
        slot = next(s for s in lists[i] if s not in taken)
        taken[slot] = i
        if len(taken) == slots:
            break
    assert [taken[s] for s in range(slots)] == owner
    counts = [owner.count(i) for i in range(5)]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.fill(names[:4], slots)
    assert sum(a != b for a, b in zip(owner, fewer) if a < 4) < slots // 4
    for bad in ((names, 100), ((), 101), (("a", "a"), 101)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_sharding_rows(spark):
    df = spark.createDataFrame([(1, "x", "old"), (1, "y", "old"), (None, "z", "old")], "doc_id bigint, text string, shard string")
    r = sharding.assign_shards(df, "doc_id").collect()
    assert len(r) == 3 and len({x.shard for x in r if x.doc_id == 1}) == 1 and all(x.shard in sharding.SHARDS for x in r)
    assert sharding.assign_shards(df.limit(0), "doc_id").count() == 0


def test_sharding_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "x", "y", "z"), (2, "x", "y", "z")], "doc_id bigint, SHARD string, Slot string, text string")
    out = sharding.assign_shards(df, "doc_id")
    assert out.columns == ["doc_id", "text", "slot", "shard"] and out.where("shard like 'shard-%'").count() == 2
    by = sharding.assign_shards(df, "Slot")
    assert by.columns == ["doc_id", "Slot", "text", "slot_1", "shard"] and {r.Slot for r in by.collect()} == {"y"}
    long = spark.createDataFrame([("k" * 1_000_000,), ("k" * 1_000_000,)], "slot string")
    assert len({r.shard for r in sharding.assign_shards(long, "slot").collect()}) == 1


# --- 2 decontamination -------------------------------------------------------------------------------------------------


def brute_decontaminate(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    words = lambda t: pattern.findall((t or "").translate(lower))
    windows = set()
    for item, t in items:
        w = words(t)
        k = min(13, len(w))
        windows |= {(tuple(w[i : i + k]), item) for i in range(len(w) - k + 1)} if k else set()
    for doc_id, t in docs:
        w, hit, found = words(t), set(), set()
        for g, item in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(str(item))
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("crowded", [False, True])
def test_decontamination(spark, monkeypatch, crowded):
    if crowded:  # a set of bits that lets everything through
        monkeypatch.setattr(common, "key_filter", lambda keys, *_: spark.sparkContext.broadcast(np.full(1 << 17, 255, np.uint8)))
    r = random.Random(3)
    items = [(i, " ".join(r.choices("abcdefgh", k=r.randint(1, 30)))) for i in range(12)] + [(50, None), (51, "?!"), (52, "Ünïque Zz, 9!"), (7, "repeated id here")]
    docs = [(i, " ".join(r.choices("abcdefgh", k=30)) + r.choice([" ", "-"]) + (r.choice(items)[1] or "").upper()) for i in range(25)] + [(90, None), (91, ""), (92, "ünïque zz9"), (3, "a b")]
    docs += [docs[0], docs[0]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = docs_of(spark, docs)
    got = decontaminate.judge(df, bench).drop("runs")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_decontaminate(docs, items), key=str)
    bad = {d for d, *_, c in brute_decontaminate(docs, items) if c}
    assert {x.doc_id for x in decontaminate.remove(df.where("doc_id <> 3"), bench).collect()} == {d for d, _ in docs if d != 3} - bad
    cut = decontaminate.remove(df, bench, "spans")
    assert cut.columns == df.columns and cut.count() == len(docs)
    again = decontaminate.judge(cut, bench.where("item_id <> 7")).agg(F.max("n_words")).first()[0]
    assert again <= max(n for _, n, *_ in brute_decontaminate(docs, items))
    assert decontaminate.judge(df.limit(0), bench).count() == 0 and decontaminate.judge(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_cut_words():
    assert decontaminate.cut_words("A b, C! d", np.array([[1, 3]])) == "A ! d"


# --- 3 line dedup ------------------------------------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance():
    r = random.Random(5)
    for _ in range(3000):
        a = "".join(r.choices("abé", k=r.randint(0, 12)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = r.choices("abé", k=r.randint(0, 1))
        b = "".join(b)
        for limit in (0, 1, 2, 3):
            assert linededup.distance_within(a, b, limit) == (edit_distance(a, b) <= limit), (a, b, limit)


def test_segments_meet():
    r = random.Random(6)
    for edits in (1, 2, 3):
        for _ in range(400):
            a = "".join(r.choices("ab", k=r.randint(edits + 1, 14)))
            b = list(a)
            for _ in range(edits):
                at = r.randint(0, len(b))
                b[at : at + r.randint(0, 1)] = r.choices("ab", k=r.randint(0, 1))
            b = "".join(b)
            if len(b) > edits:
                keys = [{(i, n, x[s : s + k]) for i, n, s, k in linededup.probes(len(x), edits)} for x in (a, b)]
                assert keys[0] & keys[1], (a, b)


def brute_lines(docs, edits, least):
    lines = sorted({x for _, t in docs for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c\n")})
    parent = {x: x for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([x for x in lines if len(x) >= least], 2):
        if edit_distance(a, b) <= edits:
            parent[root(a)] = root(b)
    seen, out = {}, {}
    for doc, t in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        own = (t or "").split("\n") if t else []
        kept = []
        for i, x in enumerate(own):
            if not x.strip(" \t\r\x0b\x0c\n") or seen.setdefault(root(x), (doc, i)) == (doc, i):
                kept.append(x)
        out[doc] = (len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [64, 1])
def test_line_dedup(spark, monkeypatch, crowd):
    monkeypatch.setattr(linking, "OUTSIDERS", 3)
    monkeypatch.setattr(linededup, "CROWD", crowd)
    r = random.Random(7)
    base = ["".join(r.choices("abc ", k=r.randint(8, 14))) for _ in range(12)] + ["short", "x", " ", ""]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(r.randint(0, 5)):
            x = list(r.choice(base))
            for _ in range(r.randint(0, 2) if len(x) > 7 else 0):
                x[r.randrange(len(x))] = r.choice("abc")
            lines.append("".join(x))
        docs.append((i, "\n".join(lines)))
    docs += [(70, None), (None, docs[3][1])]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.kept_sha256) for x in linededup.summarise(docs_of(spark, docs), 2, 8).collect()}
    assert got == brute_lines(docs, 2, 8)
    cut = linededup.remove(docs_of(spark, docs), 2, 8)
    assert cut.columns == DOCS.replace(" bigint", "").replace(" string", "").split(", ")
    assert {x.doc_id: hashlib.sha256((x.text or "").encode()).hexdigest() for x in cut.collect()} == {k: v[2] for k, v in brute_lines(docs, 2, 8).items()}
    assert linededup.summarise(docs_of(spark, docs).limit(0)).count() == 0


def test_grams_of_near_lines_meet():
    """Of two lines within the distance, one of the rarest grams is the same, whatever the order of grams."""
    r = random.Random(3)
    for least, edits in ((20, 2), (8, 2), (5, 1), (4, 3)):
        q = linededup.gram_length(least, edits)
        assert q == 1 or least - q + 1 > q * edits
        for _ in range(300):
            a = "".join(r.choices("ab", k=r.randint(least, least + 9)))
            b = list(a)
            for _ in range(edits):
                i = r.randrange(len(b))
                b[i : i + 1] = r.choice([[], [b[i], "c"], ["a"]])
            b = "".join(b)
            if len(b) < least:
                continue
            levels = np.array([r.randrange(5) for _ in range(64)], np.uint8)
            first = []
            for line in (a, b):
                found = linededup.grams(line, q)
                assert len(set(found.tolist())) == len(found) == len(line) - q + 1
                order = frequency.levels_of(found, levels).astype(np.uint64) << np.uint64(56) | found >> np.uint64(8)
                first.append(set(found[np.argsort(order)[: q * edits + 1]].tolist()))
            assert first[0] & first[1]


@pytest.mark.parametrize("shape", ["head {} and the same tail of every line", "first part {0} second part of it {1} third part", "2024-01-01T00:00:00 {} INFO"])
def test_lines_with_common_parts(spark, shape):
    """Common text before, between and after what differs, with near copies among them."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("0123456789abcdef", k=12))
    lines = [shape.format(word(), word()) for _ in range(90)]
    near = [x.replace("a", "b", 1) for x in lines[:15]] + [x + "!" for x in lines[40:50]]
    docs = [(i, "\n".join(x)) for i, x in enumerate(itertools.batched(lines + near, 7))]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.kept_sha256) for x in linededup.summarise(docs_of(spark, docs)).collect()}
    assert got == brute_lines(docs, linededup.EDITS, linededup.MIN_CHARS)


def test_lines_whose_nodes_collide(spark):
    """Lines with equal first halves of their names are told apart by the second ones."""
    rows = spark.createDataFrame([(0, 0, "a"), (1, 1, "b"), (2, 2, "a")], "doc bigint, uid bigint, text string")
    found = linededup._occurrences(rows).collect()
    assert len({(x.node, x.name) for x in found}) == 2 and found[0].name != found[0].node


# --- 4 URL filter ------------------------------------------------------------------------------------------------------


def test_url_rules_and_reputation(spark):
    urls = ["https://A.Example.ORG/es/x", "http://example.org/en/12?q", "http://x.org/a#b", "http://x.org", "https://a.com/fr/", "https://a.com/de/1", "https://notcom/fr/", None, "no scheme", "http://good.net/1", "http://bad.net/1", "http://a.co.uk/x", "http://org/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(100 + i, f"http://{'good' if i % 2 else 'bad'}.net/{i}", "h") for i in range(60)], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(60)] + [(5, None)], "page_id bigint, good int")
    r = {x.page_id: x for x in urlfilter.filter_urls(pages, labels, queries.URL_RULES).collect()}
    assert (r[0].host, r[0].path, r[0].rule, r[0].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (r[1].rule, r[2].rule, r[2].verdict, r[3].rule) == ("example.org/en/1", "org/", "allow", None)
    assert (r[4].verdict, r[5].verdict, r[6].rule, r[12].rule) == ("allow", "block", None, "org/")
    assert (r[7].host, r[7].path, r[8].host) == ("", "", "") and len(r) == 73
    assert (r[9].verdict, r[10].verdict) == ("allow", "block") and r[9].bound > r[11].bound > r[10].bound
    none = urlfilter.filter_urls(pages, labels.limit(0), []).collect()
    assert len(none) == 73 and len({x.bound for x in none}) == 1
    assert urlfilter.filter_urls(pages.limit(0), labels, []).count() == 0
    d = spark.createDataFrame([("a.b.co.uk",), ("a.b.com",), ("com",), ("",)], "host string").select(urlfilter.domain_of(F.col("host"))).collect()
    assert [x[0] for x in d] == ["b.co.uk", "b.com", "com", ""]


def test_url_many_rules_equal_few(spark, monkeypatch):
    r = random.Random(12)
    hosts = ["a.b.example.org", "example.org", "b.org", "org", "x.com", "a.x.com", ""]
    urls = [f"http://{r.choice(hosts)}/{'/'.join(r.choices(['en', 'fr', 'e', '1'], k=r.randint(0, 3)))}?q" for _ in range(120)] + [None, "x", "http://b.org/" + "e" * 100_000]
    rules = [(r.choice(["allow", "block"]), h, "/" + r.choice(["", "e", "en", "en/", "fr/1"])) for h in hosts[:6] for _ in range(3)] + [("allow", "org", ""), ("block", "org", "")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "y")], "page_id bigint, url string, r string")
    outcomes = spark.createDataFrame([(i, i % 2, 1) for i in range(50)], "page_id bigint, good int, host int")
    few = sorted(map(tuple, urlfilter.filter_urls(pages, outcomes, rules).collect()), key=str)
    monkeypatch.setattr(urlfilter, "INLINE", 0)
    assert sorted(map(tuple, urlfilter.filter_urls(pages, outcomes, rules).collect()), key=str) == few and len(few) == len(urls) + 1
    table = spark.createDataFrame(rules, "action string, host string, path string")
    assert sorted(map(tuple, urlfilter.filter_urls(pages, outcomes, table).collect()), key=str) == few


def test_url_heavy_hosts_equal_others(spark, monkeypatch):
    """A host with a third of all pages is broadcast, with the bounds that a join gives."""
    r = random.Random(5)
    urls = ["http://hot.net/x"] * 60 + [f"http://{r.choice('abcdefg')}.com/{i}" for i in range(90)] + ["http://x.org/1"] * 20
    pages = spark.createDataFrame([(i // 2, u, 0.0) for i, u in enumerate(urls)], "page_id bigint, url string, bound double")
    outcomes = spark.createDataFrame([(i, r.randrange(2)) for i in range(60)], "page_id bigint, good int")
    out = []
    for heavy in (10**9, 10, 1):
        monkeypatch.setattr(urlfilter, "HEAVY", heavy)
        out.append(sorted(map(tuple, urlfilter.filter_urls(pages, outcomes, [("allow", "org", "/")]).collect()), key=str))
    assert out[0] == out[1] == out[2] and len(out[0]) == len(urls) and all((x[3] is None) == (x[5] is not None) for x in out[0])


def test_url_users_ports_and_addresses(spark):
    urls = ["http://u@a.net:80/x", "http://a.net/", "http://192.168.0.1/", "http://10.7.0.1:8080/", "http://[::1]:9/", "http://b.a.net:/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {x.page_id: x for x in urlfilter.filter_urls(pages, spark.createDataFrame([(1, 1), (3, 0)], "page_id bigint, good int"), []).collect()}
    assert got[0].host == "u@a.net:80" and got[0].bound == got[1].bound > got[5].bound > got[2].bound > got[3].bound
    d = spark.createDataFrame([("192.168.0.1",), ("[::1]",), ("0.1",)], "host string").select("host", urlfilter.domain_of(F.col("host")).alias("domain"))
    assert [(x.domain, x.s) for x in d.select("domain", urlfilter.suffix_of(F.col("domain")).alias("s")).collect()] == [("192.168.0.1", "192.168.0.1"), ("[::1]", "[::1]"), ("0.1", "1")]


def test_public_suffixes(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.y.blog.net",), ("x.net",), ("nowhere",), ("",)], "host string")
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("blog.net",)], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in urlfilter._domains(hosts, suffixes).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.blog.net": ("y.blog.net", "blog.net"), "x.net": ("x.net", "net"), "nowhere": ("nowhere", "nowhere"), "": ("", "")}


# --- 5 quality ---------------------------------------------------------------------------------------------------------


def test_quality_learns_each_label_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((len(x), sorted(y.tolist()))))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)] + [(2, 0)], "doc_id bigint, quality int").where(quality.fold(F.col("doc_id")) != 0)
    n = labels.count()
    once = [(i, f"text {i}") for i in range(1, 5)]
    quality.train(docs_of(spark, once), labels)
    quality.train(docs_of(spark, once + [(i, f"other text {j}") for i in range(1, 5) for j in range(200)]), labels)
    assert n > 1 and seen[0] == seen[1] and seen[0][0] == n


def test_quality_accuracy_and_cases(spark):
    r = random.Random(8)
    clean = lambda: " ".join("".join(r.choices(string.ascii_lowercase, k=r.randint(2, 8))) for _ in range(r.randint(5, 60))) + "."
    junk = lambda: " ".join(w.upper() + "!!" for w in clean().split()) if r.random() < 0.5 else " | ".join(clean().split()) + "$$$"
    rows = [(i, clean() if i % 2 else junk()) for i in range(500)] + [(900, None), (901, ""), (902, "x" * 100_000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(401, None, 0), (401, 1, 0), (401, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {x.doc_id: x for x in quality.score(docs_of(spark, rows), labels).collect()}
    assert len(got) == 503 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    held = [x for i, x in got.items() if i < 500 and x.held_out]
    assert 60 < len(held) < 140 and sum(x.predicted == x.doc_id % 2 for x in held) / len(held) > 0.95
    kept = quality.keep(docs_of(spark, rows), labels)
    assert {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.predicted} and kept.columns == docs_of(spark, rows).columns
    assert {x.score for x in quality.score(docs_of(spark, rows[:5]), labels.limit(0)).collect()} == {0.5}
    assert quality.score(docs_of(spark, rows).limit(0), labels).count() == 0


def test_flat_trees_equal_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, quality.N_STATISTICS))
    y = (x[:, 0] + x[:, 3] > 0).astype(float)
    m = quality.fit(x, y, trees=5, depth=3)
    binned = m.bins(x)
    for row, fast in zip(binned[:50], m.margin(binned[:50])):
        total = m.base
        for f, s, leaf in zip(m.feature, m.split, m.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > s[node] else 1)
            total += leaf[node - len(f)]
        assert abs(total - fast) < 1e-9
    assert ((m.margin(binned) > 0) == (y > 0)).mean() > 0.85


def plain_statistics(text):
    """The statistics of a text, character by character and word by word."""
    raw = (text or "").encode()
    kinds = [0.0] * 7 + [0.0] * len(quality.MARKS)
    for b in raw:
        c = chr(b)
        k = 6 if b >= 128 else 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if "0" <= c <= "9" else 4 if c == "\n" else 3 if c in " \t\r\x0b\x0c\x1c\x1d\x1e\x1f" else 5
        kinds[k] += 1
        if c in quality.MARKS:
            kinds[7 + quality.MARKS.index(c)] += 1
    shares = [k / max(1, len(raw)) for k in kinds]
    if not raw:
        return shares + [0.0] * 9
    words, lines = raw.split(), raw.split(b"\n")
    n, different = max(1, len(words)), set(words)
    return shares + [math.log1p(len(raw)), math.log1p(len(words)), sum(len(w) for w in words) / n, max([len(w) for w in words] or [0]), len(different) / n, len(lines) / n, len(set(lines)) / len(lines),
                     sum(len(w) for w in different) / max(1, len(different)), sum(x.endswith(b".") for x in lines) / len(lines)]


def test_statistics_equal_plain_ones():
    texts = [t for _, t in corpus(13, 30)] + ["A1! é\n\tb.\r\n", "x" * 3000, "%%% ???"]
    assert np.allclose(quality.statistics(texts), [plain_statistics(t) for t in texts], rtol=1e-12)


def plain_trees(x, y, trees, depth):
    """Boosted trees by trying every border of every statistic at every node; margins of the rows it was fitted on."""
    n, m = x.shape
    edges = [sorted({float(v) for v in np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])}) for j in range(m)]
    bins = [[sum(e < x[i, j] for e in edges[j]) for j in range(m)] for i in range(n)]
    share = (sum(y) + 1) / (n + 2)
    margin = [math.log(share / (1 - share))] * n
    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in margin]
        g, h = [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]
        parts = [list(range(n))]
        for _ in range(depth):
            split = []
            for rows in parts:
                total = (sum(g[i] for i in rows), sum(h[i] for i in rows))
                best, chosen = 1e-9, None
                for j in range(m):
                    for cut in range(quality.BINS):
                        left = [i for i in rows if bins[i][j] <= cut]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        if hl < quality.LEAST / 4 or total[1] - hl < quality.LEAST / 4:
                            continue
                        gain = gl**2 / (hl + quality.L2) + (total[0] - gl) ** 2 / (total[1] - hl + quality.L2) - total[0] ** 2 / (total[1] + quality.L2)
                        if gain > best * (1 + 1e-9):
                            best, chosen = gain, (j, cut)
                split += [[i for i in rows if bins[i][chosen[0]] <= chosen[1]], [i for i in rows if bins[i][chosen[0]] > chosen[1]]] if chosen else [rows, []]
            parts = split
        for rows in parts:
            for i in rows:
                margin[i] += quality.RATE * sum(g[k] for k in rows) / (sum(h[k] for k in rows) + quality.L2)
    return margin


def plain_scores(docs, labels):
    """{doc_id: score} by plain statistics and a walk through each tree. docs: {doc_id: text}, labels: {doc_id: quality}."""
    learned = sorted((str(i), q, i) for i, q in labels.items() if q is not None and i in docs and zlib.crc32(str(i).encode()) % 5)
    m = quality.fit(np.array([plain_statistics(docs[i]) for _, _, i in learned]), np.array([float(q) for _, q, _ in learned]))
    out = {}
    for i, text in docs.items():
        row, total = [sum(e < v for e in edges) for edges, v in zip(m.edges, plain_statistics(text))], m.base
        for f, s, leaf in zip(m.feature, m.split, m.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > s[node] else 1)
            total += leaf[node - len(f)]
        out[i] = 1 / (1 + math.exp(-total))
    return out


def test_fit_equals_plain_search(monkeypatch):
    monkeypatch.setattr(quality, "BINS", 6)
    monkeypatch.setattr(quality, "N_STATISTICS", 3)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0) | (rng.random(160) < 0.1)).astype(float)
    m = quality.fit(x, y, trees=3, depth=2)
    assert np.allclose(m.margin(m.bins(x)), plain_trees(x, y.tolist(), 3, 2), rtol=1e-9)


# --- 6 exact dedup -----------------------------------------------------------------------------------------------------


def test_directory_doubles_until_buckets_fit():
    r = random.Random(9)
    counts = {r.randrange(1 << 8) if i % 3 else 5: 0 for i in range(200)}
    for k in counts:
        counts[k] = r.randint(1, 9)
    counts[5] = 500
    table = exactdedup.directory(counts, 8, 40)
    assert len(table) == 256 and table == sorted(table, key=table.index)
    for b in set(table):
        prefixes = [p for p in range(256) if table[p] == b]
        assert sum(counts.get(p, 0) for p in prefixes) <= 40 or len(prefixes) == 1
        assert prefixes == list(range(prefixes[0], prefixes[-1] + 1)) and len(prefixes) & (len(prefixes) - 1) == 0


def test_places_are_key_ranges_that_deepen(spark):
    r = random.Random(10)
    keys = [r.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + [(5 << 60) + r.randrange(1 << 60) for _ in range(300)]
    counts: dict[int, int] = {}
    for k in keys:
        counts[k % 2**64 >> 60] = counts.get(k % 2**64 >> 60, 0) + 1
    df = spark.createDataFrame([(k,) for k in keys], "key bigint").select("key", exactdedup._place(exactdedup.directory(counts, 4, 16), counts, 4, 16).alias("p"))
    got = sorted((x.key % 2**64, (x.p.bucket, x.p.bits)) for x in df.collect())
    places = [p for _, p in got]
    assert places == sorted(places) and max(places.count(p) for p in set(places)) < 50
    assert [exactdedup.deeper(n, 16) for n in (0, 16, 17, 32, 33, 1600)] == [0, 0, 1, 1, 2, 7]


@pytest.mark.parametrize("local", [exactdedup.LOCAL_BYTES, 1000])
def test_exact_dedup(spark, monkeypatch, local):
    monkeypatch.setattr(exactdedup, "LOCAL_BYTES", local)
    monkeypatch.setattr(exactdedup, "CAPACITY", 4)
    rows = corpus(2) + [(200 + i, "same  text\n") for i in range(20)] + [(None, "same text "), (None, "only null"), (3, "same\ttext ")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    got = exactdedup.groups(docs_of(spark, rows)).collect()
    least = {k: min((i for i in v if i is not None), default=None) for k, v in by.items()}
    sha = {hashlib.sha256(k.encode()).hexdigest(): k for k in by}
    assert len(got) == len(rows) and all(x.keep_id == least[sha[x.text_sha256]] and x.group_size == len(by[sha[x.text_sha256]]) for x in got)
    assert sum(x.kept for x in got) == len(by)
    kept = exactdedup.deduplicate(docs_of(spark, rows)).collect()
    assert sorted((x.doc_id, norm(x.text)) for x in kept if x.doc_id is not None) == sorted((v, k) for k, v in least.items() if v is not None) and len(kept) == len(by)
    twice = [(1, "a"), (1, "a"), (1, "b"), (0, "b")]
    assert sorted((x.doc_id, x.text) for x in exactdedup.deduplicate(docs_of(spark, twice)).collect()) == [(0, "b"), (1, "a")]
    assert exactdedup.groups(docs_of(spark, rows).limit(0)).count() == 0


def test_index_takes_more_rows(spark, tmp_path):
    """Batches added one by one give what one batch of all gives; buckets split on files, and only touched ones are read."""
    rows = [(i, t) for i, t in enumerate(["same"] * 30 + [f"text {i % 90}" for i in range(300)])]
    random.Random(4).shuffle(rows)
    index, seen = exactdedup.Index(spark, str(tmp_path / "index"), capacity=8, depth=6), {}
    buckets = []
    for batch in (rows[:20], rows[20:60], rows[60:200], rows[200:201], [], rows[201:]):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(batch)], "uid bigint, doc_id bigint, text string").repartition(3)
        before = dict(seen)
        for i, t in batch:
            n, least = seen.get(t, (0, i))
            seen[t] = (n + 1, min(least, i))
        for r in index.add(df).collect():
            t = dict(rows)[r.doc_id]
            assert (r.group_size, r.keeper.doc_id) == seen[t] and r.kept == (seen[t][1] == r.doc_id and (t not in before or before[t][1] != r.doc_id))
        buckets.append(len(index.directory()[0]))
    assert buckets[0] < buckets[1] < buckets[2] <= buckets[-1] and index.directory()[1] == 6
    ranges = sorted(index.directory()[0].values())
    assert ranges[0][0] == 0 and ranges[-1][1] == 64 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    held = index.entries(6).groupBy("bucket").count().collect()
    assert sum(r["count"] for r in held) >= len(seen) and {r.bucket for r in held} <= set(index.directory()[0])
    assert {int(p.name.split("=")[1]) for p in (tmp_path / "index/buckets").glob("bucket=*")} <= set(index.directory()[0])


# --- 7 chat formatting -------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\<|turn|>", "<|im_end|><|im_start|>system<|message|>x", "<\\|im_start|>", "a\nb", "", None, "é𝄞", "<<SYS>><</SYS>>", "[\\INST]", "$1 \\$"]
    rows = [(1, i, ["user", "assistant", "assistant", None][i % 4], t) for i, t in enumerate(nasty)] + [(2, None, "assistant", "b"), (2, None, "assistant", "a"), (2, 3, "<|im_end|>", "x"), (None, 1, "user", "q"), (2, 3, "<|im_end|>", "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, pieces string").repartition(3)
    out = chatformat.format_conversations(df).withColumn("turns", chatformat.read_turns(F.col("formatted"))).withColumn("loss", chatformat.loss_text(F.col("pieces"))).collect()
    got = {r.conv_id: r for r in out}
    clean = lambda part: [(x or "", t or "") for _, _, x, t in part]
    assert [tuple(t) for t in got[1].turns] == clean([r for r in rows if r[0] == 1])
    assert [tuple(t) for t in got[2].turns] == [("assistant", "a"), ("assistant", "b"), ("<|im_end|>", "x"), ("<|im_end|>", "x")]
    assert got[2].formatted.count("<|im_start|>assistant") == 1 and got[2].formatted.startswith("<|im_start|>assistant<|message|>a<|turn|>b<|im_end|>")
    assert got[1].loss == "".join(t or "" for i, t in enumerate(nasty) if i % 4 in (1, 2)) and got[None].loss == ""
    assert all("".join(p.text for p in r.pieces) == r.formatted for r in out)
    assert chatformat.format_conversations(df.limit(0)).count() == 0
    many = spark.range(3000).select(F.lit(None).cast("bigint").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit("long " * 50_000).alias("text")).limit(20)
    assert [len(r.formatted) for r in chatformat.format_conversations(many).collect()] == [250_000 + 32 + 5] * 20


# --- 8 n-gram Jaccard --------------------------------------------------------------------------------------------------


def brute_components(docs, k, percent):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    sets = []
    for i, t in docs:
        w = words(t)
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[root(a)] = min(i, least.get(root(a), i))
    return sorted((i, len(x), least[root(a)]) for a, (i, x) in enumerate(sets))


@pytest.mark.parametrize(("k", "percent", "outsiders", "hot"), [(4, 85, 1500, 14), (5, 80, 2, 14), (2, 50, 3, 2)])
def test_jaccard(spark, monkeypatch, k, percent, outsiders, hot):
    monkeypatch.setattr(linking, "OUTSIDERS", outsiders)
    monkeypatch.setattr(jaccard, "HOT_LEVEL", hot)
    rows = corpus(4, 90)
    base = rows[0][1].split() + rows[5][1].split()
    r = random.Random(k)
    for i in range(40):  # a group whose members are near the limit
        words = list(base)
        for _ in range(r.randint(1, 6)):
            words[r.randrange(len(words))] = f"w{r.randrange(50)}"
        rows.append((300 + i, " ".join(words)))
    got = jaccard.groups(docs_of(spark, rows), k, percent, cells=1 << 16)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, k, percent)


def test_sets_that_share_a_name_fail(spark, monkeypatch):
    """Two sets under one 64-bit name are noticed by the second one, not taken for one set."""
    docs = docs_of(spark, [(1, "a b c d e"), (2, "f g h i j")])
    rows, _ = common.numbered(docs, ["doc_id", "text"])
    made = jaccard._signatures
    monkeypatch.setattr(jaccard, "_signatures", lambda *a: made(*a).withColumn("node", F.lit(5).cast("bigint")))
    with pytest.raises(Exception, match="share a 64-bit name"):
        jaccard._placed(rows, 5, 80, 1 << 16).collect()


def test_jaccard_cases(spark):
    rows = [(5, "a b c d e f"), (None, "A b  c d e f"), (7, "a b c d e f"), (7, "other words in this row here"), (8, None)]
    got = sorted(map(tuple, jaccard.groups(docs_of(spark, rows), 5, 80, cells=1 << 16).collect()), key=str)
    assert got == sorted([(5, 2, 5), (None, 2, 5), (7, 2, 5), (7, 2, 7), (8, 0, 8)], key=str)
    assert jaccard.groups(docs_of(spark, rows).limit(0), cells=1 << 16).count() == 0
    kept = jaccard.deduplicate(docs_of(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")]))
    assert sorted(x.doc_id for x in kept.collect()) == [1, 3] and kept.columns == docs_of(spark, [(1, "a")]).columns


def test_jaccard_deduplicate_null_and_repeated_ids(spark):
    a, near = "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y zz"
    rows = [(3, a), (None, near), (None, "clean text that nothing else is like"), (None, "alone " + "b " * 9), (5, "five " * 8), (7, "Five " * 8), (7, "other words in this row here"), (None, None)]
    kept = sorted(((x.doc_id, x.text) for x in jaccard.deduplicate(docs_of(spark, rows)).collect()), key=str)
    assert kept == sorted([rows[i] for i in (0, 2, 3, 4, 6, 7)], key=str)


def test_components(spark):
    r = random.Random(11)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 30)] + [(r.randrange(500, 600), r.randrange(500, 600)) for _ in range(60)]
    got, _ = linking.components_of(spark, spark.createDataFrame(edges, "x bigint, y bigint"))
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert dict(map(tuple, got.collect())) == {x: root(x) for e in edges for x in e if e[0] != e[1] or any(x in f and f[0] != f[1] for f in edges)}


# --- 9 substring dedup -------------------------------------------------------------------------------------------------


def brute_substring(docs, length):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    first: dict[tuple, int] = {}
    for i, w in words.items():
        for j in range(len(w) - length + 1):
            first.setdefault(tuple(w[j : j + length]), i)
            first[tuple(w[j : j + length])] = min(first[tuple(w[j : j + length])], i)
    for i, w in words.items():
        gone = {p for j in range(len(w) - length + 1) if first[tuple(w[j : j + length])] < i for p in range(j, j + length)}
        yield i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()


@pytest.mark.parametrize(("length", "held"), [(50, 10**6), (50, 40), (7, 100), (2, 10**6)])
def test_substring(spark, monkeypatch, length, held):
    monkeypatch.setattr(substring, "ROWS", held)
    rows = corpus(6, 70) + [(500, "a " * 300), (501, "a " * 70 + "b"), (502, "b " + "a " * 60)]
    assert sorted(map(tuple, substring.repeats(docs_of(spark, rows), length).collect())) == sorted(brute_substring(rows, length))


def test_substring_cases(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(2, t), (2, t), (2, "x " + t), (None, t), (9, "y  " + t + "\nz"), (10, None)]
    got = sorted(((x.doc_id, x.n_words, x.n_removed) for x in substring.repeats(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(2, 60, 0), (2, 60, 0), (2, 61, 0), (None, 60, 60), (9, 62, 60), (10, 0, 0)], key=str)
    cut = {x.doc_id: x.text for x in substring.remove(docs_of(spark, rows)).where("doc_id >= 9").collect()}
    assert cut == {9: "y z", 10: None} and substring.remove(docs_of(spark, rows)).columns == docs_of(spark, rows).columns
    assert substring.repeats(docs_of(spark, rows).limit(0)).count() == 0


def test_line_dedup_rows_without_id_that_share_a_hash(spark):
    line = "a line that two documents have"
    ids = spark.range(200_000).select(F.col("id").cast("string").alias("i"))
    left = ids.select(F.concat(F.lit(line + "\n"), "i").alias("x")).withColumn("h", F.hash("x"))
    right = ids.select(F.concat(F.lit("own words of number "), "i", F.lit("\nmore")).alias("y")).withColumn("h", F.hash("y"))
    x, y = left.join(right, "h").orderBy("x").select("x", "y").first()
    docs = docs_of(spark, [(1, line), (None, x), (None, y)])
    assert sorted(r.n_removed for r in linededup.summarise(docs).where("doc_id is null").collect()) == [0, 1]
    assert {r.text for r in linededup.remove(docs).where("doc_id is null").collect()} == {x.split("\n")[1], y}


def test_substring_many_rows_without_id(spark):
    """Short clean texts and longer ones that lose their ends, more than 16 bits can tell apart."""
    t = " ".join(f"w{i}" for i in range(10))
    rows = [(1, t)] + [(None, f"{'z' * (i % 9)} {'y ' * 40} long {i} {t}") for i in range(1000)] + [(None, f"clean {i} text short as can be {i} {i + 1} {i + 2} {i + 3}") for i in range(1000)]
    got = substring.repeats(docs_of(spark, rows), 10).where("doc_id is null").collect()
    assert sorted({(x.n_words > 12, x.n_removed) for x in got}) == [(False, 0), (True, 10)] and len(got) == 2000
    cut = {x.text for x in substring.remove(docs_of(spark, rows), 10).where("doc_id is null").collect()}
    assert {x for _, x in rows[1001:]} <= cut and not any(x.endswith("w9") for x in cut)


# --- 10 SentencePiece --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer_file()


def changed(model, **how):
    """The model with another normaliser or without byte pieces, as bytes."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto.FromString(open(model, "rb").read())
    for k, v in how.items():
        if k == "no_bytes":
            m.trainer_spec.byte_fallback = False
            for p in m.pieces:
                p.type = 3 if p.type == 6 else p.type
        elif k == "unused":
            for p in m.pieces:
                p.type = 5 if p.piece in v else p.type
        else:
            setattr(m.normalizer_spec, k, v)
    return m.SerializeToString()


MAPPED = {"ﬁ".encode(): b"fi", b"\t": b" ", "Ⅳ".encode(): b"IV", b"ab": b"  x y ", b"a": b"A", "é".encode(): "e\u0301".encode(), "\u200d".encode(): b"", "日本".encode(): "語".encode(), b"q": b" "}


@pytest.mark.parametrize("how", [{}, {"remove_extra_whitespaces": True}, {"add_dummy_prefix": False}, {"no_bytes": True}, {"no_bytes": True, "remove_extra_whitespaces": True}, {"unused": {"▁the", "in", "er"}}, {"map": True}, {"map": True, "remove_extra_whitespaces": True}, {"map": True, "no_bytes": True}], ids=str)
def test_own_encoder_and_spans_equal_the_library(model, how):
    import sentencepiece

    blob = changed(model, **({k: v for k, v in how.items() if k != "map"} | ({"precompiled_charsmap": double_array(MAPPED)} if "map" in how else {})))
    library, own = sentencepiece.SentencePieceProcessor(model_proto=blob), sentencepiece_codec.Codec(blob)
    r = random.Random(repr(how))
    texts = ["".join(r.choices("abqx the inner/<s>\t\n  ▁éñ日本語😀\x00\x07ﬁⅣ\u0301\u200d#|", k=r.randint(0, 40))) for _ in range(1500)] + ["x" * 20_000, "日本" * 3000, " " * 500, "the inner " * 2000]
    for t in texts:
        ids, starts, ends = own.encode(t)
        pieces = library.encode(t, return_type="proto").pieces
        assert ids == [p.id for p in pieces], t
        assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in pieces], t


def test_sentencepiece_refuses_other_models(model):
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto.FromString(open(model, "rb").read())
    m.trainer_spec.model_type = 1
    with pytest.raises(ValueError, match="byte-pair"):
        sentencepiece_codec.Codec(m.SerializeToString())


def test_sentencepiece_equals_library(spark, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = corpus(8) + [(900, " leading"), (901, "trailing  "), (902, "日本語 テスト"), (903, "\u0000\u0001 ctrl"), (904, "▁under ▁▁x"), (905, "😀 👍🏽é é"), (906, "<s></s><unk> <0x0A>"), (907, "\n\n  a"), (908, "ﬁ Ⅳ"), (900, " leading")]
    got = {x.doc_id: x for x in sentencepiece_codec.digests(docs_of(spark, rows), model).collect()}
    for i, t in rows:
        ids = sp.encode(t or "")
        x = got[i]
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        assert x.spanned_bytes == len((t or "").encode())
    encoded = sentencepiece_codec.encode(docs_of(spark, rows), model)
    for x in encoded.collect():
        t = dict(rows)[x.doc_id] or ""
        assert b"".join(t.encode()[a:b] for a, b in zip(x.starts, x.ends)) == t.encode()
    back = {x.doc_id: x.text for x in sentencepiece_codec.decode(encoded, model).collect()}
    assert all(back[i] == sp.decode(sp.encode(t or "")) for i, t in rows)
    assert sentencepiece_codec.digests(docs_of(spark, rows).limit(0), model).count() == 0


def double_array(entries):
    """A double-array trie and replacement block, as in a compiled character map, from prefix -> replacement."""
    values, offsets = b"", {}
    for k, v in entries.items():
        offsets[k] = len(values)
        values += v + b"\0"
    trie: dict = {}
    for k in entries:
        node = trie
        for b in k:
            node = node.setdefault(b, {})
        node[None] = offsets[k]
    units = {0: 0}
    used, bases = {0}, set()

    def place(node, at):
        labels = [b for b in node if b is not None]
        keys = labels + ([0] if None in node else [])
        base = next(b for b in range(1, 100000) if b not in bases and all((b ^ c) not in used for c in keys))
        bases.add(base)
        used.update(base ^ c for c in keys)
        offset = at ^ base
        assert offset < 1 << 21
        units[at] = units.get(at, 0) | offset << 10 | (0x100 if None in node else 0)
        if None in node:
            units[base] = node[None] | 0x80000000
        for b in labels:
            units[base ^ b] = b
            place(node[b], base ^ b)

    place(trie, 0)
    n = -(-(max(units) + 1) // 256) * 256  # whole blocks of 1024 bytes
    blob = np.array([units.get(i, 0x80000000) for i in range(n)], "<u4").tobytes()
    return len(blob).to_bytes(4, "little") + blob + values


def test_character_map_takes_the_longest_prefix():
    entries = {b"a": b"1", b"abc": b"2", "ﬁ".encode(): b"fi", b"  ": b" ", b"x": b""}
    m = sentencepiece_codec.CharMap(double_array(entries))
    r = random.Random(2)
    for _ in range(300):
        raw = "".join(r.choices(["a", "b", "c", "ﬁ", " ", "x", "é"], k=12)).encode()
        for at in range(len(raw)):
            best = max((k for k in entries if raw[at:].startswith(k)), key=len, default=None)
            assert m.longest(raw, at) == (None if best is None else (len(best), entries[best]))


def test_normalisation_keeps_origins(model):
    c = sentencepiece_codec.Codec(open(model, "rb").read())
    c.map = sentencepiece_codec.CharMap(double_array({"ﬁ".encode(): b"fi", b"\t": b" "}))
    out, origin = c.normalise("aﬁ\tb")
    assert out.decode() == "▁afi▁b" and origin.tolist() == [0, 0, 0, 0, 1, 1, 4, 4, 4, 5, 6]
    c.trim = True
    out, origin = c.normalise("  a \t b ")
    assert out.decode() == "▁a▁b" and len(origin) == len(out) + 1


# --- all together ------------------------------------------------------------------------------------------------------


#: Names that the operators use inside, in other cases too.
CLASHES = ("key", "node", "uid", "UID", "comp", "slot", "SHARD", "items", "runs", "Runs", "gone", "fp", "doc", "row", "ROW", "e", "score", "n_words", "chain", "_pl_id", "_pl_sha", "_doc", "_fp", "_gone", "_runs", "id", "rep", "first", "kept", "place")


def clashing(docs):
    return docs.withColumns({c: F.lit("clash") for c in {c.lower(): c for c in CLASHES}.values()})


def operators(spark):
    """(name, rows in -> rows out, or filtered rows in -> rows out) of every operator on documents."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id bigint, quality int")
    bench = spark.createDataFrame([(1, "some words that only one text in the tests has of all in it"), (None, None)], "item_id bigint, text string")
    model = queries.tokenizer_file()
    rows = {
        "sharding": lambda d: sharding.assign_shards(d, "doc_id"), "decontaminate": lambda d: decontaminate.judge(d, bench), "linededup": linededup.summarise, "quality": lambda d: quality.score(d, labels),
        "exactdedup": exactdedup.groups, "jaccard": lambda d: jaccard.groups(d, cells=1 << 16), "substring": substring.repeats, "sentencepiece": lambda d: sentencepiece_codec.digests(d, model),
    }
    kept = {
        "decontaminate": lambda d: decontaminate.remove(d, bench), "spans": lambda d: decontaminate.remove(d, bench, "spans"), "linededup": linededup.remove, "quality": lambda d: quality.keep(d, labels),
        "exactdedup": exactdedup.deduplicate, "jaccard": jaccard.deduplicate, "substring": substring.remove,
    }
    return rows, kept


def hard_cases(ids=lambda i: i):
    long = "word " * 100_000
    rows = [(ids(1), long), (ids(2), long), (ids(3), "a\n" * 100_000), (ids(4), "x" * 1_000_000), (None, None), (None, ""), (None, "tie of two"), (ids(5), "tie of two"), (ids(5), "tie of two"), (ids(6), "tie of two"), (ids(6), "other")]
    return rows


@pytest.mark.parametrize("kind", ["bigint", "string", "last"])
def test_hard_cases(spark, kind):
    """Nulls, empty and very long texts, ties, repeated rows, ids of another type or at the end of their range, clashing columns, empty tables."""
    ids = (lambda i: f"d{i}") if kind == "string" else (lambda i: 2**63 - 7 + i) if kind == "last" else (lambda i: i)
    data = hard_cases(ids)
    docs = clashing(spark.createDataFrame([(i, t, "en") for i, t in data], f"doc_id {'string' if kind == 'string' else 'bigint'}, text string, lang string").repartition(3))
    rows, kept = operators(spark)
    if kind != "bigint":  # those that compare ids
        rows = {k: rows[k] for k in ("decontaminate", "linededup", "exactdedup", "jaccard", "substring")}
        kept = {k: kept[k] for k in ("exactdedup", "substring")}
    for name, f in rows.items():
        got = f(docs).select("doc_id").collect()
        assert sorted(str(r[0]) for r in got) == sorted(str(i) for i, _ in data), name
    sizes = {}
    for name, f in kept.items():
        out = f(docs)
        assert out.columns == docs.columns, name
        got = out.select("doc_id", "text", "UID").collect() if "UID" in docs.columns else out.select("doc_id", "text").collect()
        sizes[name] = sorted(str(r.doc_id) for r in got)
        assert {str(r.doc_id) for r in got} <= {str(i) for i, _ in data}, name
    every = sorted(str(i) for i, _ in data)
    if kind != "bigint":
        assert sizes["substring"] == every and len(sizes["exactdedup"]) == 6
        return
    assert sizes["decontaminate"] == sizes["spans"] == sizes["linededup"] == sizes["substring"] == every
    once = sorted(map(str, [ids(1), ids(3), ids(4), None, ids(5), ids(6)]))  # of null and empty, which are equal, one
    assert sizes["exactdedup"] == once
    assert sizes["jaccard"] == sorted(map(str, [ids(1), ids(3), ids(4), None, None, ids(5), ids(6)]))  # without words each stays
    for name, f in kept.items():
        assert f(docs.limit(0)).count() == 0, name


def test_pipeline_stages_on_hard_cases(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 7)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "tie of"), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing(docs_of(spark, hard_cases()))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and 0 <= out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert {r.text for r in dict(pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path)).collect()} == {t for _, t in hard_cases() if t != "tie of two"}
    assert dict(pipeline.STAGES)["encoding"](spark, docs, str(tmp_path)).count() == docs.count()


def test_sketch_counters_take_a_byte_each():
    import numpy as np

    from plumbline.llm import frequency

    rng, cells = np.random.default_rng(1), frequency.CHUNK + 10
    counters, plain = frequency.Counters(cells), np.zeros(cells, np.uint64)
    for _ in range(50):
        at = np.concatenate([rng.integers(0, cells, 500), np.full(700, cells - 1), np.full(90, 3)])
        counters.add(at)
        np.add.at(plain, at, np.uint64(1))
    assert counters.low.nbytes == cells and plain.max() > 255
    assert (np.concatenate([counters.chunk(0), counters.chunk(1)]) == plain).all()


def test_buckets_of_longer_lines_alone_give_no_rows(spark):
    """Lines of one length that differ in one place of 300: they meet in buckets of their own length's segments only."""
    base = "the quick brown fox jumps over the lazy dog and goes on"
    lines = [base[:k % len(base)] + chr(0x4E00 + k) + base[k % len(base) + 1 :] for k in range(300)]
    docs = spark.createDataFrame([(x,) for x in lines], "text string").repartition(3)
    mask = linededup._last_bits(linededup.EDITS)
    dealt = linededup._keys(docs, 2, 20)
    compatible = lambda a, b: np.abs(a - b) <= 2
    every, met, all_path = linking.first_round(spark, dealt, compatible)
    pairs, members, path = linking.first_round(spark, dealt, compatible, lambda size, key: (size - key) & mask == 0)
    rows = lambda x: spark.read.parquet(x).count()
    assert rows(path) < rows(all_path) and 2 * members.count() <= met.count() and not pairs.subtract(every).count()
    assert not members.where(F.expr(f"(size - key) & {mask}") != 0).count() and members.select("node").distinct().count() == 300
    common.drop(spark, all_path, path)


def test_rows_of_a_large_bucket_grow_with_its_members():
    """Members that a bucket is not there for meet one that it is there for, and each other elsewhere."""
    mask = linededup._last_bits(linededup.EDITS)

    def made(n: int) -> tuple[list, set, set]:
        node = np.arange(12 * n, dtype=np.int64) * 1_000_003 + 1
        size = np.where(np.arange(12 * n) < n, 24, 25).astype(np.int32)
        key = np.full(12 * n, 24 & mask | 1 << 20, np.int64)
        batch = pa.record_batch([pa.array(key), pa.array(node), pa.array(size), pa.array(np.zeros(12 * n, np.int64))], names=["part", "node", "size", "key"])
        run = linking._bucket_pairs(lambda a, b: np.abs(a - b) <= 2, lambda size, key: (size - key) & mask == 0)
        rows = [tuple(r.values()) for out in run(iter([batch])) for r in out.to_pylist()]
        return [r[2:] for r in rows if r[0] == 0], {r[2] for r in rows if r[0] == 1}, set(node[:n].tolist())

    counts = []
    for n in (50, 100, 200):
        pairs, members, own = made(n)
        assert all(x in own or y in own for x, y in pairs) and len(members) == 12 * n
        # all meet one head, which is one of the bucket's own
        assert len({x for pair in pairs for x in pair}) == 12 * n and max(sum(h in p for p in pairs) for h in own) >= 12 * n - 1
        counts.append(len(pairs))
    assert counts[0] <= 15 * 50 + 10 and counts[1] <= 2 * counts[0] + 10 and counts[2] <= 2 * counts[1] + 10


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_classes_of_unequal_lengths(spark, seed):
    """Chains of edits that lengthen and shorten lines, some in large buckets, against all pairs."""
    r = random.Random(seed)
    def edited(x):
        for _ in range(r.randint(0, 2)):
            at, c = r.randrange(len(x) + 1), r.choice("abcxyz")
            x = r.choice([x[:at] + c + x[at:], x[:at] + x[at + 1 :], x[:at] + c + x[at + 1 :]])
        return x
    lines = ["".join(r.choices("abc ", k=k)) + "." for k in (19, 20, 21, 30, 45)]
    for _ in range(160):
        lines.append(edited(r.choice(lines)))
    lines = sorted(set(lines))
    found = {x["node"]: x["comp"] for x in linededup.near_classes(spark.createDataFrame([(x,) for x in lines], "text string").repartition(4)).collect()}
    nodes = {x: linededup.line_name(x)[0] for x in lines}
    links = [(a, b) for a, b in itertools.combinations(lines, 2) if min(len(a), len(b)) >= 20 and linededup.distance_within(a, b, 2)]
    comp = {x: x for x in lines}
    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for a, b in links:
        comp[root(a)] = root(b)
    same = lambda of: {frozenset(x for x in lines if of(x) == c) for c in {of(y) for y in lines}}
    assert same(lambda x: found.get(nodes[x], x)) == same(root)


@pytest.mark.parametrize("hits", [1, 7, 1 << 20])
def test_shared_values_are_counted_in_steps(monkeypatch, hits):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "HITS", hits)
    r = random.Random(hits)
    a, b = ([sorted(r.sample(range(40), r.randint(0, 12))) for _ in range(n)] for n in (23, 17))
    count = jaccard._shared_with(pa.array(a, pa.list_(pa.int32())))
    assert count(pa.array(b, pa.list_(pa.int32()))).tolist() == [[len(set(x) & set(y)) for y in a] for x in b]
    assert count(pa.array([[], []], pa.list_(pa.int32()))).tolist() == [[0] * 23] * 2


def test_near_copies_of_a_large_bucket_take_bounded_memory():
    """512 members and 1,500 queries that share 60 values: 46 million of them, 1.8 GB if held at once."""
    import tracemalloc

    import pyarrow as pa

    rows = lambda n: pa.array([list(range(60))] * n, pa.list_(pa.int32()))
    count, members = jaccard._shared_with(rows(1500)), rows(512)
    tracemalloc.start()
    found = count(members)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == 60).all() and peak < 150e6


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_long_lines_meet_in_few_buckets(edits):
    """From LONG characters on; and the shorter of two near lines is entered under its own segments where they meet."""
    r = random.Random(edits)
    plan, anchored, last = linededup._plans(edits), linededup._anchored(edits), linededup._last_bits(edits)
    if edits == 2:
        assert [len(plan(n)) for n in (200, 1_000, 50_000)] == [4] * 3 and max(len(plan(n)) for n in range(66, 5_000)) <= 8
    for _ in range(1500):
        a = "".join(r.choices("ab", k=r.choice([r.randint(60, 75), r.randint(76, 200)])))
        b = list(a)
        for _ in range(r.randint(0, edits)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = r.choices("ab", k=r.randint(0, 1))
        a, b = sorted((a, "".join(b)), key=len)
        met = set.intersection(*({(seed, bits & last, x[at : at + size]) for seed, bits, at, size in plan(len(x))} for x in (a, b)))
        keys = np.array([1 << 20 | bits for _, bits, _ in met], np.int64)
        assert anchored(np.full(len(keys), len(a), np.int32), keys).any(), (a, b)


def test_distance_of_long_lines_takes_few_steps(monkeypatch):
    steps, plain = [], linededup._alike
    monkeypatch.setattr(linededup, "_alike", lambda *a: steps.append(1) or plain(*a))
    text = "".join(random.Random(2).choices("abcd ", k=200_000))
    assert linededup.distance_within("x" + text, text + "y", 2) and not linededup.distance_within("x" + text + "z", "y" + text + "uv", 2)
    assert len(steps) <= 18


def test_components_take_few_tables(spark, monkeypatch):
    """Edges of one node take one round, and a chain in many files as many as its length has bits, at most."""
    made, plain = [], common.stage
    monkeypatch.setattr(linking.common, "stage", lambda *a, **b: made.append(a[2]) or plain(*a, **b))
    r = random.Random(4)
    for edges, most in (([(5, i) for i in range(6, 300)], 2), ([(i, i + 1) for i in range(2000)], 3 * 11)):
        r.shuffle(edges)
        made.clear()
        got, paths = linking.components_of(spark, spark.createDataFrame(edges, "x bigint, y bigint").repartition(8))
        assert {x.comp for x in got.collect()} == {min(map(min, edges))} and got.count() == len(edges) + 1
        assert len(made) <= most, made
        common.drop(spark, *paths)
