"""Results kept up to date by streams: late and repeated events, restarts, batches run again."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from plumbline.operators import metrics, testevents
from plumbline.streaming import kept

EVENTS = "path string, seq bigint, Time timestamp, Action string, Package string, Test string, Elapsed double, Output string"


def some_events(n=300, seed=1):
    r = random.Random(seed)
    return [{"path": "p", "seq": i, "Time": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z", "Action": r.choice(["run", "pass", "fail", "output", "skip" if i % 40 == 0 else "run"]), "Package": "q", "Test": r.choice(["", "A", "B", "C/x", "C/y", f"T{i % 11}"]), "Elapsed": r.random(), "Output": "o\n"} for i in range(n)]


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(e) for e in rows) + "\n")


def plain(spark, rows):
    df = spark.createDataFrame([json.dumps(e) for e in rows], "string").select(F.from_json("value", EVENTS).alias("e")).select("e.*")
    return sorted((r.package, r.test, r.passed, r.skipped, r.elapsed, r.first_seq) for r in testevents.fold_events(df.drop("path")).collect())


def stream(spark, folder, at_once=1):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", at_once).json(str(folder))


def got(spark, folder):
    return sorted((r.package, r.test, r.passed, r.skipped, r.elapsed, r.first_seq) for r in kept.read_verdicts(spark, str(folder)).collect())


def test_verdicts_with_late_and_repeated_events_and_a_restart(spark, tmp_path):
    rows = some_events()
    parts = [rows[200:], rows[:120], rows[100:210]]  # the latest first, and some twice
    for i, p in enumerate(parts[:2]):
        put(tmp_path / "in", f"{i}.json", p)
    kept.keep_verdicts(stream(spark, tmp_path / "in"), str(tmp_path / "out")).awaitTermination(200)
    assert got(spark, tmp_path / "out") == plain(spark, parts[0] + parts[1])
    put(tmp_path / "in", "2.json", parts[2])
    kept.keep_verdicts(stream(spark, tmp_path / "in"), str(tmp_path / "out")).awaitTermination(200)
    assert got(spark, tmp_path / "out") == plain(spark, rows)
    states = [int(n.split("=")[1]) for n in kept.scratch.children(spark, f"{tmp_path}/out/batches") if n.startswith("batch=")]
    assert len(states) >= 3


def test_state_goes_after_the_watermark(spark, tmp_path):
    """A test whose time has passed is not in the store any more; its result stays, and an event that comes too late changes nothing."""
    def one(i, t, action, test):
        return {"path": "p", "seq": i, "Time": t, "Action": action, "Package": "q", "Test": test, "Elapsed": 1.0}

    for i, e in enumerate([one(1, "2024-01-01T00:00:00Z", "pass", "A"), one(2, "2024-01-03T00:00:00Z", "pass", "B"), one(3, "2024-01-03T01:00:00Z", "fail", "B"), one(4, "2024-01-01T00:00:01Z", "fail", "A")]):
        put(tmp_path / "in", f"{i}.json", [e])
        q = kept.keep_verdicts(stream(spark, tmp_path / "in"), str(tmp_path / "out"), "1 hour")
        q.awaitTermination(200)
        total = sum(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"][-1:] if p is q.recentProgress[-1])
    assert {t: passed for _, t, passed, *_ in got(spark, tmp_path / "out")} == {"A": True, "B": False}
    assert total <= 2  # B's state and its timer at most


def test_averages_and_matrix_equal_those_of_tables(spark, tmp_path):
    r = random.Random(2)
    rows = [{"config": r.choice(["full", "no-cache", "x"]), "repo": r.choice("ab"), "seq": i, "gen": i % 7, "cov": r.choice([None, r.random()])} for i in range(200)]
    schema = "config string, repo string, seq bigint, gen bigint, cov double"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for i in range(5):
        put(tmp_path / "in", f"{i}.json", rows[i * 40 : i * 40 + 40])
    kept.keep_averages(read(), str(tmp_path / "avg"), ("gen",), ("cov",)).awaitTermination(200)
    kept.keep_matrix(read(), str(tmp_path / "mat"), "cov").awaitTermination(200)
    df = spark.createDataFrame([json.dumps(e) for e in rows], "string").select(F.from_json("value", schema).alias("e")).select("e.*")
    averages = lambda: [(x.config, x.gen, round(x.cov, 9)) for x in kept.read_averages(spark, str(tmp_path / "avg"), ("gen",), ("cov",)).collect()]
    want = [(x.config, x.gen, round(x.cov, 9)) for x in metrics.average_per_config(df, ("gen",), (), ("cov",)).collect()]
    assert averages() == want
    matrix = lambda: sorted(map(tuple, kept.read_matrix(spark, str(tmp_path / "mat"), ["full", "x"]).collect()))
    cells = sorted(map(tuple, metrics.build_matrix(df, "cov", ["full", "x"]).collect()))
    assert matrix() == cells

    # the last batch again, as after a failure before its commit
    import os
    commits = tmp_path / "avg/checkpoint/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for n in (f"{last}", f".{last}.crc"):
        (commits / n).unlink(missing_ok=True)
    kept.keep_averages(read(), str(tmp_path / "avg"), ("gen",), ("cov",)).awaitTermination(200)
    assert averages() == want

    merged = lambda df: df.groupBy("config").agg(F.sum("gen").alias("gen"), F.sum("cov_sum").alias("cov_sum"), F.sum("cov_n").alias("cov_n"))
    assert kept.compact(spark, str(tmp_path / "avg"), merged, "config string, gen bigint, cov_sum double, cov_n bigint") == 4 and averages() == want
    put(tmp_path / "in", "9.json", rows[:3])
    kept.keep_averages(read(), str(tmp_path / "avg"), ("gen",), ("cov",)).awaitTermination(200)
    assert sum(x[1] for x in averages()) == sum(x[1] for x in want) + sum(e["gen"] for e in rows[:3])
