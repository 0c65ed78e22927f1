"""Every query against its SQL on the smallest tables, and the driver's contract."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from plumbline.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    def text(x):
        return "NULL" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return list(frame.columns), sorted(tuple(text(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalogue.queries()[name](spark, SF).toPandas()) == rows(duck.sql(catalogue.oracle_sql()[name]).df())


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_used_types_reads_all_references(spark, monkeypatch):
    from plumbline.operators import graphs

    seen, whole = [], graphs.used_types
    monkeypatch.setattr(graphs, "used_types", lambda refs, *rest: seen.append(refs) or whole(refs, *rest))
    catalogue.queries()["q29_used_types"](spark, SF)
    assert seen[0].count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_changed_functions_over_whole_files(spark, tmp_path):
    """q95 and its SQL against the lines of long and short files, counted one by one; a file of one part has no fortieth line."""
    import duckdb

    from plumbline.plans import gosources

    parts = [(k, "Brand#11", 1) for k in range(60)] + [(k, "Brand#12", 2) for k in range(60, 67)] + [(67, "Brand#13", 3)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want, most = [], 0
    for file, value in gosources._sources(spark, str(tmp_path)).collect():
        name = None
        for line, text in enumerate(value.split("\n"), 1):
            name = text.split(") ")[1].split("(")[0] if text.startswith("func ") else name
            if name and line % 40 == 0:
                want.append((file, name, 1))
                most = max(most, line)
            name = None if text == "}" else name
    assert most > 199  # where an earlier version ended
    assert sorted(map(tuple, catalogue.queries()["q95_changed_functions"](spark, str(tmp_path)).collect())) == sorted(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(con.execute(catalogue.oracle_sql()["q95_changed_functions"]).fetchall()) == sorted(want)
