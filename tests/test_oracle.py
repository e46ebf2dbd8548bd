"""Every query that has SQL gives the same rows in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [q for q in entry.oracle_sql() if not q.startswith("op") and q != "pipeline"]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", CORE)
def test_same_rows(spark, sf, duck, tmp_path, name):
    out = str(tmp_path / "out")
    entry.queries()[name](spark, sf).write.parquet(out)
    ours = duck.sql(f"SELECT * FROM '{out}/*.parquet'").df()
    theirs = duck.sql(entry.oracle_sql()[name]).df()
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_sql_run(spark, sf):
    for name in ("curated_by_type", "greedy_split", "scenario_plan", "synthetic_records", "metrics_comparison", "ovr_logreg"):
        assert entry.queries()[name](spark, sf).count() > 0, name


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists("/root/testdata/sf0.001")
