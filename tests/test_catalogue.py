"""Every query against DuckDB on the smallest tables, and the entry module's contract."""

import math
from pathlib import Path

import duckdb
import pytest

from locuspark.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    order = [want.columns.index(n) for n in names]
    left = sorted(tuple(plain(r[n]) for n in names) for r in got.collect())
    right = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert left == right


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_needs_the_llm_folder():
    root = Path(__file__).parents[1]
    for path in (root / "locuspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "locuspark.llm" not in path.read_text()
