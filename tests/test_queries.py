"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import matchengine.queries  # noqa: F401
from matchengine.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, list) else v


def values(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(norm(r[c]) for c in names) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = values(QUERIES[name](spark, SF).toArrow())
    if name in ORACLE_SQL:
        assert got == values(duck.execute(ORACLE_SQL[name]).to_arrow_table())


def test_driver_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
