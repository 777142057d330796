"""Every registered query of the core library against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from millrace.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, db, name):
    got = catalog.queries()[name](spark, DATA)
    want = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    rows = [tuple(cell(r[c]) for c in order) for r in got.collect()]
    wanted = [tuple(cell(r[names.index(c)]) for c in order) for r in want.fetchall()]
    assert sorted(rows) == sorted(wanted)
