"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from fluxalign import catalog

from .conftest import TINY


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    try:
        return float(v)
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{TINY}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


#: Those that compute comparisons anew from others that are compared here.
SLOW = {"cross_validated", "chart_rows", "report_findings", "stop_decision", "reader_subsets", "setup_diagnostics_from_files", "predictions_from_files"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, TINY)
    names = sorted(got.columns)
    cur = duck.execute(catalog.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    want = sorted((tuple(plain(r[cols.index(n)]) for n in names) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=str) == want


def test_every_query_has_sql_but_the_fitted_one():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"cross_validated"}
