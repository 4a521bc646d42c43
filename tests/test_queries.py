"""Registered queries against their SQL. DEPTHLOG_ALL=1 runs every one, else a spread of them."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SPREAD = ["well_table", "feature_table", "class_report", "overall_metrics", "well_kappa", "rolling_accuracy", "value_runs", "curve_summary",
          "bed_thickness", "grid_cells", "split_attach", "label_diagnostics", "threshold_sweep", "gap_rows"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def cell(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    return repr(float(v) + 0.0) if hasattr(v, "__float__") and not (isinstance(v, float) and math.isnan(v)) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(entry.oracle_sql()) if os.environ.get("DEPTHLOG_ALL") else SPREAD)
def test_query_agrees_with_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*cols).collect())
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in res.fetchall())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 120
