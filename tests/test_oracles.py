"""Every registered query with an oracle equals DuckDB's answer on the smallest tables."""

import math
import os

import pytest

from lacuna.plans import registry

DATA = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t[:-8]} as select * from read_parquet('{DATA}/{t}')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype == bool:
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype") or type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


def test_bootstraps_draw_as_often_as_the_survey_says():
    assert "range(1, 51)" in ORACLES["pr12_bootstrap_datasets"] and "range(1, 1001)" in ORACLES["ev4_bootstrap_ci"]
