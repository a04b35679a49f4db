"""Every registered query equals its DuckDB text (rows, names, values) at sf0.001,
the way the driver checks sf0.01."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from spanmask.plans.queries import registered
from tools.compare import TABLES, digest

KEYS = sorted(registered())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(E.oracle_sql()) and set(KEYS) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.sql(E.oracle_sql()[key])
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(res.columns)
    assert len(srows) == len(drows)
    assert digest(srows, sdf.columns) == digest(drows, res.columns)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 200
    assert df.columns == ["doc_id", "text", "regex_hits", "model_hits", "mode", "num_chunks"]
