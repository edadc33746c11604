"""Every registered query of the core against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from codeloom import catalogue

from conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def canon(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, float):
            return repr(round(v, 6))
        return str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert canon(rows, df.columns) == canon(want.fetchall(), want.columns)


def test_most_queries_have_a_twin():
    assert len(catalogue.oracle_sql()) >= 75
    assert catalogue.FLAGSHIP in catalogue.queries()
