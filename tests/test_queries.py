"""Every registered query of the evaluation operators gives the rows of its SQL."""

import datetime
import math

import duckdb
import pytest

from evalframe import plans
from evalframe.plans.base import TABLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    if name not in plans.ORACLES:
        return
    cur = db.execute(plans.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = [tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall()]
    got = [tuple(plain(v) for v in r) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
