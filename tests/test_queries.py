"""Every registered query runs on the smallest tables and, where it has an SQL twin, gives the same rows."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from probata.plans import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(map(plain, v))
    if hasattr(v, "item"):
        v = v.item()
    if v is None or type(v).__name__ in ("NAType", "NaTType") or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{float(v):.9g}") if isinstance(v, int | float) and not isinstance(v, bool) else v


def rows(df):
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE:
        want = db.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark, sf):
    got = {(r.c, r.support) for r in entry.entry(spark).collect()}
    assert len(got) == 4


def test_golden_gate_counts(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables here")
    got = {(r.c, r.support, r.retained, r.hits, r.errors, r.errors_referred) for r in QUERIES["agg_referral_cls"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {(0, 151, 49, 49, 29, 29), (1, 144, 47, 47, 25, 25), (2, 93, 23, 22, 23, 22), (3, 112, 27, 25, 24, 22)}


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
