"""The registered corpus queries and the pipeline on the smallest tables, held against SQL where there is some."""

import math
import os

import duckdb
import pytest

import corpus_pipeline
from probata.llm.oracle import ORACLE
from probata.llm.queries import QUERIES

TABLES = "documents embeddings pages benchmark labels".split()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or type(v).__name__ in ("NAType", "NaTType") or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{float(v):.9g}") if isinstance(v, int | float) and not isinstance(v, bool) else v


def rows(df):
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in ORACLE:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(os.path.join(sf, "documents.parquet"))
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
        assert 0.5 * before <= docs.count() <= before
    last = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, last.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
