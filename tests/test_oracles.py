"""Every query against its SQL, run by DuckDB on the same files."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from kgloom import queries as registry

QUERIES, ORACLES = registry.load_all()
SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(names).collect()), key=repr)
    assert got, "an empty result proves nothing"
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert sorted(rel.columns) == names
        at = [rel.columns.index(n) for n in names]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_a_changed_result_is_noticed(spark, duck):
    """The comparison isn't vacuous: another threshold gives other rows than the SQL."""
    from pyspark.sql import functions as F

    from kgloom.operators import chunking

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {tuple(r) for r in chunking.packed(docs, "source", "doc_id", min_tokens=60).select("doc_id", F.col("pack"), "pack_pos").collect()}
    want = {(r[0], r[2], r[3]) for r in duck.sql(f"SELECT doc_id, source, pack, pack_pos FROM ({ORACLES['pack_short_docs']})").fetchall()}
    assert got != want
