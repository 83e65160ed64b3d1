"""Every query runs; those with SQL give DuckDB's rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from bibspark.plans import core_queries, reference_queries

QUERIES = core_queries.QUERIES | reference_queries.QUERIES
SQL = core_queries.SQL | reference_queries.SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(df: pd.DataFrame) -> list:
    cell = lambda v: "" if v is None or v is pd.NA or v is pd.NaT or v != v else str(int(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["rec_id", "file_path", "reason"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_p1_by_hand(spark, sf):
    """Against a plain replay in Python over the small tables."""
    from bibspark.plans.core_queries import file_references, p1_found
    from bibspark.tables import read

    live, every = {}, set()
    for r in read(spark, sf, "lib_file").collect():
        every.add((r["lib"], r["file_path"]))
        if r["deleted_ts"] is None:
            live.setdefault((r["lib"], r["file_path"]), []).append(r["added_ts"])
    want = set()
    for r in file_references(read(spark, sf, "bib_entry")).collect():
        k = (r["lib"], r["file_path"])
        if k not in every:
            want.add((r["rec_id"], k[1], "missing"))
        elif k not in live:
            want.add((r["rec_id"], k[1], "deleted"))
        elif min(live[k]) > r["added_ts"]:
            want.add((r["rec_id"], k[1], "late"))
    assert {tuple(r) for r in p1_found(spark, sf).collect()} == want
