import datetime as dt

import pytest
from pyspark.sql import functions as F

from bibspark.operators import orphans as O

T = lambda d: dt.datetime(2024, 1, d)
REFS = "id long, lib string, path string, added_ts timestamp, file_id long"
TARGETS = "file_id long, lib string, path string, added_ts timestamp, deleted_ts timestamp"


@pytest.fixture(scope="module")
def tables(spark):
    refs = [(1, "a", "x", T(5), 0), (2, "a", "y", T(5), 0), (3, "a", "z", T(5), 0), (4, "a", "w", T(5), 0), (5, None, "x", T(5), 0), (6, None, "q", T(5), 0), (7, "a", None, T(5), 0), (8, None, None, T(5), 0), (9, "a", "z", None, 0), (1, "a", "x", T(5), 0)]
    targets = [(1, "a", "x", T(1), None), (1, "a", "x", T(1), None), (2, "a", "y", T(1), T(2)), (3, "a", "z", T(9), None), (4, "b", "w", T(1), None), (5, "a", None, T(1), None), (6, "a", "z", T(9), T(10))]
    return spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS)


def found(tables, match):
    r, t = tables
    o = O.orphans(r, t, ["lib", "path"], live=F.col("deleted_ts").isNull(), since="added_ts", asked_at="added_ts", match=match)
    assert o.columns == [*r.columns, "reason"]
    return sorted((x["id"], x["reason"]) for x in o.collect())


def test_simple(tables):
    assert found(tables, "simple") == [(2, "deleted"), (3, "late"), (4, "missing")]


def test_partial(tables):
    assert found(tables, "partial") == [(2, "deleted"), (3, "late"), (4, "missing"), (6, "missing")]


def test_full(tables):
    assert found(tables, "full") == [(2, "deleted"), (3, "late"), (4, "missing"), (5, "mixed_null"), (6, "mixed_null"), (7, "mixed_null")]


def test_empty(spark, tables):
    r, t = tables
    args = dict(live=F.col("deleted_ts").isNull(), since="added_ts", asked_at="added_ts")
    assert O.orphans(r.limit(0), t, ["lib", "path"], **args).count() == 0
    none = O.orphans(r, t.limit(0), ["lib", "path"], **args)
    assert {x["reason"] for x in none.collect()} == {"missing"}


def test_bad_match(tables):
    with pytest.raises(ValueError):
        found(tables, "loose")
