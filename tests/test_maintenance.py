import posixpath

import pytest
from pyspark.sql import functions as F

from bibspark.operators import maintenance as U

SCHEMA = "rec_id long, lib string, entry_type string, cite_key string, field_map map<string,string>"


@pytest.mark.parametrize("path", ["a/b", "./a//b/../c", "/../a/./b/", "../x/../../y", "/a/../../b", "a/.."])
def test_normal_path(spark, path):
    got = spark.createDataFrame([(path,)], "x string").select(U.normal_path(F.col("x"))).collect()[0][0]
    want = posixpath.normpath(path)
    assert got == ("" if want == "." else want)


def test_paths(spark):
    d = spark.createDataFrame([(["a/../b.pdf", "/x//y"], "/r")], "p array<string>, r string")
    assert d.select(U.rebase(F.col("p"), F.col("r"))).collect()[0][0] == ["/r/b.pdf", "/x/y"]
    d = spark.createDataFrame([("/a/b", "/a"), ("/ab", "/a"), ("/a", "/a/"), ("/a/../b", "/a")], "c string, p string")
    assert [r[0] for r in d.select(U.under(F.col("c"), F.col("p"))).collect()] == [True, False, True, False]


@pytest.mark.parametrize("text, doi", [("<dc:identifier>doi:10.1234/b</dc:identifier><prism:doi>10.1234/a</prism:doi>", "10.1234/a"), ("<pdfx:doi>10.1234/bbb</pdfx:doi><dc:identifier>doi:10.1234/aaa</dc:identifier>", "10.1234/aaa"), ("<dc:identifier>urn:uuid:77</dc:identifier>", None), ("<PDFX:DOI>10.1234/X(1)</PDFX:DOI>", "10.1234/X(1)"), ("Subject DOI: 10.1234/abc x", None), ("none", None), (None, None)])
def test_metadata_doi(spark, text, doi):
    assert spark.createDataFrame([(text,)], "x string").select(U.metadata_doi(F.col("x"))).collect()[0][0] == doi


def test_strip_markup(spark):
    text = "\x1b[1mbold\x1b[0m \x1b]8;;http://x\x1b\\link\x1b]8;;\x1b\\"
    assert spark.createDataFrame([(text,)], "x string").select(U.strip_markup(F.col("x"))).collect()[0][0] == "bold link"


def test_fix_entries(spark):
    rows = [(1, "l", "a", "k", {"author": "Jo Doe", "doi": "https://doi.org/10.1234/abcd"}), (2, "l", "a", "1k", {"author": "Doe, J", "doi": "junk", "year": "2001"}), (3, "l", "a", None, {"author": "Doe, J", "year": "2001"})]
    got = [tuple(r) for r in U.fix_entries(spark.createDataFrame(rows, SCHEMA)).orderBy("rec_id").collect()]
    assert got == [(1, "Doe, Jo", "10.1234/abcd", "k", False), (2, "Doe, J", "junk", "1k", True), (3, "Doe, J", "", "doe2001", False)]


def test_snapshot(spark):
    d = spark.createDataFrame([(1, "l", "a", "k", {"t": "1"}), (2, "l", "a", "m", {"t": "2"}), (3, "e", "a", "k", {})], SCHEMA)
    empty = spark.createDataFrame([], "lib string, version_no long, fingerprint string")
    one = U.snapshot(d, empty)
    log = spark.createDataFrame(one.collect(), one.schema)
    assert {(r["lib"], r["version_no"]) for r in log.collect()} == {("l", 1), ("e", 1)}
    assert U.snapshot(d.orderBy(F.desc("rec_id")), log).count() == 0
    changed = d.withColumn("cite_key", F.when(F.col("rec_id") == 2, "z").otherwise(F.col("cite_key")))
    assert [(r["lib"], r["version_no"]) for r in U.snapshot(changed, log).collect()] == [("l", 2)]


def test_lookups_and_moves(spark):
    k = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    s1, s2 = spark.createDataFrame([("a", "1")], "k string, v string"), spark.createDataFrame([("a", "2"), ("b", "3")], "k string, v string")
    assert {tuple(r) for r in U.first_found(k, "k", [s1, s2], "v").collect()} == {("a", "1"), ("b", "3"), ("c", None)}
    assert {tuple(r) for r in U.merge_cache(s1, s2, "k", "v").collect()} == {("a", "1"), ("b", "3")}
    moves = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c"), ("a", "n"), ("x", "n")], "source string, target string")
    listing = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "path string, sha256 string")
    assert {tuple(r) for r in U.move_plan(moves, listing).collect()} == {("a", "a", "same"), ("a", "b", "drop_source"), ("a", "c", "clash"), ("a", "n", "move"), ("x", "n", "missing")}


def test_decide(spark):
    d = spark.createDataFrame([(i, "l", "a", "k", {"title": "x"} if i == 2 else {}) for i in range(1, 5)], SCHEMA).withColumn("g", F.when(F.col("rec_id") < 4, 1).otherwise(2))
    got = lambda a: {r["rec_id"]: r["fate"] for r in U.decide(d, spark.createDataFrame([(1, a)], "g int, action string"), "g").collect()}
    assert got("merge") == {1: "dropped", 2: "merged", 3: "dropped", 4: "kept"}
    assert got("delete") == {1: "dropped", 2: "dropped", 3: "dropped", 4: "kept"}
