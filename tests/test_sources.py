import datetime as dt

from bibspark.sources import bibtex as X
from bibspark.streaming import ingest

TEXT = """
@comment{nothing}
@string{jn = "Journal"}
@article{Key1,
  title = {A {Nested {Title}}},
  author = "Doe, J. and {\\"O}st, K",
  year = 2013, month = jan,
  journal = jn # { of Tests},
  title = {second},
}
@book{k2, publisher = {Copernicus {GmbH}}}
@misc{k3}
"""


def test_parse():
    got = list(X.parse(TEXT))
    assert [g[:2] for g in got] == [("article", "Key1"), ("book", "k2"), ("misc", "k3")]
    assert got[0][2] == {"title": "A {Nested {Title}}", "author": 'Doe, J. and {\\"O}st, K', "year": "2013", "month": "jan", "journal": "Journal of Tests"}
    assert got[1][2] == {"publisher": "Copernicus {GmbH}"} and got[2][2] == {}
    assert list(X.parse("")) == [] and list(X.parse("no entries @ all")) == []


def test_sources_and_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my.bib").write_text(TEXT)
    (tmp_path / "in" / "empty.bib").write_text("")
    spark.dataSource.register(X.BibTeXSource)
    a = spark.read.format("bibtex").load(str(tmp_path / "in"))
    b = X.read_bibtex(spark, str(tmp_path / "in"))
    rows = lambda d: sorted((r["lib"], r["seq"], r["entry_type"], r["cite_key"], tuple(sorted(r["field_map"].items()))) for r in d.collect())
    assert rows(a) == rows(b) and len(rows(a)) == 3
    X.write_bibtex(b, str(tmp_path / "out"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect())
    assert [g[1:] for g in X.parse(text)] == [g[1:] for g in X.parse(TEXT)]


def test_scan(spark, tmp_path):
    for p in ("a/x.PDF", "a/.a.bib", "b/y.bib", ".hid/z.pdf", "_skip/z.pdf", "n.txt"):
        f = tmp_path / "root" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    got = {(r["name"], r["kind"], r["bundle"]) for r in X.scan_directory(spark, str(tmp_path / "root")).collect()}
    assert {("x.PDF", "pdf", True), ("y.bib", "bib", False)} <= got and not any(g[0] == "z.pdf" for g in got)


def test_links(spark):
    d = spark.createDataFrame([("https://a.b/c/p.html", '<a href="x.bib">1</a><a class=q href="/y.bib">2</a><a href="https://z/w.bib">3</a><a href="n.pdf">4</a>'), ("https://a.b/", None)], "u string, h string")
    assert {r["link"] for r in X.bibtex_links(d, "u", "h").collect()} == {"https://a.b/c/x.bib", "https://a.b/y.bib", "https://z/w.bib"}


def test_stream(spark, tmp_path):
    t = lambda n: dt.datetime(2024, 1, n)
    src, table = str(tmp_path / "src"), str(tmp_path / "table")
    put = lambda rows: spark.createDataFrame(rows, ingest.SCHEMA).coalesce(1).write.mode("append").parquet(src)
    put([("l", 1, "article", "k", {"a": "1"}, t(1)), ("l", 2, "misc", "m", None, t(1))])
    ingest.start(spark, src, table, str(tmp_path / "ck")).awaitTermination()
    put([("l", 3, "book", "k", {"a": "2", "b": "3"}, t(2))])
    ingest.start(spark, src, table, str(tmp_path / "ck")).awaitTermination()
    got = {r["cite_key"]: (r["entry_type"], r["field_map"]) for r in spark.read.parquet(f"{table}/v=1").collect()}
    assert got == {"k": ("article", {"a": "1", "b": "3"}), "m": ("misc", {})}
