import pytest
from pyspark.sql import functions as F

from bibspark.operators import packed as P

SCHEMA = "rec_id long, lib string, field_name string, field_map map<string,string>"


def rows(spark, values):
    return spark.createDataFrame([(i, "l", "clash", None if v is None else dict(v)) for i, v in enumerate(values)], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    words = ["ocean", "kelp", "ice edge", "land/sea mask", "review", "sea-level"]
    kw = [", ".join(words[i % 6 :] + words[: i % 3]) for i in range(60)] + ["; ".join(words[: 2 + i % 4]) for i in range(40)] + words * 8 + ['"snow, wet"; ocean; kelp'] * 5 + ['"snow, wet", review'] * 5
    au = ["Smith, J. and Doe, Jane"] * 30 + ["John Smith; Jane Doe; A. Person"] * 20 + ["Smith, John"] * 30 + ["J. Smith and Jane Doe and K. Other"] * 30
    fi = [":files/a b.pdf:pdf;files/c.pdf:pdf"] * 20 + ["files/x, y and z.pdf:pdf"] * 20 + ["files/q.pdf"] * 40 + ["Full Text:files/k: m.pdf:pdf, files/n.pdf"] * 3 + [":files/1.pdf:pdf, :files/2.pdf:pdf"] * 10
    return rows(spark, [{"keywords": k} for k in kw] + [{"author": a} for a in au] + [{"file": f} for f in fi] + [{}, None, {"keywords": ""}, {"keywords": " , ;"}, {"author": " "}])


@pytest.fixture(scope="module")
def codes(corpus):
    return P.fit(corpus, P.bib_fields("file", "keywords", "author"))


@pytest.mark.parametrize(
    "field, value, items",
    [
        ("keywords", "ocean, kelp, review", ["ocean", "kelp", "review"]),
        ("keywords", "land/sea mask; ocean", ["land/sea mask", "ocean"]),
        ("keywords", "land/sea mask", ["land/sea mask"]),
        ("keywords", 'kelp, "snow, wet", ocean', ["kelp", "snow, wet", "ocean"]),
        ("keywords", "ocean,, kelp,", ["ocean", "kelp"]),
        ("keywords", "ocean, ocean", ["ocean", "ocean"]),
        ("keywords", None, []),
        ("keywords", "", []),
        ("author", "Smith, J. and Doe, Jane", ["Smith, J.", "Doe, Jane"]),
        ("author", "Smith, John", ["Smith, John"]),
        ("author", "John Smith; Jane Doe", ["John Smith", "Jane Doe"]),
        ("author", "J. Smith and {Society for Ice and Snow}", ["J. Smith", "Society for Ice and Snow"]),
        ("file", ":files/a b.pdf:pdf;files/c.pdf:pdf", ["files/a b.pdf", "files/c.pdf"]),
        ("file", "files/x, y and z.pdf:pdf", ["files/x, y and z.pdf"]),
        ("file", r"files/a\; b.pdf:pdf;files/c.pdf:pdf", ["files/a; b.pdf", "files/c.pdf"]),
        ("file", '"files/a; b.pdf";files/c.pdf', ["files/a; b.pdf", "files/c.pdf"]),
        ("file", "::pdf", []),
    ],
)
def test_split(codes, field, value, items):
    assert P.clean(field, codes.split(field, value)) == items


def test_rows(spark, corpus, codes):
    out = P.split_fields(corpus, ["rec_id", "lib"], P.bib_fields("keywords"), codes, least=2)
    assert out.columns == ["rec_id", "lib", "field_name", "pos", "item"]
    got = out.groupBy("rec_id").agg(F.max("pos").alias("m"), F.count("*").alias("n")).where("m <> n or n < 2")
    assert out.count() > 100 and got.count() == 0


def test_empty_table(spark):
    empty = rows(spark, [])
    codes = P.fit(empty, P.bib_fields())
    assert P.split_fields(empty, ["rec_id"], P.bib_fields(), codes).count() == 0


def test_long_value(codes):
    value = ", ".join(["ocean"] * 20_000)
    assert len(codes.split("keywords", value)) == 20_000


@pytest.mark.parametrize("a, b", [("a//b/./c", "a/b/c"), ("tmp/../x.pdf", "x.pdf"), ("A/b.PDF", "A/b.PDF"), ("./", ""), ("../x", "../x"), ("a b/ c", "a b/ c")])
def test_resolve(a, b):
    assert P.resolve_path(a) == b


def test_codes_depend_on_shares():
    """Ten times the counts give the same codes, from HEAVY items on."""
    counts = {("keywords", "=kelp"): 900, ("keywords", "=ocean, kelp"): 40, ("author", "~X, X"): 800, ("author", "@A;>A"): 50, ("author", "@A;>;"): 7}
    totals = {("keywords", "="): 60_000, ("author", "~"): 90_000, ("author", "@"): 25_000}
    more = lambda d: {k: 10 * n for k, n in d.items()}
    a, b = P.Codes(counts, totals), P.Codes(more(counts), more(totals))
    assert a.bits == pytest.approx(b.bits) and a.escape == b.escape
    for kinds in ("A", ";", "A;"):
        assert a.declared("author", "A;", kinds) == pytest.approx(b.declared("author", "A;", kinds))
