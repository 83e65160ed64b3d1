import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibspark.functions import bib as B
from bibspark.functions.fuzzy import common_subsequence, token_set_ratio
from bibspark.functions.latex import to_latex, to_unicode


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).collect()[0]["y"]


@pytest.mark.parametrize(
    "text, doi",
    [
        ("see doi:10.5194/bg-8-515-2011 and more", "10.5194/bg-8-515-2011"),
        ("https://doi.org/10.1000/ABC.", "10.1000/abc"),
        ("x10.1234/abc", None),
        ("a,10.1234/abcd", "10.1234/abcd"),
        ("doi: 10.\n1073/pnas.123", "10.1073/pnas.123"),
        ("doi:10.1175/jcli-d-21-\n0636.1", "10.1175/jcli-d-21-0636.1"),
        ("doi:10.1234/one and https://doi.org/10.1234/two", "10.1234/two"),
        ("doi:10.1175/jc-16.s1 doi:10.1175/jc-16.1", "10.1175/jc-16.1"),
        ("doi:10.1234/abcd.pdf", "10.1234/abcd"),
        ("(doi:10.1234/ab(c)d)", "10.1234/ab(c)d"),
        ("arXiv: 2101.00001v2", "10.48550/arXiv.2101.00001"),
        ("doi:10.1/x", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_doi(spark, text, doi):
    assert value(spark, B.parse_doi, text) == doi


@pytest.mark.parametrize("text, names", [("John Smith and Doe, J", ["Smith, John", "Doe, J"]), ("Plato", ["Plato"]), ("John van Smith", ["Smith, John van"]), ("", [""])])
def test_standard_names(spark, text, names):
    assert value(spark, B.standard_names, text) == names


@pytest.mark.parametrize("text, paths", [("a.pdf", ["a.pdf"]), ("a.pdf:pdf", ["a.pdf"]), (":a.pdf:pdf", ["a.pdf"]), (":a:b.pdf:pdf;c.pdf", ["a:b.pdf", "c.pdf"]), ("::pdf", []), ("", [])])
def test_attachments(spark, text, paths):
    assert value(spark, B.attachments, text) == paths


@pytest.mark.parametrize("url, name", [("https://a.b/c/d.pdf", "d.pdf"), ("https://a.b/c/d%20e.pdf?x=1", "d e.pdf"), ("https://a.b", "download"), ("https://a.b/x+y.pdf", "x+y.pdf"), ("https://a.b/a%2Fb", "a_b")])
def test_basename(spark, url, name):
    assert value(spark, B.url_basename, url) == name


def test_protect_and_slug(spark):
    assert value(spark, B.protect_uppercase, "Hello") == "{H}ello"
    assert value(spark, B.slug, "Él niño: São Ærø ß!") == "el-nino-sao-aero-ss"
    assert value(spark, B.simplify, "Müller ") == "m_ller"


def test_title_tag(spark):
    assert value(spark, lambda c: B.title_tag(c, most=12), "One two three four") == "one-two"
    assert value(spark, lambda c: B.title_tag(c, most=1), "Extraordinary measures taken") == "extraordinary-measures"


def test_query_text(spark):
    assert value(spark, lambda c: B.query_text(c, 3), "a b\n\nReferences x\n\nc d") == "a b c"
    assert value(spark, B.query_text, "a b") is None


@pytest.mark.parametrize("tex, text", [(r"{\'e}t{\'e}", "été"), (r"Str{\"o}m", "Ström"), (r"{\c{C}}a", "Ça"), (r"S{\o}ren", "Søren"), (r"\aa", "å"), (r"R\&D", "R&D"), ("plain", "plain"), (r"\'{\i}", "í")])
def test_to_unicode(tex, text):
    assert to_unicode(tex) == text


@given(st.text(alphabet="abcéöñçŁøß {}xyz", max_size=30))
@settings(max_examples=60, deadline=None)
def test_latex_round_trip(s):
    plain = s.replace("{", "").replace("}", "")
    assert to_unicode(to_latex(plain)) == plain


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text(alphabet="abcd ", max_size=25), st.text(alphabet="abcd ", max_size=25))
@settings(max_examples=150, deadline=None)
def test_fuzzy(a, b):
    assert common_subsequence(a, b) == lcs(a, b)
    r = token_set_ratio(a, b)
    assert 0 <= r <= 100 and abs(r - token_set_ratio(b, a)) < 1e-9
    if a.split() and set(a.split()) <= set(b.split()):
        assert r == 100


@pytest.mark.parametrize("tex, text", [(r"{\'e}", "é"), (r"{\c{c}}", "ç"), (r"\'{a}", "á"), ("\\'", ""), (r"{\Omega}-{\lambda}", "Ω-λ"), (r"\v{s}ek", "šek"), (r"\'{\i}", "í"), (r"{\DJ}oko", "Đoko"), (r"5 {\textdegree}C {\pm} 1", "5 °C ± 1"), (r"\^{\'{a}}", unicodedata.normalize("NFC", "a\u0301\u0302"))])
def test_latex_to_unicode(tex, text):
    assert to_unicode(tex) == text


def test_latex_every_command():
    from bibspark.functions import latex

    for c in {*latex.COMMANDS, *latex.LETTERS} - {"ı", "ȷ"}:
        assert to_unicode(f"a{to_latex(c)}b") == f"a{c}b"


@pytest.mark.parametrize("text, bare", [("{Name}", "Name"), ("{my nam\\'{e}}", "my nam\\'{e}"), ("{my} {name}", "{my} {name}"), ("name", "name"), ("{}", ""), ("", "")])
def test_strip_brackets(spark, text, bare):
    assert value(spark, B.strip_brackets, text) == bare
