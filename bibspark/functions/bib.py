"""Column functions on bibliographic fields: names, identities, keywords, identifiers, keys, paths, addresses.

Strings are stripped of ASCII white space. Absent fields count as empty unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOI_BODY = r"10\.\d{4,9}/[-._;()/:a-z0-9]+"
# fixed values: what follows a DOI in running text, in the order in which it is looked for
DOI_TAILS = ("/-/dcsupplemental", "/-/dc", ".pdf", "preprint", "received", "published", "edited", "advance", "full", "abstract", "-supplement", "supplement")
# fixed values: entry types of Crossref work types; all others are misc
CROSSREF_TYPES = {"journal-article": "article", "book": "book", "book-chapter": "incollection", "proceedings-article": "inproceedings", "conference-paper": "inproceedings", "report": "techreport", "thesis": "phdthesis"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def field(name: str) -> Column:
    return F.coalesce(F.col("field_map").getItem(name), F.lit(""))


def has(name: str) -> Column:
    return F.coalesce(F.map_contains_key("field_map", F.lit(name)), F.lit(False))


def standard_names(author: Column) -> Column:
    """Array of names in the form "Last, First"."""
    return F.transform(F.split(author, " and "), lambda x: F.when(F.instr(strip(x), ",") > 0, strip(x)).otherwise(F.regexp_replace(strip(x), r"(?s)^(.*) ([^ ]*)$", "$2, $1")))


def family_names(author: Column) -> Column:
    return F.transform(standard_names(author), lambda x: F.split_part(x, F.lit(","), F.lit(1)))


def strip_brackets(c: Column) -> Column:
    """Text without the braces that enclose all of it; braces around parts of it stay."""
    inner = r"(?s)^\{((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}$"
    return F.regexp_replace(c, inner, "$1")


def simplify(c: Column) -> Column:
    """Lower case, non-ASCII letters as an underscore."""
    return strip(F.lower(F.regexp_replace(c, r"[^\x00-\x80]", "_")))


def author_id() -> Column:
    return simplify(F.array_join(family_names(field("author")), " "))


def title_id() -> Column:
    return simplify(field("title"))


def author_title_id() -> Column:
    return F.concat(author_id(), title_id())


def keywords(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def attachments(c: Column) -> Column:
    """Paths of a packed attachment field: path, path:type, or description:path:type (middle parts joined)."""

    def path(x: Column) -> Column:
        p = F.split(x, ":")
        n = F.size(p)
        return F.when(n == 1, x).when(n == 2, p[0]).otherwise(F.array_join(F.slice(p, F.lit(2), F.greatest(n - 2, F.lit(1))), ":"))

    return F.filter(F.transform(F.filter(F.split(c, ";"), lambda x: x != ""), path), lambda x: x != "")


def pack_attachments(paths: Column) -> Column:
    return F.array_join(F.transform(paths, lambda x: F.concat(F.lit(":"), x, F.lit(":"), F.regexp_extract(x, r"\.([^./]*)$", 1))), ";")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def parse_doi(text: Column) -> Column:
    """DOI of a text, or null: rejoined line breaks, a preferred address form, tails cut, closing brackets balanced."""
    t = F.lower(F.translate(F.regexp_replace(text, "[\u200b\u00ad]", ""), "\u2013\u2014\u0002", "--/"))
    t = F.regexp_replace(t, r"(10\.)\s*\n\s*(\d{4,9}/)", "$1$2")
    t = F.regexp_replace(t, r"(10\.1073/pnas\.)\s*\n\s*(\d)", "$1$2")
    t = F.regexp_replace(t, rf"({DOI_BODY}-)\s*\n\s*([a-z0-9])", "$1$2")
    return let(t, lambda x: let(F.regexp_extract_all(x, F.lit(rf"[doi,doi.org/][\s\.\:]{{0,2}}({DOI_BODY})"), 1), lambda found: _chosen_doi(x, found)))


def _chosen_doi(t: Column, found: Column) -> Column:
    arxiv = F.regexp_extract(t, r"arxiv:\s*(\d{4}\.\d{4,5})", 1)
    first = F.try_element_at(found, F.lit(1))

    def among(prefix: str) -> Column:
        return let(F.regexp_extract_all(t, F.lit(f"{prefix}({DOI_BODY})"), 1), lambda form: F.try_element_at(F.filter(found, lambda x: F.array_contains(form, x)), F.lit(1)))

    linked = F.coalesce(*map(among, (r"www\.[a-z]+\.org/[a-z/]+/", r"doi\.org/", r"dx\.doi\.org/")))
    supplement = r"\.s\d+\.?$"
    base = F.regexp_replace(first, supplement, "")
    proper = F.try_element_at(F.filter(F.slice(found, 2, 100000), lambda x: x.startswith(base) & ~x.rlike(supplement)), F.lit(1))
    several = let(F.coalesce(linked, first), lambda d: F.when((d == first) & first.rlike(supplement), F.coalesce(proper, d)).otherwise(d))
    picked = F.when(F.size(found) > 1, several).otherwise(first)

    def cut(d: Column) -> Column:
        out = []
        for tail in DOI_TAILS:
            at = F.instr(d, tail)
            good = at > 1
            if tail.isalpha():
                good &= F.substr(d, at - 1, F.lit(1)).rlike(r"[A-Za-z0-9.\-_/]")
            out.append(F.when(good, F.substr(d, F.lit(1), at - 1)))
        return F.regexp_replace(F.coalesce(*out, d), r"[.:]+$", "")

    def balanced(d: Column) -> Column:
        closing = F.length(d) - F.length(F.regexp_replace(d, r"\)+$", ""))
        extra = F.length(F.regexp_replace(d, r"[^)]", "")) - F.length(F.regexp_replace(d, r"[^(]", ""))
        return F.substr(d, F.lit(1), F.length(d) - F.greatest(F.least(closing, extra), F.lit(0)))

    doi = let(picked, lambda d: let(cut(d), lambda e: let(balanced(e), lambda f: F.when(F.length(f) > 8, f))))
    return F.when(F.size(found) > 0, doi).when(arxiv != "", F.concat(F.lit("10.48550/arXiv."), arxiv))


def valid_doi(doi: Column) -> Column:
    return F.coalesce(F.lower(parse_doi(F.concat(F.lit("doi:"), doi))) == F.lower(doi), F.lit(False))


def valid_key(key: Column) -> Column:
    return F.coalesce((key != "") & ~key.rlike(r"^\p{Nd}"), F.lit(False))


def record_score() -> Column:
    """Reliability of a record: valid DOI, title, author, file, number of fields."""
    doi = (field("doi") != "") & valid_doi(field("doi"))
    return ((100 * doi.cast("long") + 50 * has("title").cast("long") + 10 * has("author").cast("long") + has("file").cast("long")) * 100 + F.greatest(F.size("field_map"), F.lit(0))).cast("long")


def content(skip: tuple[str, ...] = ()) -> Column:
    """Everything of a record but the fields ``skip`` (ENTRYTYPE and ID among them), comparable and groupable; absent and empty differ."""
    fields = F.map_filter("field_map", lambda k, _: ~k.isin(*skip)) if skip else F.col("field_map")
    of = lambda name, c: F.lit("") if name in skip else F.coalesce(c, F.lit(""))
    return F.struct(of("ENTRYTYPE", "entry_type").alias("t"), of("ID", "cite_key").alias("k"), F.array_sort(F.map_entries(fields)).alias("f"))


def update_fields(first: Column, second: Column) -> Column:
    """Union of two field maps; values of the first win, also empty ones."""
    return F.map_zip_with(first, second, lambda k, a, b: F.coalesce(a, b))


def full_text() -> Column:
    """Type, key and all values by field name, joined by blanks."""
    values = F.transform(F.array_sort(F.map_keys("field_map")), lambda k: F.col("field_map").getItem(k))
    return F.array_join(F.concat(F.array(F.coalesce("entry_type", F.lit("")), F.coalesce("cite_key", F.lit(""))), F.coalesce(values, F.array().cast("array<string>"))), " ")


def query_text(text: Column, words: int = 200) -> Column:
    """First words of the paragraphs that are no reference list; null below three words."""
    kept = F.filter(F.split(text, r"\n\n"), lambda p: ~F.lower(p).startswith("reference"))
    w = F.filter(F.split(F.array_join(kept, " "), r"\s+"), lambda x: x != "")
    return F.when(F.size(w) >= 3, F.array_join(F.slice(w, 1, words), " "))


def protect_uppercase(c: Column) -> Column:
    return F.regexp_replace(c, r"([^{]|^)([A-Z])([^}]|$)", "$1{$2}$3")


def url_basename(url: Column) -> Column:
    """Last segment of the path of an address, decoded; "download" if there is none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    last = F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"([^/]*)$", 1)
    name = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    return F.when(name == "", "download").otherwise(F.translate(name, "/\\", "__"))


def slug(c: Column) -> Column:
    """Lower-case ASCII words joined by hyphens; letters with marks lose them."""
    src = "àáâãäåāçćčďèéêëēěğìíîïīłñńňòóôõöøōřśšşťùúûüūůýÿźžżđ"
    dst = "aaaaaaaccc" + "d" + "eeeeee" + "g" + "iiiii" + "l" + "nnn" + "ooooooo" + "r" + "sss" + "t" + "uuuuuu" + "yy" + "zzz" + "d"
    x = F.translate(F.lower(c), src, dst)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def title_tag(title: Column, most: int = 100, words: int = 100, least: int = 1, sep: str = "-") -> Column:
    """Leading words of a title's slug within a length, two of them at least where there are two."""
    w = F.slice(F.filter(F.split(slug(title), "-"), lambda x: F.length(x) >= least), 1, words)
    fits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda n: (n <= 1) | (F.length(F.array_join(F.slice(w, F.lit(1), n), "*")) <= most))
    n = F.greatest(F.array_max(fits), F.least(F.size(w), F.lit(2)))
    return F.array_join(F.slice(w, F.lit(1), F.greatest(n, F.lit(1))), sep)


def name_slugs() -> Column:
    author = F.when(has("author"), F.lower(field("author"))).otherwise("unknown")
    return F.transform(family_names(author), slug)


def template_fields() -> dict[str, Column]:
    """Values that file-name and key templates may use."""
    names, year = name_slugs(), F.when(has("year"), field("year")).otherwise("0000")
    caps = F.transform(names, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))
    cited = F.when(F.size(caps) >= 3, F.concat(caps[0], F.lit(" et al"))).when(F.size(caps) == 2, F.array_join(caps, " and ")).otherwise(caps[0])
    author = F.array_join(F.slice(names, 1, 2), "_")
    title = title_tag(field("title"))
    return {
        "author": author,
        "Author": F.array_join(F.slice(caps, 1, 2), "_"),
        "AUTHOR": F.upper(author),
        "AuthorX": F.replace(cited, F.lit(" "), F.lit("_")),
        "authorX": F.lower(F.replace(cited, F.lit(" "), F.lit("_"))),
        "year": year,
        "title": title,
        "Title": F.array_join(F.transform(F.split(title, "-"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "-"),
        "journal": F.col("field_map").getItem("journal"),
        "ID": F.coalesce("cite_key", F.lit("")),
        "doi": field("doi"),
        "doi_": slug(field("doi")),
        "doi_or_id": slug(F.when(has("doi"), field("doi")).otherwise(F.coalesce("cite_key", F.lit("")))),
    }


def render(template: str, fields: dict[str, Column]) -> Column:
    """Template with {names} in braces, compiled to a column; absent values render as None."""
    import re

    out, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        out += [F.lit(template[at : m.start()]), F.coalesce(fields[m[1]], F.lit("None"))]
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))
