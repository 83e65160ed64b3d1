"""The search language of the library listing, as predicates for one Catalyst filter."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bib as B


def glob_pattern(glob: str) -> str:
    """Regular expression for the whole text: *, ?, [set], [!set]."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^(?:{out})$"


def leaf(target: Column, term: str, strict: bool = False, fuzzy: float | None = None, invert: bool = False) -> Column:
    """One term on one text, letter case aside: contained; whole text by glob; or also by token-set ratio."""
    low = F.lower(target)
    hit = low.rlike(glob_pattern(term.lower())) if strict else F.contains(low, F.lit(term.lower()))
    if fuzzy is not None:
        from ..functions.fuzzy import token_set_ratio_udf

        hit = hit | (token_set_ratio_udf(F.lit(term.lower()), low) > fuzzy)
    return ~hit if invert else hit


def terms(target: Column, words: list[str], any_: bool = False, **how) -> Column:
    """All terms (or any of them); inversion is at each term, before they are combined."""
    return functools.reduce(operator.or_ if any_ else operator.and_, [leaf(target, w, **how) for w in words])


def by_field(name: str, words: list[str], **how) -> Column:
    """Terms on a field that must be present, also when inverted."""
    return B.has(name) & terms(B.field(name), words, **how)


def of_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Records whose key is among ``keys`` (column cite_key), letter case included."""
    return df.join(keys.where("cite_key is not null").select("cite_key").distinct(), "cite_key", "left_semi")


def by_key(words: list[str], **how) -> Column:
    return terms(F.coalesce("cite_key", F.lit("")), words, **how)


def by_author(words: list[str], first: bool = False, **how) -> Column:
    families = B.family_names(B.field("author"))
    return B.has("author") & terms(families[0] if first else F.array_join(families, " "), words, **how)


def everywhere(words: list[str], **how) -> Column:
    """Terms on all values; always by containment."""
    return terms(B.full_text(), words, **(how | {"strict": False}))


def has_file(yes: bool = True) -> Column:
    return (B.field("file") != "") if yes else (B.field("file") == "")


def needs_review() -> Column:
    """Bad key, bad DOI where there is one, or no author, title or year."""
    bad_doi = (B.field("doi") != "") & ~B.valid_doi(B.field("doi"))
    return ~B.valid_key(F.coalesce("cite_key", F.lit(""))) | bad_doi | (B.field("author") == "") | (B.field("title") == "") | (B.field("year") == "")


def one_liner() -> Column:
    """Key, title cut at 60 characters, and DOI, number of files and keywords in brackets."""
    title, n = B.field("title"), F.size(B.attachments(B.field("file")))
    info = F.filter(
        F.array(
            F.when(B.field("doi") != "", F.concat(F.lit("doi:"), B.field("doi"))),
            F.when(n > 0, F.concat(F.when(n == 1, "file:").otherwise("files:"), n.cast("string"))),
            F.when(B.field("keywords") != "", F.array_join(B.keywords(B.field("keywords")), " | ")),
        ),
        lambda x: x.isNotNull(),
    )
    tail = F.when(F.size(info) > 0, F.concat(F.lit("("), F.array_join(info, ", "), F.lit(")"))).otherwise("")
    return F.concat(F.coalesce("cite_key", F.lit("")), F.lit(": "), F.substring(title, 1, 60), F.when(F.length(title) > 60, "...").otherwise(""), F.lit(" "), tail)


def selected_fields(names: list[str]) -> Column:
    return F.concat_ws(" ", *[B.field(n) for n in names])


def select(df: DataFrame, *conditions: Column) -> DataFrame:
    """Entries that meet all conditions (native ones should come before fuzzy ones)."""
    for c in conditions:
        df = df.where(c)
    return df
