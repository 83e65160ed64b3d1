"""One form for text that looks the same: quick check, normalisation of unstable segments, splice.

A table built from the Unicode properties says of every character whether it can be part of text in another form
(not NFC_QC=Yes, a wide or ligature form, invisible, a blank or hyphen of another code). The JVM evaluates this
quick check; text that passes goes through unchanged and never reaches Python. Of the rest only the segments that
hold an unstable character are normalised, with their boundary context (the characters up to the next stable
starter that cannot combine), and are spliced into the unchanged text. A word that mixes scripts, or that consists
of look-alikes beside words of another script, takes the script of its own unambiguous letters.

Ordinary and unchanged: raised and lowered digits, long dashes, curly quotes, Greek letters used as symbols, LaTeX
commands, tabs and line breaks, text wholly in another script. Null stays null, empty stays empty.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: code points that show nothing
INVISIBLE = "\u00ad\u034f\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
# fixed values: hyphens that look like the ASCII one
HYPHENS = "\u2010\u2011\ufe63\uff0d"
# fixed values: Cyrillic and Greek letters that look like a Latin letter
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "ӏ": "l",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ԝ": "W",
    "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
_LATIN = set(LOOKALIKES.values())
_TO = {
    "CYRILLIC": {v: k for k, v in LOOKALIKES.items() if "CYRILLIC" in unicodedata.name(k)},
    "GREEK": {v: k for k, v in LOOKALIKES.items() if "GREEK" in unicodedata.name(k)},
}


def _simple(c: str) -> str | None:
    """What an unstable character stands for, or None if it is ordinary (or combines)."""
    if c in INVISIBLE:
        return ""
    if c in HYPHENS:
        return "-"
    if unicodedata.category(c) == "Zs" and c != " ":
        return " "
    d = unicodedata.decomposition(c)
    if d.startswith(("<wide>", "<narrow>", "<compat>")) and c not in "\u00b5\u017f\u03d0\u03d1\u03d5\u03d6\u03f0\u03f1\u03f5":
        x = unicodedata.normalize("NFKC", c)
        if x.isalnum() and (x.isascii() or not d.startswith("<compat>")):
            return x
    return None


def _tables() -> tuple[dict[str, str], str]:
    simple, unstable = {}, []
    for i in range(0xA0, sys.maxunicode + 1):
        if 0xAC00 <= i < 0xE000 or 0x3400 <= i < 0xA000 or 0x20000 <= i < 0x2F800 or i > 0x2FA1F:
            continue
        c = chr(i)
        x = _simple(c)
        if x is not None:
            simple[c] = x
        if x is not None or unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c):
            unstable.append(i)
    spans: list[list[int]] = []
    for i in unstable:
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return simple, spans


SIMPLE, _SPANS = _tables()
UNSTABLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _SPANS) + "]")
_JAVA = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _SPANS) + "]"
# suspect letters below U+0300 are few; all others are above
_FAR = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{min(b, 0x2FF):x}}}" for a, b in _SPANS if a < 0x300) + "\\x{300}-\\x{10ffff}]"
_MIXED = r"(?s)^(?=.*[\p{IsGreek}\p{IsCyrillic}])(?=.*[\p{IsLatin}\x{ff21}-\x{ff5a}])"
_SEGMENT = re.compile(r"[^\x00-\x20!-/:-@\[-`{-\x7f]+")
_WORD = re.compile(r"[^\W_][^\W_\u0300-\u036f]*(?:[\u0300-\u036f]+[^\W_\u0300-\u036f]*)*")
_OTHER = re.compile("[\u0370-\u03ff\u0400-\u052f]")


@lru_cache(maxsize=4096)
def script(c: str) -> str:
    if not c.isalpha():
        return ""
    return unicodedata.name(c, "").split(" ", 1)[0]


def _votes(word: str) -> dict[str, int]:
    """Letters of each script that no other script has alike."""
    out: dict[str, int] = {}
    for c in word:
        base = unicodedata.normalize("NFD", c)[0]
        if (s := script(c)) and base not in LOOKALIKES and base not in _LATIN:
            out[s] = out.get(s, 0) + 1
    return out


def _as(word: str, table: dict[str, str]) -> str:
    out = []
    for c in word:
        d = unicodedata.normalize("NFD", c)
        out.append(table[d[0]] + d[1:] if d[0] in table else c)
    return unicodedata.normalize("NFC", "".join(out))


def _one_script(text: str) -> str:
    """Words that mix scripts, or look-alike words among Latin ones, in one script."""
    words = list(_WORD.finditer(text))
    votes: list[dict[str, int] | None] = [None] * len(words)

    def vote(i: int) -> dict[str, int]:
        if votes[i] is None:
            votes[i] = _votes(words[i][0])
        return votes[i]

    out, at = [], 0
    for i, m in enumerate(words):
        w = m[0]
        if not _OTHER.search(w):
            continue
        scripts = {s for c in w if (s := script(c))}
        own, new = vote(i), w
        if len(scripts) > 1:
            latin, cyrillic, greek = own.get("LATIN", 0), own.get("CYRILLIC", 0), own.get("GREEK", 0)
            if cyrillic > latin:
                new = _as(w, _TO["CYRILLIC"])
            elif greek > max(1, latin):
                new = _as(w, _TO["GREEK"])
            elif latin or not (cyrillic or greek):
                new = _as(w, LOOKALIKES)
        elif not own and scripts <= {"CYRILLIC", "GREEK"}:
            s = next(iter(scripts))
            near = [vote(j).get(s, 0) for j in (i - 1, i + 1) if 0 <= j < len(words)]
            rest = [vote(j) for j in range(len(words)) if j != i]
            if not any(near) and sum(v.get("LATIN", 0) for v in rest) > sum(v.get(s, 0) for v in rest):
                new = _as(w, LOOKALIKES)
        if new != w:
            out += [text[at : m.start()], new]
            at = m.end()
    return "".join([*out, text[at:]]) if out else text


def canonical(text: str) -> str:
    """The text in its one form; equal to ``text`` where nothing in it could be written plainer."""
    if text.isascii():
        return text
    out, at = [], 0
    for m in _SEGMENT.finditer(text):
        if not UNSTABLE.search(m[0]):
            continue
        # boundary context: the stable starter before the segment, to which its first mark may belong
        a = m.start() - (m.start() > at and bool(unicodedata.combining(m[0][0])))
        seg = text[a : m.end()]
        new = unicodedata.normalize("NFC", "".join(SIMPLE.get(c, c) for c in seg))
        if new != seg:
            out += [text[at:a], new]
            at = m.end()
    text = "".join([*out, text[at:]]) if out else text
    return _one_script(text) if _OTHER.search(text) else text


def suspect(c: Column) -> Column:
    """Quick check in the JVM: true where the text may hold another form; every suspect character is beyond ASCII,
    and most are beyond the Latin letters, which a short pattern tells."""
    return F.coalesce((F.octet_length(c) != F.char_length(c)) & c.rlike(_FAR) & (c.rlike(_JAVA) | c.rlike(_MIXED)), F.lit(False))


@F.pandas_udf(StringType())
def _canonical_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else canonical(x), na_action="ignore")


def canonical_column(c: Column) -> Column:
    """Canonical form of a column: only suspect values go to Python."""
    return F.coalesce(_canonical_udf(F.when(suspect(c), c)), c)


def canonical_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the columns in canonical form; all other columns as they are."""
    return df.withColumns({c: canonical_column(F.col(c)) for c in columns})


def changed_values(df: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """(key, field_name): values that are not in canonical form."""
    parts = F.array(*[F.struct(F.lit(n).alias("field_name"), F.when(suspect(c), c).alias("v")) for n, c in values.items()])
    rows = df.select(key, F.explode(F.filter(parts, lambda x: x["v"].isNotNull())).alias("x")).select(key, "x.field_name", "x.v")
    return rows.withColumn("w", _canonical_udf("v")).where(F.col("w") != F.col("v")).select(key, "field_name")
