"""LaTeX and Unicode: accents by rule, special letters by a short table."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: accent commands and their combining marks; letters and signs with commands of their own
MARKS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a", "d": "\u0323", "b": "\u0331"}
LETTERS = {
    "Å": r"\AA", "Æ": r"\AE", "Ð": r"\DH", "Ø": r"\O", "Þ": r"\TH", "ß": r"\ss", "å": r"\aa", "æ": r"\ae", "ð": r"\dh", "ø": r"\o", "þ": r"\th",
    "Đ": r"\DJ", "đ": r"\dj", "ı": r"\i", "ȷ": r"\j", "Ł": r"\L", "ł": r"\l", "Ŋ": r"\NG", "ŋ": r"\ng", "Œ": r"\OE", "œ": r"\oe",
}
SIGNS = {"#": r"\#", "$": r"\$", "%": r"\%", "&": r"\&", "_": r"\_", "\u2013": "--", "\u2014": "---"}
COMMANDS = {
    "£": r"\textsterling", "¥": r"\textyen", "§": r"\textsection", "©": r"\textcopyright", "«": r"\guillemotleft", "®": r"\textregistered", "°": r"\textdegree", "±": r"\pm",
    "¶": r"\textparagraph", "·": r"\cdot", "»": r"\guillemotright", "×": r"\texttimes", "“": r"\textquotedblleft", "”": r"\textquotedblright", "…": r"\ldots", "™": r"\texttrademark",
    "←": r"\leftarrow", "→": r"\rightarrow", "↔": r"\leftrightarrow", "⇔": r"\Leftrightarrow", "∂": r"\partial", "∇": r"\nabla", "∑": r"\sum", "√": r"\surd", "∞": r"\infty", "∫": r"\int",
    "∼": r"\sim", "≈": r"\approx", "≤": r"\leq", "≥": r"\geq",
}


def _greek() -> dict[str, str]:
    """Greek letters by their Unicode names; capitals that look Latin have no command, nor has omicron."""
    out = {"\u03c2": r"\varsigma"}
    for c in map(chr, range(0x391, 0x3CA)):
        name = unicodedata.name(c, "").split(" ")
        if name[:1] == ["GREEK"] and len(name) == 4 and c not in "ΑΒΕΖΗΙΚΜΝΟΡΤΧο":
            word = name[3].lower().replace("lamda", "lambda")
            out[c] = "\\" + (word if name[1] == "SMALL" else word.capitalize())
    return out


COMMANDS |= _greek()
_BY_MARK = {v: k for k, v in MARKS.items()}
_BY_COMMAND = {v[1:]: k for k, v in (LETTERS | COMMANDS).items()}
_BASE = r"\\[ij](?![A-Za-z])|[^\W\d_][\u0300-\u036f]*"
_SIGN = r"\\(?:([`'^~\"=.])|([cvuHkrdb])(?![A-Za-z]))"
_ACCENT = re.compile(rf"{_SIGN}\s*(?:\{{\s*({_BASE})\s*\}}|({_BASE}))")
_BARE = re.compile(_SIGN)
_LETTER = re.compile(r"\\(" + "|".join(sorted(map(re.escape, _BY_COMMAND), key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\}| )?")


def to_unicode(text: str) -> str:
    """Text with its LaTeX accents, letters and signs decoded, composed, and without braces; a bare accent gives nothing."""
    if "\\" not in text and "{" not in text:
        return unicodedata.normalize("NFC", text)

    def accent(m: re.Match) -> str:
        return (m[3] or m[4]).lstrip("\\") + MARKS[m[1] or m[2]]

    for _ in range(2):  # an accent may stand around another one
        text = _ACCENT.sub(accent, text)
    text = _BARE.sub("", text)
    text = _LETTER.sub(lambda m: _BY_COMMAND[m[1]], text)
    for c, tex in SIGNS.items():
        if tex.startswith("\\"):
            text = text.replace(tex, c)
    return unicodedata.normalize("NFC", text).replace("{", "").replace("}", "")


def to_latex(text: str) -> str:
    """Text in LaTeX: blanks and braces stay, letters with marks become commands."""
    out = []
    for c in text:
        d = unicodedata.normalize("NFD", c)
        if c in LETTERS:
            out.append("{" + LETTERS[c] + "}")
        elif c in SIGNS:
            out.append(SIGNS[c])
        elif c in COMMANDS:
            out.append("{" + COMMANDS[c] + "}")
        elif len(d) > 1 and d[0].isascii() and all(x in _BY_MARK for x in d[1:]):
            tex = d[0]
            for x in d[1:]:
                tex = f"\\{_BY_MARK[x]}{{{tex}}}"
            out.append(tex)
        else:
            out.append(c)
    return "".join(out)


@F.pandas_udf(StringType())
def to_unicode_udf(s: pd.Series) -> pd.Series:
    return s.map(to_unicode, na_action="ignore")


@F.pandas_udf(StringType())
def to_latex_udf(s: pd.Series) -> pd.Series:
    return s.map(to_latex, na_action="ignore")
