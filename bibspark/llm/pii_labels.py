"""Labelled spans for the training of the tagger; nothing that finds details in the pipeline uses this module.

Written forms label a bounded sample of texts. The words they need are learned from that sample: given names from the
author fields and mail headers, towns from what follows a street, words that are no family name from their use in
lower case and after prepositions of place.
"""

from __future__ import annotations

import re
from collections import Counter

KINDS = ("email", "phone", "id", "address", "name")

_W = r"(?:\s|\n> ?)"
_UP = "A-ZÀ-ÖØ-ÞŠŁŽČĆŚŻĐ"
_AT = r"(?:\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+|\s*@\s*|\s*＠\s*)"
_DOT = r"(?:\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+|\.)"
EMAIL = re.compile(
    r"(?<![\w.+\-@])(?:[A-Za-z0-9][\w.+\-]*[A-Za-z0-9]|[A-Za-z0-9])(?:[@＠][\w\-]+(?:\.[\w\-]+)*\.[A-Za-z]{2,}"
    rf"|(?:\s*[\[({{]\s*(?:at|AT)\s*[\])}}]\s*)[\w\-]+(?:{_DOT}[\w\-]+)*{_DOT}[A-Za-z]{{2,}}"
    r"|\s+(?:at|AT)\s+[\w\-]+(?:\s+(?:dot|DOT)\s+[\w\-]+)*\s+(?:dot|DOT)\s+[A-Za-z]{2,}"
    rf"|{_AT}[\w\-]+(?:\s*[\[({{]\s*(?:dot|DOT)\s*[\])}}]\s*[\w\-]+)+)(?![\w\-@])",
    re.I,
)
PHONE = re.compile(
    r"(?<![\w.+\-/])(?:"
    r"\+\d{1,3}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-/]?\d{1,7}){1,6}"
    r"|00\d{2}(?:[ .\-/]\d{1,6}){2,5}"
    r"|\(0\d{1,5}\)[ \-]?\d{3,8}(?:[ \-]\d{2,5})?"
    r"|\(\d{3}\)[ \-]?\d{3}[ \-]\d{4}"
    r"|\d{3}[\-.]\d{3}[\-.]\d{4}"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|0\d{2,5}[ /]\d{3,8}(?:[ \-]\d{3,5})?"
    r")(?![\w/]|[.\-]\d)"
)
_LABEL8 = re.compile(r"(?:matrik|student|staff|number|nummer|no\.?|n[oº°]|numéro|número|employee|personal|card|étudiant|alumno|empleado|agent)[\w .:\-]{0,24}[ (:]*$", re.I)
_PASS = re.compile(r"(?:pass|ausweis|form\b|document|identit|carnet|was put)", re.I)
ID = re.compile(
    r"(?<![\w.\-+/])(?:\d \d{4} \d{5} \d{4}|\d{3}-\d{2}-\d{4}|\d{6}-\d{4}|\d{8}[A-Z])(?![\w\-]|\.\d)"
    r"|(?<![\w.\-+])\d{4}-\d{4}-\d{4}-\d{3}[\dX](?![\w\-])"
    r"|(?<![\w.\-+/])(?P<pass>[A-Z]{1,2}\d{7})(?![\w\-])"
    r"|(?<![\w.\-+/])(?P<eight>\d{8})(?![\w\-]|\.\d)"
)
# fixed values: words that make a street
_TOWN = rf"[{_UP}][\w\-]+(?:\s(?!The\b)[{_UP}][a-zà-ÿ][\w\-]*)?"
_CAP = rf"[{_UP}][\w'’\-]+"
_NAME = rf"{_CAP}(?:{_W}+{_CAP}){{0,2}}"
_STREET = (
    rf"(?:(?:Flat|Unit|Apt\.?){_W}+\d+\w?,?{_W}+)?\d+{_W}?[a-z]?,?{_W}+(?:[NSEW]\.{_W}+)?{_NAME}{_W}+(?:Street|St\b\.?|Road|Rd\b\.?|Row|Lane|Ln\b\.?|Avenue|Ave\b\.?|Way|Drive|Court|Terrace|Close|Square|Crescent)"
    rf"|\d+(?:{_W}+(?:bis|ter))?,?{_W}+(?:rue|avenue|av\.|bd|boulevard|place|chemin|quai|allée|impasse|cours){_W}+(?:(?:de|du|des|la|le|les|aux|au|à|l['’]|d['’]){_W}*)*{_NAME}"
    rf"|(?:(?:Am|An{_W}der|Auf{_W}dem|Zum|Zur|Im){_W}+{_NAME}|{_CAP}(?:strasse|straße|str\.|weg|allee|gasse|platz|ring|ufer|damm|stieg)|[{_UP}][\w\-]*(?:strasse|straße|str\.|weg|allee|gasse|platz|ufer|damm)){_W}+\d+(?:{_W}?[a-z]\b)?"
    rf"|(?:Calle|C/|Avda\.?|Avenida|Paseo|Plaza|Camino|Ronda){_W}*(?:(?:del|de|la|las|los){_W}+)*{_NAME},?{_W}+\d+(?:,{_W}*\d+\.?[ºª°]{_W}?[A-Z])?"
    rf"|P\.?{_W}?O\.?{_W}+Box{_W}+\d+|Postfach{_W}+\d+|Apartado{_W}+\d+|B\.?P\.?{_W}+\d+"
)
_CODE = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]?[ ]\d[A-Z]{2}|[A-Z]{2}[ ]\d{5})"
_SEP = r"(?:,?(?:[ \t ]+|[ \t]*(?:\r\n|\r|\n)(?:> ?)?[ \t]*))"
ADDRESS = re.compile(rf"(?<![\w.\-])(?:{_STREET})(?:,?{_W}+(?:Apt|Flat|Unit|Suite)\.?{_W}+\w+)?{_SEP}(?:\d{{4,6}}{_W}+)?(?P<town>{_TOWN})(?:,?{_SEP}{_CODE})?(?![\w])")

_PART = r"(?:(?i:de la|de las|del|de|da|do|van der|van den|van|von der|von|der|den|al|el|O)(?:[ '’\-]))?"
_FAM = rf"{_PART}(?:[A-ZO]['’])?[{_UP}][\w’'\-]*[\w]{{2}}"
_INI = rf"(?:[{_UP}]\.(?:[ \-]?[{_UP}]\.)*)"
_B = r"(?:[ \t\u00a0\u2000-\u200a\u202f]+|[ \t]*\r?\n(?:> ?|[ \t]+))"
_MID = rf"(?:[ \u00a0]+[{_UP}]\.?(?![\w/]))*"
_LETTERS = re.compile(r"[^\W\d_]+")
_LISTED = re.compile(r"(?mi)^[ \t>]*(?:author|from|to|cc)\s*:\s*([^<\n@]{5,60}?)\s*(?=<|$)|author\s*=\s*\{([^}]*)\}")
_PIECE = re.compile(r"(?:(?!\s+and\s+).)+", re.S)
_PLACED = re.compile(r"\b(?:at|near|of|in|over|under|across|bei|près de|cerca de|über|the|a|its|their)\s+([^\W\d_]+)")
_ADDRESSED = re.compile(r"\S*[@＠]\S*|\S+\s*[\[({]\s*at\s*[\])}].*", re.I)
_STREETISH = re.compile(r"\s+(?:Street|St\.|Road|Rd\.|Row|Lane|Ave|Avenue|Way)\b")


class Labeller:
    """Written forms with the given names, towns and ordinary words of a sample."""

    def __init__(self, texts: list[str]):
        given: Counter = Counter()
        words: Counter = Counter()
        placed: Counter = Counter()
        towns: Counter = Counter()
        for t in texts:
            words.update(_LETTERS.findall(_ADDRESSED.sub(" ", t)))
            placed.update(_PLACED.findall(t))
            for m in _LISTED.finditer(t):
                for piece in _PIECE.findall(m[1] or m[2] or ""):
                    w = _LETTERS.findall(piece.split(",", 1)[-1])
                    if w and len(w[0]) > 1 and (len(w) > 1 or "," in piece):
                        given[w[0].title()] += 1
            for m in ADDRESS.finditer(t):
                one, two = m["town"].split()[0], " ".join(m["town"].split())
                towns.update({one, two})
        self.pairs = {t for t, n in towns.items() if " " in t and n > 0.5 * towns[t.split()[0]]}
        low = lambda w: words[w.lower()]
        # a given name begins listed names and is seldom an ordinary word; a family name is no word of lower case or place
        self.given = {w for w, n in given.items() if n > 1 and low(w) <= 2 * words[w] and placed[w] <= 0.5 * words[w]}
        spelled = {w for w in words if w[0].isupper() and len(w) > 1}
        self.ordinary = {w.lower() for w in spelled if w.title() not in self.given and (words[w.lower()] > 4 or (words[w] > 9 and placed[w] > 0.35 * words[w]))}
        self.ordinary |= {w.lower() for t in towns for w in t.split() if towns[t] > 4}
        self.ordinary -= set("de la las del da do van der den von al el o".split())
        names = "|".join(sorted(map(re.escape, self.given), key=len, reverse=True)) or r"(?!)"
        lower = "|".join(sorted((re.escape(w.lower()) for w in self.given if len(w) > 2), key=len, reverse=True)) or r"(?!)"
        giv = rf"(?:{names})(?:-(?:[{_UP}]\w+))?"
        fam = rf"{_PART}[\w’'\-]{{4,}}"
        self.names = (
            re.compile(rf"(?<![\w.@\-/]){_FAM},{_B}(?:{giv}{_MID}|{_INI}|[{_UP}]{{1,2}}(?![\w.]))(?![\w@])"),
            re.compile(rf"(?<![\w.@\-/]){giv}{_MID}{_B}{_FAM}(?![\w@])"),
            re.compile(rf"(?<![\w.@\-/]){_INI}{_B}?{_FAM}(?![\w@])"),
            re.compile(rf"(?<![\w.@\-/])[{_UP}]{{1,3}}{_B}{_FAM}(?![\w@])"),
            re.compile(rf"(?<![\w.@\-/]){_FAM}{_B}(?:{giv}|{_INI}|[{_UP}]{{1,2}})(?![\w@])"),
        )
        self.loose = tuple(re.compile(p.pattern.replace(_FAM, fam), re.I) for p in self.names[:2])
        small = r"[^\W\d_A-Z][^\W\d_]{4,}"
        initials = r"(?:[^\W\d_A-Z]\.(?:[ \-]?[^\W\d_A-Z]\.)*)"
        self.lower = re.compile(
            rf"(?<![\w.@\-/])(?:{lower})(?:-[^\W\d_]+)?(?:{_B}[a-z]\.?(?![\w/]))*{_B}(?:(?:de la|da|de|van|von|al)[ \-]|o['’])?{small}(?![\w@])"
            rf"|(?:(?<=[{{\]\n>] )|(?<=author = {{)){initials}{_B}?{small}(?=\s+(?:\(|and\b|has|told|disagrees|<)|\s*$|}})"
            rf"|(?<= and ){initials}{_B}?{small}(?=\s+and\b|}})"
            rf"|(?<![\w.@\-/]){small},{_B}(?:(?:{lower})(?:{_B}[a-z]\.?(?![\w/]))*|{initials})(?=\s*(?:\(|and\b|}}|<|\n|\r|$))",
            re.M,
        )

    def _fits_name(self, text: str, a: int, b: int, which: int) -> bool:
        s = text[a:b]
        words = [w.lower() for w in _LETTERS.findall(s)]
        if any(w in self.ordinary for w in words) or len(words) < 2 or re.search(r"\d", s):
            return False
        if re.search(r"\d\s*$", text[max(0, a - 4) : a]) and which == 2 or _STREETISH.match(text, b):
            return False
        bare = which == 0 and re.search(rf",{_W}+[{_UP}]{{1,2}}$", s)
        if which in (3, 4) or bare:  # bare initials or no comma: only in author lists and headers
            before = text[max(0, a - 160) : a]
            line = before[before.rfind("\n") + 1 :]
            listed = re.search(r"(?:author\s*=\s*\{[^}]*|(?:Author|From|To|Cc)\s*:\s*|\[\d+\]\s*|\band\s+|;\s*)$", before) or not line.strip()
            return bool(listed)
        return True

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Spans (from, to, kind) of the written forms."""
        found: list[tuple[int, int, str]] = []
        taken = bytearray(len(text) + 1)

        def put(a: int, b: int, kind: str) -> None:
            if not any(taken[a:b]):
                found.append((a, b, kind))
                taken[a:b] = b"\1" * (b - a)

        for m in EMAIL.finditer(text):
            put(*m.span(), "email")
        for m in ADDRESS.finditer(text):
            town = m["town"].split()
            short = len(town) > 1 and " ".join(town) not in self.pairs and m.end() == m.end("town")
            put(m.start(), m.start("town") + len(town[0]) if short else m.end(), "address")
        for m in ID.finditer(text):
            if m["eight"] and (not _LABEL8.search(text[max(0, m.start() - 40) : m.start()]) or text[m.end() : m.end() + 6].startswith(" byte")):
                continue
            if m["pass"] and not _PASS.search(text[max(0, m.start() - 60) : m.end() + 40]):
                continue
            put(*m.span(), "id")
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 14:
                put(*m.span(), "phone")
        for k, p in enumerate(self.names):
            for m in p.finditer(text):
                a, b = m.span()
                if text.startswith("M. ", a) and text.startswith(" a ", b) and re.match(r"[^\W\d_]", text[a + 3 :]):
                    a += 3  # the French title
                if self._fits_name(text, a, b, k):
                    put(a, b, "name")
        for m in self.lower.finditer(text):
            if not any(w in self.ordinary for w in _LETTERS.findall(m[0])):
                put(*m.span(), "name")
        for m in _LISTED.finditer(text):
            g = 1 if m[1] else 2
            for piece in _PIECE.finditer(m[g] or ""):
                s = piece[0].strip()
                a = m.start(g) + piece.start() + len(piece[0]) - len(piece[0].lstrip())
                if any(p.fullmatch(s) for p in self.loose) and self._fits_name(text, a, a + len(s), 0):
                    put(a, a + len(s), "name")
        return sorted(found)
