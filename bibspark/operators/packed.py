"""Several values packed in one field: minimum-description-length choice of the dialect.

A *dialect* is a set of delimiter kinds together with a quoting switch. Every value is parsed with each
dialect whose delimiters occur in it; a parse costs the code lengths of its items plus the code of the
dialect, and the cheapest parse wins. Code lengths come from one distributed counting pass:

* every item (up to ``DICT_CHARS`` characters) that any candidate parse produces is counted, and costs
  ``-log2(n/N)`` plus its own spelling shared over its uses among ``HEAVY`` items (a two-part code);
* an item outside the dictionary is spelled out: the code of its *shape* (letters, digits and path runs
  reduced to one symbol each) plus ``CHAR_BITS`` for every character.

The dictionary holds symbols with ``n >= N / HEAVY`` only, hence at most ``HEAVY`` entries of bounded length
per field and kind: its size on the driver and in a broadcast is bounded whatever the input. Rarer items are
spelled out, so no value is dropped or capped. From ``HEAVY`` items on, codes depend on shares alone: the same values
in the same shares are parsed in the same way at every size. Fewer items pay their spelling in full.

Defined results: a null, empty or blank value has no items; empty items do not count; repeated items do;
a value without delimiters is one item; extra columns of the input do not take part.
"""

from __future__ import annotations

import math
import posixpath
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut

DICT_CHARS = 40
HEAVY = 20_000
CHAR_BITS = 5.0
SHAPE_BITS = 4.0
INSIDE_BITS = 8.0
FLUSH = 100_000

#: kinds of delimiter that each field may use; the order is the order of symbols in shapes
KINDS = {"keywords": ";,|\n/", "file": ";,|\n", "author": "A;&,|\n"}

_SCAN = {
    "keywords": re.compile(r"""\\.|"[^"]*"(?=\s*(?:[;,|/\n]|$))|\{|\}|[;,|/]|\n""", re.S),
    "file": re.compile(r"""\\.|"[^"]*"(?=\s*(?:[;,|\n]|$))|\{|\}|[;,|]|\n""", re.S),
    "author": re.compile(r"""\\.|"[^"]*"(?=\s*(?:[;,|&\n]|$))|\{|\}|(?i:(?<=\s)and(?=\s))|[;,|]|(?<=\s)&(?=\s)|\n""", re.S),
}
_NO_SEP = re.compile(r"""[;,|/\n&{}"\\]|\s[aA][nN][dD]\s""")


def separators(field: str, value: str, quoting: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every delimiter outside quotes, braces and escapes (or anywhere without quoting)."""
    out, depth = [], 0
    kinds = KINDS[field]
    opened = quoting and value.count("{") == value.count("}")
    for m in _SCAN[field].finditer(value):
        t = m[0]
        c = t[0]
        if c == "\\":
            continue
        if c == '"' and len(t) > 1:
            if not quoting:
                out += [(m.start() + x.start(), m.start() + x.end(), x[0]) for x in re.finditer(r"[;,|/\n]", t) if x[0] in kinds]
            continue
        if c == "{":
            depth += opened
        elif c == "}":
            depth -= opened and depth > 0
        elif depth == 0:
            out.append((m.start(), m.end(), "A" if c in "aA" else c))
    if field == "author" and any(k == "A" for _, _, k in out):
        # a line break beside "and" is white space of that delimiter
        out = [
            x for i, x in enumerate(out)
            if x[2] != "\n" or not any(y[2] == "A" and not value[min(x[1], y[1]):max(x[0], y[0])].strip() for y in out[max(0, i - 2):i + 3])
        ]
    return out


_ESC = re.compile(r"\\([;,:|&_%$#/])")
_WS_RUN = re.compile(r"\s+")


def _pieces(value: str, seps: list[tuple[int, int, str]], kinds: Iterable[str]) -> list[str]:
    out, at = [], 0
    for a, b, k in seps:
        if k in kinds:
            out.append(value[at:a].strip())
            at = b
    out.append(value[at:].strip())
    return out


def bare(item: str) -> str:
    """Without white space around, quotes or braces that enclose all of it, and escape signs."""
    item = item.strip()
    while len(item) > 1:
        if item[0] == item[-1] == '"' and '"' not in item[1:-1]:
            item = item[1:-1].strip()
        elif item[0] == "{" and item[-1] == "}" and _encloses(item):
            item = item[1:-1].strip()
        else:
            break
    return _ESC.sub(r"\1", item) if "\\" in item else item


def _encloses(item: str) -> bool:
    depth = 0
    for i, c in enumerate(item):
        depth += (c == "{") - (c == "}")
        if depth == 0:
            return i == len(item) - 1
    return False


_TYPE = re.compile(r"\s*[A-Za-z0-9]{0,5}\s*")


def attachment_path(item: str) -> str:
    """Path of one attachment: ``path``, ``path:type`` or ``description:path:type``; colons inside paths stay."""
    item = item.strip()
    if len(item) > 1 and item[0] == item[-1] == '"':
        item = item[1:-1]
    if ":" not in item:
        return bare(item)
    parts = re.split(r"(?<!\\):", item)
    if len(parts) == 1:
        return bare(item)
    if len(parts) > 1 and _TYPE.fullmatch(parts[-1]):
        parts = parts[:-1]
    if len(parts) > 1 and "/" not in parts[0]:
        parts = parts[1:]
    return bare(":".join(parts))


_NAMES = (
    (re.compile(r"\{[^{}]* [^{}]*(?:\{[^{}]*\}[^{}]*)*\}"), "O"),
    (re.compile(r"[{}\\\"'’^~`.\u00ad\u200b-\u200d\u2060\ufeff\u0300-\u036f]+(?=\w)|(?<=\w)[{}\\\"'’^~`\u00ad\u200b-\u200d\u2060\ufeff\u0300-\u036f\-]+"), ""),
    (re.compile(r"\s+[aA][nN][dD]\s+"), "\x01"),
    (re.compile(r"\s*([;,|&\n])\s*"), r"\1"),
    (re.compile(r"(?i)(?<!\w)(?:de|la|da|do|dos|das|van|von|der|den|del|di|du|le|al|el)[ \-]+(?=\w)"), ""),
    (re.compile(r"(?<![^\W_])[^\W\d_](?:\.|(?![^\W_]))(?:[ .\-]*(?<![^\W_])[^\W\d_](?:\.|(?![^\W_])))*|(?<!\w)[A-Z]{2,3}(?!\w)"), "\x02"),
    (re.compile(r"\x02[.\- \x02]+(?=[;,|&\n\x01\x02]|$)"), "\x02"),
    (re.compile(r"[^\W_][\w.\-]*"), "\x03"),
    (re.compile(r"[^\S\n]+"), ""),
)
_FILES = (
    (re.compile(r'"[^"]*"'), "\x04"),
    (re.compile(r"\\."), "_"),
    (re.compile(r"[ \t]*([:;,|\n])[ \t]*"), r"\1"),
    (re.compile(r"[^:;,|\n\x01-\x04]*\.[A-Za-z0-9]{1,5}(?=[:;,|\n]|\s*$)"), "\x01"),
    (re.compile(r"(?<=:)[A-Za-z0-9]{1,5}(?=[;,|\n]|\s*$)"), "\x02"),
    (re.compile(r"[^:;,|\n\x01-\x04]+"), "\x03"),
)
_SYMBOLS = {"author": str.maketrans("\x01\x02\x03", "AIW"), "file": str.maketrans("\x01\x02\x03\x04", "xtpq")}


def shape(field: str, text: str) -> str:
    """Form of a text, with runs of ordinary characters reduced to one symbol; delimiters stay as they are."""
    if field == "keywords":
        return re.sub(r"\w+(?:[ \-]\w+)*", "w", text)
    for pattern, by in _NAMES if field == "author" else _FILES:
        text = pattern.sub(by, text)
    return text.strip().translate(_SYMBOLS[field])


@lru_cache(maxsize=2_000)
def shape_parses(field: str, whole: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(dialect, item shapes) of every parse of a whole value's shape."""
    present = [k for k in KINDS[field] if k in whole]
    out = []
    for n in range(len(present) + 1):
        for kinds in combinations(present, n):
            x = whole
            for k in kinds:
                x = x.replace(k, "\0")
            out.append(("".join(kinds), tuple(x.split("\0"))))
    return tuple(out)


def candidates(field: str, value: str) -> list[tuple[str, tuple[str, ...]]]:
    """(dialect, items) of every parse of the value; the dialect "" takes the value whole."""
    if not _NO_SEP.search(value):
        return [("", (value.strip(),))]
    out: dict[tuple[str, ...], str] = {}
    for quoting in (True, False) if '"' in value or "{" in value else (True,):
        seps = separators(field, value, quoting)
        present = [k for k in KINDS[field] if any(s[2] == k for s in seps)]
        for n in range(len(present) + 1):
            for kinds in combinations(present, n):
                items = tuple(_pieces(value, seps, kinds))
                out.setdefault(items, "".join(kinds) + ("" if quoting else "!"))
    return [(d, i) for i, d in out.items()]


def symbols(items: Iterable[str]) -> Iterator[str]:
    """Symbols of the two codes of keywords: ``=item`` for the dictionary, ``~shape`` for spelled items."""
    for x in items:
        if x:
            yield "~" + shape("keywords", x)
            b = bare(x)
            if len(b) <= DICT_CHARS:
                yield "=" + b


class Codes:
    """Code lengths in bits, from the counted symbols of all rows."""

    def __init__(self, counts: dict[tuple[str, str], int], totals: dict[tuple[str, str], int]):
        self.bits = {}
        for (f, s), n in counts.items():
            total = max(totals.get((f, s[0]), n), n, 2)
            own = (CHAR_BITS if s[0] == "=" else SHAPE_BITS) * len(s)
            self.bits[f, s] = -math.log2(n / total) + own / n * max(1.0, total / HEAVY)
        self.escape = {k: math.log2(min(max(2, v), HEAVY)) for k, v in totals.items()}
        self.scale = {f: max(1.0, v / HEAVY) for (f, k), v in totals.items() if k == "@"}
        # dialects, given the kinds of delimiter that a value holds
        self.seen: dict[tuple[str, str], int] = {}
        self.used = {k: n for k, n in counts.items() if k[1][0] == "@"}
        for (f, s), n in self.used.items():
            self.seen[f, s.split(">")[0]] = self.seen.get((f, s.split(">")[0]), 0) + n
        self.chosen: dict[tuple[str, str], str] = {}

    def __getstate__(self):
        return self.__dict__ | {"chosen": {}}

    def form(self, f: str, s: str) -> float:
        """Bits of an item's shape; a delimiter left inside an item is spelled out, but for the comma of names and paths."""
        if f != "keywords" and (n := sum(map(s.count, "A;|&\n"))):
            return self._form(f, s) + INSIDE_BITS * n
        return self._form(f, s)

    def _form(self, f: str, s: str) -> float:
        bits = self.bits.get((f, "~" + s))
        return self.escape.get((f, "~"), 8.0) + SHAPE_BITS * len(s) if bits is None else bits

    def declared(self, f: str, present: str, kinds: str) -> float:
        """Bits that declare a dialect; before dialects are counted, two for each delimiter."""
        total = self.seen.get((f, "@" + present))
        if total is None:
            return 2.0 * len(kinds)
        return -math.log2(self.used.get((f, f"@{present}>{kinds}"), 0) / total + 0.25 / total * self.scale.get(f, 1.0)) + 0.01 * len(kinds)

    def dialect(self, f: str, whole: str) -> str:
        """Cheapest dialect of a shape; a form that this value has used already costs one bit."""
        d = self.chosen.get((f, whole))
        if d is None:
            parses, best = shape_parses(f, whole), None
            for kinds, items in parses if len(parses) > 1 else ():
                used, cost = set(), self.declared(f, parses[-1][0], kinds)
                for x in items:
                    cost += 1.0 if x in used or not x else self.form(f, x)
                    used.add(x)
                if best is None or cost < best - 1e-9:
                    best, d = cost, kinds
            d = d or ""
            if len(self.chosen) > FLUSH * 3:
                self.chosen.clear()
            self.chosen[f, whole] = d
        return d

    def keyword(self, x: str) -> float:
        if not x:
            return 1.0
        b = bare(x)
        spelled = self.form("keywords", shape("keywords", x)) + CHAR_BITS * len(b) + 3.0
        known = self.bits.get(("keywords", "=" + b)) if len(b) <= DICT_CHARS else None
        return spelled if known is None else min(known + (b != x), spelled)

    def split(self, f: str, value: str | None) -> list[str]:
        """Raw items of the cheapest parse (ties: the parse with fewer delimiters), empty ones left out."""
        if value is None or not value.strip():
            return []
        if not _NO_SEP.search(value):
            return [value.strip()]
        if f == "keywords":
            parses = candidates(f, value)
            best = min(parses, key=lambda p: (round(sum(map(self.keyword, p[1])) + 2.0 * len(p[0]), 6), len(p[0]), p[0])) if len(parses) > 1 else parses[0]
            return [x for x in best[1] if x]
        kinds = self.dialect(f, shape(f, value))
        if not kinds:
            return [value.strip()]
        if _GUARD.search(value) or (f == "author" and "\n" in kinds):
            items = _pieces(value, separators(f, value), kinds)
        else:
            items = _splitter(kinds).split(value)
        return [y for y in (x.strip() for x in items) if y]


_GUARD = re.compile(r'["{\\]')


@lru_cache(maxsize=64)
def _splitter(kinds: str) -> re.Pattern:
    return re.compile("|".join(r"\s+[aA][nN][dD]\s+" if k == "A" else r"\s&\s" if k == "&" else re.escape(k) for k in kinds))


def clean(f: str, raw: Iterable[str]) -> list[str]:
    """Items as they come out: paths of attachments, bare values of the others; empty ones do not count."""
    get = attachment_path if f == "file" else bare
    return [y for y in map(get, raw) if y]


_COUNTS = pa.schema([("field", pa.string()), ("sym", pa.string()), ("n", pa.int64())])


def _batch(c: Counter) -> pa.RecordBatch:
    keys = list(c)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([c[k] for k in keys], pa.int64())], schema=_COUNTS)


def count_symbols(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, sym, n) of all values, pre-aggregated in each task before the shuffle.

    Keywords give the symbols of all their candidate parses, the other fields ``^shape`` of the whole value.
    """
    names = list(fields)

    def count(batches):
        c: Counter = Counter()
        for b in batches:
            for f in names:
                for v in b.column(f).to_pylist():
                    if v and not v.isspace():
                        if f != "keywords":
                            c[f, "^" + shape(f, v)] += 1
                            continue
                        seen = set()
                        for _, items in candidates(f, v):
                            seen.update(items)
                        for s in symbols(seen):
                            c[f, s] += 1
            if len(c) > FLUSH:
                yield _batch(c)
                c = Counter()
        yield _batch(c)

    part = df.select(*[c.alias(f) for f, c in fields.items()]).mapInArrow(count, "field string, sym string, n long")
    return part.groupBy("field", "sym").agg(F.sum("n").alias("n"))


def _forms(shapes: DataFrame, codes: Codes | None) -> DataFrame:
    """Counts of item shapes: of all parses at first, then of the parses chosen under the codes so far."""
    shared = shapes.sparkSession.sparkContext.broadcast(codes)

    def count(batches):
        codes = shared.value
        c: Counter = Counter()
        for b in batches:
            for f, s, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                parses = shape_parses(f, s[1:])
                if codes is not None:
                    d = codes.dialect(f, s[1:])
                    c[f, f"@{parses[-1][0]}>{d}"] += n
                    parses = [p for p in parses if p[0] == d]
                for x in {x for _, items in parses for x in items} if codes is None else [x for _, items in parses for x in items]:
                    if x:
                        c[f, "~" + x] += n
            if len(c) > FLUSH:
                yield _batch(c)
                c = Counter()
        yield _batch(c)

    return shapes.mapInArrow(count, "field string, sym string, n long").groupBy("field", "sym").agg(F.sum("n").alias("n"))


def _heavy(counts: DataFrame) -> tuple[dict, dict]:
    """Symbols with a share of 1/HEAVY or more of their field and kind, and the totals."""
    kind = F.substring("sym", 1, 1)
    totals = {(r[0], r[1]): r[2] for r in counts.groupBy("field", kind).agg(F.sum("n")).collect()}
    least = F.lit(0.0)
    for (f, k), n in totals.items():
        least = F.when((F.col("field") == f) & (kind == k), F.lit(n / HEAVY)).otherwise(least)
    return {(r[0], r[1]): r[2] for r in counts.where(F.col("n") >= least).select("field", "sym", "n").collect()}, totals


def fit(df: DataFrame, fields: dict[str, Column], rounds: int = 2) -> Codes:
    """Code lengths over all rows of ``df``; what reaches the driver is bounded by ``HEAVY`` symbols a field and kind."""
    counts = cut(count_symbols(df, fields))
    words, totals = _heavy(counts.where(~F.col("sym").startswith("^"))) if "keywords" in fields else ({}, {})
    if set(fields) == {"keywords"}:
        return Codes(words, totals)
    shapes, codes = counts.where(F.col("sym").startswith("^")), None
    for _ in range(rounds + 1):
        forms, sizes = _heavy(cut(_forms(shapes, codes)))
        codes = Codes(words | forms, totals | sizes)
    return codes


def split_fields(
    df: DataFrame,
    keys: list[str],
    fields: dict[str, Column],
    codes: Codes,
    least: int = 1,
    post: Callable[[str], str] | None = None,
    distinct: bool = False,
) -> DataFrame:
    """(keys, field_name, pos, item): one row a value and position, for values of at least ``least`` items.

    ``post`` rewrites items (an empty result drops the item); ``distinct`` keeps the first of equal items of a row.
    """
    names = list(fields)
    shared = df.sparkSession.sparkContext.broadcast(codes)
    types = [df.schema[k].dataType.simpleString() for k in keys]

    def parse(batches):
        codes = shared.value
        for b in batches:
            rows, f_, p, x = [], [], [], []
            for f in names:
                for i, v in enumerate(b.column(f).to_pylist()):
                    if v:
                        items = clean(f, codes.split(f, v))
                        if post:
                            items = [y for y in map(post, items) if y]
                        if distinct:
                            items = list(dict.fromkeys(items))
                        if len(items) >= least:
                            rows += [i] * len(items)
                            f_ += [f] * len(items)
                            p += range(1, len(items) + 1)
                            x += items
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(k).take(at) for k in keys] + [pa.array(f_, pa.string()), pa.array(p, pa.int32()), pa.array(x, pa.string())], names=[*keys, "field_name", "pos", "item"])

    schema = ", ".join(f"`{k}` {t}" for k, t in zip(keys, types)) + ", field_name string, pos int, item string"
    return df.select(*keys, *[c.alias(f) for f, c in fields.items()]).mapInArrow(parse, schema)


def resolve_path(path: str) -> str:
    """Path with ``.``, ``..`` and repeated slashes resolved; letter case is kept."""
    if "//" not in path and "./" not in path and not path.endswith((".", "/")):
        return path
    at = posixpath.normpath(re.sub("/+", "/", path))
    return "" if at == "." else at


def bib_fields(*names: str) -> dict[str, Column]:
    """Columns of the packed fields of bib_entry."""
    return {f: F.col("field_map").getItem(f) for f in names or KINDS}


def count_items(df: DataFrame, keys: list[str], fields: dict[str, Column], codes: Codes) -> DataFrame:
    """(keys, n_file, n_keywords, ...): number of different items of each field of a row.

    Attachment paths are resolved and keep their letter case; other items are compared ignoring it.
    """
    names = list(fields)
    shared = df.sparkSession.sparkContext.broadcast(codes)

    def count(batches):
        codes = shared.value
        for b in batches:
            cols = []
            for f in names:
                fold = resolve_path if f == "file" else str.casefold
                cols.append(pa.array([len({fold(x) for x in clean(f, codes.split(f, v))} - {""}) if v else 0 for v in b.column(f).to_pylist()], pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *cols], names=[*keys, *("n_" + f for f in names)])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + "".join(f", n_{f} int" for f in names)
    return df.select(*keys, *[c.alias(f) for f, c in fields.items()]).mapInArrow(count, schema)
