"""Repair of text from scanned pages: running lines, page numbers, misread words, hyphenation, paragraphs.

1. Pages are grouped by scan and by runs of ``BLOCK`` page numbers, with the pages around as context, so that no scan,
   however long, is one task. Equal pages of a place are worked once. The neighbours of a page are the first
   text of each place around it, so blocks and salts change no row.
2. One distributed pass over the different pages counts words, words hyphenated within a line, and pairs of words at page
   edges and elsewhere, in a sketch of ``CELLS`` cells (two hashes, the smaller count holds). Its size is fixed,
   and no count is cut off by the size of the corpus: what it cannot tell apart are shares below about 1 / CELLS.
3. Page numbers: tokens at the edges of neighbouring pages that go up with the pages give the distance of the printed number
   from the page's place; a line at an edge that reads as that number, decorated or misread, is a page number.
4. Running headers and footers: an edge line that recurs, by trigrams of its letters, at the same edge of a page near by;
   or many of whose pairs of words recur at page edges of the corpus far more often than inside pages; or that carries the
   page number. A line whose pairs of words are those of running text must recur nearly whole, and one that begins in
   lower case, as the rest of a sentence does, must recur both ways and be shorter than a full line.
5. A word is misread if a usual misreading of a far more frequent word explains it. A hyphen at the end of a line is
   no part of the word if the joined word is known and more usual than the hyphenated one.
6. Lines that remain are joined to paragraphs, over page breaks.

Defined results: null and empty pages and pages without a number give nothing; a page scanned twice gives its lines twice (with its own page_id);
misreadings in running lines and page numbers do not count; table rows and headings are no running text; a paragraph
ends after ``HALO`` further pages.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written

BLOCK = 32
HALO = 3
#: pages on either side in which an edge line may recur
NEAR = 4
CELLS = 1 << 21
PARTS = 64
FLUSH = 200_000
#: different texts of a block that one task works at once; the rest goes to others
CROWD = 256
#: how much more frequent the right word must be, and how often it must occur at least
RATIO = 8
KNOWN = 4
#: trigrams two edge lines share, and those two lines in the words of running text share; times more often at edges than
#: inside; pages at least; part of a line's pairs
ALIKE, SAME, EDGY, OFTEN, MOST = 0.6, 0.85, 10, 3, 0.4

# fixed values: usual misreadings, "read for right"; 9 stands for any digit
MISREADINGS = (
    "c:e u:a f:t 9:o 9:s 9:l 9:g 9:b 9:t 9:i 9:z 9:e 9:a u:n l:i !:i !:l cl:d e:c b:h rn:m v:y m:in vv:w h:li l:9 i:9 o:9 s:9 z:9 b:9 g:9 q:9 !:9 |:l |:i |:9 "
    "ri:n ii:u lc:k nn:m a:o o:a o:c e:o i:t t:l i:j d:cl m:rn y:v n:u h:b w:vv"
).split()
_PAIRS = [tuple(x.split(":")) for x in MISREADINGS]

_WORD = re.compile(r"[!|]?[^\W_]+(?:[!|][^\W_]+)*")
_GAP = re.compile(r"\s{2,}")
_INNER = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_DIGIT = re.compile(r"\d")
_HEADING = re.compile(r"\s*(?:\d+(?:\.\d+)*\.?\s+[^\W\d_]\S*(?:\s+\S+){0,4}|[^\W\d_]+\s+[\dlIOZSB]{1,3}\.?)\s*")
_LAST = re.compile(r"([^\W_]+(?:[!|][^\W_]+)*)-\s*$")
_FIRST = re.compile(r"\s*([^\W_]+(?:[!|][^\W_]+)*)")


def norm(word: str) -> str:
    return word.lower() if word.isalpha() else _DIGIT.sub("9", word.lower())


_RUN = re.compile(r"[\w!|]+")
_SIGN = re.compile(r"[!|_]")


def words_of(line: str) -> list[str]:
    """All of ``_WORD``; runs without the rarer signs are words as they are."""
    runs = _RUN.findall(line)
    if not _SIGN.search(line):
        return runs
    return [w for r in runs for w in ((r,) if r.isalnum() else _WORD.findall(r))]


@lru_cache(maxsize=FLUSH)
def edge_grams(line: str) -> frozenset[str]:
    """Trigrams of the letters of an edge line."""
    form = re.sub(r"[\W\d_]+", " ", line.lower()).strip()
    return frozenset(form[i : i + 3] for i in range(len(form) - 2)) if len(form) > 4 else frozenset()


def alike(a: frozenset[str], b: frozenset[str], share: float) -> bool:
    return bool(a and b) and 2 * len(a & b) >= share * (len(a) + len(b))


def is_table(line: str) -> bool:
    line = line.strip()
    if not _GAP.search(line):
        return False
    cells = _GAP.split(line)
    return len(cells) > 2 or len(cells) == 2 and sum(c.isdigit() for c in line) > 2 and not re.search(r"[^\W\d_]{4}", line)


def _cells(sym: str) -> tuple[int, int]:
    h = zlib.crc32(sym.encode("utf-8", "surrogatepass"))
    return h & (CELLS - 1), CELLS + (h >> 11)


EDGE_LINES, INNER_LINES = ">", "<"


class Counts:
    """Words, words hyphenated inside a line, and pairs of neighbouring words of lines at page edges and of others."""

    def __init__(self):
        self.words: Counter = Counter()
        self.edge: Counter = Counter()
        self.inner: Counter = Counter()

    def add(self, text: str) -> None:
        lines = [x for x in _DIGIT.sub("9", text.lower()).split("\n") if x and not x.isspace()]
        found = [words_of(x) for x in lines]
        whole: list[str] = []
        pairs: list[tuple[str, str]] = []
        for i, (x, w) in enumerate(zip(lines, found)):
            if w and 1 < i < len(lines) - 2:
                pairs += pairwise(["", *w, ""])
            if "-" in x:
                self.words.update(["-" + m for m in _INNER.findall(x)])
                if w and x.rstrip().endswith("-"):
                    w = w[:-1]
            if i and w and lines[i - 1].rstrip().endswith("-"):
                w = w[1:]
            whole += w
        self.words.update(whole)
        self.inner.update(pairs)
        self.edge.update({p for w in (*found[:2], *found[2:][-2:]) if w for p in pairwise(["", *w, ""])})
        self.words[EDGE_LINES] += min(4, len(lines))
        self.words[INNER_LINES] += max(0, len(lines) - 4)

    def __len__(self) -> int:
        return len(self.words) + len(self.edge) + len(self.inner)

    def symbols(self):
        yield from self.words.items()
        yield from ((f"{EDGE_LINES}{a} {b}", n) for (a, b), n in self.edge.items())
        yield from ((f"{INNER_LINES}{a} {b}", n) for (a, b), n in self.inner.items())


def count_sketch(pages: DataFrame, text: str) -> np.ndarray:
    """The sketch of all pages: tables of the tasks, cut in ``PARTS`` and added part by part, ``PARTS`` tasks first."""
    size = 2 * CELLS // PARTS

    def count(batches):
        table = np.zeros(2 * CELLS, np.int64)
        c = Counts()

        def add():
            for sym, n in c.symbols():
                a, b = _cells(sym)
                table[a] += n
                table[b] += n

        for batch in batches:
            for t in batch.column(0).to_pylist():
                c.add(t)
                if len(c) > FLUSH:
                    add()
                    c = Counts()
        add()
        slot = TaskContext.get().partitionId() // PARTS
        parts = [(k, table[k * size : (k + 1) * size]) for k in range(PARTS)]
        at = [np.flatnonzero(x) for _, x in parts]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in parts], pa.int32()), pa.array([slot] * PARTS, pa.int32()), pa.array([x.astype(np.int32).tobytes() for x in at], pa.binary()), pa.array([x[i].tobytes() for (_, x), i in zip(parts, at)], pa.binary())],
            names=["part", "slot", "at", "n"],
        )

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for a, n in zip(rows.column("at").to_pylist(), rows.column("n").to_pylist()):
            total[np.frombuffer(a, np.int32)] += np.frombuffer(n, np.int64)
        at = np.flatnonzero(total).astype(np.int32)
        return pa.table([rows.column("part").slice(0, 1), pa.array([0], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary())], names=["part", "slot", "at", "n"])

    out = np.zeros(2 * CELLS, np.int32)
    schema = "part int, slot int, at binary, n binary"
    local = pages.select(text).mapInArrow(count, schema).groupBy("part", "slot").applyInArrow(add, schema)
    for part, _, at, n in local.groupBy("part").applyInArrow(add, schema).collect():  # 2 * CELLS numbers at most
        out[part * size + np.frombuffer(at, np.int32)] = np.minimum(np.frombuffer(n, np.int64), 2**31 - 1)
    return out


class Vocabulary:
    def __init__(self, sketch: np.ndarray):
        self.sketch = sketch
        self._setup()

    def _setup(self) -> None:
        self.cells = memoryview(self.sketch)
        self.memo: dict[str, int] = {}
        self.wrong: dict[str, str | None] = {}
        self.spread = max(1, self.count(INNER_LINES)) / max(1, self.count(EDGE_LINES))

    def __getstate__(self):
        return self.sketch

    def __setstate__(self, sketch):
        self.sketch = np.ascontiguousarray(sketch)
        self._setup()

    @classmethod
    def of(cls, counts: Counts) -> Vocabulary:
        sketch = np.zeros(2 * CELLS, np.int32)
        for sym, n in counts.symbols():
            for k in _cells(sym):
                sketch[k] += n
        return cls(sketch)

    def count(self, sym: str) -> int:
        n = self.memo.get(sym)
        if n is None:
            a, b = _cells(sym)
            n = min(self.cells[a], self.cells[b])
            if len(self.memo) > 2 * FLUSH:
                self.memo.clear()
            self.memo[sym] = n
        return n

    def lines(self, line: str) -> tuple[float, float]:
        """Part of a line's pairs of words that recur at edges rather than inside pages, and inside rather than at edges."""
        words = [norm(w) for w in words_of(line)]
        words = [self.right(w) or w for w in words]
        edgy = inner = 0
        pairs = list(pairwise(["", *words, ""])) if words else []
        for a, b in pairs:
            e, i = self.count(f"{EDGE_LINES}{a} {b}"), self.count(f"{INNER_LINES}{a} {b}")
            edgy += e >= OFTEN and e * self.spread > EDGY * i
            inner += i >= OFTEN and e * self.spread < EDGY * i / 2
        return edgy / max(1, len(pairs)), inner / max(1, len(pairs))

    def right(self, word: str) -> str | None:
        """The word that a normalised word is a misreading of, or None."""
        if word not in self.wrong:
            if len(self.wrong) > FLUSH:
                self.wrong.clear()
            self.wrong[word] = self._right(word)
        return self.wrong[word]

    def _near(self, word: str):
        for wrong, right in _PAIRS:
            at = word.find(wrong)
            while at >= 0:
                yield word[:at] + right + word[at + len(wrong) :]
                at = word.find(wrong, at + 1)

    def _right(self, word: str) -> str | None:
        if not word or word.strip("9") == "":
            return None
        n = self.count(word)
        best = max(((self.count(x), x) for x in self._near(word)), default=(0, ""))
        if best[0] >= KNOWN and best[0] >= RATIO * max(1, n):
            return best[1]
        if n < KNOWN and len(word) > 4:
            best = max(((self.count(y), y) for x in set(self._near(word)) for y in self._near(x)), default=(0, ""))
            if best[0] >= 8 * KNOWN and best[1] != word and best[0] >= 4 * RATIO * max(1, n):
                return best[1]
        return None

    def keeps_hyphen(self, left: str, first: str, second: str) -> bool:
        """Whether the hyphen between two parts belongs to the word; ``left`` is what precedes within the compound."""
        joined, compound = norm(first + second), f"-{first}-{second}".lower()
        a, b = self.known(joined), self.count(compound)
        if left:
            b = max(b, self.count(f"-{left}-{first}-{second}".lower()))
            a = max(a, self.count(f"-{left}-{first}{second}".lower()))
        if a or b:
            return b > a
        fixed = self.right(norm(second)) or second.lower()
        if self.count(f"-{self.right(norm(first)) or first.lower()}-{fixed}"):
            return True
        return False

    def known(self, word: str) -> int:
        n = self.count(word)
        return n or (self.count(x) if (x := self.right(word)) else 0)


_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: int) -> str:
    out = ""
    for v, s in _ROMAN:
        while n >= v:
            out += s
            n -= v
    return out


_AS_DIGIT = str.maketrans("lI|!iOoQDSsZzBbGgqTtA", "111110000552286699774")
_AS_ROMAN = str.maketrans("1|!jy0e", "iiiivoc")


def _differs(a: str, b: str) -> int:
    if a == b:
        return 0
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b))
    if abs(len(a) - len(b)) == 1:
        s, t = sorted((a, b), key=len)
        return 1 if any(t[:i] + t[i + 1 :] == s for i in range(len(t))) else 9
    return 9


def is_number(token: str, page: int) -> bool:
    """Whether a token reads as the page's number, possibly misread."""
    t = re.sub(r"[\W_]+$|^[\W_]+", "", token.replace("|", "l").replace("!", "i"))
    if not t or len(t) > 9:
        return False
    want = str(page)
    if re.fullmatch(r"[\dlIiOoQDSsZzBbGgqTtA]{1,6}", t) and (t.translate(_AS_DIGIT) == want or _differs(t.translate(_AS_DIGIT), want) <= (1 if len(want) > 1 and len(t) == len(want) else 0)):
        return True
    if any(c.isdigit() for c in t) and len(want) > 2 and _differs(t.translate(_AS_DIGIT), want) <= 1:
        return True
    r, low = roman(page), t.lower()
    if low == r:
        return True
    low = low.translate(_AS_ROMAN)
    alike = lambda s: s.replace("l", "i").replace("rn", "m").replace("cl", "d")
    return alike(low) == alike(r) or len(r) > 2 and re.fullmatch("[ivxlcdmrnuoe]+", low) is not None and _differs(alike(low), alike(r)) <= 1


def is_page_number(line: str, page: int) -> bool:
    words = line.split()
    core = [w for w in words if re.search(r"[^\W_]|[|!]", w)]
    if not core or len(line.strip()) > 24:
        return False
    if len(core) == 1:
        return is_number(core[0], page)
    if len(core) == 2 and len(re.sub(r"\W", "", core[0])) <= 5 and not core[0][0].isdigit():
        return is_number(core[1], page) and any(c.isdigit() for c in core[1].translate(_AS_DIGIT)) and len(core[0]) >= 1
    return False


def with_number(line: str, page: int) -> bool:
    """A running line with the page's number at its end or beginning."""
    s = line.strip()
    m = re.fullmatch(r"(\S+)\s{2,}(\S.*)", s)
    if m and is_number(m[1], page):
        return True
    m = re.fullmatch(r"(.*\S)\s{2,}(\S+)", s)
    return bool(m and is_number(m[2], page))


class Page:
    def __init__(self, no: int, text: str):
        self.no = no
        self.lines = text.split("\n")
        self.kind = ["" if x.strip() else "blank" for x in self.lines]
        full = [i for i, k in enumerate(self.kind) if not k]
        self.edges = full[:4], full[::-1][:4]
        self._grams: list[list[frozenset[str]] | None] = [None, None]
        self.numbers: set[int] | None = None
        lengths = sorted([len(self.lines[i].rstrip()) for i in full])
        self.width = lengths[int(0.8 * (len(lengths) - 1))] if lengths else 0


    def grams(self, side: int) -> list[frozenset[str]]:
        if self._grams[side] is None:
            self._grams[side] = [edge_grams(self.lines[i]) for i in self.edges[side]]
        return self._grams[side]


def _recurs(grams: frozenset[str], near: list[Page], side: int, share: float) -> bool:
    """Whether a line with these trigrams stands at the same edge of a page near by."""
    return bool(grams) and any(alike(grams, g, share) for q in near for g in q.grams(side))


def printed_numbers(p: Page) -> set[int]:
    """Numbers at the page's edges that stand alone or at the end or beginning of a line."""
    if p.numbers is not None:
        return p.numbers
    out = p.numbers = set()
    for edge in p.edges:
        for i in edge[:2]:
            words = p.lines[i].split()
            for w in {words[0], words[-1]}:
                t = re.sub(r"\W", "", w)
                if t.isdecimal() and len(t) < 7:
                    out.add(int(t))
    return out


def distance(p: Page, near: list[Page]) -> int:
    """How far the printed page numbers are from the places: the sequence that most of the pages near by follow, else 0."""
    votes = Counter(n - q.no for q in [p, *near] for n in printed_numbers(q))
    best = max(votes.items(), key=lambda x: (x[1], x[0] == 0, -abs(x[0])), default=(0, 0))
    return best[0] if best[1] > 1 else 0


def mark_edges(p: Page, near: list[Page], vocabulary: Vocabulary) -> None:
    """Set the kind of the page's numbers and running lines; ``near`` are the pages around it."""
    number = p.no + distance(p, near)
    for side, edge in enumerate(p.edges):
        numbered = False
        for rank, i in enumerate(edge):
            line = p.lines[i]
            if not numbered and is_page_number(line, number):
                p.kind[i], numbered = "pagenum", True
                continue
            if not numbered and with_number(line, number):
                p.kind[i], numbered = "running", True
                continue
            if is_table(line) or len(line) < 90 and _HEADING.fullmatch(line):
                break
            goes_on = line.lstrip()[:1].islower()
            if goes_on and len(line) >= 0.8 * p.width:
                break
            edgy, inner = vocabulary.lines(line)
            share = ALIKE if inner < MOST else SAME
            typical = edgy >= max(MOST, inner)
            if goes_on and not typical:
                break
            if typical and not goes_on or _recurs(edge_grams(line), near, side, share):
                p.kind[i] = "running"
                continue
            break
    short = 0.7 * max(p.width, 30)
    for i, k in enumerate(p.kind):
        if k == "":
            s = p.lines[i].strip()
            if ("  " in s or "\t" in s) and is_table(s) or len(s) < short and s[-1] not in "-," and _HEADING.fullmatch(s):
                p.kind[i] = "other"


def following(pages: list[Page], at: int, line: int, skip: int = 0) -> tuple[Page, int] | None:
    """The next line of running text, maybe on the next page, or past ``skip`` pages without any."""
    p = pages[at]
    for i in range(line + 1, len(p.lines)):
        if p.kind[i] == "":
            return p, i
    for no in range(p.no + 1, p.no + 2 + skip):
        q = next((q for q in pages if q.no == no), None)
        if q is None:
            return None
        for i, k in enumerate(q.kind):
            if k == "":
                return q, i
    return None


def line_noise(pages: list[Page], vocabulary: Vocabulary):
    """(page, line, kind) of all noise, and the joins of hyphenated words."""
    carried: set[tuple[int, int]] = set()  # lines that begin with the rest of a word
    words_at = {id(p): [words_of(x) if not k else [] for x, k in zip(p.lines, p.kind)] for p in pages}
    wrong = {w for w in {w for lines in words_at.values() for words in lines for w in words} if vocabulary.right(norm(w))}
    for at, p in enumerate(pages):
        if not any(q.no == p.no - 1 for q in pages) and (body := [i for i, k in enumerate(p.kind) if k == ""]) and p.lines[body[0]][:1].islower():
            carried.add((id(p), body[0]))
        for i, line in enumerate(p.lines):
            k = p.kind[i]
            if k in ("running", "pagenum"):
                yield p, i, k
            if k:
                continue
            words = words_at[id(p)][i]
            m = _LAST.search(line) if line.rstrip().endswith("-") else None
            nxt = following(pages, at, i) if m and not m[1][-1].isdigit() else None
            first = _FIRST.match(nxt[0].lines[nxt[1]]) if nxt else None
            joined = None
            if m and first and not first[1][0].isdigit() and (first[1][0].islower() or first[1][0] in "!|"):
                left = re.search(r"([^\W_]+)-$", line[: m.start(1)])
                if not vocabulary.keeps_hyphen(left[1] if left else "", m[1], first[1]):
                    yield p, i, "hyphen"
                    joined = m[1] + first[1]
            if (id(p), i) in carried:
                words = words[1:]
            bad = False
            if m and (joined is not None or nxt is None):
                words = words[:-1]
            if joined is not None:
                carried.add((id(nxt[0]), nxt[1]))
                right = vocabulary.right(norm(joined))
                if right and not vocabulary.count(norm(joined)) >= KNOWN:
                    # the wrong character stands before or after the break
                    here = norm(m[1])
                    if not right.startswith(here):
                        bad = True
                    if not right.endswith(norm(first[1])):
                        yield nxt[0], nxt[1], "misread"
            bad = bad or not wrong.isdisjoint(words)
            if bad:
                yield p, i, "misread"


def repaired(text: str, vocabulary: Vocabulary) -> str:
    """A line with its misread words put right."""

    def put(m: re.Match) -> str:
        right = vocabulary.right(norm(m[0]))
        if not right or "9" in right:
            return m[0]
        return right.upper() if m[0].isupper() and len(m[0]) > 1 else right.capitalize() if m[0][0].isupper() else right

    return _WORD.sub(put, text)


def paragraphs(pages: list[Page], vocabulary: Vocabulary, own: set[int]):
    """(page, number, text) of the paragraphs that begin on the pages ``own`` (positions in ``pages``).

    A paragraph goes on to at most HALO further pages. Opening lines of a page that no paragraph reaches are put out on
    that page, as its first paragraph, so every line of running text is put out. ``pages`` must hold HALO + 1 pages around.
    """
    joins = {(id(p), i) for p, i, k in line_noise(pages, vocabulary) if k == "hyphen"}
    shares = {p.no: (sum(x.startswith("  ") for x, k in zip(p.lines, p.kind) if k == ""), sum(k == "" for k in p.kind)) for p in pages}

    def indents(p: Page) -> bool:
        near = [shares[n] for n in range(p.no - HALO, p.no + HALO + 1) if n in shares]
        return sum(a for a, _ in near) > 0.03 * max(1, sum(b for _, b in near))

    indent = {id(p): indents(p) for p in pages}

    def begins(p: Page, i: int) -> bool:
        line = p.lines[i]
        indented = indent[id(p)]
        before = next((j for j in range(i - 1, -1, -1) if p.kind[j] not in ("running", "pagenum")), None)
        if before is None:
            return line.startswith("  ") or not line[:1].islower() and not indented and False
        if p.kind[before] == "other":
            return True
        if indented:
            return line.startswith("  ")
        return p.kind[before] == "blank" and (len(prev := next((p.lines[j] for j in range(before, -1, -1) if p.kind[j] == ""), "").rstrip()) < 0.8 * p.width and prev.endswith((".", "!", "?", ":")))

    place = {id(p): k for k, p in enumerate(pages)}

    def starts(p: Page, body: list[int]) -> list[int]:
        return [i for i in body if begins(p, i) or (i == body[0] and not any(q.no == p.no - 1 for q in pages))]

    def lines(at: int, i: int, reach: int) -> list[tuple[Page, int]]:
        p = q = pages[at]
        out, j = [], i
        while True:
            out.append((q, j))
            nxt = following(pages, place[id(q)], j, HALO)
            if nxt is None or begins(*nxt) or nxt[0].no - p.no > reach:
                return out
            q, j = nxt

    bodies = [[i for i, k in enumerate(p.kind) if k == ""] for p in pages]
    first = [starts(p, body) for p, body in zip(pages, bodies)]
    # only the last paragraph of a page can reach others
    reached = {id(q) for at, s in enumerate(first) if s for q, _ in lines(at, s[-1], HALO) if q is not pages[at]}
    for at in sorted(own):
        p, body = pages[at], bodies[at]
        rest = [body[0]] if body and body[0] not in first[at] and id(p) not in reached else []
        for number, i in enumerate(rest + first[at], 1):
            part = lines(at, i, 0 if i in rest else HALO)
            out = ""
            for k, (q, j) in enumerate(part):
                line = repaired(q.lines[j].strip(), vocabulary)
                if (id(q), j) in joins and k + 1 < len(part):
                    out += re.sub(r"-\s*$", "", line)
                else:
                    out += line + ("" if line.endswith("-") else " ")
            yield p, number, out.strip()


def scan_blocks(pages: DataFrame, page_id: str, scan: str, number: str, text: str, halo: int) -> tuple[DataFrame, DataFrame]:
    """The different pages of each place, and the same with their blocks and salts; context pages come with ``own`` false.

    The context of a block is the first text of every place of it and of ``halo`` pages on either side. A block whose places
    hold more than ``CROWD`` different texts is salted: each salt works its share of them with the whole context.
    """
    slim = pages.where(F.col(text).isNotNull() & (F.length(text) > 0) & F.col(number).isNotNull()).select(F.col(scan).alias("scan"), F.col(number).cast("int").alias("no"), F.col(text).alias("txt"), F.col(page_id).alias("page_id"))
    places = written(slim.groupBy("scan", "no", F.xxhash64("txt").alias("h")).agg(F.min("page_id").alias("page_id"), F.max("txt").alias("txt")))
    home = F.floor(F.col("no") / BLOCK)
    crowds = places.groupBy("scan", home.alias("block")).agg(F.ceil(F.count("*") / CROWD).alias("salts"))
    named = crowds.withColumnsRenamed({"scan": "_s", "block": "_b"})
    here = lambda d: d.join(named, F.col("scan").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    first = places.groupBy("scan", "no").agg(F.min(F.struct("page_id", "h", "txt")).alias("x")).select("scan", "no", "x.h", "x.page_id", "x.txt")
    near = F.array_distinct(F.array(home, F.floor((F.col("no") - halo) / BLOCK), F.floor((F.col("no") + halo) / BLOCK)))
    context = here(first.withColumn("block", F.explode(near))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    context = context.withColumn("own", (F.col("block") == home) & (F.col("salt") == F.pmod("h", "salts")))
    others = places.join(first.select(F.col("scan").alias("_fs"), F.col("no").alias("_fn"), F.col("h").alias("_fh")), F.col("scan").eqNullSafe(F.col("_fs")) & (F.col("no") == F.col("_fn")) & (F.col("h") == F.col("_fh")), "left_anti")
    others = here(others.withColumn("block", home)).withColumn("salt", F.pmod("h", "salts")).withColumn("own", F.lit(True))
    columns = ["scan", "block", "salt", "no", "h", "txt", "own"]
    return places, context.withColumn("first", F.lit(True)).select(*columns, "first").unionByName(others.withColumn("first", F.lit(False)).select(*columns, "first"))


def _work(places: DataFrame, blocks: DataFrame, schema: str, rows) -> DataFrame:
    """Rows of every own page by ``rows(pages around, own pages, vocabulary)``, group by group of sorted partitions."""
    shared = blocks.sparkSession.sparkContext.broadcast(Vocabulary(count_sketch(places, "txt")))  # 2 * CELLS numbers
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def finish(group: list[tuple], out: list) -> None:
        vocabulary = shared.value
        made = [(Page(no, txt), scan, no, h, own, first) for scan, _, _, no, h, txt, own, first in group]
        around = {no: p for p, _, no, _, _, first in made if first}
        for p, *_ in made:
            mark_edges(p, [around[n] for n in range(p.no - NEAR, p.no + NEAR + 1) if n != p.no and n in around], vocabulary)
        context = sorted(around.values(), key=lambda p: p.no)
        place = {id(p): (scan, no, h) for p, scan, no, h, _, _ in made}
        chosen = [p for p, *_, own, first in made if own and first]
        out += [(*place[id(p)], *r) for p, *r in rows(context, chosen, vocabulary)]
        for p, *_, own, first in made:  # other texts of a place, each among the first texts around
            if own and not first:
                out += [(*place[id(p)], *r) for p, *r in rows([p if q.no == p.no else q for q in context if abs(q.no - p.no) < BLOCK], [p], vocabulary)]

    def work(batches):
        group: list[tuple] = []
        out: list = []

        def flush():
            cols = list(zip(*out)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, types[t.split()[1]]) for c, t in zip(cols, schema.split(", "))], names=names)

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if group and group[-1][:3] != r[:3]:
                    finish(group, out)
                    group = []
                    if len(out) > FLUSH // 10:
                        yield flush()
                group.append(r)
        if group:
            finish(group, out)
        yield flush()

    keys = ["scan", "block", "salt"]
    return blocks.repartition(*keys).sortWithinPartitions(*keys, "no", F.desc("first"), "h").mapInArrow(work, schema)


def _back(found: DataFrame, pages: DataFrame, page_id: str, scan: str, number: str, text: str) -> DataFrame:
    """Results of the different pages, for every page that has this place and text."""
    every = pages.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(page_id).alias("page_id"), F.col(scan).alias("scan"), F.col(number).cast("int").alias("no"), F.xxhash64(text).alias("h"))
    return every.join(found, on=[every["scan"].eqNullSafe(found["scan"]), every["no"] == found["no"], every["h"] == found["h"]]).drop(found["scan"]).drop(found["no"]).drop(found["h"])


def noise_lines(pages: DataFrame, page_id: str = "page_id", scan: str = "file_id", number: str = "page_no", text: str = "txt") -> DataFrame:
    """(page_id, line_no, noise_kind) of every noisy line."""

    def rows(around, own, vocabulary):
        mine = {id(p) for p in own}
        return sorted({(p, i + 1, k) for p, i, k in line_noise(around, vocabulary) if id(p) in mine}, key=lambda r: (r[0].no, *r[1:]))

    places, blocks = scan_blocks(pages, page_id, scan, number, text, NEAR + 2)
    found = _work(places, blocks, "scan bigint, no int, h bigint, line_no int, noise_kind string", rows)
    return _back(found, pages, page_id, scan, number, text).select("page_id", "line_no", "noise_kind")


def repaired_paragraphs(pages: DataFrame, page_id: str = "page_id", scan: str = "file_id", number: str = "page_no", text: str = "txt") -> DataFrame:
    """(page_id, par_no, text): paragraphs of running text, at the page where they begin; what follows HALO further pages, page by page."""

    def rows(around, own, vocabulary):
        mine = {id(p) for p in own}
        return list(paragraphs(around, vocabulary, {k for k, p in enumerate(around) if id(p) in mine}))

    places, blocks = scan_blocks(pages, page_id, scan, number, text, 2 * HALO + 1 + NEAR)
    found = _work(places, blocks, "scan bigint, no int, h bigint, par_no int, text string", rows)
    return _back(found, pages, page_id, scan, number, text).select("page_id", "par_no", "text")
