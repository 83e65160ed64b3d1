"""Personal details in free text: found by a character-level BiLSTM-CRF and replaced with typed placeholders.

1. Every text is cut whole into overlapping windows of characters, whatever its words: a detail may consist of ordinary or
   of very short words. (Training uses ``windows``, the places with words that are not ordinary, signs and numbers.)
2. The windows of a block of texts are decoded together by Viterbi. The tags of overlapping windows are reconciled: each
   character takes its tag from the window in which it lies most central, and a stretch that crosses windows is one.
3. Each run of one tag is a detail of that kind. ``settle`` then sets its edges to whole words and drops runs that no
   detail can be (no digit in a number, no letter in a name). It knows no words, names or places.

The tagger is trained by pii_train; its weights are a small file of this package.

Defined results: null, empty and blank texts hold no detail and stay as they are; a detail that occurs repeatedly is
reported once a document and replaced everywhere it is found; text outside of placeholders is unchanged; texts of any
length are read whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm_crf import Alphabet, Tagger

KINDS = ("email", "phone", "id", "address", "name")
HIDDEN = 32
WINDOW = 160
OVERLAP = 64
BEFORE, AFTER = 24, 40
#: characters decoded at once
BLOCK = 1 << 16
#: texts, and about how many of their bytes, worked together
TEXTS, BYTES = 1024, 1 << 22
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.npz")

WORD = re.compile(r"[^\W\d_]{3,}")
_UP = "A-ZÀ-ÖØ-ÞŠŁŽČĆŚŻĐ"
#: signs and numbers that occur in details
SIGNS = re.compile(rf"[@＠]|[+(]\d|\d(?:[\d .\-/()]{{6,}}[\dX]|\d{{6}}|\w?,?\s(?:\s|> )*(?:[{_UP}]\w|\d{{4}}|[a-z]+\s+[{_UP}dl]))")
#: with more unknown words than this, a text is read through once more and not searched for each
FEW = 40


def windows(text: str, known: set[str]) -> list[tuple[int, int]]:
    """Stretches of ``text`` that the tagger is trained on, as overlapping windows of at most WINDOW characters."""
    hits = [m.span() for m in SIGNS.finditer(text)]
    unknown = set(WORD.findall(text)) - known
    if len(unknown) > FEW:
        hits += [m.span() for m in WORD.finditer(text) if m[0] in unknown]
    else:
        for w in unknown:
            a = text.find(w)
            while a >= 0:
                hits.append((a, a + len(w)))
                a = text.find(w, a + len(w))
    if not hits:
        return []
    hits.sort()
    merged: list[list[int]] = []
    for a, b in hits:
        a, b = max(0, a - BEFORE), min(len(text), b + AFTER)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [w for a, b in merged for w in _cut(a, b)]


def _cut(a: int, b: int) -> list[tuple[int, int]]:
    out = []
    while b - a > WINDOW:
        out.append((a, a + WINDOW))
        a += WINDOW - OVERLAP
    return [*out, (a, b)]


def all_windows(text: str) -> list[tuple[int, int]]:
    """The whole of ``text`` as overlapping windows; none of a blank text."""
    return _cut(0, len(text)) if text.strip() else []


_EDGE = re.compile(r"^[^\w+(@]+|[^\w)]+$")
_INITIAL = re.compile(r"(?:^|[\W_])[^\W\d_]$")


def settle(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """Edges of a tagged stretch at whole words; None if it cannot be a detail of its kind."""
    while a < b and not (text[a].isalnum() or kind == "phone" and text[a] in "+("):
        a += 1
    while b > a and not (text[b - 1].isalnum() or kind == "phone" and text[b - 1] == ")"):
        b -= 1
    if a == b:
        return None
    inner = (lambda c: c.isalnum() or c in "_.+-@") if kind == "email" else (lambda c: c.isalnum() or c == "_")
    while a > 0 and text[a].isalnum() and inner(text[a - 1]):
        a -= 1
    while b < len(text) and text[b - 1].isalnum() and inner(text[b]):
        b += 1
    while not text[b - 1].isalnum() and kind != "phone":
        b -= 1
    while not text[a].isalnum() and kind == "email":
        a += 1
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    if kind == "phone":
        if s.count("(") != s.count(")"):
            if text[a - 1 : a] == "(" and s.count(")") > s.count("("):
                a -= 1
            elif s[0] == "(" and s.count("(") > s.count(")"):
                a += 1
        if text[a - 1 : a] == "+":
            a -= 1
        return (a, b) if digits > 6 else None
    if kind == "id":
        return (a, b) if digits > 5 else None
    if kind == "email":
        return (a, b) if re.search(r"[@＠]|\bat\b", s, re.I) and len(s) > 5 else None
    if kind == "address":
        return (a, b) if digits and re.search(r"[^\W\d_]{3}", s) else None
    words = re.findall(r"[^\W\d_]+", s)
    if digits or len(words) < 2 or max(map(len, words)) < 3:
        return None
    if text[b : b + 1] == "." and _INITIAL.search(s):
        b += 1
    return a, b


class Finder:
    def __init__(self, weights: str = WEIGHTS):
        self.alphabet = Alphabet()
        self.tagger = Tagger.load(weights)
        self.known = set(str(np.load(weights)["known"]).split("\n"))

    def tags(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tags of the characters of all texts one after the other, and where each text begins."""
        start = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        out = np.zeros(int(start[-1]), np.int8)
        spans = np.array([(start[k] + a, start[k] + b) for k, t in enumerate(texts) for a, b in all_windows(t)], np.int64).reshape(-1, 2)
        if not len(spans):
            return out, start
        codes = self.alphabet.encode("".join(texts))
        size = spans[:, 1] - spans[:, 0]
        # a window that begins inside another gives up half of what they share
        shared = np.zeros(len(spans), np.int64)
        shared[1:] = np.maximum(0, spans[:-1, 1] - spans[1:, 0])
        order = np.argsort(size, kind="stable")
        done = 0
        while done < len(order):
            rows = max(32, BLOCK // int(size[order[min(len(order) - 1, done + BLOCK // WINDOW)]]))
            part = order[done : done + rows]
            done += rows
            n = int(size[part].max())
            at = spans[part, 0, None] + np.arange(n)
            inside = np.arange(n) < size[part, None]
            Y = self.tagger.decode(np.where(inside, codes[np.minimum(at, len(codes) - 1)], 0))
            keep_from = shared[part] // 2
            keep_to = size[part] - np.append(shared, 0)[part + 1] + np.append(shared, 0)[part + 1] // 2
            kept = (np.arange(n) >= keep_from[:, None]) & (np.arange(n) < keep_to[:, None])
            out[at[kept]] = Y[kept]
        return out, start

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Details (from, to, kind) of each text."""
        tags, start = self.tags(texts)
        cuts = np.zeros(len(tags) + 1, bool)
        cuts[1:-1] = tags[1:] != tags[:-1]
        cuts[start] = True
        edges = np.flatnonzero(cuts)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(tags):
            return out
        runs = [(int(a), int(b), int(tags[a])) for a, b in zip(edges[:-1], edges[1:]) if tags[a]]
        text_of = np.searchsorted(start, [a for a, _, _ in runs], side="right") - 1
        for (a, b, tag), k in zip(runs, text_of.tolist()):
            s = settle(texts[k], a - int(start[k]), b - int(start[k]), KINDS[tag - 1])
            if s and not (out[k] and out[k][-1][1] > s[0]):
                out[k].append((*s, KINDS[tag - 1]))
        return out


_FINDERS: dict[str, Finder] = {}


def finder(weights: str = WEIGHTS) -> Finder:
    if weights not in _FINDERS:
        _FINDERS[weights] = Finder(weights)
    return _FINDERS[weights]


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Text with a typed placeholder for each span."""
    out, at = [], 0
    for a, b, k in spans:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _blocks(batch: pa.RecordBatch):
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    a = 0
    while a < batch.num_rows:
        far = np.searchsorted(size, (size[a - 1] if a else 0) + BYTES, side="right")
        b = min(a + TEXTS, max(a + 1, int(far)), batch.num_rows)
        yield batch.slice(a, b - a)
        a = b


def details(docs: DataFrame, key: str, text: str, weights: str = WEIGHTS) -> DataFrame:
    """(key, pii_kind, pii_text): each different detail of each document."""

    def find(batches):
        f = finder(weights)
        for batch in batches:
            for b in _blocks(batch):
                rows = [(i, t) for i, t in enumerate(b.column(1).to_pylist()) if t]
                found = [(i, k, t[a:z]) for (i, t), spans in zip(rows, f.spans([t for _, t in rows])) for a, z, k in spans]
                found = list(dict.fromkeys(found))
                at = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())], names=[key, "pii_kind", "pii_text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text)).mapInArrow(find, f"`{key}` {kind}, pii_kind string, pii_text string")


def masked(docs: DataFrame, key: str, text: str, weights: str = WEIGHTS) -> DataFrame:
    """(key, text): every text with typed placeholders."""

    def put(batches):
        f = finder(weights)
        for batch in batches:
            for b in _blocks(batch):
                texts = b.column(1).to_pylist()
                spans = iter(f.spans([t for t in texts if t]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([mask(t, next(spans)) if t else t for t in texts], pa.string())], names=[key, text])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text)).mapInArrow(put, f"`{key}` {kind}, `{text}` string")


__all__ = ["KINDS", "Finder", "details", "finder", "mask", "masked"]
