"""Training of the tagger from labelled spans: ``python -m bibspark.llm.pii_train DOCUMENTS.parquet``.

At most ``SAMPLE_DOCS`` documents are labelled (a documented bound) by pii_labels; every fifth is held out. Beside each
text stands a copy in which names and towns are replaced by invented words, and some of the copies have a name more
where none stood, so that the tagger learns from form and context and not from the sample's names and turns. Batches are worked by ``WORKERS`` processes, whose gradients are averaged.
Seeds are fixed.
"""

from __future__ import annotations

import os
import re
import sys
import time
from collections import Counter
from multiprocessing import Pool

import numpy as np

from . import pii
from .bilstm_crf import Adam, Alphabet, Tagger
from .pii_labels import Labeller

SAMPLE_DOCS = 10_000
STEPS = 4500
BATCH = 64
WORKERS = 8
RATE = 0.01
#: a word is ordinary if it occurs this often, and in details at most at this share
ORDINARY, INSIDE = 8, 0.02
SWAPPED = 0.4
#: share of the copies that get a name more, anywhere in their text
MOVED = 0.3

Spans = list[tuple[int, int, str]]


def held_out(n: int) -> bool:
    return n % 5 == 0


def ordinary_words(texts: list[str], labels: list[Spans]) -> set[str]:
    """Words that need no look of the tagger: frequent, and next to never part of a name or address."""
    seen: Counter = Counter()
    inside: Counter = Counter()
    for t, spans in zip(texts, labels):
        at = 0
        for a, b, k in spans:
            seen.update(pii.WORD.findall(t[at:a]))
            if k != "email":
                inside.update(pii.WORD.findall(t[a:b]))
            at = b
        seen.update(pii.WORD.findall(t[at:]))
    return {w for w, n in seen.items() if n >= ORDINARY and inside[w] <= INSIDE * n}


def _invented(r: np.random.Generator, like: str) -> str:
    """A pronounceable word in the letter case of ``like``."""
    onset = "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sh st str t th tr v w y z ø é".split()
    middle = "a e i o u ai ea ie ou á ö ü ä é y".split()
    close = ["", "", "", "n", "r", "l", "s", "m", "nd", "rt", "lm", "k", "tz", "ng"]
    w = "".join(r.choice(onset) + r.choice(middle) + r.choice(close) for _ in range(int(r.integers(1, 4)) if len(like) < 7 else int(r.integers(2, 5))))
    return w.upper() if like.isupper() else w.lower() if like.islower() else w.capitalize()


_PARTS = re.compile(r"[^\W\d_]{2,}")
_BLANK = re.compile(r"(?<=[a-z,]) (?=[a-z])")


def moved(text: str, spans: Spans, names: list[str], r: np.random.Generator) -> tuple[str, Spans]:
    """The text with one of ``names`` put between two words of lower case outside of its details."""
    places = [m.start() + 1 for m in _BLANK.finditer(text)]
    if not places or not names:
        return text, spans
    at, name = int(r.choice(places)), str(names[int(r.integers(len(names)))])
    if any(a - 2 < at < b + 2 for a, b, _ in spans):
        return text, spans
    n = len(name) + 1
    return text[:at] + name + " " + text[at:], sorted([(a + n * (a >= at), b + n * (a >= at), k) for a, b, k in spans] + [(at, at + n - 1, "name")])


def swapped(text: str, spans: Spans, r: np.random.Generator) -> tuple[str, Spans]:
    """The text with some words of its names, addresses and mail addresses replaced by invented ones."""
    out: list[str] = []
    new: Spans = []
    at = size = 0

    def put(s: str) -> None:
        nonlocal size
        out.append(s)
        size += len(s)

    for a, b, k in spans:
        put(text[at:a])
        begin, s = size, text[a:b]
        last = 0
        for m in _PARTS.finditer(s):
            free = k == "name" and len(m[0]) > 2 or k == "email" and m[0].lower() not in ("at", "dot") or k == "address" and (m.end() == len(s) or len(m[0]) > 5 and r.random() < 0.3)
            if free and r.random() < (SWAPPED if k != "email" else SWAPPED / 2):
                put(s[last : m.start()])
                put(_invented(r, m[0]))
                last = m.end()
        put(s[last:])
        new.append((begin, size, k))
        at = b
    put(text[at:])
    return "".join(out), new


class Sample:
    """Characters, tags and windows of the training texts."""

    def __init__(self, texts: list[str], labels: list[Spans], known: set[str], seed: int):
        r = np.random.default_rng(seed)
        alphabet = Alphabet()
        texts, labels = list(texts), list(labels)
        names = [t[a:b] for t, s in zip(texts, labels) for a, b, k in s if k == "name" and "," not in t[a:b] and t[a : a + 2].istitle()]
        for t, s in list(zip(texts, labels)):
            if s or r.random() < MOVED:
                t2, s2 = swapped(*(moved(t, s, names, r) if r.random() < MOVED else (t, s)), r)
                texts.append(t2)
                labels.append(s2)
        X, Y, spans, at = [], [], [], 0
        for t, s in zip(texts, labels):
            y = np.zeros(len(t), np.int8)
            for a, b, k in s:
                y[a:b] = 1 + pii.KINDS.index(k)
            spans += [(at + a, at + b, at, at + len(t)) for a, b in pii.windows(t, known)]
            X.append(alphabet.encode(t))
            Y.append(y)
            at += len(t)
        self.X, self.Y, self.spans = np.concatenate(X), np.concatenate(Y), np.array(spans)
        # windows of rare kinds are drawn more often
        kind = np.array([self.Y[a:b].max() for a, b, _, _ in self.spans])
        some = np.bincount(kind, minlength=6).astype(float)
        w = 1 / np.maximum(1, some) ** 0.5
        w[0] *= 0.7
        self.weight = np.cumsum(w[kind] / w[kind].sum())

    def batch(self, r: np.random.Generator, n: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
        pick = self.spans[np.minimum(np.searchsorted(self.weight, r.random(n)), len(self.spans) - 1)]
        a = np.maximum(pick[:, 2], pick[:, 0] - r.integers(-6, 12, n))
        b = np.minimum(np.minimum(pick[:, 3], pick[:, 1] + r.integers(-6, 12, n)), a + pii.WINDOW)
        L = int((b - a).max())
        at = a[:, None] + np.arange(L)
        inside = at < b[:, None]
        at = np.minimum(at, len(self.X) - 1)
        return np.where(inside, self.X[at], 0).astype(np.int64), np.where(inside, self.Y[at], 0).astype(np.int64)


_STATE: dict = {}


def _gradient(job):
    p, seed = job
    tagger: Tagger = _STATE["tagger"]
    tagger.p = p
    return tagger.step(*_STATE["sample"].batch(np.random.default_rng(seed)))


def train(texts: list[str], labels: list[Spans], known: set[str], steps: int = STEPS, hidden: int = pii.HIDDEN, seed: int = 7, workers: int = WORKERS, say=print) -> Tagger:
    _STATE["sample"] = Sample(texts, labels, known, seed)
    tagger = _STATE["tagger"] = Tagger(Alphabet().size, len(pii.KINDS) + 1, hidden, seed)
    adam = Adam(tagger.p)
    began = time.time()
    with Pool(workers) as pool:
        for n in range(steps):
            done = pool.map(_gradient, [(tagger.p, seed + 1000 * n + k) for k in range(workers)], chunksize=1)
            grad = {k: sum(g[k] for _, g in done) / workers for k in done[0][1]}
            adam.update(grad, RATE * min(1, (n + 1) / 50) * (1 - 0.95 * n / steps))
            if n % 100 == 0:
                say(f"{n} {sum(x for x, _ in done) / workers:.3f} {time.time() - began:.0f}s", flush=True)
    return tagger


def agreement(finder: pii.Finder, texts: list[str], labels: list[Spans]) -> dict[str, tuple[int, int, int]]:
    """Labelled details, found ones and those that agree in place and kind, by kind."""
    out = {k: [0, 0, 0] for k in pii.KINDS}
    for spans, found in zip(labels, finder.spans(texts)):
        for s in spans:
            out[s[2]][0] += 1
        for s in found:
            out[s[2]][1] += 1
        for s in set(spans) & set(found):
            out[s[2]][2] += 1
    return {k: tuple(v) for k, v in out.items()}


def main(path: str) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(path, columns=["doc_id", "text"]).sort_by("doc_id").column("text").to_pylist() if t][:SAMPLE_DOCS]
    labeller = Labeller(texts)
    with Pool(WORKERS) as pool:
        labels = pool.map(labeller.spans, texts, chunksize=100)
    mine = [(t, s) for n, (t, s) in enumerate(zip(texts, labels)) if not held_out(n)]
    texts_in, labels_in = [t for t, _ in mine], [s for _, s in mine]
    known = ordinary_words(texts_in, labels_in)
    tagger = train(texts_in, labels_in, known)
    tagger.save(pii.WEIGHTS, known="\n".join(sorted(known)))
    rest = [(t, s) for n, (t, s) in enumerate(zip(texts, labels)) if held_out(n)]
    print(agreement(pii.Finder(), [t for t, _ in rest], [s for _, s in rest]))


if __name__ == "__main__":
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    main(sys.argv[1])
