"""Token-set similarity of texts: as an Arrow UDF, and the most similar of many candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit a character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def token_set_ratio(x: str | None, y: str | None) -> float:
    """0 to 100: likeness of the shared words with each side's other words."""
    a, b = set((x or "").split()), set((y or "").split())
    if not a or not b:
        return 0.0
    both, left, right = " ".join(sorted(a & b)), " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if both and (not left or not right):
        return 100.0
    gap = bool(both)
    na, nb = len(both) + gap + len(left), len(both) + gap + len(right)
    apart = len(left) + len(right) - 2 * common_subsequence(left, right)
    best = 100 * (1 - apart / (na + nb))
    if both:
        best = max(best, 100 * (1 - (gap + len(left)) / (len(both) + na)), 100 * (1 - (gap + len(right)) / (len(both) + nb)))
    return best


@F.pandas_udf(DoubleType())
def token_set_ratio_udf(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(a, b) for a, b in zip(x, y)])


class Texts:
    """Texts of one kind (titles, say) with what bounds their ratios with any other text from above."""

    def __init__(self, texts: list[str | None]):
        self.texts = texts
        tokens = [sorted(set((t or "").split())) for t in texts]
        self.n = np.array([len(x) for x in tokens], np.int64)
        self.size = np.array([sum(map(len, x)) for x in tokens], np.int64)
        at: dict[str, list[int]] = {}
        for i, x in enumerate(tokens):
            for t in x:
                at.setdefault(t, []).append(i)
        self.at = {t: np.array(x) for t, x in at.items()}
        # bits of the sorted words: texts of as many machine words are worked together
        whole = [" ".join(x) for x in tokens]
        length = np.array([len(x) for x in whole], np.int64)
        self.words, self.local = -(-length // 64), np.zeros(len(texts), np.int64)
        codes = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), length)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
        order = np.argsort(codes, kind="stable")
        self.codes, self.owner, self.place = codes[order], owner[order], place[order]
        self.members = {}
        for w in np.unique(self.words[self.words > 0]).tolist():
            m = np.flatnonzero(self.words == w)
            self.local[m], self.members[w] = np.arange(len(m)), len(m)
        self.made: dict[tuple[str, int], np.ndarray | None] = {}

    def mask(self, c: str, words: int) -> np.ndarray | None:
        """Places of a character in the texts of so many machine words, one bit each."""
        if (c, words) not in self.made:
            a, b = np.searchsorted(self.codes, [ord(c), ord(c) + 1])
            mine = slice(a, b) if a < b else slice(0, 0)
            own = self.words[self.owner[mine]] == words
            owner, place = self.owner[mine][own], self.place[mine][own]
            m = None
            if len(owner):
                m = np.zeros((words, self.members[words]), np.uint64)
                np.bitwise_or.at(m, (place // 64, self.local[owner]), np.uint64(1) << (place % 64).astype(np.uint64))
            self.made[c, words] = m
        return self.made[c, words]

    def common(self, text: str, rows: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of the text with the sorted words of each row."""
        out = np.zeros(len(rows), np.int64)
        for w in self.members:
            sel = np.flatnonzero(self.words[rows] == w)
            if not len(sel):
                continue
            local = self.local[rows[sel]]
            masks = {c: m[:, local] for c in set(text) if (m := self.mask(c, w)) is not None}
            s = np.full((w, len(sel)), ~np.uint64(0))
            for m in (masks[c] for c in text if c in masks):
                carry = None
                for k in range(w):
                    u = s[k] & m[k]
                    t = s[k] + u
                    if carry is not None:
                        t += carry
                    if k + 1 < w:
                        carry = (u | (s[k] & ~t)) >> np.uint64(63)
                    s[k] = t | (s[k] - u)
            out[sel] = 64 * w - np.bitwise_count(s).sum(0, dtype=np.int64)
        return out

    def bounds(self, tokens: list[str]) -> tuple[np.ndarray, Bound]:
        """What each ratio with the words is at least, and its bound from above."""
        k, both = np.zeros(len(self.n), np.int64), np.zeros(len(self.n), np.int64)
        for t in tokens:
            if (p := self.at.get(t)) is not None:
                k[p] += 1
                both[p] += len(t)
        left = self.size - both + np.maximum(self.n - k - 1, 0)
        right = sum(map(len, tokens)) - both + np.maximum(len(tokens) - k - 1, 0)
        both += np.maximum(k - 1, 0)
        gap = k > 0
        na, nb = both + gap + left, both + gap + right
        least = np.where(gap, 100 * (1 - np.minimum((gap + left) / np.maximum(both + na, 1), (gap + right) / np.maximum(both + nb, 1))), 0.0)
        least[gap & ((k == self.n) | (k == len(tokens)))] = 100.0
        return least, Bound(least, self.n > 0, left, right, na + nb)


class Bound:
    def __init__(self, least, filled, left, right, total):
        self.least, self.filled, self.left, self.right, self.total = least, filled, left, right, np.maximum(total, 1)

    def most(self, rows: np.ndarray | slice = slice(None), common: np.ndarray | None = None) -> np.ndarray:
        """Ratios are no more than this; ``common``: the most that both sides' other words can share."""
        left, right = self.left[rows], self.right[rows]
        shared = np.minimum(left, right) if common is None else np.minimum(common, np.minimum(left, right))
        return np.where(self.filled[rows], np.maximum(self.least[rows], 100 * (1 - (left + right - 2 * shared) / self.total[rows])), 0.0)


def best_matches(queries: list[str], parts: list[list[str | None]]) -> Iterator[tuple[int, float]]:
    """For each query the first candidate of the highest sum of token-set ratios over its parts, and that sum.

    Equal to scoring all pairs: a candidate is left out only if its bound from above is below a score already found.
    The other words of two sides are subsequences of all their sorted words, so they share no longer subsequence.
    """
    slack = 1e-6
    sides = [Texts(p) for p in parts if any(p)]
    for q in queries:
        tokens = sorted(set((q or "").split()))
        if not tokens or not sides:
            yield 0, 0.0
            continue
        pairs = [x.bounds(tokens) for x in sides]
        score = lambda i, q=q: sum(token_set_ratio(x.texts[i], q) for x in sides)
        seed = int(np.argmax(sum(least for least, _ in pairs)))
        best = (score(seed), -seed)
        tops = [b.most() for _, b in pairs]
        rows = np.flatnonzero(sum(tops) >= best[0] - slack)
        tops = [t[rows] for t in tops]
        whole = " ".join(tokens)
        for i in reversed(range(len(sides))):
            if len(rows) > 20:
                tops[i] = pairs[i][1].most(rows, sides[i].common(whole, rows))
                keep = sum(tops) >= best[0] - slack
                rows, tops = rows[keep], [t[keep] for t in tops]
        top = sum(tops)
        for j in np.argsort(-top, kind="stable").tolist():
            if top[j] < best[0] - slack:
                break
            best = max(best, (score(int(rows[j])), -int(rows[j])))
        yield -best[1], best[0]
