"""Evaluation passages inside training text, by an FM-index per training shard.

A shard is a run of whole documents of one task, as a sequence of word numbers (words of no evaluation item share
one number; documents are kept apart by it). The Burrows-Wheeler transform of the sequence is held in a wavelet tree
of bit vectors with rank counts. All phrases of ``SEED`` words of all passages are searched backwards at once, and their occurrences are
located by walking to the next sampled suffix position. Occurrences on one diagonal whose neighbourhood agrees
in enough words are aligned word by word; spans that hold ``LEAST`` or more words of the passage with at most
about one word in ten changed, added or left out are merged into removal spans.

Two edits in twelve words leave a run of four equal words, so seeds of four lose no such stretch. Passages of one
series share turns of phrase ("in exchange for ... crates of"); a stretch made of such turns with other words between
them is no leak, so one of its phrases must be the item's own, or twelve words in a row the item's. Edits that break other
phrases do not count against a leak. Letter case,
punctuation, white space, line breaks and quote marks do not matter. Defined results: null and empty texts have
no spans; an item without a passage of twelve words is never found; repeated documents are found each.
The evaluation set is the fixed side: it is read by the driver, ``ITEM_WORDS`` words a block (a block holds a thousand
usual items and more), and every block is searched in all documents. What is common is counted over all items, so
the split in blocks changes no row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 4
LEAST = 12
SAMPLE = 8
SHARD_WORDS = 400_000
ITEM_WORDS = 1_000_000
NEAR = 16
SHIFT = 3
#: edits per word of a stretch (two more are allowed where words were joined or split)
RATE = 0.13
#: a phrase of more than this share of the items (more than one, at least) is a common turn
COMMON = 0.01

_WORD = re.compile(r"\w+")
#: end of a sentence or a colon, with closing signs; words that an instruction speaks of its task with
_ENDS = re.compile(r"[.!?:…]+[\"'”’»)\]]*(?=\s|$)")
_TASK = re.compile(r"(?i)\b(?:passage|text|questions?|answer|read|below|following)\b")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")


def words(text: str) -> list[str]:
    """Words without regard to letter case, punctuation and white space."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    return _WORD.findall(text.casefold())


def _instruction(line: str) -> bool:
    """Whether a first line is an instruction: one sentence, and too short for a stretch or about passage and question."""
    if len(_ENDS.findall(line)) != 1 or not _ENDS.search(line.rstrip()[-3:]):
        return False
    return len(words(line)) < LEAST or len({x.casefold() for x in _TASK.findall(line)}) > 1


def passage(text: str | None) -> str:
    """The passage of an item: all lines between the instruction, if there is one, and the question on the last line.

    What is left must be able to hold a stretch, else the line is no question or instruction but the passage itself.
    """
    lines = [x for x in (text or "").splitlines() if words(x)]
    enough = lambda part: len(words("\n".join(part))) >= LEAST
    if len(lines) > 1 and enough(lines[:-1]) and not (len(lines) == 2 and _instruction(lines[0]) and enough(lines[1:])):
        lines = lines[:-1]
    if len(lines) > 1 and _instruction(lines[0]) and enough(lines[1:]):
        lines = lines[1:]
    return "\n".join(lines)


class BitRank:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        self.ones = np.concatenate(([0], np.cumsum(bits, dtype=np.int32)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        return self.ones[at]


class WaveletTree:
    """Rank of any symbol in a sequence, level by level of the symbols' bits (stable partition at each level)."""

    def __init__(self, seq: np.ndarray, top: int):
        self.depth = max(1, int(top).bit_length())
        self.levels, self.zeros = [], []
        for k in range(self.depth - 1, -1, -1):
            bits = (seq >> k) & 1
            self.levels.append(BitRank(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            seq = np.concatenate((seq[bits == 0], seq[bits == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        lo, hi = np.zeros_like(at), at.copy()
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = (symbol >> (self.depth - 1 - level)) & 1
            a, b = ones.rank(lo), ones.rank(hi)
            lo = np.where(bit, zeros + a, lo - a)
            hi = np.where(bit, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each place, and its rank there."""
        symbol, lo, hi = np.zeros_like(at), np.zeros_like(at), at.copy()
        for ones, zeros in zip(self.levels, self.zeros):
            bit = ones.ones[hi + 1] - ones.ones[hi]
            a, b = ones.rank(lo), ones.rank(hi)
            lo = np.where(bit, zeros + a, lo - a)
            hi = np.where(bit, zeros + b, hi - b)
            symbol = symbol * 2 + bit
        return symbol, hi - lo


class FMIndex:
    """Index of a sequence of symbols >= 0; 0 never takes part in a phrase."""

    def __init__(self, seq: np.ndarray, top: int):
        n = len(seq) + 1
        rank = np.concatenate((seq.astype(np.int64) + 1, [0]))
        k = 1
        while True:  # prefix doubling
            nxt = np.concatenate((rank[k:], np.zeros(min(k, n), np.int64)))[:n]
            key = rank * (n + top + 2) + nxt
            order = np.argsort(key)
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
            if rank[order[-1]] == n - 1:
                break
            k *= 2
        bwt = np.concatenate((seq.astype(np.int64) + 1, [0]))[order - 1]
        self.n = n
        self.before = np.concatenate(([0], np.cumsum(np.bincount(bwt, minlength=top + 2))))
        self.tree = WaveletTree(bwt, top + 1)
        self.sampled = order % SAMPLE == 0
        self.place = BitRank(self.sampled)
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the suffixes that begin with each phrase (rows of equal length), by backward search."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, j] + 1
            lo = self.before[c] + self.tree.rank(c, lo)
            hi = self.before[c] + self.tree.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of suffix rows: steps back to a sampled one are counted."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.sampled[at[open_]]
            done = open_[hit]
            out[done] = self.samples[self.place.rank(at[done])] + steps[done]
            open_ = open_[~hit]
            c, r = self.tree.access(at[open_])
            at[open_] = self.before[c] + r
            steps[open_] += 1
        return out


class Items:
    """Phrases and words of the passages of one block of items; items with equal passages are searched once."""

    def __init__(self, rows: list[tuple[int, list[str]]], common: set[tuple[str, ...]] | None = None):
        self.vocab: dict[str, int] = {}
        same: dict[tuple[int, ...], list[int]] = {}
        for i, ws in rows:
            same.setdefault(tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws), []).append(i)
        self.words = [list(w) for w in same]
        self.ids = list(same.values())
        self.start = np.concatenate(([0], np.cumsum([len(w) + 2 * NEAR for w in self.words]))).astype(np.int64)
        flat = np.full(int(self.start[-1]) or 1, -1, np.int64)
        phrases: dict[tuple[int, ...], int] = {}
        owners = []
        for k, w in enumerate(self.words):
            at = int(self.start[k]) + NEAR
            flat[at : at + len(w)] = w
            for j in range(len(w) - SEED + 1):
                p = phrases.setdefault(tuple(w[j : j + SEED]), len(phrases))
                owners.append((p, k, at + j))
        self.flat = flat
        self.phrases = np.array(list(phrases) or np.zeros((0, SEED)), np.int64).reshape(-1, SEED)
        own = np.array(sorted(owners) or np.zeros((0, 3)), np.int64).reshape(-1, 3)
        self.owner_item, self.owner_at = own[:, 1], own[:, 2]
        self.owner_from = np.searchsorted(own[:, 0], np.arange(len(phrases) + 1))
        if common is None:  # these are all items there are
            owners = Counter(t for w in {tuple(w) for _, w in rows} for t in set(zip(*(w[j:] for j in range(SEED)))))
            common = {t for t, n in owners.items() if n > max(1, int(COMMON * len(self.words)))}
        shared = {tuple(map(self.vocab.get, t)) for t in common}
        self.known = [{tuple(w[j : j + SEED]) for j in range(len(w) - SEED + 1)} for w in self.words]
        self.own = [k - shared for k in self.known]

    def owned(self, item: int, doc_words: list[int]) -> bool:
        """Whether a stretch holds a phrase of the item's own, not only turns that many items use, or LEAST words of it unchanged."""
        own, known, run = self.own[item], self.known[item], 0
        for j in range(len(doc_words) - SEED + 1):
            p = tuple(doc_words[j : j + SEED])
            run = run + 1 if p in known else 0
            if p in own or run > LEAST - SEED:
                return True
        return False


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i its count numbers from start[i] on, with i."""
    who = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return who, np.repeat(start - first, count) + np.arange(int(count.sum()))


def align(doc: np.ndarray, item: list[int], diagonals: list[int]) -> list[tuple[int, int, int, int]]:
    """Stretches (doc from, to, item from, to) of at least LEAST item words with few edits, near the diagonals."""
    runs = []
    for d in sorted({x + s for x in diagonals for s in range(-SHIFT, SHIFT + 1)}):
        a, b = max(0, -d), min(len(item), len(doc) - d)
        if b - a < 2:
            continue
        eq = np.array(item[a:b]) == doc[a + d : b + d]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], eq.view(np.int8), [0]))))
        runs += [(int(s) + a, int(e) + a, d) for s, e in zip(edges[::2], edges[1::2]) if e - s >= 2]
    runs.sort()
    found = []
    for i, (s, e, d) in enumerate(runs):
        best = {i: 0}
        for j in range(i, len(runs)):
            if j not in best:
                continue
            _, ej, dj = runs[j]
            edits = best[j]
            size = ej - s
            if size >= LEAST and edits <= max(2 if size < 20 else 0, RATE * size):
                found.append((s + d, ej + dj, s, ej))
            for k in range(j + 1, len(runs)):
                sk, ek, dk = runs[k]
                if sk - ej > 4:
                    break
                a = max(sk, ej, ej + dj - dk)
                if a >= ek:
                    continue
                cost = edits + max(a - ej, a + dk - ej - dj)
                if cost <= 2 + RATE * (ek - s) and cost < best.get(k, 1 << 30):
                    best[k] = cost
    found.sort()
    merged: list[list[int]] = []
    for a, b, c, e in found:
        if merged and a <= merged[-1][1]:
            merged[-1][1], merged[-1][3] = max(merged[-1][1], b), max(merged[-1][3], e)
        else:
            merged.append([a, b, c, e])
    return [tuple(m) for m in merged]


def search_shard(docs: list[np.ndarray], items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, word from, word to) of every stretch in the documents of one shard."""
    if not docs or not len(items.phrases):
        return
    starts = np.cumsum([NEAR] + [len(d) + NEAR for d in docs])
    seq = np.zeros(int(starts[-1]) + NEAR, np.int64)
    for s, d in zip(starts, docs):
        seq[s : s + len(d)] = d
    index = FMIndex(seq, len(items.vocab))
    lo, hi = index.search(items.phrases)
    phrase, rows = _spread(lo, hi - lo)
    if not len(rows):
        return
    at = index.locate(rows)
    which, owner = _spread(items.owner_from[phrase], (items.owner_from[1:] - items.owner_from[:-1])[phrase])
    doc_at, item, item_at = at[which], items.owner_item[owner], items.owner_at[owner]
    # neighbourhood: words of the item that agree on this or a near diagonal
    keep = np.zeros(len(doc_at), bool)
    span = np.arange(-NEAR + 1, NEAR)
    for a in range(0, len(doc_at), 50_000):
        d, i = doc_at[a : a + 50_000], item_at[a : a + 50_000]
        theirs = items.flat[np.clip(i[:, None] + span, 0, len(items.flat) - 1)]
        same = np.zeros(theirs.shape, bool)
        for shift in range(-SHIFT, SHIFT + 1):
            same |= theirs == seq[np.clip(d[:, None] + (span + shift), 0, len(seq) - 1)]
        total = np.concatenate((np.zeros((len(d), 1), np.int32), np.cumsum(same, 1, dtype=np.int32)), 1)
        keep[a : a + 50_000] = (total[:, LEAST:] - total[:, :-LEAST]).max(1) >= LEAST - 2
    doc_at, item, item_at = doc_at[keep], item[keep], item_at[keep]
    doc = np.searchsorted(starts, doc_at, side="right") - 1
    diagonal = (doc_at - starts[doc]) - (item_at - items.start[item] - NEAR)
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), [True]))) if len(doc) else []
    for a, b in zip(edge[:-1], edge[1:]):
        for x, y, _, _ in align(docs[doc[a]], items.words[item[a]], sorted(set(diagonal[a:b].tolist()))):
            if items.owned(int(item[a]), docs[doc[a]][x:y].tolist()):
                yield int(doc[a]), int(item[a]), x, y


def common_phrases(items: DataFrame, key: str, text: str, take: Callable[[str | None], str]) -> set[tuple[str, ...]]:
    """Phrases of more than ``COMMON`` of all different passages (more than one): each passage has so many phrases, so
    they are at most passages' mean length / COMMON.
    """

    def phrases(batches):
        for b in batches:
            found = [set(zip(*(w[j:] for j in range(SEED)))) for w in (words(take(t)) for t in b.column(0).to_pylist())]
            at = pa.array([i for i, p in enumerate(found) for _ in p], pa.int64())
            passages = pa.array([" ".join(words(take(t))) for t in b.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(x) for p in found for x in p], pa.string()), passages.take(at)], names=["phrase", "passage"])

    texts = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(text)
    owners = texts.mapInArrow(phrases, "phrase string, passage string").select("phrase", F.xxhash64("passage").alias("passage")).distinct()
    few = max(1, int(COMMON * owners.select("passage").distinct().count()))
    return {tuple(r[0].split(" ")) for r in owners.groupBy("phrase").count().where(F.col("count") > few).collect()}


def _item_blocks(items: DataFrame, key: str, text: str, take: Callable[[str | None], str]) -> list[Items]:
    common = common_phrases(items, key, text, take)
    blocks, rows, size = [], [], 0
    for r in items.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull()).dropDuplicates().toLocalIterator():
        w = words(take(r[1]))
        rows.append((r[0], w))
        size += len(w)
        if size > ITEM_WORDS:
            blocks.append(Items(rows, common))
            rows, size = [], 0
    return [*blocks, Items(rows, common)] if rows else blocks


def leaked_spans(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, take: Callable[[str | None], str] = passage) -> DataFrame:
    """(key, item, start, stop, n_words): removal spans, in characters of the text, of every leaked item.

    ``take`` gives the passage of an item's text; the whole text counts with ``take=str``.
    """
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, start int, stop int, n_words int"
    blocks = _item_blocks(items, item_key, item_text, take)
    out = None
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            items = shared.value
            get = items.vocab.get
            ids, texts, rows, size = [], [], [], 0

            def flush():
                found = [(ids[d], x, *_characters(texts[d], a, b), b - a) for d, i, a, b in search_shard(rows, items) for x in items.ids[i]]
                cols = list(zip(*found)) or [[]] * 5
                types = [batch_types[0], batch_types[1], pa.int32(), pa.int32(), pa.int32()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, item_key, "start", "stop", "n_words"])

            batch_types = None
            for b in batches:
                batch_types = b.schema.field(0).type, pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if not t:
                        continue
                    w = np.array([get(x, 0) for x in words(t)], np.int64)
                    ids.append(i)
                    texts.append(t)
                    rows.append(w)
                    size += len(w) + NEAR
                    if size > SHARD_WORDS:
                        yield flush()
                        ids, texts, rows, size = [], [], [], 0
            if rows:
                yield flush()

        part = docs.select(key, text).mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _characters(text: str, a: int, b: int) -> tuple[int, int]:
    """Character span of words a to b; a word of the normalised text is found again by count."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) != len(words(text)):  # hidden characters inside words or forms that change length
        spans, at = [], 0
        for m in re.finditer("[\\w\u00ad\u200b-\u200f\u2060-\u2064\ufeff]+", text):
            n = len(words(m[0]))
            spans += [m.span()] * n
            at = m.end()
    if not spans:
        return 0, len(text)
    return spans[min(a, len(spans) - 1)][0], spans[min(b, len(spans)) - 1][1]
