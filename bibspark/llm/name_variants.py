"""Variant spellings of names of people and organisations, clustered and named by the entries of a registry.

1. Every mention is folded (one form of characters, LaTeX accents decoded, letter case and accents dropped). Equal
   spellings are worked once: all steps but the last run over the different spellings.
2. Character trigrams of a spelling's words are weighted by term and inverse document frequency; the documents are the
   words of all spellings, counted in a hashed space of ``SPACE`` buckets, so what reaches the driver is bounded.
3. Sparse top-n cosine join. Both sides are sharded by trigrams: by the prefix principle, two unit vectors of cosine
   ``LEAST`` or more share a trigram among each one's rarest ones (those before the rest falls below ``LEAST`` in norm), so
   a spelling goes only to the shards of these. Within a shard the postings of the entries' spellings are summed for
   blocks of spellings. Neither side is collected or broadcast; one shard holds about ``SHARD`` entries. Each
   spelling keeps its ``TOP`` nearest entries.
4. Average-linkage clustering. The mean cosine between two clusters of unit vectors is the product of their mean
   vectors, so clusters are kept as sums of vectors, a distributed aggregate, and no pairs within a cluster are formed.
   Clusters begin with an entry's own spellings (an acronym begins one of its own); spellings join the cluster of highest average linkage; the
   sums are taken again over all members, so that mentions are compared with mentions, and each spelling goes to the
   cluster of highest average linkage to its members, at least ``LINKAGE``.
5. Only entries whose name fits come into question (exact check): the family name agrees up to one typing error, and
   the given name, its short form or initial agrees; another given name or initial is another person. Short forms
   are learned from the mentions: "bob" is one of "robert" if it occurs with several families, and in most of them the
   registry has a Robert.

A name that a third of all mentions share is one spelling; its mentions are joined back to it by a join that adaptive
execution splits. Defined results: null, empty and blank names are no mention but keep their position; a mention that fits
several entries goes to the one of highest linkage, then smallest id; an entry without a family name is never found; an
empty registry links nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .canonical_text import canonical

SPACE = 1 << 16
TOP = 12
LEAST = 0.38
LINKAGE = 0.12
#: part of the trigrams of an organisation that a spelling with abbreviated words keeps
COVER = 0.33
#: cells of the accumulator of a block, entries a shard, spellings a task
CELLS, SHARD, SPELLINGS = 1 << 22, 20_000, 50_000
REMEMBERED = 200_000
#: a short form occurs with so many families, in this share of its families, and at this share of the name's own count
FAMILIES, SHARE, WEIGHT = 3, 0.5, 0.01

_FOLDS = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "þ": "th", "Þ": "Th", "ð": "d"})
_TEX = (
    (re.compile(r"\\[\"'`^~=.cvuHkrbd]\s*\{?\\?([A-Za-z])\}?"), r"\1"),
    (re.compile(r"\\(aa|AA|ae|AE|oe|OE|ss|o|O|l|L|i|j)(?![A-Za-z])\s?"), r"\1"),
)


def fold_name(name: str) -> str:
    """A name without differences of characters, LaTeX, letter case and accents."""
    if "\\" in name:
        for p, by in _TEX:
            name = p.sub(by, name)
    if "{" in name or "}" in name:
        name = name.replace("{", "").replace("}", "")
    if not name.isascii():
        name = unicodedata.normalize("NFD", canonical(name).translate(_FOLDS))
        name = "".join(c for c in name if not unicodedata.combining(c))
    return " ".join(name.lower().split())


_TOKEN = re.compile(r"[^\W_]+")


def _bucket(gram: str) -> int:
    h = 2166136261
    for c in gram:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 16) % SPACE


@lru_cache(maxsize=REMEMBERED)
def word_grams(word: str) -> tuple[int, ...]:
    """Buckets of the trigrams of a word with its ends marked."""
    w = f"^{word}$"
    return tuple({_bucket(w[i : i + 3]) for i in range(len(w) - 2)})


def document_frequencies(names: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """Words of all spellings that hold a trigram, by bucket; at most ``SPACE`` numbers reach the driver."""

    def count(batches):
        df, n = np.zeros(SPACE, np.int64), 0
        words: Counter = Counter()

        def add():
            for w, k in words.items():
                df[list(word_grams(w))] += k
            words.clear()

        for b in batches:
            for name in b.column(0).to_pylist():
                if name:
                    w = _TOKEN.findall(name)
                    n += len(w)
                    words.update(w)
            if len(words) > REMEMBERED:
                add()
        add()
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], n), pa.int64())], names=["bucket", "n"])

    df, total = np.zeros(SPACE, np.int64), 0
    for r in names.select(column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r[0] < 0:
            total = r[1]
        else:
            df[r[0]] = r[1]
    return df, total


class Weights:
    """Inverse document frequencies of the trigrams, and unit vectors of names."""

    def __init__(self, df: np.ndarray, total: int):
        self.idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    def vectors(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, weight) of the trigrams of each name, in order of rows."""
        flat: list[int] = []
        size = []
        for n in names:
            before = len(flat)
            for w in _TOKEN.findall(n):
                flat += word_grams(w)
            size.append(len(flat) - before)
        key, times = np.unique(np.repeat(np.arange(len(names), dtype=np.int64), size) * SPACE + np.array(flat, np.int64), return_counts=True)
        row, bucket = key // SPACE, key % SPACE
        w = times * self.idf[bucket]
        norm = np.sqrt(np.bincount(row, w * w, len(names)))
        return row, bucket, w / norm[row]

    def shards(self, names: list[str], k: int, least: float = LEAST) -> list[set[int]]:
        """Shards of the rarest trigrams of each name: those before the rest of its vector is shorter than ``least``."""
        out: list[set[int]] = [set() for _ in names]
        row, bucket, w = self.vectors(names)
        order = np.lexsort((bucket, -self.idf[bucket], row))
        row, bucket, w = row[order], bucket[order], w[order]
        first = np.searchsorted(row, row)
        spent = np.cumsum(w * w)
        left = 1 - (spent - w * w - (spent - w * w)[first])
        for i, b in zip(row[left >= least * least].tolist(), bucket[left >= least * least].tolist()):
            out[i].add(b % k)
        return out


def one_edit(a: str, b: str) -> int:
    """0 if equal, 1 if one insertion, deletion, replacement or swap of neighbours apart, else 9."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 9
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return 1 if x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[:2][::-1] and x[2:] == y[2:]) else 9


def _abbreviates(short: str, word: str) -> bool:
    """Letters of ``short`` occur in ``word`` in order, beginning with the same letter."""
    if not short or short[0] != word[:1]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


class Person:
    def __init__(self, family: str, given: str | None, short: tuple[str, ...] = ()):
        self.family = _TOKEN.findall(fold_name(family))
        self.joined = " ".join(self.family)
        self.given = _TOKEN.findall(fold_name(given or ""))
        self.first = self.given[0] if self.given else ""
        self.short = short
        self.initials = {self.first[:1], *(s[0] for s in short)}

    def cores(self) -> list[tuple[str, float]]:
        """Names of which a spelling holds at least so many trigrams: one typing error changes at most four."""
        return [(self.joined, len(_grams(self.joined)) - 4)]

    def spellings(self) -> list[str]:
        f = " ".join(self.family)
        out = [f"{f} {' '.join(self.given)}".strip(), f"{f} {' '.join(g[0] for g in self.given)}".strip()]
        return list(dict.fromkeys(out))

    def _later(self, tokens: list[str]) -> bool:
        """Second names and initials: in the order of the entry's; more of them only where the entry has none."""
        own = self.given[1:]
        i = 0
        for t in tokens:
            while i < len(own) and own[i][0] != t[0]:
                i += 1
            if i == len(own):
                return not any(len(g) == 1 for g in own) and len(t) == 1
            i += 1
        return True

    def given_edits(self, rest: list[str], dotted: set[str]) -> int:
        if not rest or not self.first:
            return 9
        t, later = rest[0], rest[1:]
        if len(t) == 1:
            return 0 if t in self.initials and self._later(later) else 9
        edits = 9
        if t == self.first or t in self.short or (self.first.startswith(t) and (t in dotted or len(t) > 2)):
            edits = 0
        elif len(t) > 3 and one_edit(t, self.first) == 1 or len(t) > 4 and any(one_edit(t, s) == 1 for s in self.short):
            edits = 1
        if edits < 9 and self._later(later):
            return edits
        if len(t) <= 3 and t[0] in self.initials and self._later([*t[1:], *later]):
            return 0
        if len(self.given) > 1 and len(self.given[1]) > 1 and one_edit(t, self.first + self.given[1]) < 9:
            return one_edit(t, self.first + self.given[1])
        return 9

    def families(self, name: str) -> list[tuple[int, list[str]]]:
        """(typing errors, other words) of each place where the folded name may hold this family name."""
        tokens = _TOKEN.findall(name)
        n, out = len(self.family), []
        comma = len(_TOKEN.findall(name.split(",", 1)[0])) if "," in name else 0
        for a in (0,) if comma else range(len(tokens)):
            for size in (n, n + 1, n - 1) if len(self.joined) > 4 else (n,):
                if size < 1 or a + size > len(tokens) or (comma and size != comma):
                    continue
                have = " ".join(tokens[a : a + size])
                e = one_edit(have, self.joined)
                if e and size != n and have.replace(" ", "") != self.joined.replace(" ", ""):
                    continue
                if e < 9 and (e == 0 or len(self.joined) > 4):
                    out.append((e, tokens[:a] + tokens[a + size :]))
        return out

    def edits(self, name: str) -> int:
        """Typing errors with which the folded name stands for this person; 9: it does not."""
        dotted = {m[:-1] for m in re.findall(r"[^\W_]+\.", name)}
        best = min((e + self.given_edits(rest, dotted) for e, rest in self.families(name)), default=9)
        return best if best <= 2 else 9

    def token(self, name: str) -> str | None:
        """The given name that stands beside the unchanged family name, if it is neither an initial nor mistyped."""
        for e, rest in self.families(name):
            if e == 0 and rest and len(rest[0]) > 1 and (rest[0] == self.first or one_edit(rest[0], self.first) == 9):
                return rest[0]
        return None


class Organisation:
    joined = first = ""

    def __init__(self, name: str):
        self.words = [w for w in _TOKEN.findall(fold_name(name)) if w != "the"]
        self.acronym = "".join(w[0] for w in self.words if w not in ("of", "for", "and", "the"))

    def cores(self) -> list[tuple[str, float]]:
        return [(x, part * len(_grams(x))) for x, part in ((" ".join(self.words), COVER), (self.acronym, 1.0)) if x]

    def spellings(self) -> list[str]:
        return list(dict.fromkeys(x for x in (" ".join(self.words), self.acronym) if x))

    def families(self, name: str) -> bool:
        return self.edits(name) < 9

    def token(self, name: str) -> None:
        return None

    def edits(self, name: str) -> int:
        name = re.sub(r"\([^()]*\)?", " ", name).replace("&", " and ")
        tokens = [t for t in re.findall(r"[^\W_]+\.?", name) if t != "the"]
        if len(tokens) == 1:
            return 0 if tokens[0].strip(".") == self.acronym and len(self.acronym) > 2 else 9
        if len(tokens) != len(self.words):
            return one_edit("".join(t.strip(".") for t in tokens), "".join(self.words))
        total = 0
        for t, w in zip(tokens, self.words):
            short = t.strip(".")
            if t == w or short == w or (t.endswith(".") or len(short) < 4) and _abbreviates(short, w):
                continue
            total += one_edit(short, w)
        return total if total <= 2 else 9


def _grams(name: str) -> set[int]:
    return {g for w in _TOKEN.findall(name) for g in word_grams(w)}


@lru_cache(maxsize=REMEMBERED)
def entry(org: bool, family: str, given: str | None, short: tuple[str, ...] = ()) -> Person | Organisation:
    return Organisation(family) if org else Person(family, given, short)


class Index:
    """Postings of the trigrams of the entries of one shard."""

    def __init__(self, entries: list[Person | Organisation], weights: Weights):
        self.entries, self.weights = entries, weights
        spelled = [(k, s) for k, e in enumerate(entries) for s in e.spellings()]
        self.of = np.array([k for k, _ in spelled], np.int64)
        self.count = np.bincount(self.of, minlength=len(entries))
        self.org = np.array([isinstance(e, Organisation) for e in entries], bool)
        row, bucket, w = weights.vectors([s for _, s in spelled])
        order = np.argsort(bucket, kind="stable")
        self.start = np.searchsorted(bucket[order], np.arange(SPACE + 1))
        self.posting, self.weight = row[order], w[order]
        cores = [(k, _grams(c), need) for k, e in enumerate(entries) for c, need in e.cores()]
        self.core_entry = np.array([k for k, _, _ in cores], np.int64)
        self.need = np.array([max(1.0, need) for _, _, need in cores])
        flat = np.array([x for _, g, _ in cores for x in g], np.int64)
        at = np.repeat(np.arange(len(cores)), [len(g) for _, g, _ in cores])
        order = np.argsort(flat, kind="stable")
        self.core_start, self.core = np.searchsorted(flat[order], np.arange(SPACE + 1)), at[order]

    def near(self, names: list[str], least: float = LEAST, top: int = TOP):
        """(name, entry, cosine, linkage) of the ``top`` nearest entries (ties are kept) of each name."""
        if not self.of.size:
            return
        rows = max(1, CELLS // len(self.of))
        for a in range(0, len(names), rows):
            part = names[a : a + rows]
            row, bucket, w = self.weights.vectors(part)
            which, at = _spread(self.start, bucket)
            dot = np.bincount(row[which] * len(self.of) + self.posting[at], w[which] * self.weight[at], len(part) * len(self.of)).reshape(len(part), -1)
            n, s = np.nonzero(dot >= least)
            pair = np.unique(n * len(self.entries) + self.of[s])
            n, k = pair // len(self.entries), pair % len(self.entries)
            if not len(n):
                continue
            # the exact check's bound: enough trigrams of the family name or of the organisation's
            which, at = _spread(self.core_start, bucket)
            m = len(self.core_entry)
            shared = np.bincount(row[which] * m + self.core[at], minlength=len(part) * m).reshape(len(part), m)
            i, c = np.nonzero(shared >= self.need)
            fits = np.isin(pair, i * len(self.entries) + self.core_entry[c])
            first = np.searchsorted(self.of, k)
            linkage, cosine = np.zeros(len(k)), np.zeros(len(k))
            for j in range(int(self.count.max())):
                there = j < self.count[k]
                d = np.where(there, dot[n, np.minimum(first + j, len(self.of) - 1)], 0)
                linkage += d
                cosine = np.maximum(cosine, d)
            # an organisation's acronym is a cluster of its own beside its name
            linkage = np.where(self.org[k], cosine, linkage / self.count[k])
            order = np.lexsort((-cosine, n))
            nth = np.arange(len(n)) - np.searchsorted(n, n)
            last = np.full(len(part), -1.0)
            ranked = order[nth == top - 1]
            last[n[ranked]] = cosine[ranked]
            keep = fits & (cosine >= last[n])
            yield from zip((n[keep] + a).tolist(), k[keep].tolist(), cosine[keep].tolist(), linkage[keep].tolist())


def _spread(start: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket its postings, with the bucket's place."""
    many = start[bucket + 1] - start[bucket]
    which = np.repeat(np.arange(len(bucket)), many)
    return which, np.repeat(start[bucket] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


_FOUND = "name string, n long, person_id long, org boolean, family string, given string, joined string, first string, token string, linkage double"


def near_entries(spellings: DataFrame, registry: DataFrame, weights, shards: int, tasks: int, least: float = LEAST) -> DataFrame:
    """Sparse top-n cosine join of spellings (name, n) with entries (person_id, org, family, given); only entries whose family name fits."""

    def route(texts, columns):
        def go(batches):
            for b in batches:
                rows = texts(b)
                to = [sorted(set().union(*x)) for x in rows] if shards > 1 else [[0]] * b.num_rows
                at = pa.array([i for i, x in enumerate(to) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([k for x in to for k in x], pa.int32()), *(b.column(i).take(at) for i in range(b.num_columns))], names=["shard", *columns])

        return go

    def name_shards(b):
        return [[x] for x in weights.value.shards(b.column(0).to_pylist(), shards, least)] if shards > 1 else []

    def entry_shards(b):
        if shards == 1:
            return []
        spelled = [entry(o, f, g).spellings() for o, f, g in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
        found = iter(weights.value.shards([s for x in spelled for s in x], shards, least))
        return [[next(found) for _ in x] for x in spelled]

    left = spellings.select("name", "n").mapInArrow(route(name_shards, ["name", "n"]), "shard int, name string, n long").withColumn("task", F.pmod(F.xxhash64("name"), F.lit(tasks)).cast("int"))
    right = registry.select("person_id", "org", "family", "given").mapInArrow(route(entry_shards, ["person_id", "org", "family", "given"]), "shard int, person_id long, org boolean, family string, given string")
    right = right.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def join(names: pa.Table, known: pa.Table) -> pa.Table:
        cols = known.select(["person_id", "org", "family", "given"]).to_pydict()
        entries = [entry(o, f, g) for o, f, g in zip(cols["org"], cols["family"], cols["given"])]
        texts, n = names.column("name").to_pylist(), names.column("n").to_pylist()
        out = []
        if texts and entries:
            for i, k, _, linkage in Index(entries, weights.value).near(texts, least):
                e = entries[k]
                if e.families(texts[i]):
                    out.append((texts[i], n[i], cols["person_id"][k], cols["org"][k], cols["family"][k], cols["given"][k], e.joined, e.first, e.token(texts[i]), linkage))
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(types), types)], names=[c.split()[0] for c in _FOUND.split(", ")])

    found = left.groupBy("shard", "task").cogroup(right.groupBy("shard", "task")).applyInArrow(join, _FOUND)
    return found if shards == 1 else found.dropDuplicates(["name", "person_id"])


def short_forms(found: DataFrame) -> DataFrame:
    """(first, short): short forms of given names, learned from the families with which they occur."""
    t = found.where("token is not null")
    families = t.groupBy("token").agg(F.count_distinct("joined").alias("families"))
    pairs = t.groupBy("token", "first").agg(F.count_distinct("joined").alias("both"), F.sum("n").alias("weight"))
    own = pairs.where("token = first").select("first", F.col("weight").alias("own"))
    usual = pairs.where("token <> first").join(families, "token").join(own, "first").where((F.col("both") >= FAMILIES) & (F.col("both") >= SHARE * F.col("families")) & (F.col("weight") >= WEIGHT * F.col("own")))
    return usual.groupBy("first").agg(F.sort_array(F.collect_set("token")).alias("short"))


def _checked(found: DataFrame) -> DataFrame:
    """Rows of ``found`` (with ``short``) whose whole name fits."""
    fields = ["name", "person_id", "org", "family", "given", "linkage", "short"]

    def check(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(len(fields))]
            at = pa.array([i for i, (name, _, o, f, g, _, s) in enumerate(zip(*cols)) if entry(o, f, g, tuple(s or ())).edits(name) < 9], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(i).take(at) for i in range(6)], names=fields[:6])

    return found.select(*fields).mapInArrow(check, "name string, person_id long, org boolean, family string, given string, linkage double")


def _best(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("name").orderBy(F.desc("linkage"), "person_id")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def _grams_of(rows: DataFrame, text, keys: dict[str, str], weights) -> DataFrame:
    """(keys, bucket, w): unit vectors of the texts that ``text`` gives for a batch."""

    def go(batches):
        for b in batches:
            lists = text(b)
            row, bucket, w = weights.value.vectors([s for x in lists for s in x])
            at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists])[row], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keys))), pa.array(bucket, pa.int64()), pa.array(w, pa.float64())], names=[*keys, "bucket", "w"])

    return rows.mapInArrow(go, ", ".join(f"`{k}` {t}" for k, t in keys.items()) + ", bucket long, w double")


def average_linkage(checked: DataFrame, registry: DataFrame, weights) -> DataFrame:
    """(name, person_id, linkage): each spelling in the cluster of highest average linkage to its other members."""
    checked = checked.withColumn("part", F.col("org") & ~F.col("name").rlike(r"[\p{L}\p{N}][^\p{L}\p{N}]+[\p{L}\p{N}]"))
    best = _best(checked).select("name", "person_id", "part")

    def seeds(batches):
        for b in batches:
            rows = [(i, o and k > 0, s) for i, o, f, g in zip(*(b.column(i).to_pylist() for i in range(4))) for k, s in enumerate(entry(o, f, g).spellings())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.int64(), pa.bool_(), pa.string()))], names=["person_id", "part", "name"])

    own = registry.select("person_id", "org", "family", "given").mapInArrow(seeds, "person_id long, part boolean, name string")
    members = best.select("person_id", "part", "name").unionByName(own)
    key = {"person_id": "long", "part": "boolean"}
    sums = _grams_of(members, lambda b: [[s] for s in b.column(2).to_pylist()], key, weights).groupBy(*key, "bucket").agg(F.sum("w").alias("total"))
    sizes = members.groupBy(*key).agg(F.count("*").alias("size"))
    rows = _grams_of(checked.select("name", *key), lambda b: [[s] for s in b.column(0).to_pylist()], {"name": "string", **key}, weights)
    dots = rows.join(sums.hint("merge"), [*key, "bucket"]).groupBy("name", *key).agg(F.sum(F.col("w") * F.col("total")).alias("dot"))
    inside = best.withColumn("inside", F.lit(1))
    linked = dots.join(sizes.hint("merge"), list(key)).join(inside.hint("merge"), ["name", *key], "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    linked = linked.withColumn("linkage", F.round((F.col("dot") - F.col("inside")) / (F.col("size") - F.col("inside")), 9))
    return _best(linked.select("name", "person_id", "linkage").where(F.col("linkage") >= LINKAGE))


def link_mentions(mentions: DataFrame, name: str, keys: list[str], registry: DataFrame, least: float = LEAST) -> DataFrame:
    """(keys, person_id): the registry entry of every mention that has one; ``name`` holds folded names.

    ``registry`` has person_id, family, given and org (boolean).
    """
    named = F.col("person_id").isNotNull() & F.col("family").rlike(r"[\p{L}\p{N}]")
    entries = registry.where(named).select(F.col("person_id").cast("long").alias("person_id"), F.coalesce("org", F.lit(False)).alias("org"), "family", "given").dropDuplicates(["person_id"])
    spellings = written(mentions.where(F.trim(name) != "").groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")))
    weights = mentions.sparkSession.sparkContext.broadcast(Weights(*document_frequencies(spellings, "name")))  # SPACE numbers
    shards, tasks = -(-entries.count() // SHARD), -(-spellings.count() // SPELLINGS)
    found = written(near_entries(spellings, entries, weights, max(1, shards), max(1, tasks), least))
    checked = written(_checked(found.join(short_forms(found), "first", "left")))
    linked = average_linkage(checked, entries, weights).select(F.col("name").alias("_name"), F.col("person_id").alias("_id"))
    mine = mentions.select(*keys, F.col(name).alias("_n"))
    return mine.join(linked.hint("merge"), F.col("_n") == F.col("_name")).select(*keys, F.col("_id").alias("person_id"))
