import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bibspark.operators import history as H
from bibspark.operators import identity as I
from bibspark.operators import keys as K
from bibspark.operators import merge as M
from bibspark.operators import search as S

SCHEMA = "rec_id long, lib string, seq long, entry_type string, cite_key string, field_map map<string,string>"
REF = {"title": "A Study", "author": "Smith, J and Doe, J", "doi": "10.1234/abcd", "year": "2001"}


def bib(spark, maps, keys=None):
    return spark.createDataFrame([(i + 1, "l", i + 1, "article", keys[i] if keys else f"k{i}", m) for i, m in enumerate(maps)], SCHEMA)


def test_levels(spark):
    d = bib(
        spark,
        [REF, REF, REF | {"year": "2002"}, {"doi": "10.1234/abcd"}, REF | {"doi": "10.1234/other"}, REF | {"doi": "10.1234/ABCD", "title": "Else"}, {}, {}, None],
        ["a", "a", "b", "c", "d", "e", "f", "f", "f"],
    )
    got = {r["rec_id"]: (r["level"], r["match"]) for r in I.best_earlier(d).collect()}
    assert got == {2: (104, 1), 3: (103, 1), 4: (102, 1), 5: (101, 1), 6: (101, 1)}


def test_greedy(spark):
    # e3 is like e1 and e2, which are not alike: it joins the first group, which never merges with the second
    d = bib(spark, [{"doi": "10.1234/x1", "title": "P"}, {"doi": "10.1234/x2", "title": "Q"}, {"doi": "10.1234/x1", "title": "Q"}, {"title": "Q"}, {}, {}])
    assert [tuple(r) for r in I.greedy_groups(d).orderBy("rec_id").collect()] == [(1, 1), (2, 2), (3, 1), (4, 1), (5, 5), (6, 6)]


def replay(rows):
    groups = []
    for i, d, a in rows:
        for g in groups:
            if any((d and d == x[1]) or (a and a == x[2]) for x in g):
                g.append((i, d, a))
                break
        else:
            groups.append([(i, d, a)])
    return {x[0]: g[0][0] for g in groups for x in g}


def test_greedy_matches_replay(spark, sf):
    d = spark.read.parquet(f"{sf}/bib_entry.parquet")
    rows = [tuple(r) for r in I.identities(d).select("rec_id", "doi_id", "at_id").orderBy("rec_id").collect()]
    assert {r[0]: r[1] for r in I.greedy_groups(d).collect()} == replay(rows)


def test_greedy_in_ranges(spark, monkeypatch):
    """However the records are cut in ranges, the groups are those of a replay, and rounds do not grow with the longest chain."""
    r = random.Random(1)
    rows = [(i, f"10.1234/x{i // 2}", f"t{(i + 1) // 2}") for i in range(1, 61)]  # one chain: DOI and title in turn
    rows += [(i, f"10.1234/y{r.randrange(60)}" if r.random() < 0.8 else "", f"u{r.randrange(60)}" if r.random() < 0.8 else "") for i in range(61, 161)]
    d = spark.createDataFrame([(i, None, {"doi": x, "title": t}) for i, x, t in rows], "rec_id long, cite_key string, field_map map<string,string>").repartition(3)
    cuts, cut = [], I.cut
    monkeypatch.setattr(I, "cut", lambda x: cuts.append(1) or cut(x))
    assert {x[0]: x[1] for x in I.greedy_groups(d).collect()} == replay(rows)
    assert len(cuts) < 4
    monkeypatch.setattr(I, "FOLD_ROWS", 40)
    assert {x[0]: x[1] for x in I.greedy_groups(d).collect()} == replay(rows)
    assert len(cuts) < 12


def test_merge(spark):
    d = bib(spark, [{"a": "1", "b": "x", "c": ""}, {"a": "1", "b": "y", "doi": "10.1234/good1"}, {"d": "z"}]).withColumn("g", F.lit(1))
    m = {r["field"]: r["merged"] for r in M.merge_fields(d, "g").collect()}
    assert m == {"a": "1", "b": None, "c": "", "d": "z", "doi": "10.1234/good1"}
    r = {x["field"]: x["value"] for x in M.merge_resolved(d, "g").collect()}
    assert r == m | {"b": "y"}


@pytest.mark.parametrize(
    "mode, want",
    [
        ("u", {(1, "t", "old"), (1, "y", "1"), (1, "z", ""), (4, "t", "free")}),
        ("U", {(1, "t", "new2"), (1, "y", "1"), (1, "z", "9"), (4, "t", "free")}),
        ("o", {(1, "t", "new2"), (1, "z", "9"), (4, "t", "free")}),
        ("s", {(1, "t", "old"), (1, "z", ""), (4, "t", "free")}),
        ("a", {(1, "t", "old"), (1, "z", ""), (2, "t", "new"), (2, "y", "1"), (3, "t", "new2"), (3, "z", "9"), (4, "t", "free")}),
    ],
)
def test_insert(spark, mode, want):
    d = bib(spark, [{"t": "old", "z": ""}, {"t": "new", "y": "1"}, {"t": "new2", "z": "9"}, {"t": "free"}])
    links = spark.createDataFrame([(2, 1), (3, 1)], "rec_id long, match long")
    got = M.insert(d.where("rec_id = 1"), d.where("rec_id > 1"), links, mode)
    assert {tuple(r) for r in got.select("entry", "field", "value").collect()} == want


def test_diff(spark):
    a, b = bib(spark, [{"t": "1"}, {"t": "2"}, {"t": "3"}]), bib(spark, [{"t": "1"}, {"t": "x"}])
    assert {tuple(r) for r in M.diff(a, b, "rec_id").collect()} == {(1, "existing"), (2, "modified"), (3, "removed")}
    assert {tuple(r) for r in M.field_diff(a, b, "rec_id").select("rec_id", "field", "old", "new").collect()} == {(2, "t", "2", "x")}


def test_undo_redo(spark):
    t = dt.datetime(2024, 1, 1)
    log = [("l", 0, "snapshot", None, "m", t, t), ("l", 1, "snapshot", None, "m", t, t), ("l", 2, "snapshot", None, None, t, t), ("l", 3, "restore", 1, "m", t, t), ("l", 3, "restore", 1, "m", t, t), ("e", 5, "snapshot", None, "m", t, t)]
    d = spark.createDataFrame(log, "lib string, version_no long, kind string, restores long, message string, ts timestamp, loaded_ts timestamp")
    assert {tuple(r) for r in H.undo_redo(d).collect()} == {("l", 3, 1, 0, 2), ("e", 5, 5, None, None)}
    assert {tuple(r) for r in H.undo_redo(d, 2).collect()} == {("l", 3, 1, None, None), ("e", 5, 5, None, None)}
    to = spark.createDataFrame([("l", 2), ("e", 9)], "lib string, version_no long")
    assert [tuple(r) for r in H.restore(d, to).collect()] == [("l", 4, "restore", 2)]


def test_search(spark):
    d = bib(spark, [{"title": "Alpha Beta", "author": "Zed, Q"}, {"title": "Gamma"}, {"note": "alpha"}])
    ids = lambda *c: [r["rec_id"] for r in S.select(d, *c).orderBy("rec_id").collect()]
    assert ids(S.by_field("title", ["alpha", "BETA"])) == [1]
    assert ids(S.by_field("title", ["alpha", "gamma"], any_=True)) == [1, 2]
    assert ids(S.by_field("title", ["alpha"], invert=True)) == [2]
    assert ids(S.by_field("title", ["g?m*"], strict=True)) == [2]
    assert ids(S.by_field("title", ["[!a]*"], strict=True)) == [2]
    assert ids(S.everywhere(["alpha"])) == [1, 3]
    assert ids(S.by_author(["zed"], first=True)) == [1]
    assert ids(S.by_field("title", ["alpha betas"], fuzzy=60)) == [1]


def test_keys(spark):
    d = bib(spark, [{"author": "Smith, J", "year": "2001", "title": "x"}] * 30 + [{}])
    got = [r["new_key"] for r in K.cite_keys(d).orderBy("rec_id").collect()]
    assert got[:3] == ["smith2001", "smith2001b", "smith2001c"] and len(set(got)) == 31 and got[-1] == "unknown0000"


def test_keys_of_other_names(spark):
    """A letter may belong to another record's own key; each key is given once, as if one record came after the other."""
    names = [("Roe", "2000"), ("Roe", "2000"), ("Roe", "2000b"), ("Roe", "2000c"), ("Roe", "2000"), ("Doe", "1999"), ("Roe", "2000b"), ("Roe", "2000")]
    d = bib(spark, [{"author": f"{a}, J", "year": y, "title": "x"} for a, y in names])
    rows = K.cite_keys(d).orderBy("rec_id").collect()

    def replay():
        taken = set()
        for r in rows:
            key = r["base_key"]
            while key in taken:
                key = key[:-1] + chr(ord(key[-1]) + 1) if key[-1].isalpha() and key[-2].isdigit() else key + "b"
            taken.add(key)
            yield key

    assert [r["new_key"] for r in rows] == list(replay())


def _fold(rows, batch, skip):
    """What becomes of each record of a batch, one after the other: None if it stays, else the record it meets."""
    fam = lambda a: " ".join(x.split(",")[0] for x in a.split(" and ") if x).lower()
    ids = lambda f: (f.get("doi", "").lower(), fam(f.get("author", "")) + f.get("title", "").lower())

    def level(a, b):
        if not any(ids(a)):
            return 0
        same = [bool(x) and x == y for x, y in zip(ids(a), ids(b))]
        return 104 if a == b else 103 if ids(a) == ids(b) else 102 if a.get("doi") and a.get("doi") == b.get("doi") else 101 if any(same) else 0

    there, fate = dict(rows), {}
    for i, f in batch:
        hits = [(level(f, g), -j) for j, g in there.items() if level(f, g)]
        best = max(hits) if hits else None
        fate[i] = -best[1] if best else None
        if not best or not skip:
            there[i] = f
    if not skip:  # a record that met a duplicate stands for the one in which its chain ends
        for i in fate:
            while fate[i] in fate and fate[fate[i]] is not None:
                fate[i] = fate[fate[i]]
    return fate


@pytest.mark.parametrize("seed", range(3))
def test_insertion_replayed(spark, seed):
    import random

    from bibspark.operators import insertion as N

    r = random.Random(seed)
    some = lambda x: {k: v for k, v in x.items() if v}
    rows = [some({"doi": r.choice(["", "10.1000/a", "10.1000/A", "10.1000/b", "10.1000/c"]), "author": r.choice(["", "X, A", "Y, B"]), "title": r.choice(["", "one", "two"]), "year": r.choice(["", "1"])}) for _ in range(24)]
    d = bib(spark, rows)
    old, new = d.where("rec_id <= 8"), d.where("rec_id > 8")
    pairs = list(enumerate(rows, 1))
    place = lambda x: x - N.LATER if x >= N.LATER else x
    got = {place(x["at"]): place(x["match"]) for x in N.chained(old, new).collect()}
    assert {i: got.get(i) for i in range(9, 25)} == _fold(pairs[:8], pairs[8:], skip=False)
    stay, dropped = N.kept_when_skipping(old, new)
    want = _fold(pairs[:8], pairs[8:], skip=True)
    assert {place(x["at"]): place(x["match"]) for x in dropped.collect()} == {i: m for i, m in want.items() if m is not None}
    assert {place(x["at"]) for x in stay.collect()} == set(range(1, 9)) | {i for i, m in want.items() if m is None}


MODES_WANT = {
    "o": {("doi", "10.5194/bg-8-515-2011"), ("author", "New Author Field"), ("journal", "ConflictJournal"), ("ID", "AnotherKey"), ("file", ":a.pdf:pdf;:b.pdf:pdf")},
    "s": {("doi", "10.5194/bg-8-515-2011"), ("journal", "Biogeosciences"), ("year", "RareYear"), ("ID", "Roe_2011"), ("file", ":a.pdf:pdf;:b.pdf:pdf")},
    "u": {("doi", "10.5194/bg-8-515-2011"), ("author", "New Author Field"), ("journal", "Biogeosciences"), ("year", "RareYear"), ("ID", "Roe_2011"), ("file", ":a.pdf:pdf;:b.pdf:pdf")},
    "U": {("doi", "10.5194/bg-8-515-2011"), ("author", "New Author Field"), ("journal", "ConflictJournal"), ("year", "RareYear"), ("ID", "AnotherKey"), ("file", ":a.pdf:pdf;:b.pdf:pdf")},
}


@pytest.mark.parametrize("mode", sorted(MODES_WANT))
def test_insertion_modes(spark, mode):
    from bibspark.operators import insertion as N

    rows = [(1, "article", "Roe_2011", {"doi": "10.5194/bg-8-515-2011", "journal": "Biogeosciences", "year": "RareYear", "file": ":a.pdf:pdf"}), (2, "article", "AnotherKey", {"doi": "10.5194/bg-8-515-2011", "author": "New Author Field", "journal": "ConflictJournal", "file": "b.pdf"})]
    d = spark.createDataFrame(rows, "rec_id long, entry_type string, cite_key string, field_map map<string,string>")
    old, new = d.where("rec_id = 1"), d.where("rec_id = 2")
    got = {(r["entry"], r["field"], r["value"]) for r in N.insert_checked(old, new, mode).collect() if r["field"] != "ENTRYTYPE"}
    assert got == {(1, f, v) for f, v in MODES_WANT[mode]}
    assert {r["entry"] for r in N.insert_checked(old, new, "a").collect()} == {1, 2}
    with pytest.raises(ValueError):
        N.insert_checked(old, new, "r")
    assert {r["entry"] for r in N.insert_checked(old, new.limit(0), mode).collect()} == {1}
    assert {r["entry"] for r in N.insert_checked(old.limit(0), new, mode).collect()} == {2}


def test_groups_by_any_identity(spark):
    """Equal key, DOI or authors and title, first match first."""
    rows = [("k1", {"doi": "10.1000/a"}), ("k2", {"doi": "10.1000/b"}), ("k1", {"doi": "10.1000/c"}), (None, {"doi": "10.1000/C"}), ("k2", {"doi": "10.1000/A"}), ("", {}), ("", {})]
    d = spark.createDataFrame([(i, "article", k, f) for i, (k, f) in enumerate(rows, 1)], "rec_id long, entry_type string, cite_key string, field_map map<string,string>")
    assert {r["rec_id"]: r["group_first"] for r in I.greedy_groups(d, by_key=True).collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7}


def test_key_conflicts(spark):
    from bibspark.operators import insertion as N

    d = bib(spark, [{"title": "a"}, {"title": "b"}, {"title": "a"}, {"title": "c"}, {"title": "d"}, None], ["K", "x", "k", "k", None, "new"])
    got = {tuple(r) for r in N.key_conflicts(d.where("rec_id < 3"), d.where("rec_id >= 3")).collect()}
    assert got == {(3, 1, "duplicate"), (4, 1, "conflict")}
