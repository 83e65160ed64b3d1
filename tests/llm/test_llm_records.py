import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibspark.llm import form_copies, name_variants, survivors

T = lambda n: dt.datetime(2024, 1, n)


# --- survivors ----------------------------------------------------------------------------------------------------
def test_best_values(spark):
    rows = [
        (1, 10, 2, 3, T(1), 1, 0), (1, 11, 2, 5, T(1), 0, 0), (1, 12, 3, None, None, 1, 0), (1, 13, 3, 1, None, 1, 0), (1, 14, 3, 1, T(2), 1, 0), (1, 9, 3, 1, T(2), 1, 0), (1, 9, 3, 1, T(2), 1, 0),
        (2, 20, None, 1, T(1), None, None), (3, 30, 0, 1, T(1), 1, 0),
    ]
    d = spark.createDataFrame(rows, "g long, rec_id long, n int, trust int, m timestamp, ok int, field_name int")
    best = survivors.best_values(d, "g", "rec_id", {"n": F.col("n"), "ok": F.col("ok")}, F.col("trust"), F.col("m"))
    assert {tuple(r) for r in best.collect()} == {(1, "n", 9), (1, "ok", 10), (3, "ok", 30)}
    values = spark.createDataFrame([(9, "nine"), (10, "ten"), (30, "x")], "rec_id long, v string")
    made = survivors.merged_records(best, values, "g", "rec_id", {"n": F.col("v"), "ok": F.upper("v")})
    assert {tuple(r) for r in made.collect()} == {(1, "nine", "TEN"), (3, None, "X")}
    assert survivors.best_values(d.limit(0), "g", "rec_id", {"n": F.col("n")}, F.col("trust"), F.col("m")).count() == 0


def test_hot_group_is_limited_before_the_shuffle(spark):
    d = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("rec_id"), F.lit(1).alias("n"))
    best = survivors.best_values(d, "g", "rec_id", {"n": F.col("n")}, F.lit(1), F.lit(T(1)))
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
    assert best.collect()[0]["rec_id"] == 0


# --- copies -------------------------------------------------------------------------------------------------------
def brute(rows):
    groups: dict[str, list[int]] = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in (t or "").upper().lower() if c.isalnum()), []).append(i)
    return groups


@pytest.mark.parametrize("limit", [1, 7, 50_000])
def test_copies(spark, limit):
    r = random.Random(4)
    base = ["", None, "The Same Title", "the same title!", "Größe", "GRÖSSE", "x" * 20_000, "X " * 20_000, "x" * 20_001] + ["Common prefix of many titles " + "".join(r.choice("abAB ,.") for _ in range(6)) for _ in range(150)]
    rows = [(i + 5, t) for i, t in enumerate(base + base[:60])]
    d = spark.createDataFrame([(i, t, 1, "row") for i, t in rows], "rec_id long, t string, copies int, row string").repartition(5)
    key = [form_copies.canonical_letters(F.col("t"))]
    want = {(min(g), i) for g in brute(rows).values() for i in g if i != min(g)}
    got = form_copies.form_copies(d, "rec_id", key, limit)
    assert {(x["first"], x["rec_id"]) for x in got.collect()} == want
    counts = {x["first"]: x["copies"] for x in form_copies.copy_counts(d, "rec_id", key, limit).collect()}
    assert counts == {min(g): len(g) for g in brute(rows).values()}


def test_copies_of_nothing(spark):
    d = spark.createDataFrame([], "rec_id long, t string")
    assert form_copies.form_copies(d, "rec_id", [form_copies.canonical_letters(F.col("t"))]).count() == 0


@given(st.lists(st.binary(max_size=40), max_size=40))
@settings(max_examples=100, deadline=None)
def test_trie(keys):
    t = form_copies.Trie()
    for i, k in enumerate(keys):
        t.add(k, 1, i, i)
    assert {k: (n, f, r) for k, n, f, r in t.terminals()} == {k: (keys.count(k), keys.index(k), [i for i, x in enumerate(keys) if x == k]) for k in set(keys)}


@pytest.mark.parametrize("doi, bare", [("doi:10.1/X", "10.1/X"), ("DOI: 10.1/x", "10.1/x"), ("https://doi.example/10.1/x", "10.1/x"), ("http://dx.doi.org/10.1/x", "10.1/x"), ("10.1234/x", "10.1234/x"), (" 10.1/x", "10.1/x"), ("doi:", ""), ("https://doi.example/", ""), (None, "")])
def test_bare_doi(spark, doi, bare):
    d = spark.createDataFrame([(doi,)], "x string")
    assert d.select(form_copies.bare_doi(F.col("x")).alias("y")).collect()[0]["y"] == bare


def test_memory_of_one_bucket():
    """However many buckets a task gets, it holds one; a hot key's members go out after every FLUSH records."""
    import tracemalloc

    import pyarrow as pa

    def batches(buckets, rows=500):
        for b in range(buckets):
            key = b"%05d" % b
            yield pa.RecordBatch.from_pydict({"bucket": [key] * rows, "key": [key + b"%06d" % (i // 2) + b"x" * 50 for i in range(rows)], "n": [1] * rows, "first": list(range(rows)), "row": [f"{b}-{i}" for i in range(rows)]})

    def peak(buckets):
        tracemalloc.start()
        n = sum(x.num_rows for x in form_copies._count_buckets((x.select(["bucket", "row", "key", "n", "first"]).select(["bucket", "key", "n", "first", "row"]) for x in batches(buckets))))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, top

    (few, low), (many, high) = peak(20), peak(200)
    assert few == 20 * 500 and many == 200 * 500 and high < 1.5 * low
    hot = (pa.RecordBatch.from_pydict({"id": list(range(a, a + 10_000)), "key": [b"same"] * 10_000}) for a in range(0, 250_000, 10_000))
    lists = [len(m) for b in form_copies._count_locally(hot) for m in b.column(4).to_pylist()]
    assert sum(lists) == 250_000 and max(lists) <= form_copies.FLUSH


# --- names --------------------------------------------------------------------------------------------------------
REGISTRY = [(1, "Veskanovski", "Rosa", False), (2, "Veskanovski", "Edward", False), (3, "de la Obrumbwick", "Oskar", False), (4, "Ströbelcombe", "Anthony H.", False), (5, "Joruhuber", "Jürgen-Luc K.", False), (6, "Laboratory for Reference Keeping Val", None, True), (7, "Society of Ice and Snow, Étang", None, True), (8, "Kolerdgaard", "Robert", False)]
NAMES = {
    "Rosa Veskanovski": 1, "VESKANOVSKI, R.": 1, "E Veskanovski": 2, "Veskanovski, Q.": None, "Veskanovski, T.": 2, "Veskanovski": None, "Veskanovski Edward": 2, "veskanovski, ned": 2, "Vesknaovski, Rosa": 1, "Veskanovska, William": None,
    "O. de la Obrumbwick": 3, "Str{\\\"o}belcombe, A. H.": 4, "Strobelcombe, Tony": 4, "Strobelcombe, A. B.": None, "J.-L.K. Joruhuber": 5, "Joruhuber, Jürgen": 5, "Ｊoruhuber, Jür​gen": 5,
    "{The Lab. f. Reference Keeping Val}": 6, "LRKV": 6, "Laboratory for Reference Keping Val (LRKV)": 6, "Society of Ice & Snow, Etang": 7, "Society of Snow": None, "B. Kolerdgaard": 8, "Bob Kolerdgaard": 8, "Rob. Kolerdgaard": 8, "": None, "   ": None,
}


# short forms are learned: each occurs with three more families in which the registry has the full name
TAUGHT = {"Edward": ["ned", "ted"], "Anthony": ["tony"], "Robert": ["bob"]}
FAMILIES = ["Quilnavik", "Drosmerlet", "Ulmhaver", "Pirstanzo"]
_TYPES = "person_id long, family string, given string, org boolean"


def _taught():
    entries = [(100 + 10 * i + j, f + g[:2].lower(), g, False) for i, g in enumerate(TAUGHT) for j, f in enumerate(FAMILIES)]
    return entries, [f"{s} {f + g[:2]}" for g, short in TAUGHT.items() for f in FAMILIES for s in [g, *short]]


def _linked(spark, names, registry):
    d = spark.createDataFrame([(i, 1, name_variants.fold_name(n) if n is not None else None, 5) for i, n in enumerate(names)], "rec_id long, pos int, name string, person_id long")
    return {r["rec_id"]: r["person_id"] for r in name_variants.link_mentions(d, "name", ["rec_id", "pos"], spark.createDataFrame(registry, _TYPES)).collect()}


def test_names(spark):
    entries, mentions = _taught()
    names = [*NAMES, *mentions, None]
    got = _linked(spark, names, REGISTRY + entries)
    assert {n: got.get(i) for i, n in enumerate(NAMES)} == NAMES
    assert len(got) == sum(x is not None for x in NAMES.values()) + len(mentions)
    assert _linked(spark, [], REGISTRY) == {} and _linked(spark, names, []) == {}


def test_clusters_decide(spark, monkeypatch):
    """Without linkage nothing is linked, and the mentions of a cluster draw what fits several entries."""
    registry = [(1, "Torvaldsund", "Maria", False), (2, "Torvaldsund", "Martin Otto", False), (3, None, "Ann", False), (None, "Xanvik", "Bo", False)]
    names = ["Torvaldsund, M.", "Torvaldsund, Maria", "Maria Torvaldsund", "Torvaldsund, Martin O.", "Martin Torvaldsund", "Bo Xanvik"]
    got = _linked(spark, names, registry)
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}
    monkeypatch.setattr(name_variants, "LINKAGE", 1.01)
    assert _linked(spark, names, registry) == {}


def test_shards_lose_nothing(spark, monkeypatch):
    """The sharded join finds the pairs of the join in one shard, and all of a brute-force comparison."""
    import numpy as np

    entries, mentions = _taught()
    registry = spark.createDataFrame(REGISTRY + entries, _TYPES)
    names = spark.createDataFrame([(name_variants.fold_name(n), 1) for n in [*NAMES, *mentions] if n.strip()], "name string, n long").distinct()
    weights = name_variants.Weights(*name_variants.document_frequencies(names, "name"))
    shared = spark.sparkContext.broadcast(weights)
    pairs = lambda k, tasks: {(r["name"], r["person_id"]) for r in name_variants.near_entries(names, registry, shared, k, tasks).collect()}
    one = pairs(1, 1)
    assert one and pairs(7, 3) == one

    def unit(s):
        _, b, w = weights.vectors([s])
        v = np.zeros(name_variants.SPACE)
        v[b] = w
        return v

    for n in [r["name"] for r in names.collect()]:
        for i, f, g, o in REGISTRY + entries:
            e = name_variants.entry(o, f, g)
            if max(float(unit(n) @ unit(s)) for s in e.spellings()) >= name_variants.LEAST + 1e-6 and e.families(n):
                assert (n, i) in one


@given(st.text(alphabet="abc", max_size=7), st.text(alphabet="abc", max_size=7))
@settings(max_examples=200, deadline=None)
def test_one_edit(a, b):
    near = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abc"} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    assert name_variants.one_edit(a, b) == (0 if a == b else 1 if b in near else 9)


def test_candidates_lose_no_typing_error():
    """Every name one typing error away from a family name passes the trigram bound."""
    import numpy as np

    entries = [name_variants.entry(o, f, g) for _, f, g, o in REGISTRY]
    index = name_variants.Index(entries, name_variants.Weights(np.ones(name_variants.SPACE, np.int64), 100))
    rnd, wrong = random.Random(1), []
    for k, e in enumerate(entries[:5]):
        f = " ".join(e.family)
        for _ in range(60):
            i = rnd.randrange(len(f) - 1)
            g = rnd.choice([f[:i] + f[i + 1 :], f[:i] + "q" + f[i:], f[:i] + "q" + f[i + 1 :], f[:i] + f[i + 1] + f[i] + f[i + 2 :]])
            name = f"{g}, {e.given[0]}"
            if e.edits(name) < 9 and not any(j == k for _, j, _, _ in index.near([name], 0.3)):
                wrong.append(name)
    assert not wrong
