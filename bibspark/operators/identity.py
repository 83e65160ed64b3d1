"""Duplicate detection: identities, levels of similarity, classes, greedy groups, best records.

No operator expands the pairs of a group. Every record gets the class of each identity (its first record), or the
best earlier record with its level; classes are computed by aggregates that combine before the shuffle, and joined
back (adaptive execution splits a hot class on the record side).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bib as B
from ..tables import cut
from .ordered import placed, runs

# fixed values: levels of similarity
LEVELS = {"EXACT": 104, "GOOD": 103, "FAIR": 102, "PARTIAL": 101}
#: records of a range that is folded in one task
FOLD_ROWS = 1 << 18


def identities(df: DataFrame) -> DataFrame:
    """doi_id (lower case) and at_id (authors' families and title, simplified)."""
    return df.withColumns({"doi_id": F.lower(B.field("doi")), "at_id": B.author_title_id(), "doi_raw": B.field("doi")})


def first_of(df: DataFrame, key: list[str], order: str, out: str) -> DataFrame:
    """``out``: smallest ``order`` among the rows of equal, non-null, non-empty key; null where the key is empty."""
    filled = F.lit(False)
    for k in key:
        filled = filled | (F.col(k) != "") if dict(df.dtypes)[k] == "string" else filled | F.col(k).isNotNull()
    firsts = df.where(filled).groupBy(*key).agg(F.min(order).alias(out))
    return df.join(firsts, key, "left")


def _compared(df: DataFrame, order: str) -> DataFrame:
    """What records are compared by: content, both identities, DOI as written, each identity; null where they have none."""
    d = identities(df)
    ided = (F.col("doi_id") != "") | (F.col("at_id") != "")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return d.select(
        order, F.when(ided, F.sha2(F.to_json(B.content()), 256)).alias("body"), F.when(ided, F.sha2(F.concat_ws("\x1f", "doi_id", "at_id"), 256)).alias("pair"),
        filled("doi_raw").alias("doi_raw"), filled("doi_id").alias("doi_id"), F.when(F.col("at_id") != "", F.sha2("at_id", 256)).alias("at_id"),
    )


def best_among(df: DataFrame, library: DataFrame, order: str = "rec_id") -> DataFrame:
    """(order, match, level): the most similar record of ``library`` before each record of ``df``, the earliest of that level."""
    mine, theirs = cut(_compared(df, order)), cut(_compared(library, order))
    kinds = ["body", "pair", "doi_raw", "doi_id", "at_id"]
    # one aggregate over (kind, key), joined once: a row of df meets at most one row for each kind
    tall = lambda d: d.select(order, F.posexplode(F.array(*kinds)).alias("kind", "key")).where("key is not null")
    firsts = tall(theirs).groupBy("kind", "key").agg(F.min(order).alias("first"))
    j = tall(mine).join(firsts, ["kind", "key"]).where(F.col("first") < F.col(order))
    level = F.when(F.col("kind") < 3, F.lit(LEVELS["EXACT"]) - F.col("kind")).otherwise(LEVELS["PARTIAL"])
    best = j.groupBy(order).agg(F.max(F.struct(level.cast("long").alias("level"), (-F.col("first")).alias("back"))).alias("x"))
    return best.select(order, (-F.col("x.back")).alias("match"), "x.level")


def best_earlier(df: DataFrame, order: str = "rec_id") -> DataFrame:
    """(order, level, match): the most similar earlier record of each record, the earliest of that level.

    EXACT: all content equal; GOOD: both identities equal; FAIR: DOI equal as written; PARTIAL: one identity equal.
    Records without any identity match nothing.
    """
    return best_among(df, df, order).select(order, "level", "match")


def classes(df: DataFrame, order: str = "rec_id") -> DataFrame:
    """(order, doi_class, at_class, n_doi, n_at): classes of equal DOI and of equal author-title, and their sizes."""
    d = identities(df).select(order, "doi_id", "at_id")
    for k, c, n in (("doi_id", "doi_class", "n_doi"), ("at_id", "at_class", "n_at")):
        g = d.where(F.col(k) != "").groupBy(k).agg(F.min(order).alias(c), F.count("*").alias(n))
        d = d.join(g, k, "left")
    return d.select(order, "doi_class", "at_class", F.coalesce("n_doi", F.lit(0)).alias("n_doi"), F.coalesce("n_at", F.lit(0)).alias("n_at"))


def grouped_by(df: DataFrame, key: Column, order: str = "rec_id", valid: Column | None = None) -> DataFrame:
    """(order, group_first, n): class and size by a key; ``valid`` says which keys may form duplicate groups."""
    d = df.select(order, key.alias("_k"), (F.lit(True) if valid is None else valid).alias("_ok"))
    g = d.groupBy("_k").agg(F.min(order).alias("group_first"), F.count("*").alias("n"))
    return d.join(g, "_k").select(order, "group_first", "n", ((F.col("n") > 1) & F.col("_ok")).alias("duplicate"))


def adjacent_runs(df: DataFrame, key: Column, within: str, order: list[str], ident: str = "rec_id") -> DataFrame:
    """(ident, run, n): runs of neighbours of equal key within a library, in its order."""
    d = df.select(within, ident, *[c for c in order if c != ident], F.coalesce(key, F.lit("")).alias("_k"))
    d = runs(d, [within], order, "_k", "run")
    n = d.groupBy(within, "run").agg(F.count("*").alias("n"))
    return d.join(n, [within, "run"]).select(within, ident, "run", "n")


def _folded(records: DataFrame, came: DataFrame | None, names: list[str], parts: int, order: str, rows: bool) -> DataFrame:
    """The fold over the records of each range ``_p`` in their order, after what ``came`` into it from earlier ranges.

    ``rows``: (order, group_first) of every record. Else (_p, kind, key, low, was) of each class that was asked for (all
    of them in the first round): its smallest group up to the end of the range, and what had come into it.
    """
    m, first = len(names), came is None
    value = records.schema["o"].dataType.simpleString()

    def fold(batches):
        at, low, asked, kind_of = None, [], [], None

        def minima():
            for k in range(m) if at is not None else ():
                keys = list(low[k]) if first else list(asked[k])
                cols = [[at] * len(keys), [k] * len(keys), keys, [low[k][x] for x in keys], [asked[k].get(x) for x in keys]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), kind_of, kind_of))], names=["_p", "kind", "key", "low", "was"])

        for b in batches:
            kind_of, groups, out = b.schema.field("o").type, [], []
            for p, kind, o, *ids in zip(*(b.column(x).to_pylist() for x in ("_p", "kind", "o", *names))):
                if p != at:
                    if not rows:
                        yield from minima()
                    at, low, asked = p, [{} for _ in names], [{} for _ in names]
                if kind < m:  # what comes in
                    asked[kind][ids[0]] = o
                    if o is not None:
                        low[kind][ids[0]] = o
                    continue
                g = o
                for x, l in zip(ids, low):
                    if x is not None and (y := l.get(x, g)) < g:
                        g = y
                for x, l in zip(ids, low):
                    if x is not None:
                        l[x] = g
                if rows:
                    out.append(o)
                    groups.append(g)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, kind_of), pa.array(groups, kind_of)], names=[order, "group_first"])
        if not rows:
            yield from minima()

    d = records.select("_p", F.lit(m).alias("kind"), "o", *names)
    if came is not None:
        d = d.unionByName(came.select("_p", "kind", "o", F.col("key").alias(names[0])), allowMissingColumns=True)
    return d.repartition(parts, "_p").sortWithinPartitions("_p", "kind", "o").mapInArrow(fold, f"`{order}` {value}, group_first {value}" if rows else f"_p int, kind int, key long, low {value}, was {value}")


def greedy_groups(df: DataFrame, order: str = "rec_id", by_key: bool = False) -> DataFrame:
    """(order, group_first): each record joins the earliest group that holds an earlier record equal to it
    (PARTIAL level, or with ``by_key`` the same key), else it founds one; groups never merge later.

    Ranges of at most about ``FOLD_ROWS`` records are folded in their order, all ranges at once; what a range leaves to the
    later ones is the smallest group of each class. Rounds go on until nothing new comes into any range: as many as a
    chain of records crosses ranges, the number of ranges at most, one if the records fit one range.
    """
    ids = {"d": F.when(F.col("doi_id") != "", F.xxhash64("doi_id")), "a": F.when(F.col("at_id") != "", F.xxhash64("at_id"))}
    if by_key:
        ids["k"] = F.when(F.col("cite_key") != "", F.xxhash64("cite_key"))
    names = list(ids)
    d = cut(identities(df).select(F.col(order).alias("o"), *[c.alias(k) for k, c in ids.items()]))
    unplaced, d = d.where("o is null").select(F.col("o").alias(order), F.col("o").alias("group_first")), d.where("o is not null")
    parts = max(1, -(-d.count() // FOLD_ROWS))
    d, came, moved = placed(d, [], ["o"], parts) if parts > 1 else d.withColumn("_p", F.lit(0)), None, parts > 1
    of_class = Window.partitionBy("kind", "key")
    before = of_class.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    while moved:
        # into each range comes, for classes of several ranges, the smallest group of the ranges before it
        left = _folded(d, came, names, parts, order, rows=False).withColumns({"n": F.count("*").over(of_class), "o": F.min("low").over(before)})
        came = cut(left.where("n > 1").select("_p", "kind", "key", "o", (~F.col("o").eqNullSafe(F.col("was"))).alias("moved")))
        moved = not came.where("moved").isEmpty()
    return unplaced.unionByName(_folded(d, came, names, parts, order, rows=True))


def best_record(df: DataFrame, group: str, order: str = "rec_id") -> DataFrame:
    """(group, order, score): the most reliable record of each group; ties go to the later one."""
    best = df.select(group, order, B.record_score().alias("score")).groupBy(group).agg(F.max(F.struct("score", order)).alias("b"))
    return best.select(group, f"b.{order}", "b.score")


def exact_unique(df: DataFrame, order: str = "rec_id", skip: tuple[str, ...] = ()) -> DataFrame:
    """(first, copies): one row for each different content (but for the fields ``skip``), at its first record."""
    return df.groupBy(F.sha2(F.to_json(B.content(skip)), 256).alias("_c")).agg(F.min(order).alias("first"), F.count("*").alias("copies")).drop("_c")
