"""Insertion of a batch of records into a library with a check for duplicates, as an ordered fold.

Records of the batch come in their order, after the library. Each is compared with what the library holds by then: a
record of equal DOI or of equal authors and title is a duplicate, the most similar one counts, the first of these. A
record of the batch without a duplicate is added, and those after it are compared with it as well. What becomes of a
duplicate is the mode's choice; its attachments go to the record it meets.

The fold is done on classes of equal identities and never on pairs: a duplicate of a duplicate is followed to the record
that both end in, by pointer jumping. Identities are those that records bring along. In mode s dropped records are
in the way of no other one; which stay is a fixpoint, each round of which decides all records whose earlier relatives are decided.

Defined results: records without DOI, authors and title have no duplicate; a key and a type follow the winning record
(as fields ID and ENTRYTYPE); repeated rows are duplicates; an empty batch or library changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bib as B
from ..tables import cut
from . import identity as I
from . import merge as M

#: what the places of the batch are beyond those of the library
LATER = 1 << 61
MODES = (*M.MODES, "r")


def _in_order(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    columns = ["entry_type", "cite_key", "field_map"]
    return old.select(F.col(order).alias("at"), *columns).unionByName(new.select((F.col(order) + F.lit(LATER)).alias("at"), *columns))


def chained(old: DataFrame, new: DataFrame, order: str = "rec_id") -> DataFrame:
    """(at, match, level): for each record of the batch that is a duplicate, the record in which its chain ends."""
    links = cut(I.best_earlier(_in_order(old, new, order), "at").where(F.col("at") >= LATER))
    done, open_ = None, links.select("at", "level", F.col("match").alias("root"))
    while True:
        up = open_.select(F.col("at").alias("_a"), F.col("root").alias("_r"))
        if done is not None:
            up = up.unionByName(done.select(F.col("at").alias("_a"), F.col("root").alias("_r")))
        step = cut(open_.join(up, F.col("root") == F.col("_a"), "left"))
        ended = step.where("_r is null").select("at", "level", "root")
        done = ended if done is None else done.unionByName(ended)
        open_ = step.where("_r is not null").select("at", "level", F.col("_r").alias("root"))
        if open_.isEmpty():
            return done.withColumnRenamed("root", "match").select("at", "match", "level")


def kept_when_skipping(old: DataFrame, new: DataFrame, order: str = "rec_id") -> tuple[DataFrame, DataFrame]:
    """Places of the records that stay in mode s, and (at, match, level) of those that are dropped."""
    every = _in_order(old, new, order)
    ids = cut(I.identities(every).select("at", F.when(F.col("doi_id") != "", F.col("doi_id")).alias("d"), F.when(F.col("at_id") != "", F.col("at_id")).alias("a")))
    kept, open_ = ids.where(F.col("at") < LATER), ids.where(F.col("at") >= LATER)
    while not open_.isEmpty():
        j = open_
        for k in ("d", "a"):
            for rows, name in ((kept, "k"), (open_, "o")):
                first = rows.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min("at").alias(f"{name}{k}"))
                j = j.join(first, F.col(k) == F.col("_k"), "left").drop("_k")
        gone = F.coalesce(F.col("kd") < F.col("at"), F.lit(False)) | F.coalesce(F.col("ka") < F.col("at"), F.lit(False))
        waits = F.coalesce(F.col("od") < F.col("at"), F.lit(False)) | F.coalesce(F.col("oa") < F.col("at"), F.lit(False))
        j = cut(j.select("at", "d", "a", F.when(gone, "gone").when(waits, "waits").otherwise("stays").alias("fate")))
        kept = cut(kept.unionByName(j.where("fate = 'stays'").select("at", "d", "a")))
        open_ = j.where("fate = 'waits'").drop("fate")
    stay = kept.select("at")
    dropped = every.join(stay, "at", "left_anti")
    return stay, I.best_among(dropped, every.join(stay, "at", "left_semi"), "at")


def merged_files(base: DataFrame, hits: DataFrame) -> DataFrame:
    """(entry, file): attachments of the records that met duplicates, their own first, each path once."""
    own = base.join(hits.select(F.col("match").alias("entry")).distinct(), "entry", "left_semi").select("entry", F.lit(-1).cast("long").alias("at"), "field_map")
    rows = own.unionByName(hits.select(F.col("match").alias("entry"), "at", "field_map"))
    paths = rows.select("entry", "at", F.posexplode(B.attachments(B.field("file"))).alias("pos", "path")).groupBy("entry", "path").agg(F.min(F.struct("at", "pos")).alias("place"))
    packed = paths.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("x"))
    return packed.select("entry", B.pack_attachments(F.transform("x", lambda x: x["path"])).alias("file"))


def insert_checked(old: DataFrame, new: DataFrame, mode: str, order: str = "rec_id") -> DataFrame:
    """(entry, field, value): the library after the insertion of the batch; mode r raises if there is a duplicate."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    every = _in_order(old, new, order)
    own = F.create_map(F.lit("ENTRYTYPE"), F.coalesce("entry_type", F.lit("")), F.lit("ID"), F.coalesce("cite_key", F.lit("")))
    fields = F.map_concat(F.map_filter(F.coalesce("field_map", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("ENTRYTYPE", "ID")), own)
    every = every.select("at", fields.alias("field_map"))
    links = kept_when_skipping(old, new, order)[1] if mode == "s" else chained(old, new, order)
    if mode == "r":
        if not links.isEmpty():
            raise ValueError("the batch holds duplicates")
    hits = every.join(links.select("at", "match"), "at")
    base = every.join(links.select("at"), "at", "left_anti")
    if mode in ("a", "r"):
        rows = every.select(F.col("at").alias("entry"), F.explode("field_map").alias("field", "value"))
    else:
        rows = M.insert(base, hits.select("at", "field_map"), links.select("at", "match"), mode, "at")
        files = merged_files(base.withColumnRenamed("at", "entry"), hits)
        with_file = files.select("entry", F.lit("file").alias("field"), F.col("file").alias("value"))
        rows = rows.join(with_file.select("entry", "field"), ["entry", "field"], "left_anti").unionByName(with_file)
    return rows.select(F.when(F.col("entry") >= LATER, F.col("entry") - LATER).otherwise(F.col("entry")).alias("entry"), "field", "value")


def key_conflicts(old: DataFrame, new: DataFrame, order: str = "rec_id", within: str = "lib") -> DataFrame:
    """(order, match, kind): records of the batch whose key, letter case aside, an earlier record of their library has.

    ``duplicate``: the first record of that key has the same title, so that the new one adds nothing; ``conflict``: it has
    another, so that the new one needs another key. Records without a key conflict with none.
    """
    columns = [within, F.lower("cite_key").alias("k"), B.field("title").alias("title")]
    every = old.select(F.col(order).alias("at"), *columns).unionByName(new.select((F.col(order) + F.lit(LATER)).alias("at"), *columns)).where("k is not null")
    first = every.groupBy(within, "k").agg(F.min(F.struct("at", "title")).alias("f")).select(F.col(within).alias("_w"), F.col("k").alias("_k"), "f")
    j = every.where(F.col("at") >= LATER).join(first, F.col(within).eqNullSafe(F.col("_w")) & (F.col("k") == F.col("_k"))).where("f.at < at")
    plain = lambda c: F.when(c >= LATER, c - LATER).otherwise(c)
    return j.select(plain(F.col("at")).alias(order), plain(F.col("f.at")).alias("match"), F.when(F.col("title") == F.col("f.title"), "duplicate").otherwise("conflict").alias("kind"))
