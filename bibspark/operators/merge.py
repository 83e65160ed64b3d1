"""Merging of groups and insertion of records under conflict modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bib as B

MODES = ("o", "a", "u", "U", "s")


def field_values(df: DataFrame, group: str, order: str) -> DataFrame:
    """(group, field, value, first): different values of each field of a group with their first place."""
    return df.select(group, order, F.explode("field_map").alias("field", "value")).groupBy(group, "field", "value").agg(F.min(order).alias("first"))


def merge_fields(df: DataFrame, group: str, order: str = "rec_id") -> DataFrame:
    """(group, field, n_values, n_filled, merged): the one filled value of each field, or null if they conflict."""
    v = field_values(df, group, order)
    filled = F.col("value") != ""
    return v.groupBy(group, "field").agg(
        F.count("*").alias("n_values"),
        F.sum(filled.cast("long")).alias("n_filled"),
        F.when(F.sum(filled.cast("long")) == 1, F.max(F.when(filled, F.col("value")))).when(F.sum(filled.cast("long")) == 0, F.lit("")).alias("merged"),
    )


def merge_resolved(df: DataFrame, group: str, order: str = "rec_id") -> DataFrame:
    """(group, field, value): conflicts take the best record's value, else the first one in order."""
    from .identity import best_record

    v = field_values(df, group, order)
    best = best_record(df, group, order).select(group, order)
    theirs = df.join(best, [group, order], "left_semi").select(group, F.explode("field_map").alias("field", "best")).where("best <> ''")
    merged = merge_fields(df, group, order)
    first = v.groupBy(group, "field").agg(F.min(F.struct("first", "value")).alias("f")).select(group, "field", F.col("f.value").alias("first_value"))
    j = merged.join(theirs, [group, "field"], "left").join(first, [group, "field"])
    return j.select(group, "field", F.coalesce("merged", "best", "first_value").alias("value"))


def insert(old: DataFrame, new: DataFrame, links: DataFrame, mode: str, order: str = "rec_id") -> DataFrame:
    """Field values of the library after inserting ``new`` into ``old``: (entry, field, value).

    ``links`` holds (order, match): the old record that a new one is a duplicate of; new records without one are
    added. Several new records for one old record apply in order. u: existing values win; U: new values win;
    o: the last new record replaces the old one; a: both are kept; s: new duplicates are dropped.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    hits = new.join(links, order)
    free = new.join(links.select(order), order, "left_anti").select(F.col(order).alias("entry"), "field_map")
    base = old.select(F.col(order).alias("entry"), "field_map")
    if mode == "s":
        rows = base.unionByName(free)
    elif mode == "a":
        rows = base.unionByName(new.select(F.col(order).alias("entry"), "field_map"))
    elif mode == "o":
        last = hits.groupBy("match").agg(F.max(F.struct(order, F.array_sort(F.map_entries("field_map")).alias("f"))).alias("x")).select(F.col("match").alias("entry"), F.map_from_entries("x.f").alias("field_map"))
        rows = base.join(last.select("entry"), "entry", "left_anti").unionByName(last).unionByName(free)
    else:
        every = old.select(F.col(order).alias("entry"), F.lit(-1).cast("long").alias("at"), "field_map").unionByName(hits.select(F.col("match").alias("entry"), F.col(order).alias("at"), "field_map"))
        pick = F.min if mode == "u" else F.max
        values = every.select("entry", "at", F.explode("field_map").alias("field", "value")).groupBy("entry", "field").agg(pick(F.struct("at", "value")).alias("x")).select("entry", "field", F.col("x.value").alias("value"))
        return values.unionByName(free.select("entry", F.explode("field_map").alias("field", "value")))
    return rows.select("entry", F.explode("field_map").alias("field", "value"))


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed, modified or existing, by full outer join on the key."""
    b = before.select(key, F.sha2(F.to_json(B.content()), 256).alias("b"))
    a = after.select(key, F.sha2(F.to_json(B.content()), 256).alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").otherwise("existing")
    return b.join(a, key, "full").select(key, change.alias("change"))


def field_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, field, old, new): fields that differ, for records on both sides."""
    both = before.select(key).intersect(after.select(key))
    b = before.join(both, key).select(key, F.explode("field_map").alias("field", "old"))
    a = after.join(both, key).select(key, F.explode("field_map").alias("field", "new"))
    return b.join(a, [key, "field"], "full").where(~F.col("old").eqNullSafe(F.col("new")))


def touched(before: DataFrame, after: DataFrame, key: str, name: str) -> DataFrame:
    """(key, touched): whether a record's ``name`` is one under which something was added, removed or modified."""
    names = before.select(key, name).unionByName(after.select(key, name)).where(F.col(name).isNotNull()).groupBy(key).agg(F.min(name).alias(name))
    changed = diff(before, after, key).where("change <> 'existing'").join(names, key).select(name).distinct().withColumn("_t", F.lit(True))
    return names.join(changed, name, "left").select(key, F.coalesce("_t", F.lit(False)).alias("touched"))
