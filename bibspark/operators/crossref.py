"""Crossref messages as records, enrichment of records, and ranking of candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bib as B

#: rows of a block
QUERIES = 1000
MESSAGES = 50_000

_NAMES = "ARRAY<STRUCT<family: STRING, given: STRING>>"
_DATE = "STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>"
SCHEMA = (
    f"STRUCT<type: STRING, title: ARRAY<STRING>, author: {_NAMES}, editor: {_NAMES}, DOI: STRING, URL: STRING, `container-title`: ARRAY<STRING>, volume: STRING, issue: STRING, page: STRING, publisher: STRING,"
    f" `publisher-location`: STRING, ISBN: ARRAY<STRING>, institution: STRUCT<name: STRING>, abstract: STRING, `published-print`: {_DATE}, `published-online`: {_DATE}, issued: {_DATE}, _bad: STRING>"
)


def names(authors: Column) -> Column:
    one = lambda a: F.when(F.coalesce(a["family"], F.lit("")) != "", F.concat(a["family"], F.lit(", "), F.coalesce(a["given"], F.lit("")))).otherwise(F.coalesce(a["given"], F.lit("")))
    return F.coalesce(F.array_join(F.transform(authors, one), " and "), F.lit(""))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with their parsed form ``m``; null and damaged ones are left out."""
    m = F.from_json("message_json", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return messages.withColumn("m", m).where(F.col("m").isNotNull() & F.col("m._bad").isNull())


def bib_type(kind: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in B.CROSSREF_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, F.coalesce(kind, F.lit(""))), F.lit("misc"))


def year() -> Column:
    at = lambda f: F.when(F.col(f"m.`{f}`.`date-parts`").isNotNull(), F.coalesce(F.try_element_at(F.try_element_at(F.col(f"m.`{f}`.`date-parts`"), F.lit(1)), F.lit(1)).cast("string"), F.lit("0000")))
    return F.coalesce(at("published-print"), at("published-online"), at("issued"), F.lit("0000"))


def records(messages: DataFrame) -> DataFrame:
    """(message_id, entry_type, cite_key, field_map, abstract): one record a message, with the fields of its type, none empty."""
    head = lambda c: F.try_element_at(F.col(f"m.`{c}`"), F.lit(1))
    kind = F.coalesce("m.type", F.lit("misc"))
    of = lambda *types: kind.isin(*types)
    values = {
        "title": head("title"), "author": names(F.col("m.author")), "doi": F.col("m.DOI"), "url": F.col("m.URL"), "year": year(),
        "journal": F.when(of("journal-article"), head("container-title")), "volume": F.when(of("journal-article"), F.col("m.volume")),
        "number": F.when(of("journal-article"), F.col("m.issue")), "pages": F.when(of("journal-article"), F.col("m.page")),
        "publisher": F.when(of("book", "proceedings-article"), F.col("m.publisher")), "address": F.when(of("book"), F.col("m.`publisher-location`")),
        "editor": F.when(of("book", "proceedings-article"), names(F.col("m.editor"))), "isbn": F.when(of("book"), head("ISBN")),
        "booktitle": F.when(of("proceedings-article"), head("container-title")), "institution": F.when(of("report"), F.col("m.institution.name")),
        "school": F.when(of("thesis"), F.col("m.institution.name")), "type": F.when(of("thesis"), F.col("m.type")),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()])
    kept = F.map_from_entries(F.filter(entries, lambda x: F.coalesce(x["v"], F.lit("")) != ""))
    return parsed(messages).select("message_id", bib_type(kind).alias("entry_type"), F.coalesce("m.DOI", F.lit("")).alias("cite_key"), kept.alias("field_map"), F.col("m.abstract").alias("abstract"))


def latest(messages: DataFrame) -> DataFrame:
    """The newest readable message of each DOI (letter case aside)."""
    p = parsed(messages).where("doi is not null and doi <> ''")
    best = p.groupBy(F.lower("doi").alias("doi_id")).agg(F.max(F.struct(F.col("fetched_ts"), F.col("message_id"))).alias("b"))
    return best.select("doi_id", F.col("b.message_id").alias("message_id"))


def enrich(bib: DataFrame, messages: DataFrame) -> DataFrame:
    """(rec_id, field, value): records overlaid with the fetched fields of their DOI; key and file stay, records without a message too."""
    fetched = records(messages).join(latest(messages), "message_id").select("doi_id", F.map_filter("field_map", lambda k, v: k != "file").alias("new"))
    j = bib.select("rec_id", "field_map", F.when(B.field("doi") != "", F.lower(B.field("doi"))).alias("doi_id")).join(fetched, "doi_id", "left")
    none = F.create_map().cast("map<string,string>")
    return j.select("rec_id", F.explode(B.update_fields(F.coalesce("new", none), F.coalesce("field_map", none))).alias("field", "value"))


def ranked(queries: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    """(key, message_id, score): the first of the most relevant of all messages for each query.

    ``messages`` has (message_id, author, title, abstract); the score sums token-set ratios with the query's text over
    the parts that the message has. Every block of queries meets every block of messages in one task, which keeps the
    best message of each query; the best of those is taken.
    """
    from ..functions.fuzzy import best_matches
    from ..tables import cut, task_count

    parts = ("author", "title", "abstract")
    q = cut(queries.select(F.col(key).alias("key"), "text"))
    m = cut(messages.groupBy(*parts).agg(F.min("message_id").alias("message_id")))
    m_blocks = max(1, -(-m.count() // MESSAGES))
    q_blocks = max(1, -(-q.count() // QUERIES), -(-2 * task_count(q.sparkSession) // m_blocks))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n, f: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)).alias("cell")
    q = q.withColumn("b", place("key", q_blocks)).select("key", "text", every(m_blocks, lambda x: F.col("b") * m_blocks + x))
    m = m.withColumn("b", place("message_id", m_blocks)).select("message_id", *parts, every(q_blocks, lambda x: x * m_blocks + F.col("b")))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("message_id")
        ids = right["message_id"].to_numpy()
        found = list(best_matches(left["text"].tolist(), [right[c].tolist() for c in parts])) if len(left) and len(ids) else []
        return pd.DataFrame({"key": left["key"] if found else [], "message_id": [int(ids[i]) for i, _ in found], "score": [s for _, s in found]})

    schema = f"key {queries.schema[key].dataType.simpleString()}, message_id bigint, score double"
    # small inputs, long work: adaptive execution must not join these partitions
    tasks = min(3 * q_blocks * m_blocks, 2000)
    q, m = q.repartition(tasks, "cell"), m.repartition(tasks, "cell")
    found = q.groupBy("cell").cogroup(m.groupBy("cell")).applyInPandas(best, schema)
    top = found.groupBy("key").agg(F.max(F.struct("score", (-F.col("message_id")).alias("back"))).alias("x"))
    return top.select(F.col("key").alias(key), (-F.col("x.back")).alias("message_id"), "x.score")
