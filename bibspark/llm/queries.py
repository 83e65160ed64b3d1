"""Queries of the operators for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packed as P
from ..tables import field, read, written
from . import byte_bpe, canonical_text, form_copies, leaked_passages, name_variants, pii, scan_repair, survivors



def _letters(x: str) -> str:
    return rf"regexp_replace(replace(lower(upper({x})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g')"


_DOI = r"regexp_replace(coalesce(field_map['doi'], ''), '(?i)^\s*(?:doi\s*[:=]?\s*)?(?:(?:https?:)?//)?(?:[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z\-]+/+|[a-z0-9\-]+\.[a-z\-]+$)?\s*(?:doi\s*[:=]?\s*)?', '')"
_KEYED = f"""with k as (select rec_id, {_letters("coalesce(field_map['title'], '')")} || chr(31) || {_letters(_DOI)} || chr(31) || {_letters("coalesce(field_map['author'], '')")} as k from bib_entry),
g as (select rec_id, min(rec_id) over (partition by k) as first_rec_id from k)"""
SQL: dict[str, str] = {
    "p4_found": _KEYED + " select first_rec_id, rec_id from g where rec_id <> first_rec_id",
    "p4_counts": _KEYED + " select first_rec_id, count(*) as n_copies from g group by 1",
}


def _value(name: str) -> F.Column:
    return F.col("field_map").getItem(name)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and authors that are not in the one canonical form."""
    return canonical_text.changed_values(read(spark, sf_dir, "bib_entry"), "rec_id", {f: _value(f) for f in ("title", "author")})


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and author of every record in canonical form."""
    bib = read(spark, sf_dir, "bib_entry").select("rec_id", _value("title").alias("title"), _value("author").alias("author"))
    return canonical_text.canonical_table(bib, ["title", "author"])


def _survivors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bib, links = read(spark, sf_dir, "bib_entry"), read(spark, sf_dir, "dup_link").distinct()
    values = bib.select("rec_id", "trust", "modified_ts", _value("doi").alias("doi"), _value("file").alias("file"), _value("keywords").alias("keywords"))
    slim = values.join(links, "rec_id").select("group_no", "rec_id", "trust", "modified_ts", "doi", "file", "keywords")
    fields = P.bib_fields("file", "keywords")
    codes = P.fit(bib, fields)
    counted = P.count_items(slim, ["group_no", "rec_id", "trust", "modified_ts", "doi"], {"file": F.col("file"), "keywords": F.col("keywords")}, codes)
    doi = F.col("doi").rlike(r"(?s)10\.[0-9.]*[0-9]/\s*[^\s]")
    best = survivors.best_values(counted, "group_no", "rec_id", {"doi": doi, "file": F.col("n_file"), "keywords": F.col("n_keywords")}, F.col("trust"), F.col("modified_ts"))
    return best, bib


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each group and field the record whose value survives."""
    return _survivors(spark, sf_dir)[0]


def p3_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One built record a group, with the surviving value of each field."""
    best, bib = _survivors(spark, sf_dir)
    return survivors.merged_records(best, bib, "group_no", "rec_id", {f: _value(f) for f in ("doi", "file", "keywords")})


def _identity() -> list[F.Column]:
    return [form_copies.canonical_letters(x) for x in (field("title"), form_copies.bare_doi(field("doi")), field("author"))]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a record, with the smallest rec_id of its copies."""
    return form_copies.form_copies(read(spark, sf_dir, "bib_entry"), "rec_id", _identity()).select(F.col("first").alias("first_rec_id"), "rec_id")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different record once, with the number of copies."""
    return form_copies.copy_counts(read(spark, sf_dir, "bib_entry"), "rec_id", _identity()).select(F.col("first").alias("first_rec_id"), F.col("copies").alias("n_copies"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the text of every document."""
    return byte_bpe.encode_column(read(spark, sf_dir, "documents"), "doc_id", "text")


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of an evaluation passage in a document, in characters of its text."""
    return leaked_passages.leaked_spans(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "eval_item"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items that leaked into them."""
    return p9_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every noisy line of the scanned pages with the kind of noise."""
    return scan_repair.noise_lines(read(spark, sf_dir, "scanned_page"))


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned pages as continuous paragraphs."""
    return scan_repair.repaired_paragraphs(read(spark, sf_dir, "scanned_page"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every author of a record who is an entry of author_registry."""
    bib, fields = read(spark, sf_dir, "bib_entry"), P.bib_fields("author")
    names = written(P.split_fields(bib, ["rec_id"], fields, P.fit(bib, fields), post=name_variants.fold_name).select("rec_id", "pos", F.col("item").alias("name")))
    entries = read(spark, sf_dir, "author_registry").select("person_id", "family", "given", (F.col("kind") == "organisation").alias("org"))
    return name_variants.link_mentions(names, "name", ["rec_id", "pos"], entries)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different personal detail of each document, as written."""
    return pii.details(read(spark, sf_dir, "documents"), "doc_id", "text")


def p10_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with typed placeholders in place of personal details."""
    return pii.masked(read(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p2_found": p2_found, "p2_canonical": p2_canonical, "p3_found": p3_found, "p3_merged": p3_merged, "p4_found": p4_found, "p4_counts": p4_counts, "p5_found": p5_found, "p5_paragraphs": p5_paragraphs, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_spans": p9_spans, "p10_found": p10_found, "p10_masked": p10_masked}
