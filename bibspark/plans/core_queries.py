"""Queries of the general data-quality operators: broken references and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import orphans as O
from ..operators import packed as P
from ..tables import read


def file_references(bib: DataFrame) -> DataFrame:
    """(rec_id, lib, added_ts, file_path): each different resolved path that a record's file field names."""
    fields = P.bib_fields("file")
    refs = P.split_fields(bib.where(F.length(F.col("field_map").getItem("file")) > 0), ["rec_id", "lib", "added_ts"], fields, P.fit(bib, fields), post=P.resolve_path, distinct=True)
    return refs.select("rec_id", "lib", "added_ts", F.col("item").alias("file_path"))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    bib, files = read(spark, sf_dir, "bib_entry"), read(spark, sf_dir, "lib_file")
    masks = [m + "0" for m in O.present_masks(bib, ["lib"])]
    return O.orphans(file_references(bib), files, ["lib", "file_path"], live=F.col("deleted_ts").isNull(), since="added_ts", asked_at="added_ts", match="partial", masks=masks)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path in a file field that is missing, deleted or late in lib_file."""
    return _broken(spark, sf_dir).select("rec_id", "file_path", "reason")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken references per table, month of the record's added_ts, and reason."""
    return O.orphan_report(_broken(spark, sf_dir), "bib_entry", F.date_format("added_ts", "yyyy-MM"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of the file, keywords and author fields that pack two or more."""
    bib, fields = read(spark, sf_dir, "bib_entry"), P.bib_fields("file", "keywords", "author")
    return P.split_fields(bib, ["rec_id"], fields, P.fit(bib, fields), least=2)


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p6_found": p6_found}
SQL: dict[str, str] = {}
