"""Attachments: links against the listing, integrity, orphans, targets of renaming, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bib as B


def links(bib: DataFrame) -> DataFrame:
    """(rec_id, lib, pos, path): attachments as the plain parser reads them (";" between, colon-packed)."""
    return bib.where(B.field("file") != "").select("rec_id", "lib", F.posexplode(B.attachments(B.field("file"))).alias("pos", "path")).withColumn("pos", (F.col("pos") + 1).cast("long"))


def listing(files: DataFrame) -> DataFrame:
    """(lib, path, sha256, size_bytes): live files, one row a path; the smallest checksum stands where they differ."""
    return files.where("deleted_ts is null and file_path is not null").groupBy("lib", F.col("file_path").alias("path")).agg(F.min("sha256").alias("sha256"), F.max("size_bytes").alias("size_bytes"))


def filecheck(bib: DataFrame, files: DataFrame) -> DataFrame:
    """(rec_id, pos, path, verdict): keep, repeated_path, missing or repeated_content, in the order of the checks."""
    j = links(bib).join(listing(files).withColumn("there", F.lit(True)), ["lib", "path"], "left")
    path = Window.partitionBy("rec_id", "path").orderBy("pos")
    j = j.withColumn("_p", F.row_number().over(path))
    ok = (F.col("_p") == 1) & F.col("there")
    content = Window.partitionBy("rec_id", "sha256", "_ok").orderBy("pos")
    j = j.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_s", F.row_number().over(content))
    verdict = F.when(F.col("_p") > 1, "repeated_path").when(F.col("there").isNull(), "missing").when(F.col("sha256").isNotNull() & (F.col("_s") > 1), "repeated_content").otherwise("keep")
    return j.select("rec_id", "pos", "path", verdict.alias("verdict"))


def unreferenced(bib: DataFrame, files: DataFrame) -> DataFrame:
    """(lib, path): live files that no record names; hidden files and libraries do not count."""
    name = F.element_at(F.split("path", "/"), -1)
    plain = ~name.startswith(".") & ~F.lower(name).endswith(".bib")
    return listing(files).where(plain).select("lib", "path").join(links(bib).select("lib", "path"), ["lib", "path"], "left_anti")


def status(bib: DataFrame) -> DataFrame:
    """(lib, n_entries, n_files, n_with_file)."""
    n = F.size(B.attachments(B.field("file")))
    return bib.groupBy("lib").agg(F.count("*").alias("n_entries"), F.sum(F.greatest(n, F.lit(0)).cast("long")).alias("n_files"), F.sum((n > 0).cast("long")).alias("n_with_file"))


def sizes(files: DataFrame) -> DataFrame:
    """(lib, n_pdf, bytes): live PDF files of any letter case."""
    return listing(files).where(F.lower("path").endswith(".pdf")).groupBy("lib").agg(F.count("*").alias("n_pdf"), F.sum("size_bytes").cast("long").alias("bytes"))


def rename_targets(bib: DataFrame, files: DataFrame | None = None, folder: str = "files", template: str = "{authorX}_{year}_{title}") -> DataFrame:
    """(rec_id, pos, path, target): one file takes the rendered name, several go to a folder of that name.

    Broken links keep their path, where a listing of ``files`` is given.
    """
    from .keys import file_name

    named = bib.where(B.field("file") != "").select("rec_id", file_name(template).alias("name"))
    l = links(bib).join(named, "rec_id")
    l = l.withColumn("n", F.count("*").over(Window.partitionBy("rec_id")))
    ext = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    base = F.element_at(F.split("path", "/"), -1)
    target = F.when(F.col("n") == 1, F.concat(F.lit(folder + "/"), F.col("name"), ext)).otherwise(F.concat(F.lit(folder + "/"), F.col("name"), F.lit("/"), base))
    if files is None:
        return l.select("rec_id", "pos", "path", target.alias("target"))
    there = listing(files).select(F.col("lib").alias("_l"), F.col("path").alias("_p")).distinct()
    j = l.join(there, (F.col("lib") == F.col("_l")) & (F.col("path") == F.col("_p")), "left")
    return j.select("rec_id", "pos", "path", F.when(F.col("_p").isNull(), F.col("path")).otherwise(target).alias("target"))


def merged(members: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """(group, place, path): attachments of a group in order of its records, each path and each content once.

    Contents are those of the live files of a record's own library; paths without a known content count by themselves.
    """
    from .ordered import rank

    l = members.select(group, "rec_id", "lib", F.posexplode(B.attachments(B.field("file"))).alias("pos", "path"))
    at = F.struct("rec_id", "pos")
    paths = l.groupBy(group, "path").agg(F.min(F.struct(at.alias("at"), "lib")).alias("x")).select(group, "path", F.col("x.at").alias("at"), F.col("x.lib").alias("lib"))
    known = listing(files).select(F.col("lib").alias("_l"), F.col("path").alias("_p"), "sha256")
    j = paths.join(known, (F.col("lib") == F.col("_l")) & (F.col("path") == F.col("_p")), "left")
    what = F.coalesce(F.concat(F.lit("#"), "sha256"), F.concat(F.lit("/"), "path"))
    first = j.groupBy(group, what.alias("what")).agg(F.min(F.struct("at", "path")).alias("y")).select(group, "y.at.rec_id", "y.at.pos", "y.path")
    return rank(first, [group], ["rec_id", "pos"], "place").select(group, "place", "path")
