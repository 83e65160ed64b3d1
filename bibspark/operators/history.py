"""Append-only version history: cursor, undo, redo, restore, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def versions(log: DataFrame) -> DataFrame:
    """Different versions of each library; rows that were loaded repeatedly count once, the earliest ts holds."""
    return log.where("lib is not null and version_no is not null").groupBy("lib", "version_no").agg(F.min("kind").alias("kind"), F.max("restores").alias("restores"), F.min("ts").alias("ts"))


def cursors(log: DataFrame) -> DataFrame:
    """(lib, head, cursor): last version, and the version whose content is current."""
    last = versions(log).groupBy("lib").agg(F.max(F.struct("version_no", "restores")).alias("h"))
    return last.select("lib", F.col("h.version_no").alias("head"), F.coalesce("h.restores", "h.version_no").alias("cursor"))


def undo_redo(log: DataFrame, n: int = 1) -> DataFrame:
    """(lib, head, cursor, undo_to, redo_to): targets n steps back and forth; null where there is none.

    Back goes along all versions before the cursor; forth along those after it that are no restores.
    """
    v, c = versions(log).select("lib", "version_no", "restores"), cursors(log)
    j = v.join(c, "lib")
    back = j.where("version_no < cursor").withColumn("r", F.row_number().over(Window.partitionBy("lib").orderBy(F.desc("version_no")))).where(F.col("r") == n).select("lib", F.col("version_no").alias("undo_to"))
    forth = j.where("version_no > cursor and restores is null").withColumn("r", F.row_number().over(Window.partitionBy("lib").orderBy("version_no"))).where(F.col("r") == n).select("lib", F.col("version_no").alias("redo_to"))
    return c.join(back, "lib", "left").join(forth, "lib", "left")


def restore(log: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows to append so that each library of ``targets`` (lib, version_no) shows that version again."""
    c = cursors(log)
    known = versions(log).select("lib", "version_no")
    return targets.join(known, ["lib", "version_no"], "left_semi").join(c, "lib").select("lib", (F.col("head") + 1).alias("version_no"), F.lit("restore").alias("kind"), F.col("version_no").alias("restores"))


def library_history(log: DataFrame) -> DataFrame:
    """(lib, n_versions, n_restores, last_ts)."""
    v = versions(log)
    return v.groupBy("lib").agg(F.count("*").alias("n_versions"), F.sum((F.col("kind") == "restore").cast("long")).alias("n_restores"), F.max("ts").alias("last_ts"))


def beyond(log: DataFrame, keep: int) -> DataFrame:
    """(lib, version_no): versions that go when each library keeps its newest ``keep``; the current content's version stays."""
    v = versions(log).select("lib", "version_no")
    oldest = v.withColumn("r", F.row_number().over(Window.partitionBy("lib").orderBy(F.desc("version_no")))).where(F.col("r") == keep).select("lib", F.col("version_no").alias("kept"))
    return v.join(oldest, "lib").join(cursors(log), "lib").where((F.col("version_no") < F.col("kept")) & (F.col("version_no") != F.col("cursor"))).select("lib", "version_no")
