"""Streaming ingest (an extension): records arrive in files and are upserted into a library table.

A ``foreachBatch`` sink keeps, for each (lib, cite_key), existing values first (mode u) or new ones (mode U). Batches
are idempotent: a table version is named by the batch, so a batch that runs again writes the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bib as B

SCHEMA = "lib string, seq bigint, entry_type string, cite_key string, field_map map<string,string>, loaded_ts timestamp"


def upsert(library: DataFrame, batch: DataFrame, mode: str = "u") -> DataFrame:
    """Library after a batch, by (lib, cite_key); rows of one key within the batch count in the order of loaded_ts."""
    key = ["lib", "cite_key"]
    rows = batch.select(*key, F.struct("loaded_ts", "seq").alias("at"), "entry_type", F.explode_outer("field_map").alias("k", "v"))
    pick = F.min if mode == "u" else F.max
    values = rows.groupBy(*key, "k").agg(pick(F.struct("at", "v")).alias("x"), pick(F.struct("at", "entry_type")).alias("t"), F.min("at").alias("first"))
    new = values.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "x.v")))).alias("new_map"), pick("t").alias("t"), F.min("first").alias("a"))
    new = new.select(F.col("lib").alias("_l"), F.col("cite_key").alias("_c"), "new_map", F.col("t.entry_type").alias("new_type"), "a", F.lit(True).alias("_new"))
    # null is a key like any other, so that a library does not pile up records without one
    j = library.withColumn("_old", F.lit(True)).join(new, F.col("lib").eqNullSafe(F.col("_l")) & F.col("cite_key").eqNullSafe(F.col("_c")), "full")
    j = j.withColumn("lib", F.when(F.col("_old"), F.col("lib")).otherwise(F.col("_l"))).withColumn("cite_key", F.when(F.col("_old"), F.col("cite_key")).otherwise(F.col("_c")))
    old, add = F.coalesce("field_map", F.create_map().cast("map<string,string>")), F.coalesce("new_map", F.create_map().cast("map<string,string>"))
    merged = B.update_fields(old, add) if mode == "u" else B.update_fields(add, old)
    kind = F.coalesce("entry_type", "new_type") if mode == "u" else F.coalesce("new_type", "entry_type")
    return j.select("lib", F.coalesce("seq", F.col("a.seq")).alias("seq"), kind.alias("entry_type"), "cite_key", merged.alias("field_map"), F.coalesce("loaded_ts", F.col("a.loaded_ts")).alias("loaded_ts"))


def start(spark: SparkSession, source: str, table: str, checkpoint: str, mode: str = "u", trigger: dict | None = None):
    """Run the ingest: parquet files of SCHEMA in ``source``, versions of the library under ``table``/v=N."""
    hadoop = spark._jvm.org.apache.hadoop.fs

    def latest(before: int) -> str | None:
        at = hadoop.Path(table)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return None
        done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v=") and fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
        done = [n for n in done if n < before]
        return f"{table}/v={max(done)}" if done else None

    def sink(batch: DataFrame, epoch: int) -> None:
        at = latest(epoch)
        library = spark.read.schema(SCHEMA).parquet(at) if at else spark.createDataFrame([], SCHEMA)
        upsert(library, batch, mode).write.mode("overwrite").parquet(f"{table}/v={epoch}")

    stream = spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()


def arrivals(spark: SparkSession, source: str, late: str = "30 days", window: str = "7 days") -> DataFrame:
    """Streaming count of records per library and window of loaded_ts, with a watermark for late ones."""
    s = spark.readStream.schema(SCHEMA).parquet(source)
    return s.withWatermark("loaded_ts", late).groupBy("lib", F.window("loaded_ts", window).alias("w")).agg(F.count("*").alias("n")).select("lib", F.col("w.start").alias("from_ts"), "n")
