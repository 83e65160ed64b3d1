"""Session and table helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "bibspark", cores: int | str = "*") -> SparkSession:
    """A local session with the settings the library is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); on one machine a temporary one is set where it is unset."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="bibspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", at)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that the loss of an executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def field(name: str, default: str | None = "") -> "F.Column":
    """Value of an open field; absent fields give the default."""
    c = F.col("field_map").getItem(name)
    return c if default is None else F.coalesce(c, F.lit(default))


def task_count(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def local_path(*parts: str) -> str:
    return os.path.join(os.path.dirname(os.path.abspath(__file__)), *parts)


_WRITTEN: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """The rows as a parquet table in the shared folder; removed when the driver ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/bibspark-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN.append((spark, at))
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _remove_written() -> None:
    for spark, at in _WRITTEN:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            return
