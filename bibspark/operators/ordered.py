"""Ordered computations within groups of any size: ranks, neighbours, running minima.

A group may hold a third of all rows, so no group is one task. Rows are range-partitioned by group and order; each
part works on its own, and what the parts before it add (one row a group and part) is summed up in a small window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, task_count


def placed(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Rows with ``_p``, the number of their range of (by, order); fixed by a checkpoint."""
    n = parts or max(task_count(df.sparkSession), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(n, *by, *order).withColumn("_p", F.spark_partition_id()))


def _add_before(d: DataFrame, by: list[str], agg, total, out: str, place: str = "_p") -> DataFrame:
    """``out``: ``total`` of ``agg`` over the parts before a row's part of its group, null in the first one."""
    w = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    b = d.groupBy(*by, place).agg(agg.alias("_t")).withColumn(out, total("_t").over(w))
    b = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*by, place])], out)
    cond = F.lit(True)
    for i, k in enumerate([*by, place]):
        cond &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return d.join(b, cond, "left").drop(*[f"_k{i}" for i in range(len(by) + 1)])


def rank(df: DataFrame, by: list[str], order: list[str], out: str, parts: int | None = None) -> DataFrame:
    """Row number from 1 within each group."""
    d = _add_before(placed(df, by, order, parts), by, F.count("*"), F.sum, "_b")
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order)))
    return d.select(*df.columns, (F.col("_r") + F.coalesce("_b", F.lit(0))).cast("long").alias(out))


def earlier_min(d: DataFrame, by: str, order: str, value: str, out: str, place: str = "_p") -> DataFrame:
    """``out``: smallest value among the earlier rows of a row's group, null for the first; ``d`` has its places."""
    w = Window.partitionBy(by, place).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = _add_before(d, [by], F.min(value), F.min, "_b", place)
    return d.withColumn(out, F.least(F.min(value).over(w), F.col("_b"))).drop("_b")


def runs(df: DataFrame, by: list[str], order: list[str], key: str, out: str, parts: int | None = None) -> DataFrame:
    """Number of the run of neighbours of equal key that a row belongs to, from 1 within each group."""
    d = placed(df, by, order, parts)
    own = Window.partitionBy(*by, "_p").orderBy(*order)
    # the last row of the part before, if the group began there
    last = F.max(F.struct(*order, F.col(key).alias("_last")))
    d = _add_before(d, by, last, F.max, "_e")
    before = F.when(F.row_number().over(own) == 1, F.col("_e._last")).otherwise(F.lag(key).over(own))
    d = d.withColumn("_new", F.coalesce((before != F.col(key)).cast("long"), F.lit(1))).drop("_e")
    d = _add_before(d, by, F.sum("_new"), F.sum, "_b")
    d = d.withColumn("_r", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return d.select(*df.columns, (F.col("_r") + F.coalesce("_b", F.lit(0))).cast("long").alias(out))
