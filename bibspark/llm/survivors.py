"""Best representative of each duplicate group, field by field.

Every member of a group offers a value per field with a completeness; the order of preference is completeness,
trust, recency, smallest key. The top record of each (group, field) is kept by window ordering. Spark limits each
task to its own best row before the shuffle (a rank filter on a window plans a partial group limit), so a group
that holds a third of all rows sends one row per task and field.

Defined results: null trust and null time rank lowest; a field for which no member has a value gives no row; repeated
members count once; members without a record are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_values(members: DataFrame, group: str, key: str, completeness: dict[str, Column], trust: Column, recency: Column) -> DataFrame:
    """(group, field_name, key): the record whose value survives, for each field with a completeness above zero."""
    offers = F.array(*[F.struct(F.lit(n).alias("field_name"), c.cast("int").alias("complete")) for n, c in completeness.items()])
    rows = (
        members.select(group, key, trust.alias("_trust"), recency.alias("_recent"), F.explode(F.filter(offers, lambda x: x["complete"] > 0)).alias("_o"))
        .select(group, key, "_trust", "_recent", "_o.field_name", "_o.complete")
    )
    order = Window.partitionBy(group, "field_name").orderBy(F.desc("complete"), F.desc_nulls_last("_trust"), F.desc_nulls_last("_recent"), F.asc(key))
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).select(group, "field_name", key)


def merged_records(best: DataFrame, records: DataFrame, group: str, key: str, values: dict[str, Column]) -> DataFrame:
    """One built record a group: each field with the value of its surviving record."""
    picked = best.join(records.select(key, *[c.alias(f"_v_{n}") for n, c in values.items()]), key)
    return picked.groupBy(group).agg(*[F.max(F.when(F.col("field_name") == n, F.col(f"_v_{n}"))).alias(n) for n in values])
