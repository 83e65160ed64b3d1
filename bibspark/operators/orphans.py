"""References to records that do not exist, over composite keys with partial nulls.

References are grouped by their null mask. Each mask is compared with the targets on its non-null columns only:
the targets are aggregated once per mask that occurs (one row a key, with what is needed to judge it), and one
equi-join on (mask, masked key) does the anti-join of every mask. ``match`` declares what nulls mean:

* ``simple``: a reference with a null in its key is not checked;
* ``partial``: its non-null columns must equal those of some target;
* ``full``: a key that is null in part is an orphan (``mixed_null``); one that is null throughout is not checked.

A key that many references share is split by adaptive execution, since the reference side of a left outer join
may be split; targets are pre-aggregated before the shuffle. Null keys never equal each other under ``simple``.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def null_mask(keys: list[str]) -> Column:
    """"1" for every null column of the key, in order."""
    return F.concat(*[F.when(F.col(k).isNull(), "1").otherwise("0") for k in keys])


def present_masks(df: DataFrame, keys: list[str]) -> list[str]:
    """Null masks that occur: at most two to the power of the number of columns."""
    return sorted(r[0] for r in df.select(null_mask(keys).alias("m")).distinct().collect())


def reference_status(refs: DataFrame, targets: DataFrame, keys: list[str], *, live: Column, since: str, match: str = "partial", masks: list[str] | None = None) -> DataFrame:
    """References with ``_n`` (targets of the key), ``_live`` (targets that are live), ``_dated`` and ``_from``
    (live targets with a time, and the earliest of these) and ``_checked``.

    ``targets`` has the columns ``keys``; ``live`` is a condition and ``since`` a time column on it.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    every = ["".join(x) for x in product("01", repeat=len(keys))]
    full, none = "0" * len(keys), "1" * len(keys)
    masks = [m for m in (masks if masks is not None else every) if m in every]
    used = [m for m in masks if m == full or match == "partial" and m != none] or [full]
    slim = targets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], live.alias("_is"), F.when(live, F.col(since)).alias("_t"))
    if len(used) > 1:
        slim = slim.withColumn("_mask", F.explode(F.array(*[F.lit(m) for m in used])))
    else:
        slim = slim.withColumn("_mask", F.lit(used[0]))
    for i in range(len(keys)):
        hidden = F.substring("_mask", i + 1, 1) == "1"
        slim = slim.where(hidden | F.col(f"_k{i}").isNotNull()).withColumn(f"_k{i}", F.when(~hidden, F.col(f"_k{i}").cast("string")).otherwise(""))
    by = [f"_k{i}" for i in range(len(keys))]
    status = slim.groupBy("_mask", *by).agg(F.count("*").alias("_n"), F.sum(F.col("_is").cast("long")).alias("_live"), F.count("_t").alias("_dated"), F.min("_t").alias("_from"))
    asked = refs.withColumn("_mask", null_mask(keys))
    for i, k in enumerate(keys):
        asked = asked.withColumn(f"_k{i}", F.coalesce(F.col(k).cast("string"), F.lit("")))
    out = asked.join(status, ["_mask", *by], "left")
    checked = F.lit(True) if match == "partial" else (F.col("_mask") == full) | (F.lit(match == "full") & (F.col("_mask") != none))
    if match == "partial":
        checked = F.col("_mask") != none
    return out.withColumn("_checked", checked).drop(*by)


def orphans(refs: DataFrame, targets: DataFrame, keys: list[str], *, live: Column, since: str, asked_at: str, match: str = "partial", masks: list[str] | None = None) -> DataFrame:
    """References without a valid target, with ``reason``: missing, deleted, late (or mixed_null under ``full``).

    ``late``: there are live targets, and all of them have a time after the reference's ``asked_at``; a null time
    on either side is not late. Columns of ``refs`` are kept; those of ``targets`` do not come along, so clashing
    names do no harm. Empty tables: no targets makes every reference missing; no references gives no rows.
    """
    j = reference_status(refs, targets, keys, live=live, since=since, match=match, masks=masks)
    partly = (F.col("_mask") != "0" * len(keys)) & F.lit(match == "full")
    late = (F.col("_dated") == F.col("_live")) & (F.col("_from") > F.col(asked_at))
    reason = F.when(partly, "mixed_null").when(F.col("_n").isNull(), "missing").when(F.col("_live") == 0, "deleted").when(late, "late")
    return j.withColumn("reason", reason).where(F.col("_checked") & F.col("reason").isNotNull()).select(*refs.columns, "reason")


def orphan_report(found: DataFrame, table: str, period: Column) -> DataFrame:
    """Cases per table, period and reason."""
    return found.groupBy(F.lit(table).alias("table_name"), period.alias("period"), "reason").agg(F.count("*").alias("n_cases"))
