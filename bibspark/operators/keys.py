"""Citation keys and file names from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bib as B
from ..tables import cut
from .ordered import rank

KEY = "{authorX}{year}"
UNKNOWN = "unknown_{doi_or_id}"


def file_name(template: str, unknown: str = UNKNOWN) -> Column:
    """Rendered template; records without author, year or title take the template for unknown ones."""
    f = B.template_fields()
    lacking = (B.field("author") == "") | (B.field("year") == "") | (B.field("title") == "")
    return F.when(lacking, B.render(unknown, f)).otherwise(B.render(template, f))


def letter(n: Column) -> Column:
    """Suffix of the n-th record of a key: none, b, c, ..., z, then aa, ab, ... (base 26)."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    one = lambda i: F.substr(F.lit(alphabet), (i + 1).cast("int"), F.lit(1))
    k = n - 26
    return F.when(n < 1, "").when(n < 26, one(n)).when(k < 676, F.concat(one(F.floor(k / 26)), one(k % 26))).otherwise(F.concat(F.lit("_"), n.cast("string")))


def cite_keys(df: DataFrame, within: str = "lib", order: str = "rec_id", template: str = KEY) -> DataFrame:
    """(order, base_key, new_key): keys made unique within a library in the order of its records.

    A taken key gets the next free letter; "roe2000b" is the second letter of "roe2000", whoever asks for it. Records
    ask for the letter of their rank; where several ask for one, the earliest keeps it and the others go one further.
    Each round keeps all that is settled, and the earliest record that still moves settles in it.
    """
    d = df.select(within, order, F.lower(B.render(template, B.template_fields())).alias("base_key"))
    lettered = F.col("base_key").rlike("[0-9][b-z]$")
    stem = F.when(lettered, F.expr("left(base_key, length(base_key) - 1)")).otherwise(F.col("base_key"))
    start = F.when(lettered, F.ascii(F.expr("right(base_key, 1)")) - ord("a")).otherwise(0)
    d = rank(d, [within, "base_key"], [order], "nth").select(within, order, "base_key", stem.alias("stem"), (start + F.col("nth") - 1).cast("long").alias("place"))
    mixed = d.where(lettered).select(F.col(within).alias("_w"), F.col("stem").alias("_s")).distinct().withColumn("_mixed", F.lit(True))
    d = cut(d.join(mixed, F.col(within).eqNullSafe(F.col("_w")) & (F.col("stem") == F.col("_s")), "left").drop("_w", "_s"))
    settled, moving = d.where("_mixed is null"), d.where("_mixed")
    while True:
        first = moving.groupBy(within, "stem", "place").agg(F.min(order).alias("_f")).withColumnsRenamed({within: "_w", "stem": "_s", "place": "_p"})
        late = F.col("_f") < F.col(order)
        j = moving.join(first, F.col(within).eqNullSafe(F.col("_w")) & (F.col("stem") == F.col("_s")) & (F.col("place") == F.col("_p")))
        moving = cut(j.select(*moving.columns, late.alias("_late")).withColumn("place", F.col("place") + F.col("_late").cast("long")))
        if moving.where("_late").isEmpty():
            break
        moving = moving.drop("_late")
    every = settled.unionByName(moving.drop("_late"))
    return every.select(order, "base_key", F.concat("stem", letter(F.col("place"))).alias("new_key"))
