"""Upkeep of a library: repair of entries, paths, lookups, caches, decisions, snapshots, file moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bib as B

# fixed values: places of a DOI in document metadata, in the order in which they are tried, letter case aside
_DOI = r"(10\.\d{4,9}/[-._;()/:a-z0-9]+)"
METADATA_DOI = (rf"<prism:doi>{_DOI}</prism:doi>", rf"<dc:identifier>doi:{_DOI}</dc:identifier>", rf"<pdfx:doi>{_DOI}</pdfx:doi>", rf"<crossmark:DOI>{_DOI}</crossmark:DOI>")
ACTIONS = ("keep", "delete", "merge", "best")


def metadata_doi(text: Column) -> Column:
    """DOI of a metadata text: the first place that holds one, letter case aside; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")) for p in METADATA_DOI])


def strip_markup(text: Column) -> Column:
    """Text without terminal colours and links."""
    linkless = F.regexp_replace(text, "\x1b\\]8;[^;]*;[^\x1b\x07]*(?:\x1b\\\\|\x07)", "")
    return F.regexp_replace(linkless, "\x1b\\[[0-9;]*m", "")


def normal_path(path: Column) -> Column:
    """Path with ".", ".." and repeated slashes resolved; leading ".." of relative paths stay."""
    absolute = path.startswith("/")

    def add(done: Column, part: Column) -> Column:
        up = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return (
            F.when(part.isin("", "."), done)
            .when((part == "..") & up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when((part == "..") & absolute, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    empty = F.array().cast("array<string>")
    # a guard keeps element_at away from empty arrays
    safe = lambda done, part: F.when(F.size(done) == 0, F.when(part.isin("", ".") | ((part == "..") & absolute), done).otherwise(F.array(part))).otherwise(add(done, part))
    joined = F.array_join(F.aggregate(F.split(path, "/"), empty, safe), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(joined)


def rebase(paths: Column, root: Column) -> Column:
    """Relative paths under a root, made absolute and resolved; absolute ones are resolved only."""
    return F.transform(paths, lambda p: normal_path(F.when(p.startswith("/"), p).otherwise(F.concat(root, F.lit("/"), p))))


def under(child: Column, parent: Column) -> Column:
    """Whether a path is the parent or lies below it."""
    c, p = normal_path(child), normal_path(parent)
    return (c == p) | c.startswith(F.concat(F.regexp_replace(p, "/$", ""), F.lit("/")))


def fix_entries(df: DataFrame, key_template: str | None = None) -> DataFrame:
    """(rec_id, author, doi, cite_key, stopped): names, then DOI, then key; a DOI that cannot be read stops the rest."""
    from .keys import KEY

    doi = B.field("doi")
    parsed = B.parse_doi(F.concat(F.lit("doi:"), doi))
    stopped = (doi != "") & parsed.isNull()
    same = F.lower(parsed) == F.lower(doi)
    key = F.coalesce("cite_key", F.lit(""))
    new_key = F.lower(B.render(key_template or KEY, B.template_fields()))
    return df.select(
        "rec_id",
        F.array_join(B.standard_names(B.field("author")), " and ").alias("author"),
        F.when(doi == "", doi).when(stopped | same, doi).otherwise(parsed).alias("doi"),
        F.when(~stopped & ~B.valid_key(key), new_key).otherwise(key).alias("cite_key"),
        stopped.alias("stopped"),
    )


def lookup(df: DataFrame, order: str = "rec_id") -> DataFrame:
    """(lib, key, order): the last record of each key, letter case aside."""
    k = df.where("cite_key is not null").select("lib", F.lower("cite_key").alias("key"), order)
    return k.groupBy("lib", "key").agg(F.max(order).alias(order))


def merge_cache(memory: DataFrame, disk: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of both caches; what is in memory wins."""
    j = memory.select(key, F.col(value).alias("_m")).join(disk.select(key, F.col(value).alias("_d")), key, "full")
    return j.select(key, F.coalesce("_m", "_d").alias(value))


def first_found(keys: DataFrame, key: str, sources: list[DataFrame], value: str) -> DataFrame:
    """(key, value): from the first source that has the key, in the order of ``sources``; null where none has."""
    out = keys.select(key).distinct()
    for n, s in enumerate(sources):
        out = out.join(s.groupBy(key).agg(F.min(value).alias(f"_{n}")), key, "left")
    return out.select(key, F.coalesce(*[f"_{n}" for n in range(len(sources))]).alias(value))


def decide(groups: DataFrame, decisions: DataFrame, group: str, order: str = "rec_id") -> DataFrame:
    """(group, order, fate): what becomes of each member under the decision on its group (keep, delete, best, merge).

    ``best`` and ``merge`` retain the best record; members of groups without a decision are kept.
    """
    from .identity import best_record

    best = best_record(groups, group, order).select(group, F.col(order).alias("_best"))
    j = groups.join(decisions, group, "left").join(best, group)
    chosen = F.when(F.col(order) == F.col("_best"), F.when(F.col("action") == "merge", "merged").otherwise("kept")).otherwise("dropped")
    return j.select(group, order, F.when(F.col("action").isin("best", "merge"), chosen).when(F.col("action") == "delete", "dropped").otherwise("kept").alias("fate"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(lib, n, fingerprint): content of each library, without regard to order: count, exclusive or and sum of hashes."""
    fields = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("field_map", F.create_map().cast("map<string,string>")))), lambda x: F.concat(x["key"], F.lit("\x1e"), F.coalesce(x["value"], F.lit("")))), "\x1f")
    text = F.concat_ws("\x1d", F.coalesce("entry_type", F.lit("")), F.coalesce("cite_key", F.lit("")), fields)
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return df.groupBy("lib").agg(F.count("*").alias("n"), F.concat_ws("-", F.bit_xor(h).cast("string"), F.sum(h.cast("decimal(20,0)")).cast("string")).alias("fingerprint"))


def snapshot(df: DataFrame, log: DataFrame) -> DataFrame:
    """Rows to append to a log (lib, version_no, fingerprint): libraries whose content differs from their last version."""
    last = log.groupBy("lib").agg(F.max(F.struct("version_no", "fingerprint")).alias("x")).select("lib", F.col("x.version_no").alias("v"), F.col("x.fingerprint").alias("f"))
    j = fingerprint(df).join(last, "lib", "left").where(~F.col("fingerprint").eqNullSafe(F.col("f")))
    return j.select("lib", (F.coalesce("v", F.lit(0)) + 1).alias("version_no"), "fingerprint")


def move_plan(moves: DataFrame, listing: DataFrame) -> DataFrame:
    """(source, target, action) for wanted moves (source, target): same, drop_source (equal content), clash, move, missing."""
    s = listing.select(F.col("path").alias("source"), F.col("sha256").alias("_s"))
    t = listing.select(F.col("path").alias("target"), F.col("sha256").alias("_t"), F.lit(True).alias("_there"))
    j = moves.join(s.withColumn("_here", F.lit(True)), "source", "left").join(t, "target", "left")
    action = F.when(F.col("source") == F.col("target"), "same").when(F.col("_here").isNull(), "missing").when(F.col("_there").isNull(), "move").when(F.col("_s") == F.col("_t"), "drop_source").otherwise("clash")
    return j.select("source", "target", action.alias("action"))
