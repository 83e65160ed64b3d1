"""BibTeX as a source and sink: tokenizer, ``spark.read.format("bibtex")``, serialisation, directory scans."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "lib string, seq bigint, entry_type string, cite_key string, field_map map<string,string>"
_ENTRY = re.compile(r"@\s*([A-Za-z]+)\s*([({])")
_NAME = re.compile(r"\s*([A-Za-z][\w\-:.+/]*)\s*=\s*")
# fixed values: month macros
_MONTHS = {m: m for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()}


def _value(text: str, i: int, macros: dict[str, str]) -> tuple[str, int]:
    """One value (parts joined by #) and where it ends: braced, quoted, bare."""
    parts = []
    while True:
        while i < len(text) and text[i].isspace():
            i += 1
        if i >= len(text):
            break
        if text[i] == "{":
            depth, j = 0, i
            while j < len(text):
                if text[j] == "\\":
                    j += 1
                elif text[j] == "{":
                    depth += 1
                elif text[j] == "}":
                    depth -= 1
                    if not depth:
                        break
                j += 1
            parts.append(text[i + 1 : j])
            i = j + 1
        elif text[i] == '"':
            depth, j = 0, i + 1
            while j < len(text) and (text[j] != '"' or depth):
                if text[j] == "\\":
                    j += 1
                else:
                    depth += (text[j] == "{") - (text[j] == "}")
                j += 1
            parts.append(text[i + 1 : j])
            i = j + 1
        else:
            m = re.compile(r"[^\s,#})]+").match(text, i)
            if not m:
                break
            parts.append(macros.get(m[0].lower(), m[0]))
            i = m.end()
        while i < len(text) and text[i].isspace():
            i += 1
        if i < len(text) and text[i] == "#":
            i += 1
            continue
        break
    return "".join(parts), i


def parse(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(entry type, key, fields) of each entry; blank text has none; comments and preambles are left out.

    The first of repeated fields counts; field names are in lower case; a damaged entry ends at the next one.
    """
    macros, i = dict(_MONTHS), 0
    while m := _ENTRY.search(text, i):
        kind, i = m[1].lower(), m.end()
        if kind == "comment":
            continue
        if kind == "preamble":
            _, i = _value(text, i, macros)
            continue
        key = ""
        if kind != "string":
            k = re.compile(r"\s*([^,\s})]*)\s*,?").match(text, i)
            key, i = k[1], k.end()
        fields: dict[str, str] = {}
        while n := _NAME.match(text, i):
            value, i = _value(text, n.end(), macros)
            fields.setdefault(n[1].lower(), value)
            c = re.compile(r"\s*,").match(text, i)
            if c:
                i = c.end()
        if kind == "string":
            macros |= {k: v for k, v in fields.items()}
        else:
            yield kind, key, fields


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """For local and mounted folders; ``read_bibtex`` reads any file system."""

    def __init__(self, options):
        self.path = options["path"]
        if "://" in self.path and not self.path.startswith("file://"):
            raise ValueError("the bibtex format reads local or mounted folders; use read_bibtex for other file systems")

    def partitions(self):
        import glob
        import os

        at = self.path.removeprefix("file://")
        files = sorted(glob.glob(os.path.join(at, "**/*.bib"), recursive=True)) if os.path.isdir(at) else sorted(glob.glob(at))
        return [_File(f) for f in files]

    def read(self, partition):
        import os

        with open(partition.path, encoding="utf-8", errors="replace") as f:
            text = f.read()
        lib = os.path.splitext(os.path.basename(partition.path))[0].lstrip(".")
        for n, (kind, key, fields) in enumerate(parse(text), 1):
            yield lib, n, kind, key, fields


class BibTeXSource(DataSource):
    """``spark.dataSource.register(BibTeXSource)``, then ``spark.read.format("bibtex").load(path)``: one task a file."""

    @classmethod
    def name(cls):
        return "bibtex"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Libraries of a path on any file system, one row an entry, by whole-text files."""
    import pyarrow as pa

    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[bB][iI][bB]").select("value", F.col("_metadata.file_name").alias("file"))

    def rows(batches):
        for b in batches:
            out = [(f.rsplit(".", 1)[0].lstrip("."), n, k, c, list(v.items())) for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, (k, c, v) in enumerate(parse(t or ""), 1)]
            cols = list(zip(*out)) or [[]] * 5
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["lib", "seq", "entry_type", "cite_key", "field_map"])

    return files.mapInArrow(rows, SCHEMA)


def entry_text() -> Column:
    """One entry as BibTeX: fields by name, one blank of indent."""
    fields = F.transform(F.array_sort(F.map_entries("field_map")), lambda x: F.concat(F.lit(" "), x["key"], F.lit(" = {"), x["value"], F.lit("}")))
    head = F.concat(F.lit("@"), F.coalesce("entry_type", F.lit("misc")), F.lit("{"), F.coalesce("cite_key", F.lit("unknown")))
    return F.concat(head, F.when(F.size(fields) > 0, F.concat(F.lit(",\n"), F.array_join(fields, ",\n"))).otherwise(""), F.lit("\n}\n"))


def write_bibtex(df: DataFrame, path: str) -> None:
    """Libraries as text, one folder a library, entries by key."""
    df.select(F.coalesce("lib", F.lit("unnamed")).alias("lib"), F.coalesce("cite_key", F.lit("")).alias("k"), entry_text().alias("value")).repartition("lib").sortWithinPartitions("lib", "k").select("lib", "value").write.partitionBy("lib").mode("overwrite").text(path)


def scan_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, folder, name, length, kind): PDF and BibTeX files below a folder; hidden and "_" folders are skipped.

    ``bundle`` marks the files of a folder that has a hidden library of its own name (on local or mounted file systems).
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    parts = F.split("path", "/")
    f = f.withColumns({"name": F.element_at(parts, -1), "folder": F.regexp_replace("path", "/[^/]*$", "")})
    root = path.rstrip("/").removeprefix("file:")
    inside = F.regexp_replace(F.col("folder"), "^.*?" + re.escape(root), "")
    f = f.where(~inside.rlike(r"/[._]"))
    kind = F.when(F.lower("name").endswith(".pdf"), "pdf").when(F.lower("name").endswith(".bib"), "bib").otherwise("other")

    def hidden(batches):  # Spark's listing leaves hidden files out; the folders' own libraries are looked for one by one
        import os

        import pyarrow as pa

        for b in batches:
            at = b.column(0).to_pylist()
            yes = [x for x in at if os.path.exists(os.path.join(p := x.removeprefix("file:"), f".{os.path.basename(p)}.bib"))]
            yield pa.RecordBatch.from_arrays([pa.array(yes, pa.string()), pa.array([True] * len(yes), pa.bool_())], names=["folder", "bundle"])

    bundles = f.select("folder").distinct().mapInArrow(hidden, "folder string, bundle boolean")
    return f.withColumn("kind", kind).join(bundles, "folder", "left").withColumn("bundle", F.coalesce("bundle", F.lit(False)))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files below a folder of any file system."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"))


def bibtex_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(url, link): addresses of BibTeX files on pages, made absolute."""
    hrefs = F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']+\.bib)["']"""), 1))
    x = pages.select(F.col(url).alias("url"), hrefs.alias("h"))
    site, folder = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1), F.regexp_replace("url", r"[^/]*$", "")
    link = F.when(F.col("h").rlike("^[a-z]+://"), F.col("h")).when(F.col("h").startswith("/"), F.concat(site, F.col("h"))).otherwise(F.concat(folder, F.col("h")))
    return x.select("url", link.alias("link"))
