"""Copies that differ in form only: recursive radix partitioning on canonical bytes, tries with counters.

1. Every record gets its canonical key (letters and digits, case folded). Each task counts its own keys in a trie
   with terminal counters, so that a group of copies shrinks to one row a task before anything is shuffled.
   A trie is put out after ``FLUSH`` records, so that neither it nor the members of a hot key grow with the task.
2. The rows are split into buckets by key prefix. A bucket above ``BUCKET_ROWS`` is split again by further bytes
   (twice as many as before) until every bucket fits; the prefixes of oversized buckets stay a distributed table that
   is joined back. Rows of one key cannot be split further, but there is one for FLUSH records at most.
3. Rows come to a task bucket by bucket, and each bucket is counted in its own trie, which goes before the next one
   comes; the result goes back to the members by the number of the local row,
   which is unique, so that no group is ever gathered in one task.

Defined results: absent equals empty; records whose fields hold no letter or digit are copies of each other;
repeated rows count as copies where their keys differ; an empty table gives no rows; very long texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut, written

BUCKET_ROWS = 50_000
STRIDE = 16
FLUSH = 100_000
#: so many prefixes of oversized buckets may be broadcast; more are joined by a shuffle
BROADCAST = 50_000


def canonical_letters(c: Column) -> Column:
    """Letters and digits only, case folded."""
    folded = F.replace(F.lower(F.upper(F.coalesce(c, F.lit("")))), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(folded, r"[^\p{L}\p{N}]+", "")


def bare_doi(c: Column) -> Column:
    """Without a label or resolver address before it."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^\s*(?:doi\s*[:=]?\s*)?(?:(?:https?:)?//)?(?:[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z\-]+/+|[a-z0-9\-]+\.[a-z\-]+$)?\s*(?:doi\s*[:=]?\s*)?", "")


class Trie:
    """Path-compressed trie over byte strings, ``STRIDE`` bytes an edge, with a counter at each terminal."""

    def __init__(self, depth: int = 0):
        self.root: dict = {}
        self.depth = depth
        self.size = 0

    def add(self, key: bytes, n: int, first: int, row: int) -> None:
        node, i = self.root, self.depth
        while True:
            chunk = key[i : i + STRIDE]
            i += STRIDE
            at = node.get(chunk)
            if at is None:
                node[chunk] = [key[i:], n, first, [row]]
                self.size += 1
                return
            if isinstance(at, list):
                if at[0] == key[i:]:
                    at[1] += n
                    at[2] = min(at[2], first)
                    at[3].append(row)
                    return
                rest = at[0]
                at[0] = rest[STRIDE:]
                node[chunk] = {rest[:STRIDE]: at}
                at = node[chunk]
            node = at

    def terminals(self) -> Iterator[tuple[bytes, int, int, list[int]]]:
        """(key beyond the depth, count, smallest id, rows)."""
        stack: list[tuple[bytes, dict]] = [(b"", self.root)]
        while stack:
            path, node = stack.pop()
            for chunk, at in node.items():
                if isinstance(at, dict):
                    stack.append((path + chunk, at))
                else:
                    yield path + chunk + at[0], at[1], at[2], at[3]


_LOCAL = "row string, key binary, n long, first long, members array<bigint>"


def _count_locally(batches):
    import uuid

    task, serial, trie = uuid.uuid4().hex[:20], 0, Trie()

    def flush():
        nonlocal serial
        rows = list(trie.terminals())
        ids = [f"{task}{serial + i:x}" for i in range(len(rows))]
        serial += len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
            names=["row", "key", "n", "first", "members"],
        )

    held = 0
    for b in batches:
        for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            trie.add(k, 1, i, i)
            held += 1
            if held == FLUSH:
                yield flush()
                trie, held = Trie(), 0
    yield flush()


def radix_buckets(rows: DataFrame, limit: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` (with a column ``key``) and the bucket of each: its shortest prefix whose bucket fits.

    The prefixes of oversized buckets are a distributed table, joined back to the rows; a bucket that only rows of
    one key fill ends with this key.
    """
    depth = 1
    open_, closed = rows, None
    while True:
        prefix = F.substring("key", 1, depth)
        big = cut(open_.where(F.length("key") >= depth).groupBy(prefix.alias("_p")).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("_p"))
        found = big.count()
        if not found:
            done = open_.withColumn("bucket", prefix)
            return done if closed is None else closed.unionByName(done)
        joined = open_.withColumn("_q", prefix).join(F.broadcast(big) if found <= BROADCAST else big, (F.col("_q") == F.col("_p")) & (F.length("key") >= depth), "left")
        fits = joined.where("_p is null").withColumn("bucket", F.col("_q")).drop("_p", "_q")
        closed = fits if closed is None else closed.unionByName(fits)
        open_ = joined.where("_p is not null").drop("_p", "_q")
        depth *= 2


def _by_bucket(rows: DataFrame) -> DataFrame:
    """Rows of a bucket in one task, one bucket after the other."""
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def _tries(batches, columns: int):
    """(trie, labels) of each bucket of sorted rows (bucket, key, n, first, label ...); one bucket is held at a time."""
    trie, bucket, labels = None, None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(columns))):
            if row[0] != bucket:
                if trie is not None:
                    yield trie, labels
                trie, bucket, labels = Trie(len(row[0])), row[0], []
            trie.add(row[1], row[2], row[3], len(labels))
            labels.append(row[4] if columns > 4 else None)
    if trie is not None:
        yield trie, labels


def _count_buckets(batches):
    for t, ids in _tries(batches, 5):
        out = [(ids[r], first, n) for _, n, first, rows in t.terminals() if n > 1 for r in rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=["row", "first", "copies"])


def form_copies(df: DataFrame, key: str, parts: list[Column], limit: int = BUCKET_ROWS) -> DataFrame:
    """(first, key, copies): the other members of every group of copies, with the group's smallest key and size."""
    text = F.concat_ws("\x1f", *parts)
    local = written(df.select(F.col(key).cast("long").alias("id"), F.encode(text, "UTF-8").alias("key")).mapInArrow(_count_locally, _LOCAL))
    rows = radix_buckets(local.select("row", "key", "n", "first"), limit).select("bucket", "key", "n", "first", "row")
    counted = _by_bucket(rows).mapInArrow(_count_buckets, "row string, first long, copies long")
    members = counted.join(local.select("row", "members"), "row").select("first", "copies", F.explode("members").alias(key))
    return members.where(F.col(key) != F.col("first")).select("first", key, "copies")


def copy_counts(df: DataFrame, key: str, parts: list[Column], limit: int = BUCKET_ROWS) -> DataFrame:
    """(first, copies): one row for each different record, with the number of its copies (itself included)."""
    text = F.concat_ws("\x1f", *parts)
    local = written(df.select(F.col(key).cast("long").alias("id"), F.encode(text, "UTF-8").alias("key")).mapInArrow(_count_locally, _LOCAL).drop("members"))
    rows = _by_bucket(radix_buckets(local.select("key", "n", "first"), limit).select("bucket", "key", "n", "first"))

    def count(batches):
        for t, _ in _tries(batches, 4):
            out = list(t.terminals())
            yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["first", "copies"])

    return rows.mapInArrow(count, "first long, copies long")
