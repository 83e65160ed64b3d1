"""Encoding with a public byte-level BPE vocabulary.

Text is cut into pieces by the vocabulary's pattern. A piece that is not itself in the vocabulary is merged with a
segment tree over the ranks of its adjacent pairs: the root names the leftmost pair of lowest rank, a merge changes
three leaves, each in logarithmic time, until no pair can be merged. Pieces repeat, so their ids are remembered
in each worker, in a table of bounded size.

Defined results: null and empty text give an empty list; strings of special tokens are ordinary text; very long
pieces cost n log n.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed value: the pattern that cuts text into pieces, as the public vocabulary defines it
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARIES = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
REMEMBERED = 200_000
_NONE = 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after = [*range(1, n), -1]
    before = [-1, *range(n - 1)]
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = ranks.get(piece[i : i + 2], _NONE)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k //= 2
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            m = a if a <= b else b
            if tree[k] == m:
                break
            tree[k] = m
            k //= 2

    while (lowest := tree[1]) < _NONE:
        k = 1
        while k < size:
            k *= 2
            if tree[k] != lowest:
                k += 1
        i = k - size
        j = after[i]
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        put(j, _NONE)
        put(i, ranks.get(parts[i] + parts[after[i]], _NONE) if after[i] >= 0 else _NONE)
        if (h := before[i]) >= 0:
            put(h, ranks.get(parts[h] + parts[i], _NONE))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        self.ranks = load_ranks(path)
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known, add = self.known, out.extend
        for p in self.pieces(text):
            try:
                add(known[p])
            except KeyError:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = merge_piece(p.encode("utf-8", "surrogatepass"), self.ranks)
                if len(p) <= 64:
                    known[p] = ids
                add(ids)
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encode_column(df: DataFrame, key: str, text: str, path: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken", pattern: str = PATTERN) -> DataFrame:
    """(key, ids): token ids of the text of every row; the vocabulary is read in each worker once."""

    def encode(batches):
        enc = _ENCODERS.get((path, pattern)) or _ENCODERS.setdefault((path, pattern), Encoder(path, pattern))
        for b in batches:
            offsets, ids = [0], []
            for t in b.column(1).to_pylist():
                ids += enc.encode(t)
                offsets.append(len(ids))
            flat = pa.array(np.array(ids, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text)).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
