"""Encoding of texts with a public byte-level BPE vocabulary, by a segment tree over byte positions.

A text is split by the vocabulary's pattern. Inside a piece every live byte position holds a token;
leaf i of the tree holds the rank of the pair that position i forms with the next live position
(``NONE`` if that is no merge). The root gives the lowest rank, the descent to the left its leftmost
position. A merge joins two positions: the left one keeps the new token, the right one dies, and the
leaves of the right, the left and its live left neighbour are set, each in logarithmic time. A piece
of n bytes takes O(n log n) however long it is.

Pieces recur, so every worker remembers the ids of short pieces, up to a fixed number of them.

Defined results: null and empty texts give an empty list; blanks are encoded as they are; the
strings of special tokens are ordinary text; equal rows of a key give one row, a key with several
texts one for each. The vocabulary is read on the driver's side and shipped to the executors.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame

VOCABULARY = os.environ.get("TIDEMARK_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 60
REMEMBERED = 300_000
REMEMBERED_BYTES = 64


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.split = regex.compile(pattern).findall
        self.seen: dict[str, list[int]] = {}

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        ranks = self.ranks
        if data in ranks:  # equal to merging it: every vocabulary entry is reached by its own merges
            return [ranks[data]]
        n = len(data)
        size = 1 << (n - 1).bit_length()
        # end[i]: where the token at live position i ends, which is also the next live position.
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = ranks.get(data[i:i + 2], NONE)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, rank: int) -> None:
            k = size + i
            tree[k] = rank
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        while (least := tree[1]) != NONE:
            k = 1
            while k < size:
                k *= 2
                if tree[k] != least:
                    k += 1
            i = k - size
            j = end[i]
            stop = end[i] = end[j]
            put(j, NONE)
            if stop < n:
                before[stop] = i
                put(i, ranks.get(data[i:end[stop]], NONE))
            else:
                put(i, NONE)
            if (h := before[i]) >= 0:
                put(h, ranks.get(data[h:stop], NONE))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i:end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        seen = self.seen
        for p in self.split(text):
            ids = seen.get(p)
            if ids is None:
                data = p.encode("utf-8")
                ids = self.piece(data)
                if len(data) <= REMEMBERED_BYTES:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[p] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids) for the distinct (key, text) rows."""
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    rows = df.select(key, text).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(SparkFiles.get(name))
        for b in batches:
            yield pd.DataFrame({key: b[key], "ids": pd.Series([e.encode(t) for t in b[text]], index=b.index, dtype=object)})

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind}, ids array<int>")
