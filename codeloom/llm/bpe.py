"""Problem 6: encoding of a corpus with a public byte-level BPE vocabulary.

Each text is split by the vocabulary's pattern; the pieces are encoded once per Python worker and kept in a bounded
table, since a corpus repeats its words. A piece is merged with a priority queue of merge ranks over a doubly linked
list of symbols: stale queue entries are skipped, so a piece of n bytes costs O(n log n) however long it is.
Null and empty texts have the empty list of ids.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; a parameter of every function that reads them.
TOKENIZERS = os.environ.get("CODELOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits a text before merging, as published with the vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers at most (about 200 bytes each), and the longest that it remembers.
KEPT_PIECES, KEPT_LENGTH = 200_000, 64


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: always the pair of neighbours with the lowest rank is merged, the leftmost first."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    start, end = list(range(n)), list(range(1, n + 1))
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(queue)
    # a symbol is named by its first byte; an entry is stale once either symbol has grown or gone
    alive = [True] * n
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = right[i] if alive[i] else -1
        if j < 0 or end[j] != stop:
            continue
        end[i], right[i], alive[j] = stop, right[j], False
        if right[j] >= 0:
            left[right[j]] = i
            wider = piece[start[i] : end[right[j]]]
            if wider in ranks:
                heapq.heappush(queue, (ranks[wider], i, end[right[j]]))
        if left[i] >= 0:
            wider = piece[start[left[i]] : stop]
            if wider in ranks:
                heapq.heappush(queue, (ranks[wider], left[i], stop))
    return [ranks[piece[start[i] : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """A rank file with the pieces met so far."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        ids = merge(text.encode("utf-8", "replace"), self.ranks)
        if len(text) <= KEPT_LENGTH:
            if len(self.known) >= KEPT_PIECES:
                self.known.clear()
            self.known[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, ids = self.known, []
        for piece in self.pieces.findall(text):
            ids += known.get(piece) or self.piece(piece)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the vocabulary's byte strings one after another."""
        if not hasattr(self, "strings"):
            self.strings = {i: b for b, i in self.ranks.items()}
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(name: str, folder: str) -> Encoder:
    return Encoder(os.path.join(folder, f"{name}.tiktoken"))


def ids_of(text: Column, name: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """array<int> of the ids of a text column; [] for null and empty."""
    folder = folder or TOKENIZERS

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = encoder(name, folder)
        for texts in batches:
            yield pd.Series([tool.encode(t) for t in texts], dtype=object)

    return encode(text)


def count_of(text: Column, name: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """Number of ids of a text column as bigint; 0 for null and empty. Only the number leaves the worker."""
    folder = folder or TOKENIZERS

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = encoder(name, folder)
        for texts in batches:
            yield pd.Series([len(tool.encode(t)) for t in texts], dtype="int64")

    return count(text)


def text_of(ids: Column, name: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """The text of an array of ids; '' for null and empty. Undoes ids_of on every text that is valid Unicode."""
    folder = folder or TOKENIZERS

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = encoder(name, folder)
        for rows in batches:
            yield pd.Series([tool.decode([] if r is None else list(r)) for r in rows], dtype=object)

    return decode(ids)


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as cores for work that is heavy per row; a scan of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
