"""Embedders by name (Q7, X5): each is an Arrow function from text to array<float>. The offline one hashes words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def hashing(dim: int = 64) -> Callable[[pd.Series], list[list[float]]]:
    """Signed word hashes, unit length; a text without words is all zero. The same in every process."""
    known: dict[str, tuple[int, float]] = {}

    def place(word: str) -> tuple[int, float]:
        if word not in known:
            if len(known) > 200_000:
                known.clear()
            h = zlib.crc32(word.encode())
            known[word] = (h % dim, 1.0 if h >> 16 & 1 else -1.0)
        return known[word]

    def embed(texts: pd.Series) -> list[list[float] | None]:
        found: list[list[float] | None] = []
        for text in texts:
            if text is None:
                found.append(None)
                continue
            v = np.zeros(dim, dtype=np.float32)
            for w in WORD.findall(text):
                i, s = place(w.lower())
                v[i] += s
            n = float(np.linalg.norm(v))
            found.append((v / n if n else v).tolist())
        return found

    return embed


EMBEDDERS: dict[str, Callable[[int], Callable]] = {"hashing": hashing}


def embedded(text: Column, name: str = "hashing", dim: int = 64) -> Column:
    """array<float> of a text column; null for null. Register others in EMBEDDERS."""
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder: {name}")
    make = EMBEDDERS[name]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make(dim)
        for texts in batches:
            yield pd.Series(embed(texts), dtype=object)

    return run(text)
