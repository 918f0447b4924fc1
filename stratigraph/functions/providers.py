"""Pluggable providers: embeddings and summaries as Arrow-batched functions over a column.

A provider is a plain function from a list of texts to a list of results, built once per worker by a factory; the engine
truncates texts to what providers take, normalises vectors and gives a zero vector for null, empty or failed texts. The defaults
need no network: hashed token counts, and the first sentences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS = 24_000


def hashing_embedder(dim: int) -> Callable[[list[str]], np.ndarray]:
    """Signed hashed counts of words: deterministic, no model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out

    return embed


def first_sentences(n: int = 2) -> Callable[[list[str]], list[str]]:
    """The first ``n`` sentences of each text."""
    return lambda texts: [" ".join(re.split(r"(?<=[.!?])\s+", t.strip())[:n]) for t in texts]


def embed(text: Column, factory: Callable[[], Callable] | None = None, dim: int = 64) -> Column:
    """Unit vectors (array of float) of texts; the factory runs once per worker task."""
    make = factory or (lambda: hashing_embedder(dim))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for s in batches:
            texts = [(t or "")[:MAX_CHARS] for t in s]
            v = np.asarray(f(texts), np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(np.where(norm > 1e-9, v / np.maximum(norm, 1e-9), 0).astype(np.float32)))

    return run(text)


def summarise(text: Column, factory: Callable[[], Callable] | None = None, max_chars: int = 4000) -> Column:
    """Summaries of texts; null and blank texts have none."""
    make = factory or first_sentences

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for s in batches:
            out = f([(t or "")[:max_chars] for t in s])
            yield pd.Series([o if t and t.strip() and o else None for t, o in zip(s, out)])

    return run(text)
