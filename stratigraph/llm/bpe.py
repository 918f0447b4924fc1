"""Encoding with a public byte-level BPE vocabulary, exact and in linear time.

The bytes of a piece of text are read as Latin-1, so that pyahocorasick finds in one pass the longest vocabulary entry
that starts at each byte. The encoder then goes forward with longest entries and backtracks: an entry may follow
another one only if the two are compatible, i.e. merging the bytes of both by rank gives back exactly these two. A
sequence whose neighbours are all compatible is the one that the merges produce, so the result equals merge-by-merge
encoding. Compatibility is memoised per pair of entries, positions that turned out to be dead ends are marked, and no
position is tried again, which keeps the work linear in the length whatever the text.

Cases: null and empty texts give an empty list; special tokens' strings are ordinary text; texts are never cut.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pattern that splits text before merging: a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE_CACHE, PAIR_CACHE = 300_000, 2_000_000


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary file: in STRATIGRAPH_TOKENIZERS, else in the installed package of public tokenizers."""
    root = os.environ.get("STRATIGRAPH_TOKENIZERS")
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """One vocabulary of ranks; ``encode`` gives the ids of a text."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.rank.items()}
        self.find = regex.compile(pattern).findall
        self.auto = ahocorasick.Automaton()
        for b in self.rank:
            self.auto.add_word(b.decode("latin-1"), len(b))
        self.auto.make_automaton()
        self.pair: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merges(self, b: bytes) -> list[int]:
        """Merge-by-merge encoding of a few bytes, by definition."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            ranks = [self.rank.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand after ``left`` (-1: at the start)."""
        key = (left + 1) << 20 | right
        ok = self.pair.get(key)
        if ok is None:
            whole = self.bytes_of[right] if left < 0 else self.bytes_of[left] + self.bytes_of[right]
            if len(self.pair) >= PAIR_CACHE:
                self.pair.clear()
            ok = self.pair[key] = self.merges(whole) == ([right] if left < 0 else [left, right])
        return ok

    def next_shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of ``token``; -1 if there is none."""
        t = self.shorter.get(token)
        if t is None:
            b = self.bytes_of[token]
            t = next((self.rank[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.rank), -1)
            self.shorter[token] = t
        return t

    def piece(self, b: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.rank.get(b)
        if whole is not None and self.follows(-1, whole):
            return [whole]
        n = len(b)
        longest = [1] * n
        for end, size in self.auto.iter(b.decode("latin-1")):
            longest[end + 1 - size] = size  # ends ascend, so the longest is written last
        dead = bytearray(n + 1)
        ids: list[int] = []
        pos, token = 0, self.rank[b[: longest[0]]]
        while pos < n:
            while token >= 0:
                end = pos + len(self.bytes_of[token])
                if not dead[end] and self.follows(ids[-1] if ids else -1, token):
                    break
                token = self.next_shorter(token)
            if token >= 0:
                ids.append(token)
                pos = end
                if pos < n:
                    token = self.rank[b[pos : pos + longest[pos]]]
            else:
                dead[pos] = 1
                last = ids.pop()
                pos -= len(self.bytes_of[last])
                token = self.next_shorter(last)
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens."""
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for p in self.find(text):
            ids = cache.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8"))
                if len(p) < 64:
                    if len(cache) >= PIECE_CACHE:
                        cache.clear()
                    cache[p] = ids
            out += ids
        return out


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, built once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def spread(df: DataFrame) -> DataFrame:
    """Rows in at least a partition a core: costly Python work must not wait for a few large files."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, count_only: bool = False) -> DataFrame:
    """id and ``ids`` (list of integers) or, with ``count_only``, ``n_tokens`` of each text."""
    path = path or tokenizer_path()
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            lists = [enc.encode(t) for t in b.column(1).to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int32, len(lists))
            if count_only:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int64))], [id_col, "n_tokens"])
            else:
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))
                offsets = pa.array(np.r_[np.int32(0), np.cumsum(sizes, dtype=np.int32)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], [id_col, "ids"])

    kind = dict(src.dtypes)[id_col]
    return spread(src).mapInArrow(run, f"{id_col} {kind}, " + ("n_tokens bigint" if count_only else "ids array<int>"))
