"""Byte-level BPE encoding and decoding with a public tokenizer's vocabulary.

Merging keeps a priority queue of (merge rank, position) over a doubly linked list of symbols; an entry whose symbols have changed since
it was queued is stale and skipped. Each pre-token is encoded once and remembered in a bounded cache.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizer files, a parameter.
TOKENIZERS = os.environ.get("REPLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of this byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Encodes and decodes with the ranks of one vocabulary file; a token's id is its rank."""

    def __init__(self, path: str, cache: int = 200_000):
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pieces = regex.compile(PATTERN)
        self.memo: dict[str, list[int]] = {}
        self.cache = cache

    def merge(self, data: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        sym = [data[i : i + 1] for i in range(n)]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        nxt[-1] = -1
        get = ranks.get
        queue = [(r, i, data[i : i + 2]) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, joined = heappop(queue)
            left = sym[i]
            if left is None or (j := nxt[i]) < 0 or len(left) + len(sym[j]) != len(joined) or left + sym[j] != joined:
                continue  # stale
            sym[i], sym[j] = joined, None
            nxt[i] = k = nxt[j]
            if k >= 0:
                prv[k] = i
                pair = joined + sym[k]
                if (r := get(pair)) is not None:
                    heappush(queue, (r, i, pair))
            if (p := prv[i]) >= 0:
                pair = sym[p] + joined
                if (r := get(pair)) is not None:
                    heappush(queue, (r, p, pair))
        out, i = [], 0
        while i >= 0:
            out.append(ranks[sym[i]])
            i = nxt[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        memo = self.memo
        for piece in self.pieces.findall(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(memo) >= self.cache:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(self.tokens[int(i)] for i in ids).decode("utf-8", "replace")


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _path(folder: str, name: str) -> str:
    return str(Path(folder) / name)


def ids(text: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """ARRAY<INT> of token ids without special tokens; empty for null and empty texts. Special tokens' strings are ordinary text."""
    path = _path(folder, name)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for batch in batches:
            yield pd.Series([enc.encode(t) for t in batch])

    return run(text)


def n_tokens(text: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """INT number of tokens; 0 for null and empty texts."""
    path = _path(folder, name)

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for batch in batches:
            yield pd.Series([len(enc.encode(t)) for t in batch], dtype="int32")

    return run(text)


def decoded(ids_col: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """STRING of an id list: vocabulary strings concatenated; null stays null."""
    path = _path(folder, name)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for batch in batches:
            yield pd.Series([None if x is None else enc.decode(x) for x in batch])

    return run(ids_col)


def encode_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; repeated rows give repeated rows."""
    return df.select(F.col(id_col).alias("doc_id"), ids(F.col(text_col)).alias("ids"))
