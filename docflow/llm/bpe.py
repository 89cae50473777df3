"""Encoding by a public byte-level BPE tokenizer (problem 8): speculate and verify.

Each new word is first cut greedily into the longest tokens. A sequence of tokens is the tokenizer's own result if and only if
every adjacent pair is what the merges give for the pair's bytes alone; so all distinct adjacent pairs of a batch are checked
at once on arrays that walk down the tokens' merge trees. Only words with a failing pair are merged exactly, byte by byte.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docflow.llm.tables import spread

FOLDER = os.environ.get("DOCFLOW_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: How the tokenizer cuts a text into words. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 400_000  # words kept by a Python worker; beyond it the memory starts anew

NONE = np.int64(1 << 40)


class Vocabulary:
    """Ranks of a vocabulary, which are the ids, with the two parts that were merged into each token."""

    def __init__(self, folder: str = FOLDER, name: str = VOCABULARY):
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {v: k for k, v in self.ids.items()}
        self.longest = max(map(len, self.ids))
        size = max(self.bytes) + 1
        self.left = np.arange(size, dtype=np.int64)  # a single byte is its own part
        self.right = np.arange(size, dtype=np.int64)
        for token in sorted(self.bytes):
            b = self.bytes[token]
            if len(b) > 1:
                parts = self.merged(b, token)
                if len(parts) == 2:
                    self.left[token], self.right[token] = parts
        made = np.flatnonzero(self.left != np.arange(size))
        keys = (self.left[made] << 20) | self.right[made]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], made[order].astype(np.int64)
        self.words = regex.compile(PATTERN)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, b: bytes, below: int = 1 << 40) -> list[int]:
        """Exact merging: the lowest-ranked adjacent pair first, of ranks under ``below``; linked parts, no rescans."""
        import heapq

        ids = [self.ids[b[i : i + 1]] for i in range(len(b))]
        n = len(ids)
        start, end = list(range(n)), list(range(1, n + 1))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                r = self.ids.get(b[start[i] : end[j]])
                if r is not None and r < below:
                    heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, e = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = after[i]
            if j >= n or end[j] != e or self.ids.get(b[start[i] : e]) != r:
                continue
            ids[i], end[i], alive[j] = r, e, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [ids[i] for i in range(n) if alive[i]]

    def greedy(self, b: bytes) -> list[int]:
        """Longest tokens from left to right."""
        out, i, n, ids = [], 0, len(b), self.ids
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                t = ids.get(b[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each pair of tokens gives just these two tokens.

        A merge across the border would join a part on the left's right edge with one on the right's left edge, before
        either was merged further. Walking both edges down from the outermost parts, the later made of the two is
        undone each time; a pair of edge parts that can be merged earlier than both were undone shows a conflict.
        """
        a, b = first.astype(np.int64).copy(), second.astype(np.int64).copy()
        limit = np.full(len(a), NONE)
        ok = np.ones(len(a), dtype=bool)
        active = np.arange(len(a))
        while len(active):
            x, y = a[active], b[active]
            at = np.searchsorted(self.pair_keys, (x << 20) | y)
            at[at == len(self.pair_keys)] = 0
            hit = self.pair_keys[at] == ((x << 20) | y)
            rank = np.where(hit, self.pair_ids[at], NONE)
            clash = rank < limit[active]
            ok[active[clash]] = False
            active, x, y = active[~clash], x[~clash], y[~clash]
            # undo the later of the two edge parts; a tie undoes the right one, for the left one is merged first
            undo_left = x > y
            nx = np.where(undo_left, self.right[x], x)
            ny = np.where(undo_left, y, self.left[y])
            lim = np.where(undo_left, x, y + 1)
            # a single byte can't be undone: the other edge is undone then, if it can be
            stuck = np.where(undo_left, nx == x, ny == y)
            sx = np.where(undo_left, x, self.right[x])
            sy = np.where(undo_left, self.left[y], y)
            slim = np.where(undo_left, y + 1, x)
            both = stuck & np.where(undo_left, sy == y, sx == x)
            nx, ny, lim = np.where(stuck, sx, nx), np.where(stuck, sy, ny), np.where(stuck, slim, lim)
            a[active], b[active], limit[active] = nx, ny, lim
            active = active[~both]
        return ok

    def learn(self, words: list[str]) -> None:
        """Put the tokens of new words into the memory."""
        if len(self.memo) + len(words) > MEMO:
            self.memo.clear()
        if len(self.pairs) > 4 * MEMO:
            self.pairs.clear()
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        tokens = [self.greedy(b) for b in raw]
        flat = np.array([t for ts in tokens for t in ts], dtype=np.int64)
        sizes = np.array([len(ts) for ts in tokens])
        owner = np.repeat(np.arange(len(words)), sizes)
        if len(flat) > 1:
            inner = owner[1:] == owner[:-1]
            keys = ((flat[:-1] << 20) | flat[1:])[inner]
            of = owner[:-1][inner]
            distinct, back = np.unique(keys, return_inverse=True)
            fresh = np.array([k not in self.pairs for k in distinct.tolist()], dtype=bool)
            if fresh.any():
                new = distinct[fresh]
                good = self.compatible(new >> 20, new & ((1 << 20) - 1))
                self.pairs.update(zip(new.tolist(), good.tolist()))
            fine = np.array([self.pairs[k] for k in distinct.tolist()], dtype=bool)[back] if len(distinct) else np.zeros(0, bool)
            for w in np.unique(of[~fine]):
                tokens[w] = self.merged(raw[w])
        for w, ts in zip(words, tokens):
            self.memo[w] = tuple(ts)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text; an empty text has none."""
        cuts = [self.words.findall(t) if t else [] for t in texts]
        new = {w for c in cuts for w in c}.difference(self.memo)
        if new:
            self.learn(sorted(new))
        memo = self.memo
        if len(memo) < len(new):
            raise RuntimeError("memory of words is too small")
        out = []
        for c in cuts:
            ids: list[int] = []
            for w in c:
                got = memo.get(w)
                ids.extend(got if got is not None else self.merged(w.encode("utf-8", "surrogatepass")))
            out.append(ids)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encode(texts)]


@lru_cache(2)
def vocabulary(folder: str = FOLDER, name: str = VOCABULARY) -> Vocabulary:
    """The vocabulary, read once by each Python worker."""
    return Vocabulary(folder, name)


CHUNK = 256  # texts encoded together


def encode_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every row: null and empty texts give an empty list; special tokens' strings are ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(folder, name)
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                ids = v.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.array(np.concatenate([np.array(x, np.int32) for x in ids]) if len(ids) else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "ids"])

    from pyspark.sql import functions as F

    return spread(df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column))).mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(df: DataFrame, text_column: str, *keep: str, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` of every row with n_tokens, the number of its text's tokens (0 for null)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(folder, name)
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                n = v.counts([t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return spread(df.select(text_column, *keep)).mapInArrow(run, schema)
