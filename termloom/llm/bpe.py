"""Byte-level BPE with a public rank file.

A pre-token's bytes form a doubly linked list. Every adjacent pair with a merge rank waits in the bucket of that
rank; a hierarchical bitmap over the ranks says by find-first-set which bucket comes next. An entry is stale when its left
part was merged away or has another right neighbour by now; it is skipped when taken. A merge costs
the few levels of the bitmap, whatever the length of the pre-token, so a text that is one long run of letters takes time
in proportion to its length.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function that reads them.
TOKENIZERS = "/opt/tokenizers"

# Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RankQueue:
    """Ranks that have waiting entries, as bitmaps of 64 bits a word; a bit of one level stands for a word below."""

    def __init__(self, size: int):
        self.levels: list[list[int]] = []
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            if level[word]:
                level[word] |= bit
                return
            level[word] = bit
            rank = word

    def first(self) -> int:
        """The least rank with entries, -1 for none."""
        at = 0
        for level in reversed(self.levels):
            w = level[at]
            if not w:
                return -1
            at = (at << 6) | ((w & -w).bit_length() - 1)
        return at

    def take(self, rank: int) -> list[int]:
        """Removes and returns the positions waiting at a rank, leftmost first."""
        entries = self.buckets.pop(rank)
        for level in self.levels:
            word = rank >> 6
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                break
            rank = word
        entries.sort()
        return entries


class ByteBPE:
    """Encoder over a rank file: one base64 token and its rank per line."""

    def __init__(self, path: str, pattern: str = PATTERN, cache: int = 200_000, longest_cached: int = 64):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: dict[str, list[int]] = {}
        self.cache, self.longest = cache, longest_cached
        self.token = {rank: token for token, rank in self.ranks.items()}

    def _pair(self, a: int, b: int) -> int:
        """Rank of the merge of two ids, which is the id of its result; -1 for none."""
        got = self.pairs.get((a, b))
        if got is None:
            got = self.ranks.get(self.token[a] + self.token[b], -1)
            if len(self.pairs) < 1_000_000:
                self.pairs[a, b] = got
        return got

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.bytes[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, pair = self.queue, self._pair
        for i in range(n - 1):
            if (r := pair(ids[i], ids[i + 1])) >= 0:
                queue.push(r, i)
        while (rank := queue.first()) >= 0:
            for i in queue.take(rank):
                if ids[i] < 0 or (j := after[i]) >= n or pair(ids[i], ids[j]) != rank:
                    continue  # stale
                ids[i], ids[j] = rank, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (r := pair(rank, ids[k])) >= 0:
                        queue.push(r, i)
                h = before[i]
                if h >= 0 and (r := pair(ids[h], rank)) >= 0:
                    queue.push(r, h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings that look like special tokens are ordinary text."""
        out: list[int] = []
        known = self.known
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= self.longest and len(known) < self.cache:
                    known[piece] = ids
            out += ids
        return out

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.token[i] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> ByteBPE:
    """One encoder per worker process and file."""
    return ByteBPE(path)


def token_ids(text: Column, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """Token ids of a text column as array<int>, without special tokens; null and empty texts give an empty array."""
    path = f"{folder}/{vocabulary}.tiktoken"

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield pd.Series([e.encode(t) if t else [] for t in texts], dtype=object)

    return encode(text)


def token_count(text: Column, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """Number of tokens of a text column; 0 for null and empty texts."""
    path = f"{folder}/{vocabulary}.tiktoken"

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield pd.Series([e.count(t) if t else 0 for t in texts], dtype="int64")

    return count(text)
