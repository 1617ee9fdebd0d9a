"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every match of the split pattern (a pre-token) is encoded on its own.  Its
bytes form a doubly linked list; each adjacent pair that the vocabulary knows
sits in the bucket of its merge rank.  A bitmap of two levels tells which
buckets hold something, so the next rank is two find-first-set steps away
whatever the pre-token's length; an entry whose pair has changed meanwhile is
stale and skipped.  A pre-token of n bytes costs O(n log n), which is what makes
very long pre-tokens (base64, runs of one letter) harmless.

Defined results: null and empty texts have no ids and decode to no bytes; texts
are never cut; repeated rows are encoded alike; only the named column is read,
so other columns may have any names.  Ids that the vocabulary does not hold
decode to nothing, and so does a null id array.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .staging import held_by_worker

#: Pre-tokens that a worker remembers; a cleared cache costs time only.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are rarely met again and are not remembered.
CACHE_CHARS = 48
#: Characters beyond which a text's matches are streamed, not listed.
STREAM_CHARS = 2_000_000


class RankQueue:
    """Positions by merge rank, with a two-level bitmap of the filled ranks.

    A word of the lower level covers 256 ranks; ``top`` has a bit for each word.
    """

    def __init__(self, ranks: int) -> None:
        self.bit = [1 << k for k in range(max(256, (ranks >> 8) + 1))]
        self.low = [0] * ((ranks >> 8) + 1)
        self.buckets: dict[int, list[int]] = {}

    def fill(self, data: bytes, ranks: dict[bytes, int], pair: list[int]) -> int:
        """Enter every adjacent pair of ``data``; returns the upper level."""
        get, buckets, bit, low, top = ranks.get, self.buckets, self.bit, self.low, 0
        for i in range(len(data) - 1):
            rank = get(data[i : i + 2])
            if rank is not None:
                pair[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    low[rank >> 8] |= bit[rank & 255]
                    top |= bit[rank >> 8]
        return top

    def drain(self, data: bytes, ranks: dict[bytes, int], pair: list[int], after: list[int], before: list[int], top: int) -> None:
        """Merge, always the leftmost pair of the lowest rank, until no known pair is left."""
        get, buckets, bit, low, n = ranks.get, self.buckets, self.bit, self.low, len(data)
        push, pop = heapq.heappush, heapq.heappop
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            first = bits & -bits
            rank = (word << 8) + first.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) == 1:
                i = bucket[0]
                del buckets[rank]
                bits ^= first
                low[word] = bits
                if not bits:
                    top ^= bit[word]
            else:
                i = pop(bucket)
            if pair[i] != rank:  # stale: a neighbour's merge has changed this pair
                continue
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = pair[i] = -1
            left = before[i]
            if end < n:
                before[end] = i
                new = get(data[i : after[end]])
                if new is not None:
                    pair[i] = new
                    if new in buckets:
                        push(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        low[new >> 8] |= bit[new & 255]
                        top |= bit[new >> 8]
            if left >= 0:
                new = get(data[left:end])
                if new is None:
                    pair[left] = -1
                else:
                    pair[left] = new
                    if new in buckets:
                        push(buckets[new], left)
                    else:
                        buckets[new] = [left]
                        low[new >> 8] |= bit[new & 255]
                        top |= bit[new >> 8]


class ByteBpe:
    """Encoder and decoder over a rank file's vocabulary."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        size = max(self.ranks.values(), default=0) + 1
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.decimal = [str(i) for i in range(size)]
        self.split = regex.compile(pattern)
        self.queue = RankQueue(size)
        self.cache = _Pieces(self)

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        ranks, queue, n = self.ranks, self.queue, len(data)
        whole = ranks.get(data)
        if whole is not None:
            return (whole,)
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        queue.drain(data, ranks, pair, after, before, queue.fill(data, ranks, pair))
        ids, i = [], 0
        while i < n:
            end = after[i]
            ids.append(ranks[data[i:end]])
            i = end
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        if len(text) <= STREAM_CHARS:
            pieces = self.split.findall(text)
        else:
            pieces = (m.group() for m in self.split.finditer(text))
        return list(chain.from_iterable(map(self.cache.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes_of
        try:
            return b"".join(map(table.__getitem__, ids))
        except KeyError:
            return b"".join(table.get(i, b"") for i in ids)

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and the lowercase hex SHA-256 of the ids joined by spaces and of the decoded bytes."""
        ids = self.encode(text) if text else []
        listed = " ".join(map(self.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


class _Pieces(dict):
    """What a worker remembers of pre-tokens it has met."""

    def __init__(self, bpe: ByteBpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.bpe.piece(piece.encode())
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


def _codec(shared, pattern: str) -> ByteBpe:
    """One codec for each worker process and vocabulary."""
    return held_by_worker(("bpe", hash(shared.value), pattern), lambda: ByteBpe(shared.value, pattern))


class BpeColumns:
    """``encode`` and ``decode`` as column functions over one vocabulary.

    The rank file (about 1 MB, a fixed size) is read by the driver and broadcast.
    """

    def __init__(self, spark: SparkSession, rank_path: str, pattern: str) -> None:
        with open(rank_path, "rb") as f:
            shared = spark.sparkContext.broadcast(f.read())

        @F.pandas_udf("array<int>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = _codec(shared, pattern)
            for texts in batches:
                yield pd.Series([codec.encode(t) if t else [] for t in texts], dtype=object)

        @F.pandas_udf("binary")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = _codec(shared, pattern)
            for rows in batches:
                yield pd.Series([b"" if ids is None else codec.decode(ids.tolist() if hasattr(ids, "tolist") else ids) for ids in rows], dtype=object)

        @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
        def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            codec = _codec(shared, pattern)
            for texts in batches:
                yield pd.DataFrame([codec.digests(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

        self._encode, self._decode, self._digests = encode, decode, digests

    def encode(self, text: Column | str) -> Column:
        """Ids of the whole text, as ``array<int>``; null and empty give []."""
        return self._encode(text)

    def decode(self, ids: Column | str) -> Column:
        """The bytes that ids stand for."""
        return self._decode(ids)

    def digests(self, text: Column | str) -> Column:
        """Struct of the number of ids, SHA-256 of the ids in decimal and of what they decode to; neither leaves the worker."""
        return self._digests(text)
