"""Token counts by a map-side lookup in two tiers.

Tier one is a compact table of frequent pre-tokens and their token counts,
packed into a few hundred KB and broadcast.  Tier two is each worker's own cache
for the rest, filled by the tokenizer itself.  Counting is a map over documents:
no pre-token is ever shuffled, and neither tier changes a result; they only
spare calls of the tokenizer.

The frequent table comes from about ``SEED_DOCUMENTS`` documents of a few partitions, tallied
where they lie, and holds at most ``FREQUENT`` pre-tokens: both are fixed bounds on
what one task and the driver hold.  Which documents they are has no influence on any count.

Defined results: null and empty texts have 0 tokens; whole texts are counted,
whatever their length; strings of special tokens inside a text count as the
library's default has it (one token each); repeated rows count alike.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import held_by_worker

SEED_DOCUMENTS, SEED_TASKS = 2000, 64
FREQUENT = 32_768
CACHE_ENTRIES = 400_000
CACHE_CHARS = 48
STREAM_CHARS = 2_000_000


def pack(counts: dict[str, int]) -> dict[str, bytes]:
    """Keys in one blob, their byte lengths and token counts as small arrays."""
    keys = [k.encode() for k in counts]
    return {"blob": b"".join(keys), "sizes": np.array([len(k) for k in keys], np.uint16).tobytes(), "tokens": np.array(list(counts.values()), np.uint16).tobytes()}


def unpack(packed: dict[str, bytes]) -> dict[str, int]:
    ends = np.cumsum(np.frombuffer(packed["sizes"], np.uint16), dtype=np.int64).tolist()
    tokens = np.frombuffer(packed["tokens"], np.uint16).tolist()
    blob, starts = packed["blob"], [0, *ends[:-1]]
    return {blob[a:b].decode(): n for a, b, n in zip(starts, ends, tokens, strict=True)}


class PieceCounter(dict):
    """Token counts by pre-token: the frequent ones fixed, the others cached."""

    def __init__(self, tokenizer, frequent: dict[str, int]) -> None:
        super().__init__(frequent)
        self.frequent, self.tokenizer = frequent, tokenizer

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


class TextCounter:
    """Counts a text as the tokenizer file's library would.

    Files whose pre-tokenizer is the byte-level pattern go through the two tiers;
    any other file goes to the library with whole texts.
    """

    def __init__(self, spec: str, pattern: str, frequent: dict[str, int]) -> None:
        from tokenizers import Tokenizer

        config = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre = config.get("pre_tokenizer") or {}
        added = [t for t in config.get("added_tokens", [])]
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not config.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        specials = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.split = regex.compile(pattern)
        self.pieces = PieceCounter(self.tokenizer, frequent)

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of these there are."""
        if self.special is None or not self.special.search(text):
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1

    def matches(self, text: str):
        if len(text) <= STREAM_CHARS:
            return self.split.findall(text)
        return (m.group() for m in self.split.finditer(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.by_piece:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts, n = self.parts(text)
        for part in parts:
            n += sum(map(self.pieces.__getitem__, self.matches(part)))
        return n


def _counter(spec, pattern: str, packed) -> TextCounter:
    key = ("tokens", hash(spec.value), pattern, hash(packed.value["blob"]))
    return held_by_worker(key, lambda: TextCounter(spec.value, pattern, unpack(packed.value)))


def frequent_table(docs: DataFrame, spec, pattern: str, text: str = "text") -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of about ``SEED_DOCUMENTS`` documents.

    ``SEED_TASKS`` partitions, evenly spaced, are all that is read for it: each tallies its first
    documents; packed tallies, no texts and no pre-token rows, come to the driver.
    """
    rows, spark = docs.select(F.col(text)).rdd, docs.sparkSession
    n = rows.getNumPartitions()
    chosen = sorted({i * n // SEED_TASKS for i in range(min(n, SEED_TASKS))}) if n > SEED_TASKS else list(range(n))
    per_task = -(-SEED_DOCUMENTS // max(1, len(chosen)))

    def tally(part: Iterator) -> Iterator[tuple[dict, bytes]]:
        counter, seen = TextCounter(spec.value, pattern, {}), Counter()
        for (t,) in islice(part, per_task):
            for piece in counter.parts(t or "")[0]:
                seen.update(p for p in counter.matches(piece) if len(p) <= CACHE_CHARS)
            if len(seen) > 16 * FREQUENT:  # the rare ones go, so that a worker's memory is bounded
                seen = Counter(dict(seen.most_common(4 * FREQUENT)))
        if seen:
            top = seen.most_common(FREQUENT)
            yield pack({p: min(counter.pieces[p], 65_535) for p, _ in top}), np.array([k for _, k in top], np.uint32).tobytes()

    met, tokens = Counter(), {}
    for packed, times in spark.sparkContext.runJob(rows, tally, chosen):
        found = unpack(packed)
        tokens |= found
        met.update(dict(zip(found, np.frombuffer(times, np.uint32).tolist(), strict=True)))
    return {p: tokens[p] for p, _ in met.most_common(FREQUENT)}


def token_count(docs: DataFrame, tokenizer_path: str, pattern: str, text: str = "text") -> Column:
    """A column with the number of tokens of ``text``; ``docs`` seeds the frequent tier."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    packed = spark.sparkContext.broadcast(pack(frequent_table(docs, spec, pattern, text)))

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(spec, pattern, packed)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return count(F.col(text))
