"""Vectors, content hashes and the offline embedding."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def vector_literal(v: Column | str) -> Column:
    """``[x,y,...]`` with eight decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(col(v), lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]"))


def uuid_of(hex_id: Column | str) -> Column:
    """A 32-digit hexadecimal id in UUID form."""
    return F.regexp_replace(col(hex_id), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


@F.pandas_udf(StringType())
def blake2b_128(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else hashlib.blake2b(v.encode(), digest_size=16).hexdigest())


@F.pandas_udf(StringType())
def blake2b_64(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else hashlib.blake2b(v.encode(), digest_size=8).hexdigest())


def chunk_id(source: Column | str, strategy: Column | str, index: Column | str, text: Column | str) -> Column:
    """Deterministic id of a chunk: where it is and what it says."""
    return blake2b_128(F.concat_ws(":", col(source), col(strategy), col(index).cast("string"), blake2b_64(col(text))))


def cache_key(provider: str, model: str, input_type: str, text: Column | str) -> Column:
    return blake2b_128(F.concat(F.lit(f"{provider}:{model}:{input_type}:"), col(text)))


_IN_WORD = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: Characters of texts that are embedded at a time, about; features whose hashes are computed at a time.
CHARACTERS, FEATURES = 1_000_000, 16_384
#: Bytes of a feature that an MD5 block holds, and of most features: fewer bytes are copied for those.
BLOCK, SHORT = 55, 23
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [(np.uint32(n), np.uint32(32 - n)) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in four * 4]


def _md5(words: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of many one-block messages; ``words`` has their first words as rows, the others but the length are 0."""
    a, b, c, d = (np.full(len(bits), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        if g < len(words):
            f += words[g]
        elif g == 14:
            f += bits
        np.left_shift(f, _TURNS[i][0], out=turned)
        f >>= _TURNS[i][1]
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(0x67452301)
    b += np.uint32(0xEFCDAB89)
    return a, b


def _hashes(said: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each run of bytes the first four of its MD5 as a number, and the sixth's last bit beneath; ``said`` ends in ``BLOCK`` bytes more."""
    made = np.empty(len(begin), np.int64)
    for least, most in ((-1, SHORT), (SHORT, BLOCK)):
        windows = np.lib.stride_tricks.sliding_window_view(said, most + 1)
        some = np.flatnonzero((size > least) & (size <= most))
        for first in range(0, len(some), FEATURES):
            part = some[first : first + FEATURES]
            length = size[part]
            held = windows[begin[part]]
            held *= np.arange(most + 1) < length[:, None]
            held[np.arange(len(part)), length] = 0x80
            a, b = _md5(np.ascontiguousarray(held.view("<u4").T), (length * 8).astype(np.uint32))
            made[part] = a.byteswap().astype(np.int64) << 1 | (b >> np.uint32(8) & np.uint32(1))
    for i in np.flatnonzero(size > BLOCK):
        digest = hashlib.md5(said[begin[i] : begin[i] + size[i]].tobytes(), usedforsecurity=False).digest()
        made[i] = int.from_bytes(digest[:4], "big") << 1 | (digest[5] & 1)
    return made


def _embedded(texts: list[str | None], dimension: int) -> np.ndarray:
    """Signed feature hashing of words and word pairs, a row of unit length for each text; zero without words.

    Words are found, and features hashed, in the bytes of all texts at once.
    """
    lower = [(t or "").lower().encode() for t in texts]
    raw = np.frombuffer(b" " + b" ".join(lower) + b" ", np.uint8)
    held = _IN_WORD[raw]
    start = np.flatnonzero(held[1:] & ~held[:-1]) + 1
    length = np.flatnonzero(held[:-1] & ~held[1:]) + 1 - start
    doc = np.searchsorted(1 + np.cumsum([len(t) + 1 for t in lower]), start, "right")
    after = np.concatenate(([False], held[:-1]))
    said = np.concatenate((np.where(held, raw, np.uint8(32))[held | after], np.zeros(BLOCK + 1, np.uint8)))  # words, a space after each
    begin = np.cumsum(length + 1) - (length + 1)
    first = np.flatnonzero(doc[1:] == doc[:-1])
    coded = _hashes(said, np.concatenate((begin, begin[first])), np.concatenate((length, length[first] + 1 + length[first + 1])))
    cell = np.concatenate((doc, doc[first])) * dimension + (coded >> 1) % dimension
    vectors = np.bincount(cell, (coded & 1) * 2.0 - 1.0, len(texts) * dimension).astype(np.float64).reshape(len(texts), dimension)
    norm = np.sqrt(np.square(vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norm, out=vectors, where=norm > 0).astype(np.float32)


def _embed(text: str | None, dimension: int) -> np.ndarray:
    return _embedded([text], dimension)[0]


def _runs(texts: pa.Array) -> Iterator[list[str | None]]:
    """Texts in runs of about ``CHARACTERS``; at least one text each."""
    upto = np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + CHARACTERS, "right")))
        yield texts[first:end].to_pylist()
        first = end


def hash_embedding(text: Column | str, dimension: int = 384) -> Column:
    """The offline embedding of a text, always float32; an Arrow batch's texts are Python's for one run only."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = np.zeros((len(texts), dimension), np.float32)
            first = 0
            for run in _runs(texts):
                made[first : first + len(run)] = _embedded(run, dimension)
                first += len(run)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dimension), pa.array(made.reshape(-1)))

    return embed(col(text))


def model_prompt(text: Column | str, model: str, input_type: str) -> Column:
    """The prefix that a local model family expects before queries and passages."""
    if "e5" in model.lower():
        return F.concat(F.lit("query: " if input_type == "query" else "passage: "), col(text))
    if "bge" in model.lower() and input_type == "query":
        return F.concat(F.lit("Represent this sentence for searching relevant passages: "), col(text))
    return col(text)
