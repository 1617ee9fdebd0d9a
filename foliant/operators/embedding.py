"""Embedding by a provider outside Spark: batches, retries, and a cache that outlives a failure.

A provider maps a list of texts to as many vectors.  Distinct texts that the
cache lacks go to it in batches of exactly ``batch`` (each task's last one aside),
filled across Arrow batches.  A call that raises ``ProviderError`` is made again after a
pause that doubles; another number of vectors than of texts is an error at once.  The
misses are worked off in ``waves``: a wave is appended to the cache before the next begins, so
a job that fails loses one wave, and a rerun asks only for what is missing.

Defined results: null texts have a null vector and are never sent; repeated texts are sent
once; an empty table sends nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged

Provider = Callable[[list[str]], list[list[float]]]
CACHE = "key string, vector array<float>"


class ProviderError(RuntimeError):
    """A call that may succeed when it is made again."""


def cache_key(text: Column, provider: str, model: str, kind: str = "document") -> Column:
    """One key for a text, its provider, model and kind of input."""
    return F.sha2(F.concat_ws("\x01", F.lit(provider), F.lit(model), F.lit(kind), text), 256)


def call(provider: Provider, texts: list[str], retries: int, backoff: float) -> tuple[list[list[float]], int]:
    """The vectors of one batch, and how many calls they took."""
    for attempt in range(1, retries + 1):
        try:
            found = provider(texts)
        except ProviderError:
            if attempt == retries:
                raise
            time.sleep(backoff * 2 ** (attempt - 1))
            continue
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return found, attempt
    raise ValueError("at least one call must be allowed")


def embedded(misses: DataFrame, provider: Provider, batch: int = 64, retries: int = 3, backoff: float = 0.5) -> DataFrame:
    """(key, vector, calls) of rows (key, text); calls are counted at the first row of each batch."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts = [], []

        def sent(n: int) -> pa.RecordBatch:
            vectors, calls = call(provider, texts[:n], retries, backoff)
            made = pa.RecordBatch.from_arrays([pa.array(keys[:n]), pa.array(vectors, pa.list_(pa.float32())), pa.array([calls] + [0] * (n - 1), pa.int32())], names=["key", "vector", "calls"])
            del keys[:n], texts[:n]
            return made

        for rows in batches:
            keys += rows.column("key").to_pylist()
            texts += rows.column("text").to_pylist()
            while len(texts) >= batch:
                yield sent(batch)
        if texts:
            yield sent(len(texts))

    return misses.select("key", "text").mapInArrow(embed, f"{CACHE}, calls int")


def embed_texts(texts: DataFrame, provider: Provider, cache: str, key: Column, batch: int = 64, retries: int = 3, backoff: float = 0.5, waves: int = 8) -> tuple[DataFrame, DataFrame]:
    """``texts`` with key and vector, and one row of hits, misses and provider calls; ``cache`` is a folder of Parquet files."""
    spark = texts.sparkSession
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    read = lambda: spark.read.schema(CACHE).parquet(cache)
    wanted = texts.where("text is not null").select(key.alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    wanted = staged(wanted.join(read().select("key").distinct().withColumn("hit", F.lit(True)), "key", "left"), "wanted")
    missing = wanted.where("hit is null")
    calls = 0
    for wave in range(waves):
        fresh = staged(embedded(missing.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave), provider, batch, retries, backoff), "wave")
        calls += fresh.agg(F.coalesce(F.sum("calls"), F.lit(0))).first()[0]
        fresh.select("key", "vector").write.mode("append").parquet(cache)
    stats = wanted.agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses")).withColumn("calls", F.lit(calls).cast("long"))
    vectors = read().groupBy("key").agg(F.first("vector").alias("vector"))
    return texts.withColumn("key", F.when(F.col("text").isNotNull(), key)).join(vectors, "key", "left"), stats
