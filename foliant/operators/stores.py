"""Index lifecycle: versions, upserts, deletes, supersession, the embedding cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from .retrieval import metadata_filter


def versions(uploads: DataFrame, key: str = "document_key", digest: str = "sha256", seq: str = "seq") -> DataFrame:
    """Version, is_duplicate and is_new_version of every upload.

    A version is a distinct digest, numbered by first appearance; any digest seen
    before, also an older one, is a duplicate of its version.
    """
    same = Window.partitionBy(key, digest)
    rows = uploads.withColumn("__first", F.min(seq).over(same))
    rows = rows.withColumn("is_duplicate", F.row_number().over(same.orderBy(seq)) > 1)
    rows = rows.withColumn("version", F.dense_rank().over(Window.partitionBy(key).orderBy("__first")).cast("int"))
    return rows.withColumn("is_new_version", ~F.col("is_duplicate") & (F.col("version") > 1)).drop("__first")


def latest_version(uploads: DataFrame, key: str = "document_key", digest: str = "sha256", seq: str = "seq") -> DataFrame:
    return versions(uploads, key, digest, seq).groupBy(key).agg(F.max("version").alias("version"))


def latest(records: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last write of each key: one aggregate, no window."""
    fields = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(seq)).alias("r")).select(key, "r.*")


def upsert(table: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with ``records`` (one per key) written over it."""
    return table.join(records.select(key), key, "left_anti").unionByName(records)


def delete_by_filter(table: DataFrame, filters: dict) -> DataFrame:
    """Rows that the filter does not match; an empty filter deletes nothing."""
    return table.where(~F.coalesce(metadata_filter(filters), F.lit(False))) if filters else table


def supersede(index: DataFrame, fresh: DataFrame, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The index with the fresh sources' old chunks replaced, and (source, superseded_previous)."""
    sources = fresh.select(source).distinct()
    old = index.select(source).distinct().withColumn("__old", F.lit(True))
    flags = sources.join(old, source, "left").select(source, F.coalesce("__old", F.lit(False)).alias("superseded_previous"))
    return index.join(sources, source, "left_anti").unionByName(fresh), flags


def save(table: DataFrame, path: str, vector: str | None = None) -> None:
    """Replace the table at ``path``, also by what was read from there; until the last step the old one stays.

    A collection names its ``vector`` column: the first write records the dimension, later ones must have it.
    """
    tables.save(table, path, vector)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The table that was saved last."""
    return tables.load(spark, path)


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; none if it is missing or null."""
    return table.where(F.col(key) == F.lit(value))


def same_dimension(vectors: DataFrame, dim: int, vector: str = "embedding") -> Column:
    """Whether a vector fits the collection."""
    return F.size(vector) == dim


def cache_misses(texts: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """Distinct (key, text) that the cache does not hold."""
    return texts.select(key.alias("key"), "text").where("text is not null").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def embed_with_cache(texts: DataFrame, cache: DataFrame, key: Column, embed, batch: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts with vectors, the grown cache, and one row of hits, misses and batches.

    Only distinct texts missing from the cache reach ``embed``; vectors are float32
    on either way.
    """
    misses = cache_misses(texts, cache, key)
    fresh = misses.select("key", embed(F.col("text")).cast("array<float>").alias("vector"))
    grown = cache.select("key", F.col("vector").cast("array<float>").alias("vector")).unionByName(fresh)
    wanted = texts.where("text is not null").select(key.alias("key")).distinct()
    stats = wanted.join(cache.select("key").withColumn("hit", F.lit(True)), "key", "left").agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
    stats = stats.withColumn("batches", F.ceil(F.col("misses") / batch))
    return texts.withColumn("key", key).join(grown, "key", "left"), grown, stats
