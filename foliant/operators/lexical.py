"""A stored inverted index for BM25 that follows upserts and deletes.

Layout: a commit writes a segment, a folder with four tables.  ``docs``: id, length, block,
metadata and the document's terms with counts.  ``blocks``: of each term and run of up to
``BLOCK`` documents the greatest count, the least length and the number of documents in them.  Both are
made in tasks, without a shuffle of words.
``gone``: ids whose earlier documents no longer count.  ``deltas``: what the commit
adds to, or takes from, each term's document frequency.  Numbers of documents and of
their terms are in the manifest, so statistics are those of the live documents
after each commit, without a rebuild.  The manifest is renamed into place (``tables``): a commit that
fails leaves the index as it was.

Search: a block's bound for a query is what a document with the block's greatest count and
least length would score, summed over terms.  The blocks of greatest bound are scored first;
the k-th best score found there is what the bounds of all others must reach.  Scoring is a map over
the documents of these blocks, of which each task keeps its k best per query; the hits are those of a search over everything.

Defined results: null and empty texts have no terms and count as documents; of rows with one id in an
upsert the one of greatest content counts; deletes of unknown ids change nothing; null ids are not
indexed; a query without known terms has no hits; ids are of any type that can be ordered.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from .. import tables
from ..functions import text as T
from ..staging import staged
from . import retrieval
from .retrieval import B, K1, metadata_filter, ranked

#: Documents in a block of postings; blocks of a query that are scored first, at least.
BLOCK, FIRST_BLOCKS = 128, 4
#: What bounds may lose to rounding of scores.
SLACK = 1e-6


def _read(spark: SparkSession, now: dict, name: str) -> DataFrame:
    """One table of all segments, with the number of the commit as ``seq``."""
    found = None
    for s in now["segments"]:
        part = spark.read.schema(StructType.fromJson(json.loads(now["schemas"][name]))).parquet(f"{s['folder']}/{name}").withColumn("seq", F.lit(s["seq"]))
        found = part if found is None else found.unionByName(part)
    return found


def _live(spark: SparkSession, now: dict) -> DataFrame:
    """The documents that count, of all segments."""
    docs = _read(spark, now, "docs")
    gone = _read(spark, now, "gone").groupBy("id").agg(F.max("seq").alias("until"))
    return docs.join(gone, "id", "left").where("until is null or seq >= until").drop("until")


def _counted(rows: DataFrame, meta: list[str]) -> DataFrame:
    """Documents (id, w, metadata) with their length and their terms' counts in place of the words."""
    schema = StructType().add("id", rows.schema["id"].dataType).add("len", "integer").add("words", ArrayType(StructType().add("term", "string").add("tf", "integer")))
    for c in meta:
        schema = schema.add(rows.schema[c])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in retrieval._short(whole)):
            length = pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False)
            coded = batch.column("w").flatten().dictionary_encode()
            known = max(1, len(coded.dictionary))
            pair, tf = np.unique(np.repeat(np.arange(len(length)), length) * np.int64(known) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            doc, code = np.divmod(pair, known)
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(length))))).astype(np.int32)
            words = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code)), pa.array(tf.astype(np.int32))], names=["term", "tf"])
            columns = [batch.column("id"), pa.array(length.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), words)]
            yield pa.RecordBatch.from_arrays([*columns, *map(batch.column, meta)], names=["id", "len", "words", *meta])

    return rows.select("id", "w", *meta).mapInArrow(count, schema)


def _blocks(docs: DataFrame) -> DataFrame:
    """(term, block, max_tf, min_len, n) of documents as they were written, the blocks one after the other."""

    def bounds(part: pa.RecordBatch) -> pa.RecordBatch:
        n = pc.list_value_length(part.column("words")).to_numpy(zero_copy_only=False)
        term, tf = part.column("words").flatten().flatten()
        coded, tf = term.dictionary_encode(), tf.to_numpy(zero_copy_only=False)
        numbers, block = np.unique(part.column("block").to_numpy(), return_inverse=True)
        known = max(1, len(coded.dictionary))
        key = np.repeat(block, n) * np.int64(known) + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        key, tf, length = key[order], tf[order], np.repeat(part.column("len").to_numpy(), n)[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
        greatest, least = (np.maximum.reduceat(tf, starts), np.minimum.reduceat(length, starts)) if len(key) else (tf, length)
        columns = [coded.dictionary.take(pa.array(key[starts] % known)), numbers[key[starts] // known], greatest.astype(np.int32), least.astype(np.int32), np.diff(np.append(starts, len(key)))]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["term", "block", "max_tf", "min_len", "n"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            block = held.column("block").to_numpy()
            change = np.flatnonzero(block[1:] != block[:-1])
            if len(change):  # the last block may go on in the next batch
                yield bounds(held.slice(0, change[-1] + 1))
                held = held.slice(change[-1] + 1)
        if held is not None:
            yield bounds(held)

    return docs.select("len", "block", "words").mapInArrow(bounded, "term string, block long, max_tf int, min_len int, n long")


def _write(spark: SparkSession, path: str, now: dict, docs: DataFrame, gone: DataFrame, removed: DataFrame | None, replaces: bool) -> dict:
    """Commit a segment; ``docs`` has id, len, words (term, tf) and metadata, ``removed`` the same of documents that no longer count."""
    seq, folder = now["version"] + 1, f"{path}/segment-{uuid.uuid4().hex}"
    # documents of like length share blocks, so that the bounds are tight
    docs.sortWithinPartitions("len", "id").withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK)).write.parquet(f"{folder}/docs")
    fresh = spark.read.parquet(f"{folder}/docs")
    _blocks(fresh).write.parquet(f"{folder}/blocks")
    gone.select("id").distinct().write.parquet(f"{folder}/gone")
    changes = spark.read.parquet(f"{folder}/blocks").groupBy("term").agg(F.sum("n").alias("df"))
    counts = fresh.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first()
    n, words = counts.n, counts.words
    if removed is not None:
        lost = removed.select(F.explode("words.term").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        changes = changes.unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        counts = removed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first()
        n, words = n - counts.n, words - counts.words
    changes.sortWithinPartitions("term").write.parquet(f"{folder}/deltas")
    schemas = {name: spark.read.parquet(f"{folder}/{name}").schema.json() for name in ("docs", "blocks", "gone", "deltas")}
    before = [] if replaces else now.get("segments", [])
    content = {"segments": [*before, {"folder": folder, "seq": seq}], "n_docs": n if replaces else now.get("n_docs", 0) + n, "n_words": words if replaces else now.get("n_words", 0) + words, "schemas": schemas}
    return tables.commit(spark, path, content, now["version"])


def apply(path: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> dict:
    """Commit changes to the index at ``path``: documents written over those with their ids, and ids deleted; upserts win.

    Columns of ``upserts`` other than id and text are kept as metadata; they must be the same in all commits.
    """
    spark = (upserts if upserts is not None else deletes).sparkSession
    now = tables.manifest(spark, path)
    if upserts is None:
        if not now["version"]:
            raise ValueError("an index begins with documents")
        fresh = _read(spark, now, "docs").where("false").drop("seq", "block")
    else:
        meta = [c for c in upserts.columns if c not in (id_col, text)]
        rows = upserts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), *meta)
        again = staged(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "again")
        if not again.isEmpty():  # only texts with an id that recurs are shuffled
            held = rows.join(again, "id", "left_semi").groupBy("id").agg(F.max(F.struct("text", *meta)).alias("r")).select("id", "r.*")
            rows = rows.join(again, "id", "left_anti").unionByName(held)
        fresh = _counted(rows.select("id", T.terms("text").alias("w"), *meta), meta)
    named = [t.select(F.col(id_col).alias("id")) for t in (upserts, deletes) if t is not None]
    gone = named[0] if len(named) == 1 else named[0].unionByName(named[1])
    gone = staged(gone.where("id is not null").distinct(), "gone")
    removed = staged(_live(spark, now).join(gone, "id", "left_semi").select("id", "len", "words"), "removed") if now["version"] else None
    return _write(spark, path, now, fresh, gone, removed, replaces=False)


def compact(spark: SparkSession, path: str) -> dict:
    """Write the live documents as one segment; texts aren't read again."""
    now = tables.manifest(spark, path)
    live = _live(spark, now).drop("seq", "block")
    return _write(spark, path, now, live, live.select("id").where("false"), None, replaces=True)


def _gain(tf: Column, length: Column, avg_len: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (avg_len or 1.0)))


def _scores(chosen: DataFrame, docs: DataFrame, weights: list, kinds: dict, avg_len: float, k: int) -> DataFrame:
    """Each task's k best (query_id, id, score) of the documents of the chosen (query_id, seq, block)."""
    spark = chosen.sparkSession
    queries, vocabulary = sorted({w.query_id for w in weights}), sorted({w.term for w in weights})
    place, code_of = {q: i for i, q in enumerate(queries)}, {t: i for i, t in enumerate(vocabulary)}
    entries = sorted((code_of[w.term], place[w.query_id], w.w) for w in weights)
    starts = np.searchsorted([e[0] for e in entries], np.arange(len(vocabulary) + 1))
    shared = spark.sparkContext.broadcast((queries, vocabulary, starts, np.array([e[1] for e in entries], np.int32), np.array([e[2] for e in entries], float)))
    schema = StructType().add("query_id", kinds["query_id"]).add("id", kinds["id"]).add("score", "double")
    numbers = spark.createDataFrame(list(place.items()), StructType().add("query_id", kinds["query_id"]).add("q", "integer"))
    picked = chosen.join(F.broadcast(numbers), "query_id").groupBy("seq", "block").agg(F.collect_list("q").alias("only"))
    rows = docs.join(staged(picked, "picked"), ["seq", "block"]).select("id", "len", "only", F.col("words.term").alias("terms"), F.col("words.tf").alias("tfs"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, vocabulary, starts, to, weights = shared.value
        known, best = pa.array(vocabulary, pa.string()), retrieval._Best(len(queries), k)
        often, at_once = retrieval._often(starts, to, weights, len(queries)), max(1, retrieval.CELLS // max(1, len(queries)))

        def found() -> pa.RecordBatch:
            q, ids, score = best.take()
            return pa.RecordBatch.from_arrays([pa.array([queries[i] for i in q.tolist()], to_arrow_type(kinds["query_id"])), pa.array(ids, to_arrow_type(kinds["id"])), pa.array(score)], names=["query_id", "id", "score"])

        for batch in batches:
            for part in (batch.slice(i, at_once) for i in range(0, len(batch), at_once)):
                code = pc.index_in(part.column("terms").flatten(), value_set=known)
                held = code.is_valid()
                doc = np.repeat(np.arange(len(part)), pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False))[held.to_numpy(zero_copy_only=False)]
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(part))))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, x) for x in (code.drop_null(), part.column("tfs").flatten().filter(held))]
                score = retrieval._scores(pa.RecordBatch.from_arrays([part.column("len"), *lists], names=["len", "codes", "tfs"]), starts, to, weights, avg_len, len(queries), often)
                may = np.zeros(score.shape, bool)
                may[part.column("only").flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(part)), pc.list_value_length(part.column("only")).to_numpy(zero_copy_only=False))] = True
                score[~may] = 0
                best.add(score, part.column("id").to_numpy(zero_copy_only=False))
                if best.full():
                    yield found()
        yield found()

    return rows.mapInArrow(scored, schema)


def search(queries: DataFrame, path: str, k: int = 10, filters: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Top k (query_id, rank, id, score), and (query_id, blocks, scored): how many blocks hold a term, and how many were scored.

    The filters apply to hits, not to the statistics.
    """
    spark = queries.sparkSession
    now = tables.manifest(spark, path)
    n, avg_len = now["n_docs"], now["n_words"] / now["n_docs"] if now["n_docs"] else 0.0
    asked = staged(queries.select("query_id", F.explode(T.terms("text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")), "asked")
    known = _read(spark, now, "deltas").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    weights = asked.join(known, "term").select("query_id", "term", (F.col("qtf") * F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("w"))
    weights = staged(weights, "weights")
    parts = max(1, -(-weights.count() // retrieval.TERM_BLOCK))
    made = [_search(now, weights.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else weights, k, filters, avg_len) for i in range(parts)]
    return tuple(reduce(DataFrame.unionByName, tables_) for tables_ in zip(*made, strict=True))


def _search(now: dict, weights: DataFrame, k: int, filters: dict | None, avg_len: float) -> tuple[DataFrame, DataFrame]:
    """The search of queries whose (query_id, term, w) the driver can hold."""
    spark = weights.sparkSession
    heads = _read(spark, now, "blocks").join(weights, "term")  # a block's rows are written by one task, so their sums are few before they are shuffled
    heads = heads.select("query_id", "seq", "block", (F.col("w") * _gain(F.col("max_tf"), F.col("min_len"), avg_len)).alias("bound"))
    bounds = staged(heads.groupBy("query_id", "seq", "block").agg(F.sum("bound").alias("bound")), "bounds")
    docs = (_live(spark, now) if len(now["segments"]) > 1 else _read(spark, now, "docs")).where(metadata_filter(filters))
    kinds, held = {"query_id": weights.schema["query_id"].dataType, "id": docs.schema["id"].dataType}, weights.collect()
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "seq", "block")
    first = staged(bounds.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(FIRST_BLOCKS, -(-2 * k // BLOCK))).select("query_id", "seq", "block"), "first")
    best = staged(ranked(_scores(first, docs, held, kinds, avg_len, k), k), "best")
    least = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(first, ["query_id", "seq", "block"], "left_anti").join(least, "query_id", "left")
    rest = staged(rest.where((F.col("least").isNull()) | (F.col("bound") >= F.col("least") - SLACK)).select("query_id", "seq", "block"), "rest")
    more = _scores(rest, docs, held, kinds, avg_len, k)
    hits = staged(ranked(best.select("query_id", "id", "score").unionByName(more), k).select("query_id", "rank", "id", "score"), "hits")
    scored = first.unionByName(rest).groupBy("query_id").agg(F.count(F.lit(1)).alias("scored"))
    report = bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks")).join(scored, "query_id")
    return hits, report
