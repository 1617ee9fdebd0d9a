"""Search: BM25, vectors, rank fusion, reranking.  Queries come in batches.

Every function takes a table of queries (query_id, text or vector) and a corpus,
and returns hits (query_id, rank, id, score).  Ranks break ties by id, on scores
rounded to six places, so float noise can't flip them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions import text as T
from ..staging import new_folder, staged

K1, B = 1.5, 0.75
RRF_K = 60
#: Query vectors that one broadcast holds, about; more go in blocks.
QUERY_BLOCK = 4096
#: (query, term) rows that one broadcast of BM25 weights holds, about; scores of vectors held at once in a task.
TERM_BLOCK = 1_000_000
#: Blocks whose terms are known at once when documents are coded.
CODED_BLOCKS = 16
SCORES = 2_000_000
#: Words of documents that a task codes at a time.
WORDS = 500_000
#: Share of a block's queries from which a term is scored by a matrix product.
OFTEN = 1 / 16
#: (query, document) scores that a task holds at a time: few, so that they stay in the processor's cache.
CELLS = 250_000


def metadata_filter(filters: dict) -> Column:
    """AND of equalities; a list means membership; None never equals a value."""
    out = F.lit(True)
    for name, value in (filters or {}).items():
        c = F.col(name)
        out = out & (c.isin(list(value)) if isinstance(value, list | tuple | set) else F.coalesce(c == value, F.lit(value is None) & c.isNull()))
    return out


def ranked(scored: DataFrame, k: int, id_col: str = "id", by: str = "query_id") -> DataFrame:
    """The k best rows of each query; Spark prunes to k before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_docs, avg_len in terms."""
    return docs.select(F.size(T.terms(text)).alias("n")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_len"))


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, id, tf, len): the inverted index with each document's length."""
    words = docs.select(F.col(id_col).alias("id"), T.terms(text).alias("w")).withColumn("len", F.size("w"))
    return words.select("id", "len", F.explode("w").alias("term")).groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", filters: dict | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Top k by BM25 over the whole corpus; the filters apply to hits, not to the statistics.

    ``scope`` (query_id, id) names the documents that each query may find; a query without any finds none.

    A query term that occurs twice counts twice.  A document is cut into words once:
    those that no query has are dropped, the others' codes and counts are written as
    postings; a scope is joined with these, not with texts.  Scoring is a map over these with the queries' weights as a broadcast; each
    task keeps its own k best per query, so no (query, document) pair is shuffled but
    those.  Queries go in blocks of about ``TERM_BLOCK`` (query, term) rows; postings are
    made once for ``CODED_BLOCKS`` of these, with the terms of all of them.
    """
    spark = queries.sparkSession
    asked = staged(queries.select("query_id", F.explode(T.terms("text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")), "asked")
    # a document's terms go to Python as one text, as no term has a space: millions of short strings cost more than cutting it again
    rows = docs.select(F.col(id_col).alias("id"), F.array_join(T.terms(text), " ").alias("w"), metadata_filter(filters).alias("ok"))
    only = None if scope is None else scope.groupBy("id").agg(F.collect_set("query_id").alias("only"))
    blocks = -(-asked.count() // TERM_BLOCK)
    folder = new_folder(spark, "bm25")
    if blocks <= 1:
        return staged(ranked(_block_scores(asked, *_coded(asked, rows, f"{folder}/postings"), only, k), k).select("query_id", "rank", "id", "score"), "hits")
    rows = rows if blocks <= CODED_BLOCKS else staged(rows, "words")
    only = None if only is None else staged(only, "only")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    for first in range(0, blocks, CODED_BLOCKS):
        coded = _coded(asked.where(block.between(first, first + CODED_BLOCKS - 1)), rows, f"{folder}/postings-{first}")
        for i in range(first, min(blocks, first + CODED_BLOCKS)):
            ranked(_block_scores(asked.where(block == i), *coded, only, k), k).write.mode("append").parquet(f"{folder}/hits")
    return ranked(spark.read.parquet(f"{folder}/hits").drop("rank"), k).select("query_id", "rank", "id", "score")


def _coded(asked: DataFrame, rows: DataFrame, path: str) -> tuple[DataFrame, dict[str, int], np.ndarray, float]:
    """Postings of documents, written: codes and counts of the terms asked for; the terms' codes and idf, and the mean length."""
    spark = rows.sparkSession
    vocabulary = sorted(r.term for r in asked.select("term").distinct().collect())
    shared_terms = spark.sparkContext.broadcast(pa.array(vocabulary, pa.string()))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared_terms.value
        for batch in (part for whole in batches for part in _short(whole, pc.add(pc.count_substring(whole.column("w"), " "), 1))):
            words = _cut(batch.column("w"))
            length = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            code = pc.index_in(words.flatten(), value_set=known)
            doc = np.repeat(np.arange(len(length)), length)
            held = code.is_valid().to_numpy(zero_copy_only=False)
            pair, tf = np.unique(doc[held] * np.int64(len(known)) + code.drop_null().to_numpy(), return_counts=True)
            doc, code = np.divmod(pair, max(1, len(known)))
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(length))))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (code, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(length.astype(np.int32)), batch.column("ok"), *lists], names=["id", "len", "ok", "codes", "tfs"])

    id_type = rows.schema["id"].dataType
    schema = StructType().add("id", id_type).add("len", "integer").add("ok", "boolean").add("codes", ArrayType(IntegerType())).add("tfs", ArrayType(IntegerType()))
    rows.mapInArrow(coded, schema).write.parquet(path)
    index = spark.read.schema(schema).parquet(path)
    totals = index.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len")).first()
    df = np.zeros(len(vocabulary))
    for r in index.select(F.explode("codes").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        df[r.c] = r.df
    return index, {t: i for i, t in enumerate(vocabulary)}, np.log((totals.n - df + 0.5) / (df + 0.5) + 1), float(totals.avg_len)


def _block_scores(asked: DataFrame, index: DataFrame, term_of: dict[str, int], idf: np.ndarray, avg_len: float, only: DataFrame | None, k: int) -> DataFrame:
    """Each task's k best (query_id, id, score) for one block of queries; ``only`` (id, only) lists who may find a document."""
    block = asked.select("query_id", "term", "qtf").collect()
    query_ids = sorted({r.query_id for r in block})
    query_of = {q: i for i, q in enumerate(query_ids)}
    entries = np.array(sorted((term_of[r.term], query_of[r.query_id], r.qtf) for r in block), np.int64).reshape(-1, 3)
    weights = entries[:, 2] * idf[entries[:, 0]]
    starts = np.searchsorted(entries[:, 0], np.arange(len(term_of) + 1))
    shared = index.sparkSession.sparkContext.broadcast((query_ids, starts, entries[:, 1].astype(np.int32), weights, avg_len))
    id_type = index.schema["id"].dataType
    hits = StructType().add("query_id", asked.schema["query_id"].dataType).add("id", id_type).add("score", "double")
    scoped = only is not None

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, starts, to, weights, avg_len = shared.value
        place = {q: i for i, q in enumerate(queries)}
        often = _often(starts, to, weights, len(queries))
        best = _Best(len(queries), k)
        kind = to_arrow_type(hits["query_id"].dataType)

        def rows() -> pa.RecordBatch:
            q, ids, score = best.take()
            return pa.RecordBatch.from_arrays([pa.array([queries[i] for i in q.tolist()], kind), pa.array(ids, to_arrow_type(id_type)), pa.array(score)], names=["query_id", "id", "score"])

        for batch in batches:
            batch = batch.filter(batch.column("ok"))
            at_once = max(1, CELLS // max(1, len(queries)))
            for first in range(0, len(batch), at_once):
                part = batch.slice(first, at_once)
                score = _scores(part, starts, to, weights, avg_len, len(queries), often)
                if scoped:
                    may = np.zeros(score.shape, bool)
                    for i, named in enumerate(part.column("only").to_pylist()):
                        may[[place[q] for q in named if q in place], i] = True
                    score[~may] = 0
                best.add(score, part.column("id").to_numpy(zero_copy_only=False))
                if best.full():
                    yield rows()
        yield rows()

    may_hit = index.where("ok")
    return (may_hit if only is None else may_hit.join(only, "id")).mapInArrow(scored, hits)


def _cut(joined: pa.StringArray) -> pa.ListArray:
    """Lists of words of words joined by spaces; nothing is cut to no word."""
    lists = pc.split_pattern(joined, " ")
    empty = pc.equal(joined, "").to_numpy(zero_copy_only=False)
    if not empty.any():
        return lists
    many = np.where(empty, 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(many))).astype(np.int32), words.filter(pc.not_equal(words, "")))


def _short(batch: pa.RecordBatch, many: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of documents that hold about ``WORDS`` words (``many`` each, or as listed); at least one document each."""
    upto = np.cumsum((pc.list_value_length(batch.column("w")) if many is None else many).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(batch):
        end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + WORDS, "right")))
        yield batch.slice(first, end - first)
        first = end


def _often(starts: np.ndarray, to: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The column of each term that a share ``OFTEN`` of the queries have (-1: of none), and their weights as a matrix, queries by columns."""
    terms = np.flatnonzero(np.diff(starts) > OFTEN * n)
    matrix = np.zeros((n, len(terms)))
    for i, t in enumerate(terms):
        matrix[to[starts[t] : starts[t + 1]], i] = weights[starts[t] : starts[t + 1]]
    column = np.full(len(starts), -1)
    column[terms] = np.arange(len(terms))
    return column, matrix


def _scores(part: pa.RecordBatch, starts: np.ndarray, to: np.ndarray, weights: np.ndarray, avg_len: float, n: int, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The scores of all queries and a few documents, queries by documents; 0 where they share no term."""
    length = part.column("len").to_numpy().astype(np.float64)
    codes, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("codes", "tfs"))
    doc = np.repeat(np.arange(len(length)), pc.list_value_length(part.column("codes")).to_numpy(zero_copy_only=False))
    norm = tf + K1 * (1 - B + B * (length[doc] / avg_len if avg_len else 0.0))
    gain = tf * (K1 + 1) / norm
    column, matrix = often
    met = column[codes] >= 0
    gains = np.zeros((matrix.shape[1], len(length)))
    gains[column[codes[met]], doc[met]] = gain[met]
    score = matrix @ gains
    codes, doc, gain = codes[~met], doc[~met], gain[~met]
    many = (starts[codes + 1] - starts[codes]).astype(np.int64)
    upto = np.cumsum(many)
    first = 0
    while first < len(codes):  # of the other terms about ``CELLS`` entries at a time
        done = upto[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(upto, done + CELLS, "right")))
        n_of = many[first:end]
        entry = np.repeat(starts[codes[first:end]] - (upto[first:end] - n_of - done), n_of) + np.arange(n_of.sum())
        cell = to[entry].astype(np.int64) * len(length) + np.repeat(doc[first:end], n_of)
        score += np.bincount(cell, weights[entry] * np.repeat(gain[first:end], n_of), score.size).reshape(score.shape)
        first = end
    return score


class _Best:
    """The k best scores ``above`` a bound of each query that a task has seen, to six places, ties by id.

    A score below a query's k-th best so far can't enter, nor one below the k-th of those it comes
    with; what may enter is gathered and ranked when there is much of it, so that few are ever sorted.
    """

    def __init__(self, queries: int, k: int, above: float = 0.0):
        self.k, self.above, self.floor = k, above, np.full(queries, above)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.ranked = 0, 0

    def _may(self, score: np.ndarray) -> np.ndarray:
        return score >= np.maximum(self.floor - 1e-6, np.nextafter(self.above, np.inf))[:, None]

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        may = self._may(score)
        if score.shape[1] > self.k and np.count_nonzero(may) * 8 > may.size:
            self.floor = np.maximum(self.floor, np.round(np.partition(score, -self.k, axis=1)[:, -self.k], 6))
            may = self._may(score)
        q, doc = np.divmod(np.flatnonzero(may), max(1, score.shape[1]))
        rounded = np.round(score[q, doc], 6) + 0.0
        may = (rounded > self.above) & (rounded >= self.floor[q])
        if may.any():
            self.rows.append((q[may], ids[doc[may]], rounded[may]))
            self.held += int(may.sum())
        if self.held - self.ranked > max(self.ranked, CELLS):
            self.rank()

    def rank(self) -> None:
        q, ids, score = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, q))
        q, ids, score = q[order], ids[order], score[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)  # from where each row's query begins
        last = nth == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        kept = nth < self.k
        self.rows = [(q[kept], ids[kept], score[kept])]
        self.held = self.ranked = int(kept.sum())

    def full(self) -> bool:
        return self.ranked > SCORES

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is held; the least scores that may enter stay."""
        if self.rows:
            self.rank()
        found = self.rows[0] if self.rows else (np.zeros(0, int), np.zeros(0, object), np.zeros(0))
        self.rows, self.held, self.ranked = [], 0, 0
        return found


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", exclude_self: bool = False, filters: dict | None = None) -> DataFrame:
    """Exact top k by cosine among the vectors that the filters match; ids are of any type.

    A block of query vectors is broadcast; each task multiplies its batches with it
    and keeps its own k best per query, so little more than the result is shuffled.
    Several blocks take turns: the driver holds one, and its hits are written before the next.
    """
    asked = queries.select("query_id", "vector")
    if filters:
        vectors = vectors.where(metadata_filter(filters))
    blocks = -(-asked.count() // QUERY_BLOCK)
    if blocks <= 1:
        return ranked(_best_of_block(asked, vectors, k, id_col, vector, exclude_self)[0], k).select("query_id", "rank", "id", "score")
    spark = queries.sparkSession
    folder = new_folder(spark, "vectors")
    asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.monotonically_increasing_id()), F.lit(blocks))).write.parquet(f"{folder}/queries")
    numbered = spark.read.parquet(f"{folder}/queries")
    for i in range(blocks):
        found, shared = _best_of_block(numbered.where(F.col("block") == i), vectors, k, id_col, vector, exclude_self)
        ranked(found, k).write.mode("append").parquet(f"{folder}/hits")
        shared.destroy()
    return ranked(spark.read.parquet(f"{folder}/hits").drop("rank"), k).select("query_id", "rank", "id", "score")


def _best_of_block(queries: DataFrame, vectors: DataFrame, k: int, id_col: str, vector: str, exclude_self: bool) -> tuple[DataFrame, Broadcast]:
    """Each task's k best (query_id, id, score) for one block of queries, and the broadcast it reads."""
    block = queries.collect()
    matrix = _unit(np.array([r.vector for r in block], np.float64)) if block else np.zeros((0, 1))
    shared = queries.sparkSession.sparkContext.broadcast(([r.query_id for r in block], matrix))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        asked_ids = np.array(ids)
        held = _Best(len(ids), k, -np.inf)

        def rows() -> pd.DataFrame:
            q, own, score = held.take()
            return pd.DataFrame({"query_id": asked_ids[q], "id": own, "score": score})

        for batch in batches:
            if not len(batch) or not ids:
                continue
            at_once = max(1, 2 * CELLS // len(ids))  # a task's vectors and scores, as doubles, beside those of its other process
            for first in range(0, len(batch), at_once):
                part = batch.iloc[first : first + at_once]
                own = part["id"].to_numpy()
                score = matrix @ _unit(np.array(part["v"].tolist(), np.float64)).T
                if exclude_self:
                    score[asked_ids[:, None] == own[None, :]] = -np.inf
                held.add(score, own)
                if held.full():
                    yield rows()
        if held.rows:
            yield rows()

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("v is not null")
    schema = StructType().add("query_id", queries.schema["query_id"].dataType).add("id", rows.schema["id"].dataType).add("score", "double")
    return rows.mapInPandas(best, schema), shared


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def above(hits: DataFrame, least: float = 0.25) -> DataFrame:
    """Hits whose score reaches the threshold: after the top k, never before."""
    return hits.where(F.col("score") >= least)


def fuse(legs: dict[str, DataFrame], k: int = 8, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion; ``ranks`` keeps each leg's rank."""
    both = None
    for name, hits in legs.items():
        leg = hits.select("query_id", "id", "rank", F.lit(name).alias("leg"), F.lit(float((weights or {}).get(name, 1.0))).alias("w"))
        both = leg if both is None else both.unionByName(leg)
    fused = both.groupBy("query_id", "id").agg(
        F.round(F.sum(F.col("w") / (RRF_K + F.col("rank"))), 6).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("leg", "rank")))).alias("ranks")
    )
    return ranked(fused, k)


def normalized(hits: DataFrame) -> DataFrame:
    """Scores over the query's best, to four places."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("score", F.round(F.col("score") / F.when(best != 0, best).otherwise(1.0), 4))


def hybrid(queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, vectors: DataFrame, k: int = 8, candidates: int = 50, filters: dict | None = None) -> DataFrame:
    """BM25 and vectors, 50 candidates each, fused and normalized; the filters hold on either leg, so both tables have their columns."""
    legs = {"bm25": bm25(queries, docs, candidates, filters=filters), "dense": vector_topk(query_vectors, vectors, candidates, filters=filters)}
    return normalized(fuse(legs, k))


def leg_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hits that two legs share, per query."""
    return a.select("query_id", "id").intersect(b.select("query_id", "id")).groupBy("query_id").agg(F.count(F.lit(1)).alias("overlap"))


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's words in a text, and half of its word pairs' share, over 1.5."""

    def score(asked: Column, said: Column) -> Column:
        covered = F.size(F.filter(asked, lambda w: F.array_contains(said, w))) / F.size(asked)
        pairs = F.array_distinct(T.bigrams(asked))
        phrase = F.when(F.size(pairs) > 0, F.size(F.array_intersect(pairs, T.bigrams(said))) / F.size(pairs)).otherwise(0.0)
        return F.when(F.size(asked) > 0, F.bround((covered + 0.5 * phrase) / 1.5, 4))

    return T.let(T.without(T.terms(query), T.RERANK_STOP), lambda asked: T.let(T.without(T.terms(text), T.RERANK_STOP), lambda said: score(asked, said)))


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 8, id_col: str = "doc_id", score=lexical_score) -> DataFrame:
    """Score the candidates anew; a query of stop words alone keeps its order."""
    texts = docs.select(F.col(id_col).alias("id"), F.col("text").alias("doc_text"))
    asked = queries.select("query_id", F.col("text").alias("query_text"))
    rows = hits.join(asked, "query_id").join(texts, "id").withColumn("new", score(F.col("query_text"), F.col("doc_text")))
    rows = rows.select("query_id", "id", F.col("score").alias("retrieval_score"), F.coalesce("new", F.col("score")).alias("score"), F.col("rank").alias("first_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_rank", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first_rank")
