"""Composite plans: ingest, index, search with the graph, and answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions import text as T
from ..functions.vectors import hash_embedding
from ..operators import answers as A
from ..operators import chunking, cleaning, evaluation, graph, recognition, retrieval, stores
from ..sources import files as scan
from ..staging import staged


def clean_and_chunk(elements: DataFrame, strategy: str = "semantic") -> tuple[DataFrame, DataFrame]:
    """Chunks of cleaned elements, and the cleaning counters."""
    kept, stats = cleaning.clean(elements)
    if strategy == "semantic":
        return chunking.chunks(kept, strategy), stats
    ordered = F.array_sort(F.collect_list(F.struct("elem_idx", "text")))
    docs = kept.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda e: e["text"]), "\n\n").alias("text"))
    return chunking.chunks(docs, strategy), stats


def embed_chunks(chunks: DataFrame, embed=hash_embedding) -> DataFrame:
    """Chunks with vectors; equal texts are embedded once."""
    texts = chunks.select("text").distinct().withColumn("vector", embed(F.col("text")))
    return chunks.join(texts, "text")


def valid_only(chunks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of documents that pass validation, and the report of all."""
    report = chunking.validate(chunks, docs)
    return chunks.join(report.where("ok").select("doc_id"), "doc_id", "left_semi"), report


def build_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a corpus, documents among them; texts are searched for entities once, and those of two names are kept for relations."""
    lists = staged(graph.entity_lists(docs), "mentions")
    mentions, several = graph.listed_mentions(lists), lists.where("text is not null").select(F.col("source").alias("doc_id"), "text")
    documents, mentioned = graph.document_edges(mentions)
    columns = ["key", "name", "type", "source", "mentions"]
    edge = ["source_key", "target_key", "type", "evidence", "source_document"]
    return graph.entities(mentions).select(columns).unionByName(documents.select(columns)), graph.relations(several, mentions).select(edge).unionByName(mentioned.select(edge))


def graph_search(queries: DataFrame, docs: DataFrame, vertices: DataFrame, edges: DataFrame, k: int = 8, candidates: int = 30, depth: int = 2, embed=hash_embedding) -> DataFrame:
    """Vector search fused with BM25 over the documents that the graph implicates for each query."""
    asked = queries.select("query_id", embed(F.col("text")).alias("vector"))
    first = retrieval.vector_topk(asked, docs.select("doc_id", embed(F.col("text")).alias("embedding")), candidates, id_col="doc_id")
    seeds = staged(graph.query_seeds(queries, vertices), "seeds")
    scope, related = graph.graph_scope(seeds, vertices, edges, depth)
    scope = staged(scope, "scope")
    names = related.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("more"))
    richer = queries.join(names, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "more").alias("text"))
    second = retrieval.bm25(richer, docs, candidates, scope=scope.withColumnRenamed("source", "id"))
    return retrieval.normalized(retrieval.fuse({"vector": first, "graph": second}, k))


def index_documents(elements: DataFrame, index: DataFrame, embed=hash_embedding, strategy: str = "semantic") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean, chunk, validate, embed and supersede: the new index, the validation report, (doc_id, superseded_previous).

    Only documents that pass validation reach the index; each replaces its former chunks.
    """
    made, _ = clean_and_chunk(elements, strategy)
    ordered = F.array_sort(F.collect_list(F.struct("elem_idx", "text")))
    docs = elements.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda e: e["text"]), "\n\n").alias("text"))
    good, report = valid_only(made, docs)
    fresh = embed_chunks(good, embed).select(*index.columns)
    grown, flags = stores.supersede(index, fresh, "doc_id")
    return grown, report, flags


def prompts(questions: DataFrame, hits: DataFrame, template: str = A.ANSWER_PROMPT) -> DataFrame:
    """(query_id, prompt): the template with each question's hits (rank, source, text)."""
    located = hits.withColumns({"heading_path": F.array().cast("array<string>"), "pages": F.array().cast("array<int>")})
    rows = questions.join(A.context(located), "query_id", "left")
    return rows.select("query_id", A.render(template, context=F.col("context"), graph_context=F.lit(""), question=F.col("text")).alias("prompt"))


def ask(questions: DataFrame, docs: DataFrame, k: int = 6, model=None) -> DataFrame:
    """Screened, routed, retrieved, answered and checked questions (query_id, text).

    ``model`` maps a prompt column to an answer column; without it answers are extracts.
    """
    screened = A.screen_input(questions)
    open_ = screened.where("verdict.allowed").select("query_id", "text")
    # written once: it is read six times, and a filter on its texts would be pushed below the join, onto all documents
    hits = staged(retrieval.bm25(open_, docs, k).join(docs.select(F.col("doc_id").alias("id"), F.col("text"), F.col("source")), "id"), "hits")
    answered = A.extractive_answers(open_, hits) if model is None else prompts(open_, hits).select("query_id", model(F.col("prompt")).alias("answer"))
    out = A.screen_output(answered, hits).withColumnRenamed("score", "faithfulness")
    rows = screened.join(out, "query_id", "left")
    agent = F.when(F.col("verdict.allowed"), A.route("text")).otherwise("guardrail")
    tokens = T.token_count(F.coalesce("masked", F.lit("")))
    return rows.select("query_id", agent.alias("agent_id"), F.col("verdict.score").alias("injection_score"), "masked", "faithfulness", "trustworthy", T.token_count("text").alias("prompt_tokens"), tokens.alias("completion_tokens"))


def evaluate_retrieval(hits: DataFrame, relevant: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Metrics of each query, and their means."""
    cases = evaluation.retrieval_metrics(hits, relevant, k)
    return cases, evaluation.mean_report(cases)


def evaluate_answers(cases: DataFrame, answered: DataFrame, hits: DataFrame) -> DataFrame:
    """One row of means; ``cases`` has query_id and expected_keywords, ``answered`` query_id and answer."""
    grounded = A.groundedness(answered, hits).select("query_id", F.col("score").alias("faithfulness"))
    cited = A.check_citations(answered, hits)
    rows = cases.join(answered, "query_id").join(grounded, "query_id").join(cited, "query_id")
    rows = rows.withColumns({
        "citation_accuracy": evaluation.citation_accuracy(F.col("valid"), T.citations("answer")),
        "keyword_coverage": evaluation.keyword_coverage(F.col("answer"), F.col("expected_keywords")),
    })
    return evaluation.answer_report(rows)


def report_json(report: DataFrame) -> DataFrame:
    """(value): each row as JSON, to write as text."""
    return report.select(F.to_json(F.struct("*")).alias("value"))


#: Kinds of files without text of their own, for which a recognition engine is asked.
SCANNED = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")


def ingest(spark: SparkSession, folder: str, versions_path: str, parsers: dict | None = None, make_engine=None, render=None, clean: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan, recognise, clean and register a folder: elements, one row of metadata per file, cleaning counters.

    Files of a scanned kind that have no text (or no parser) go through ``make_engine``'s engine, page by
    page as ``render`` cuts them (bytes to a list of page images; the file itself is the page without
    it).  ``warnings`` tells of each file what was recovered, unsure or impossible; a file that can't be
    read keeps its ``error``.  Versions are numbered over all uploads that ``versions_path`` has seen, by file name and digest.
    """
    files = staged(scan.scan(spark, folder, parsers), "files")
    empty = files.where(F.col("ext").isin(*SCANNED) & (F.coalesce(F.size("elements"), F.lit(0)) == 0)).select(F.col("path").alias("doc_id"))
    named = scan.explode_elements(files.where("error is null"), "path").withColumnRenamed("path", "doc_id").drop("extra")
    notes = empty.withColumns({"warnings": F.array(F.lit("no text, and no recognition engine")), "recovered": F.lit(False)})
    if make_engine is not None:

        @F.pandas_udf("array<binary>")
        def pages(contents: pd.Series) -> pd.Series:
            return contents.map(lambda data: [bytes(data)] if render is None else [bytes(p) for p in render(bytes(data))])

        content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("doc_id"), "content")
        scanned = content.join(empty, "doc_id", "left_semi").select("doc_id", F.posexplode(pages("content")).alias("page", "content")).withColumn("page", F.col("page") + 1)
        found, counts = recognition.recognised(scanned, make_engine)
        found, counts = staged(found, "recognised"), staged(counts, "recognised")
        named = named.unionByName(found.select(named.columns))
        told = [F.when(F.col("words") > 0, F.lit("text recovered by recognition")), F.when(F.col("low"), F.concat(F.lit("low confidence: "), F.col("confidence").cast("string"))), F.when(F.col("errors") > 0, F.concat(F.col("errors").cast("string"), F.lit(" pages failed"))), F.when(F.col("words") == 0, F.lit("no word was recognised"))]
        notes = counts.select("doc_id", F.array_compact(F.array(*told)).alias("warnings"), (F.col("words") > 0).alias("recovered"))
    kept, stats = cleaning.clean(named) if clean else (named, None)
    known = tables.manifest(spark, versions_path)
    batch = known["version"] + 1
    fresh = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("document_key"), "sha256", F.struct(F.lit(batch).alias("batch"), "modified", "path").alias("seq"))
    uploads = fresh if batch == 1 else tables.load(spark, versions_path).unionByName(fresh)
    tables.save(uploads, versions_path)
    numbered = stores.versions(tables.load(spark, versions_path)).where(F.col("seq.batch") == batch).select(F.col("seq.path").alias("path"), "version", "is_duplicate", "is_new_version")
    described = scan.document_metadata(files).join(files.select("path", "error"), "path").join(numbered, "path").join(notes.withColumnRenamed("doc_id", "path"), "path", "left")
    described = described.withColumns({"warnings": F.coalesce("warnings", F.array().cast("array<string>")), "error": F.when(~F.coalesce("recovered", F.lit(False)), F.col("error"))}).drop("recovered")
    return kept, described, stats


def messages(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """What a conversation keeps of ``ask``, for ``memory.append_messages``: (conv_id, turn, role, text) of each question and its answer.

    ``questions`` has query_id, conv_id and text; a refused question is kept without an answer, an answer as it was masked.
    Turns count within these questions, in the order of query_id.
    """
    both = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("said")), F.struct(F.lit("assistant").alias("role"), F.col("masked").alias("said")))
    rows = questions.join(answered.select("query_id", "masked"), "query_id", "left").select("conv_id", "query_id", F.posexplode(both).alias("part", "m")).where("m.said is not null")
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("query_id", "part"))
    return rows.select("conv_id", turn.alias("turn"), "m.role", F.col("m.said").alias("text"))


def usage(answered: DataFrame, model: str) -> DataFrame:
    """Tokens and cost of ``ask``'s answers by agent."""
    rows = A.cost(answered.select("agent_id", F.lit(model).alias("model"), "prompt_tokens", "completion_tokens"))
    return rows.groupBy("agent_id", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("usd"), 6).alias("usd"))
