"""Chunking: token windows, recursive splits, structure-aware groups; validation.

Structure is found by windows over a document's elements: breadcrumbs, hard breaks
and topic shifts are columns.  Only where a token budget decides, which depends on
what went before, two short folds run over a document's numbers, never its texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import chunk_id

MAX_TOKENS, OVERLAP, MIN_PROSE, MIN_CHUNK, COHESION = 512, 64, 64, 20, 0.08
HEADINGS = ("heading", "slide_title")
#: Heading levels of the formats that are read; deeper ones count as the last.
LEVELS = 9
_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def window_count(n: Column, size: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """How many windows n tokens give."""
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / (size - overlap)) + 1).cast("int")


def token_spans(text: str) -> list[tuple[int, int]]:
    """Where the default tokenizer's tokens begin and end."""
    return [m.span() for m in _TOKEN.finditer(text)]


def token_windows(text: str, size: int = MAX_TOKENS, overlap: int = OVERLAP, tokenizer=token_spans) -> list[str]:
    """Sliding windows over a text's tokens, cut from the text itself."""
    spans = tokenizer(text)
    if len(spans) <= size:
        return [text.strip()] if spans else []
    starts = range(0, len(spans) - overlap, size - overlap)
    return [text[spans[s][0] : spans[min(s + size, len(spans)) - 1][1]] for s in starts]


def _count(text: str) -> int:
    return sum(1 for _ in _TOKEN.finditer(text))


def recursive_split(text: str, size: int = MAX_TOKENS, level: int = 0, counted=_count) -> list[str]:
    """Split at paragraphs, lines, sentences, words, each level only where needed, and join again while it fits; ``counted`` gives a text's tokens."""
    levels = ((lambda t: t.split("\n\n"), "\n\n"), (lambda t: t.split("\n"), "\n"), (_SENTENCE.split, " "), (lambda t: t.split(" "), " "))
    if level == 0:
        text = text.strip()
    if not text:
        return []
    if counted(text) <= size or level == len(levels):
        return [text]
    cut, glue = levels[level]
    small = [q for part in cut(text) if part.strip() for q in recursive_split(part, size, level + 1, counted) if q.strip()]
    out: list[list] = []
    for piece in small:
        n = counted(piece)
        if out and out[-1][1] + n <= size:
            out[-1][0].append(piece)
            out[-1][1] += n
        else:
            out.append([[piece], n])
    joined = [glue.join(parts) for parts, _ in out]
    return [p.strip() for p in joined] if level == 0 else joined


def cohesion(a: Column, b: Column) -> Column:
    """Overlap of two passages' content words; 1 without evidence."""
    return T.let(T.cohesion_words(a), lambda x: T.let(T.cohesion_words(b), lambda y: T.jaccard(x, y)))


def breadcrumbs(elements: DataFrame) -> DataFrame:
    """``elements`` with path: the headings above each one, itself included.

    A heading sits one below the last one at most: the k-th is at the least of
    level_j + k - j over all headings j up to it, a running minimum.  On each depth
    the last heading so far counts, down to the depth of the last one.
    """
    so_far = Window.partitionBy("doc_id").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.col("type").isin(*HEADINGS)
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(LEVELS))
    rows = elements.withColumn("k", F.sum(heading.cast("int")).over(so_far))
    rows = rows.withColumn("depth", F.when(heading, F.col("k") + F.least(F.lit(0), F.min(F.when(heading, level - F.col("k"))).over(so_far))))
    rows = rows.withColumn("now", F.coalesce(F.last("depth", ignorenulls=True).over(so_far), F.lit(0)))
    trail = F.array(*[F.last(F.when(F.col("depth") == d, F.col("text")), ignorenulls=True).over(so_far) for d in range(1, LEVELS + 1)])
    return rows.withColumn("path", F.slice(trail, F.lit(1), F.col("now"))).drop("k", "depth", "now")


def break_columns(elements: DataFrame, shift: float = COHESION, similar=cohesion) -> DataFrame:
    """``elements`` with n (tokens), opens (a group starts here) and may: after prose, whether the topic shifts (else null).

    A run of headings opens a group and what follows belongs to it; a table ends the group.
    """
    order = Window.partitionBy("doc_id").orderBy("elem_idx")
    kind = F.when(F.col("type").isin(*HEADINGS), "heading").when(F.col("type") == "table", "table").otherwise("prose")
    rows = elements.withColumns({"kind": kind, "n": T.token_count("text")}).withColumns({"last": F.lag("kind").over(order), "said": F.lag("text").over(order)})
    opens = F.col("last").isNull() | (F.col("last") == "table") | ((F.col("last") == "prose") & (F.col("kind") != "prose"))
    may = F.when((F.col("kind") == "prose") & (F.col("last") == "prose"), similar(F.col("said"), F.col("text")) < shift)
    return rows.withColumns({"opens": opens, "may": may}).drop("last", "said")


def _numbered(step) -> Column:
    """A pandas UDF over arrays of structs that numbers each array's entries by ``step(entries)``."""

    @F.pandas_udf("array<int>")
    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in T.slices(batches):
            yield rows.map(step)

    return numbers


def _group_numbers(size: int, least: int):
    """Prose breaks before an element that passes the budget, or at a topic shift once enough is held."""

    def step(entries) -> list[int]:
        out, group, held = [], -1, 0
        for e in entries:
            soft = e["may"] is not None and (held + e["n"] > size or (e["may"] and held >= least))
            if e["opens"] or soft:
                group, held = group + 1, 0
            held += e["n"]
            out.append(group)
        return out

    return step


def _chunk_numbers(size: int, least: int):
    """A fragment joins the chunk before it, or, being the first, the one after it, where the budget allows; tables stay alone."""

    def step(entries) -> list[int]:
        out, held = [], []
        for e in entries:
            n, free = e["n"], not e["keep_whole"]
            if held and free and n < least and held[-1][1] and held[-1][0] + n <= size:
                held[-1] = (held[-1][0] + n, True)
            else:
                held.append((n, free))
            out.append(len(held) - 1)
        forward = len(held) > 1 and held[0][1] and held[1][1] and held[0][0] < least and held[0][0] + held[1][0] <= size
        return [max(0, i - 1) for i in out] if forward else out

    return step


def _ordered(rows: DataFrame, order: list[str], numbered: list[str], step, name: str) -> DataFrame:
    """``rows`` with their number ``name`` within the document; the fold sees the columns ``numbered`` only."""
    whole = F.struct(*order, *[c for c in rows.columns if c not in (*order, "doc_id")])
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(whole)).alias("rows"))
    numbers = _numbered(step)(F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in numbered])))
    return docs.withColumn("numbers", numbers).select("doc_id", F.inline(F.arrays_zip("rows", "numbers"))).select("doc_id", "rows.*", F.col("numbers").alias(name))


def _texts(order: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["text"]), "\n\n")


CHUNK = ("doc_id", "chunk_index", "text", "token_count", "keep_whole", "heading_path", "pages", "element_types")


def semantic_chunks(elements: DataFrame, size: int = MAX_TOKENS, least: int = MIN_CHUNK, similar=cohesion) -> DataFrame:
    """Structure-aware chunks (CHUNK).

    A heading opens a group, a table is whole, prose breaks at the budget or a topic
    shift; oversized prose is split, fragments join a neighbour.  Everything is keyed
    by document, so elements are shuffled once.
    """
    need = elements.select("doc_id", "elem_idx", "type", "text", F.col("position").cast("int").alias("position"), F.col("level").cast("int").alias("level"))
    rows = break_columns(breadcrumbs(need), similar=similar)
    groups = _ordered(rows.select("doc_id", "elem_idx", "text", "type", "kind", "position", "path", "n", "opens", "may"), ["elem_idx"], ["n", "opens", "may"], _group_numbers(size, MIN_PROSE), "group")
    # a group's path is that of its last heading: of all its elements
    groups = groups.groupBy("doc_id", "group").agg(
        _texts(F.struct("elem_idx", "text")).alias("text"), F.sum("n").cast("int").alias("n"), F.max_by("path", "elem_idx").alias("heading_path"), F.collect_set("position").alias("pages"),
        F.collect_set("type").alias("element_types"), F.bool_or(F.col("kind") == "table").alias("keep_whole"),
    )

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in T.slices(batches):
            yield texts.map(lambda t: None if t is None else recursive_split(t, size))

    large = (F.col("n") > size) & ~F.col("keep_whole")
    parts = groups.withColumn("parts", split(F.when(large, F.col("text")))).withColumn("parts", F.when(large, F.col("parts")).otherwise(F.array("text")))
    pieces = parts.select("doc_id", "group", F.posexplode("parts").alias("part", "piece"), "heading_path", "pages", "element_types", "keep_whole").withColumnRenamed("piece", "text").withColumn("n", T.token_count("text"))
    pieces = _ordered(pieces, ["group", "part"], ["n", "keep_whole"], _chunk_numbers(size, least), "chunk_index")
    made = pieces.groupBy("doc_id", "chunk_index").agg(
        _texts(F.struct("group", "part", "text")).alias("text"), F.sum("n").cast("int").alias("token_count"), F.bool_or("keep_whole").alias("keep_whole"),
        F.min_by("heading_path", F.struct("group", "part")).alias("heading_path"), F.collect_set("pages").alias("pages"), F.collect_set("element_types").alias("element_types"),
    )
    merged = {c: F.array_sort(F.array_distinct(F.flatten(c))) for c in ("pages", "element_types")}
    return made.withColumns(merged).select(*CHUNK)


def _split_chunks(docs: DataFrame, cut, tokenizer=token_spans) -> DataFrame:
    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in T.slices(batches):
            yield texts.map(lambda t: cut(t) if t else [])

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(tokenizer(t)))

    rows = docs.select("doc_id", F.posexplode(split("text")).alias("chunk_index", "text"))
    return rows.withColumns({"token_count": T.token_count("text") if tokenizer is token_spans else counted("text"), "keep_whole": F.lit(False)})


def recursive_chunks(docs: DataFrame, size: int = MAX_TOKENS, tokenizer=token_spans) -> DataFrame:
    """Texts split where they part; ``tokenizer`` gives a text's token spans, by which the budget counts."""
    return _split_chunks(docs, lambda t: recursive_split(t, size, counted=lambda part: len(tokenizer(part))), tokenizer)


def token_chunks(docs: DataFrame, size: int = MAX_TOKENS, overlap: int = OVERLAP, tokenizer=token_spans) -> DataFrame:
    """Windows of ``size`` tokens; ``tokenizer`` gives a text's token spans."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    return _split_chunks(docs, lambda t: token_windows(t, size, overlap, tokenizer), tokenizer)


def chunks(docs_or_elements: DataFrame, strategy: str = "semantic", **options) -> DataFrame:
    """Chunks by strategy, with their ids."""
    made = {"semantic": semantic_chunks, "recursive": recursive_chunks, "token": token_chunks}[strategy](docs_or_elements, **options)
    made = made.withColumn("strategy", F.lit(strategy))
    return made.withColumn("chunk_id", chunk_id(F.col("doc_id").cast("string"), "strategy", "chunk_index", "text"))


def described(chunked: DataFrame, metadata: DataFrame) -> DataFrame:
    """Chunks with what their document's metadata say: source, title, version and sha256; ``metadata`` as ``plans.pipelines.ingest`` gives it."""
    base = metadata.select(F.col("path").alias("doc_id"), F.col("filename").alias("source"), "title", "version", "sha256")
    return chunked.join(base, "doc_id", "left")


def validate(chunked: DataFrame, docs: DataFrame, least: int = 10, size: int = MAX_TOKENS, tolerance: float = 1.1, coverage: float = 0.7) -> DataFrame:
    """One row per document of ``docs``: counts of each issue, coverage, ``ok``."""
    first = F.row_number().over(Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy("chunk_index")) == 1
    many = F.count(F.lit(1)).over(Window.partitionBy("doc_id")) > 1
    rows = chunked.withColumns({"first": first, "many": many, "empty": F.trim("text") == ""})
    stats = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if("empty").alias("empty_chunks"),
        F.count_if((F.col("token_count") > int(size * tolerance)) & ~F.col("keep_whole")).alias("oversized"),
        F.count_if((F.col("token_count") < least) & F.col("many")).alias("undersized"),
        F.count_if(~F.col("first")).alias("duplicates"),
        ((F.max("chunk_index") != F.count(F.lit(1)) - 1) | (F.count_distinct("chunk_index") != F.count(F.lit(1)))).alias("gaps"),
        F.sum(F.when(F.col("first"), F.char_length("text")).otherwise(0)).alias("unique_chars"),
        F.round(F.avg("token_count"), 1).alias("avg_tokens"), F.max("token_count").alias("max_tokens"), F.min("token_count").alias("min_tokens"),
    )
    out = docs.select("doc_id", F.char_length("text").alias("n_chars")).join(stats, "doc_id", "left")
    share = F.round(F.least(F.lit(1.0), F.try_divide(F.col("unique_chars"), F.col("n_chars"))), 3)
    out = out.withColumn("coverage", share)
    bad = F.col("chunks").isNull() | (F.col("empty_chunks") > 0) | (F.col("oversized") > 0) | (F.col("duplicates") > 0) | F.col("gaps") | (F.coalesce("coverage", F.lit(1.0)) < coverage)
    return out.withColumn("ok", ~bad).drop("unique_chars")
