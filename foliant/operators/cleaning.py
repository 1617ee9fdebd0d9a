"""Cleaning of extracted elements: chrome lines, boilerplate, repeats.

Elements are rows (doc_id, elem_idx, type, text, position, level).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import staged
from .dedup import fold_repeats

EDGE_LINES, PAGE_SHARE, MIN_PAGES, MAX_CHROME = 2, 0.6, 3, 80

#: Whole elements that carry no content.
BOILERPLATE = (r"(?i)^page [0-9]+( of [0-9]+)?$", r"^[0-9]+ ?/ ?[0-9]+$", r"^[-_=*.·•\s]+$", r"(?i)^(confidential|draft|internal use only)$")
NEAR_TYPES = ("paragraph", "list_item")


def is_boilerplate(text: Column | str) -> Column:
    out = F.lit(False)
    for pattern in BOILERPLATE:
        out = out | F.trim(T.col(text)).rlike(pattern)
    return out


def page_lines(elements: DataFrame) -> DataFrame:
    """(doc_id, position, lines): the non-blank lines of each page in order."""
    lines = elements.where("position is not null").groupBy("doc_id", "position").agg(F.array_sort(F.collect_list(F.struct("elem_idx", "text"))).alias("parts"))
    split = F.flatten(F.transform("parts", lambda p: F.split(p["text"], "\n")))
    return lines.select("doc_id", "position", F.filter(split, lambda x: F.trim(x) != "").alias("lines"))


def edge_lines(lines: Column) -> Column:
    """The first two and last two of a page's lines, if short; as fingerprints, each once."""
    n = F.size(lines)
    edge = F.when(n <= EDGE_LINES, lines).otherwise(F.concat(F.slice(lines, 1, EDGE_LINES), F.slice(lines, -EDGE_LINES, EDGE_LINES)))
    return F.array_distinct(F.transform(F.filter(edge, lambda x: F.char_length(F.trim(x)) <= MAX_CHROME), T.line_fingerprint))


def chrome_lines(elements: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, pages): lines at the edges of most pages of a document."""
    pages = page_lines(elements)
    total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES)
    seen = pages.select("doc_id", F.explode(edge_lines(F.col("lines"))).alias("fingerprint")).groupBy("doc_id", "fingerprint").agg(F.count(F.lit(1)).alias("pages"))
    return seen.join(total, "doc_id").where(F.col("pages") >= F.greatest(F.lit(MIN_PAGES), F.ceil(F.col("n") * PAGE_SHARE))).drop("n")


def strip_chrome(elements: DataFrame) -> DataFrame:
    """Elements without the chrome lines, wherever they stand; ``removed`` counts them."""
    chrome = chrome_lines(elements).groupBy("doc_id").agg(F.collect_set("fingerprint").alias("chrome"))
    rows = elements.join(chrome, "doc_id", "left").withColumn("all", F.split("text", "\n"))
    kept = F.when(F.col("chrome").isNull(), F.col("all")).otherwise(F.filter("all", lambda x: ~F.array_contains(F.col("chrome"), T.line_fingerprint(x))))
    rows = rows.withColumn("kept", kept).withColumn("removed", F.size("all") - F.size("kept"))
    text = F.when(F.col("removed") > 0, F.regexp_replace(F.array_join("kept", "\n"), r"^\s+|\s+$", "")).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("all", "kept", "chrome")


def tables(elements: DataFrame) -> DataFrame:
    return elements.where("type = 'table'")


def exact_repeats(elements: DataFrame) -> DataFrame:
    """``is_repeat``: whether an earlier element of the document says the same."""
    order = Window.partitionBy("doc_id", F.sha2(T.fold("text"), 256)).orderBy("elem_idx")
    return elements.withColumn("is_repeat", F.row_number().over(order) > 1)


def clean(elements: DataFrame, near: float = 0.92) -> tuple[DataFrame, DataFrame]:
    """Cleaned elements, and one row of counters per document."""
    start = staged(elements.withColumn("text", T.normalize_text("text")), "normalized")  # read five times
    counted = start.groupBy("doc_id").agg(F.count(F.lit(1)).alias("elements_in"))
    stripped = strip_chrome(start.where(F.col("text") != ""))
    chrome = stripped.groupBy("doc_id").agg(F.sum("removed").alias("chrome_lines_removed"))
    full = stripped.where(F.col("text") != "").drop("removed").withColumn("boilerplate", is_boilerplate("text"))
    full = staged(full, "stripped")
    judged = staged(fold_repeats(full.where("not boilerplate").drop("boilerplate"), near, NEAR_TYPES), "judged")
    stats = counted.join(chrome, "doc_id", "left")
    stats = stats.join(full.groupBy("doc_id").agg(F.count_if("boilerplate").alias("boilerplate_dropped")), "doc_id", "left")
    fates = [F.count_if(F.col("fate") == f).alias(n) for f, n in (("exact", "exact_duplicates_dropped"), ("near", "near_duplicates_dropped"), ("kept", "elements_out"))]
    stats = stats.join(judged.groupBy("doc_id").agg(*fates), "doc_id", "left").na.fill(0)
    return judged.where("fate = 'kept'").drop("fate"), stats
