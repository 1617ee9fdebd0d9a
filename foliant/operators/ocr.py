"""Layout of recognised words: lines, blocks, tables, receipt fields.

Words are rows (doc_id, page, text, x0, y0, x1, y1, confidence), or arrays of a page
each, which need no shuffle.  Only the clustering of a page's words into lines, and of a
table's cells into columns, is an ordered fold; cells are gaps between neighbours in a
page's arrays, blocks gaps between lines, found by a window.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

CELL_GAP, BLOCK_GAP, TABLE_SHARE, LOW_CONFIDENCE = 1.5, 1.8, 0.6, 60.0
LINED = "page int, line int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, gap double, cell long"
#: Words of pages whose lines and cells are found at a time, about.
WORDS = 500_000

#: Patterns of receipt fields in order of preference; the group is the value.
FIELDS = {
    "invoice_number": [r"(?i)\b(?:invoice|inv|receipt)\s*(?:no|number|#|num)?\s*[:.#]?\s*([A-Z]{0,4}[-/]?[0-9][\p{L}\p{N}_/-]*)"],
    "date": [r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", r"\b([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4})\b", r"(?i)\b([0-9]{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+[0-9]{2,4})\b"],
    "total": [r"(?i)(?:grand\s+total|amount\s+due|total\s+due|total)\s*[|:$]*\s*\$?\s*([0-9,]+\.[0-9]{2})"],
    "tax": [r"(?i)(?:tax|vat|gst)\s*(?:\(?[0-9]{1,2}%\)?)?\s*[|:$]*\s*\$?\s*([0-9,]+\.[0-9]{2})"],
    "vendor_tax_id": [r"(?i)\b(?:ntn|vat\s*reg|tax\s*id|ein)\s*[:#]?\s*([\p{L}\p{N}_-]{5,})"],
}


def receipt_field(text: Column, name: str) -> Column:
    """The first pattern that matches gives the field: its first match, for the total its last."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in FIELDS[name]]
    return F.coalesce(*[F.when(F.size(m) > 0, F.element_at(m, -1 if name == "total" else 1)) for m in found])


def _with_id(rows: DataFrame, fields: str) -> str:
    """Fields after a doc_id of the type that ``rows`` has."""
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {fields}"


def is_usable(text: Column | str = "text", confidence: Column | str = "confidence") -> Column:
    """Whether a word has a text and a confidence."""
    return (F.trim(text) != "") & ((F.col(confidence) if isinstance(confidence, str) else confidence) >= 0)


def usable(words: DataFrame) -> DataFrame:
    return words.where(is_usable())


def line_numbers(centres: Iterable[float], heights: Iterable[float]) -> list[int]:
    """Lines of one page's words from top to bottom: sums and medians of the open line are kept up, not made anew."""
    number, at, half, held, out = -1, 0.0, 0.0, [], []
    total = lost = 0.0  # a compensated sum, as Python's own
    for centre, height in zip(centres, heights, strict=True):
        if number < 0 or abs(centre - at) > half:
            number, total, lost, held = number + 1, 0.0, 0.0, []
        upto = total + centre
        lost += (total - upto) + centre if abs(total) >= abs(centre) else (centre - upto) + total
        total = upto
        insort(held, height)
        n = len(held)
        at = (total + lost) / n
        half = (held[n // 2] if n % 2 else (held[n // 2 - 1] + held[n // 2]) / 2) / 2
        out.append(number)
    return out


def _laid_out(many: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of some pages, ``many`` words a page, its line, its page's gap and its cell in the line; and the words' order by page, line, left edge and text."""
    ends = np.cumsum(many)
    page = np.repeat(np.arange(len(many)), many)
    centres, heights = (y0 + y1) / 2, y1 - y0
    down = np.lexsort((heights, x0, centres, page))
    line = np.empty(len(page), int)
    for n, end in zip(many, ends, strict=True):
        own = down[end - n : end]
        line[own] = line_numbers(centres[own].tolist(), heights[own].tolist())
    held = np.bincount(page[~np.isnan(heights)], minlength=len(many))
    rising = np.append(heights[np.lexsort((heights, page))], np.nan)
    middle = np.where(held > 0, (rising[ends - many + np.maximum(held - 1, 0) // 2] + rising[ends - many + held // 2]) / 2, np.nan)
    gap = (CELL_GAP * middle)[page]
    order = np.lexsort((x1, x0, line, page))
    together = (page[order][1:] == page[order][:-1]) & (line[order][1:] == line[order][:-1])
    if (together & (x0[order][1:] == x0[order][:-1])).any():
        order = np.lexsort((x1, pc.rank(texts, tiebreaker="dense").to_numpy(), x0, line, page))
    wide = np.zeros(len(order), int)
    wide[1:] = together & (x0[order][1:] - x1[order][:-1] > gap[order][1:])
    upto, opens = np.cumsum(wide), _opens(together, len(order))
    cell = np.empty(len(order), int)
    cell[order] = upto - np.repeat(upto[opens], np.diff(np.append(opens, len(order))))
    return line, gap, cell, order


def _opens(together: np.ndarray, n: int) -> np.ndarray:
    """Where runs of ``n`` things begin of which neighbours are together."""
    return np.flatnonzero(np.concatenate(([True], ~together)))[:n]


def _runs(batch: tuple[pa.Array, ...]) -> Iterator[tuple[np.ndarray, list[np.ndarray], pa.Array]]:
    """Numbers of words, boxes and texts of a batch's pages, about ``WORDS`` words at a time; at least one page."""
    many = pc.list_value_length(batch[0]).fill_null(0).to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(many)))
    numbers, texts = [x.flatten().cast("double").to_numpy(zero_copy_only=False) for x in batch[:4]], batch[4].flatten()
    first = 0
    while first < len(many):
        end = max(first + 1, int(np.searchsorted(upto, upto[first] + WORDS, "right")) - 1)
        yield many[first:end], [x[upto[first] : upto[end]] for x in numbers], texts[upto[first] : upto[end]]
        first = end


def _lists(many: list[np.ndarray], parts: list[list], names: list[str]) -> pa.ListArray:
    """Structs of columns that came in parts, in lists of ``many`` each."""
    ends = np.concatenate(([0], *many)).cumsum().astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.concat_arrays([pa.array(x) for x in column]) for column in zip(*parts, strict=True)], names=names))


@F.arrow_udf(ArrayType(StructType().add("line", "integer").add("gap", "double").add("cell", "long")))
def _laid(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in batches:
        sizes, parts = [np.zeros(0, int)], [[np.zeros(0, np.int32), np.zeros(0), np.zeros(0, int)]]
        for many, boxes, texts in _runs(batch):
            line, gap, cell, _ = _laid_out(many, *boxes, texts)
            sizes.append(many)
            parts.append([line.astype(np.int32), gap, cell])
        yield _lists(sizes, parts, ["line", "gap", "cell"])


@F.arrow_udf(ArrayType(StructType().add("line", "integer").add("text", "string").add("y0", "double").add("y1", "double").add("cells", "long").add("words", "long")))
def _boxed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in batches:
        sizes, parts = [np.zeros(0, int)], [[np.zeros(0, np.int32), pa.array([], pa.string()), np.zeros(0), np.zeros(0), np.zeros(0, int), np.zeros(0, int)]]
        for many, (x0, y0, x1, y1), texts in _runs(batch):
            line, _, cell, order = _laid_out(many, x0, y0, x1, y1, texts)
            page = np.repeat(np.arange(len(many)), many)[order]
            opens = _opens((page[1:] == page[:-1]) & (line[order][1:] == line[order][:-1]), len(order))
            ends = np.append(opens, len(order))
            said = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), texts.take(pa.array(order)).cast("string")), " ")
            low, high = (f.reduceat(y[order], opens) if len(opens) else np.zeros(0) for f, y in ((np.fmin, y0), (np.fmax, y1)))
            sizes.append(np.bincount(page[opens], minlength=len(many)))
            parts.append([line[order][opens].astype(np.int32), said, low, high, cell[order][ends[1:] - 1] + 1, np.diff(ends)])
        yield _lists(sizes, parts, ["line", "text", "y0", "y1", "cells", "words"])


def pages(words: DataFrame) -> DataFrame:
    """(doc_id, page, words): the usable words of each page as an array, in any order."""
    return usable(words).groupBy("doc_id", "page").agg(F.collect_list(F.struct("text", "x0", "y0", "x1", "y1", "confidence")).alias("words"))


def _of_page(udf) -> Column:
    return udf(*[f"words.{c}" for c in ("x0", "y0", "x1", "y1", "text")]).alias("at")


def lines(words: DataFrame) -> DataFrame:
    """``line`` of every word: it joins the line above if its centre is within half the line's median height.

    ``cell`` is its cell in the line: a new one begins where the gap is over 1.5 median
    heights of the page (``gap``).  A page's words are one array.
    """
    rows = pages(words).select("doc_id", "page", F.explode(F.arrays_zip("words", _of_page(_laid))).alias("z"))
    kinds = dict(f.split() for f in LINED.split(", "))
    at = {"page": F.col("page")} | {c: F.col(f"z.at.{c}") for c in ("line", "gap", "cell")}
    return rows.select("doc_id", *[at.get(c, F.col(f"z.words.{c}")).cast(kind).alias(c) for c, kind in kinds.items()])


def page_boxes(pages: DataFrame) -> DataFrame:
    """The same as ``line_boxes`` of ``pages``, one row a page with the array of its words: no row of a word is made, shuffled or sorted."""
    may = F.filter("words", lambda w: is_usable(w["text"], w["confidence"]))
    return pages.select("doc_id", "page", may.alias("words")).select("doc_id", "page", F.inline(_of_page(_boxed)))


def cells(lined: DataFrame) -> DataFrame:
    """(doc_id, page, line, cell, text, x0, gap, words, y0, y1): words of a line joined where no gap exceeds 1.5 median heights of the page."""
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    measures = [F.first("gap").alias("gap"), F.count(F.lit(1)).alias("words"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    return lined.repartition("doc_id", "page").groupBy("doc_id", "page", "line", "cell").agg(words.alias("text"), F.min("x0").alias("x0"), *measures)


def line_boxes(celled: DataFrame) -> DataFrame:
    """One row per line of ``cells``: its text in reading order, its box, and how many cells and words it has."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"]), " ")
    return celled.groupBy("doc_id", "page", "line").agg(text.alias("text"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("cells"), F.sum("words").alias("words"))


def block_numbers(boxes: DataFrame) -> DataFrame:
    """``block`` of each line: a gap over 1.8 line heights opens a new one."""
    down = Window.partitionBy("doc_id", "page").orderBy("line")
    height = F.col("y1") - F.col("y0")
    gap = F.col("y0") - F.lag("y1").over(down)
    opens = gap > BLOCK_GAP * F.greatest(height, F.lag(height).over(down))
    return boxes.withColumn("opens", F.coalesce(opens.cast("int"), F.lit(0))).withColumn("block", F.sum("opens").over(down)).drop("opens")


def blocks(lined: DataFrame) -> DataFrame:
    """(doc_id, page, block, kind, columns, text): tables are blocks of two lines or more, mostly of several cells."""
    return box_blocks(line_boxes(cells(lined)))


def box_blocks(boxes: DataFrame) -> DataFrame:
    """The same of lines with their boxes."""
    rows = block_numbers(boxes)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    many = F.col("cells") >= 2
    out = rows.groupBy("doc_id", "page", "block").agg(text.alias("text"), F.count(F.lit(1)).alias("n"), F.count_if(many).alias("n_many"), F.mode(F.when(many, F.col("cells"))).alias("columns"))
    table = (F.col("n") >= 2) & (F.col("n_many") / F.col("n") >= TABLE_SHARE)
    return out.select("doc_id", "page", "block", F.when(table, "table").otherwise("paragraph").alias("kind"), F.when(table, F.col("columns")).alias("columns"), "text")


def table_rows(lined: DataFrame) -> DataFrame:
    """(doc_id, page, block, line, cells): a table's rows with cells in aligned columns."""
    numbered = block_numbers(line_boxes(cells(lined))).select("doc_id", "page", "line", "block")
    kinds = blocks(lined).where("kind = 'table'").select("doc_id", "page", "block")
    rows = cells(lined).select("doc_id", "page", "line", "cell", "text", "x0", "gap").join(numbered, ["doc_id", "page", "line"]).join(kinds, ["doc_id", "page", "block"])

    def align(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["line", "x0"])
        centres: list[float] = []
        places = []
        for x0, gap in zip(part["x0"], part["gap"], strict=True):
            at = next((i for i, c in enumerate(centres) if abs(x0 - c) <= 2 * gap), None)
            if at is None:
                centres.append(x0)
                at = len(centres) - 1
            else:
                centres[at] = (centres[at] + x0) / 2
            places.append(at)
        rank = {old: new for new, old in enumerate(sorted(range(len(centres)), key=centres.__getitem__))}
        part = part.assign(column=[rank[p] for p in places])
        out = []
        for line, own in part.groupby("line"):
            cell = own.groupby("column")["text"].agg(" ".join)
            out.append({"doc_id": own["doc_id"].iloc[0], "page": own["page"].iloc[0], "block": own["block"].iloc[0], "line": line, "cells": [cell.get(i, "") for i in range(len(centres))]})
        return pd.DataFrame(out)

    return rows.groupBy("doc_id", "page", "block").applyInPandas(align, _with_id(lined, "page int, block long, line int, cells array<string>"))


def confidence(words: DataFrame) -> DataFrame:
    """(doc_id, confidence, low): the mean to one place, and whether it warns."""
    mean = F.round(F.avg("confidence"), 1)
    return usable(words).groupBy("doc_id").agg(mean.alias("confidence"), (mean < LOW_CONFIDENCE).alias("low"))


def otsu(histogram: DataFrame) -> DataFrame:
    """(image_id, threshold) from (image_id, level, n): the level that parts dark from light best.

    The between-class variance of every level comes from running sums, in thousandths, so
    that float noise can't part equal ones; the first of equal ones wins.
    """
    along = Window.partitionBy("image_id").orderBy("level")
    whole = Window.partitionBy("image_id")
    mass = F.col("level") * F.col("n")
    rows = histogram.withColumns({"dark": F.sum("n").over(along), "all": F.sum("n").over(whole), "dark_mass": F.sum(mass).over(along), "mass": F.sum(mass).over(whole)})
    light = F.col("all") - F.col("dark")
    apart = F.try_divide(F.col("dark_mass"), F.col("dark")) - F.try_divide(F.col("mass") - F.col("dark_mass"), light)
    spread = F.coalesce(F.round(F.col("dark").cast("double") * light * (apart * apart) * 1000), F.lit(0.0))
    return rows.groupBy("image_id").agg(F.max_by("level", F.struct(spread, -F.col("level"))).alias("threshold"))


def elements(words: DataFrame) -> DataFrame:
    """Recognised pages as elements: blocks in reading order, tables with aligned cells."""
    lined = lines(words)
    cells_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.array_join("cells", " | ").alias("t")))), lambda r: r["t"]), "\n")
    tables = table_rows(lined).groupBy("doc_id", "page", "block").agg(cells_text.alias("table_text"))
    rows = blocks(lined).join(tables, ["doc_id", "page", "block"], "left")
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block")) - 1).alias("elem_idx")
    return rows.select("doc_id", number, F.col("kind").alias("type"), F.coalesce("table_text", "text").alias("text"), F.col("page").alias("position"), F.lit(None).cast("int").alias("level"))
