"""Page images through an OCR engine: the engine's contract, page preparation, and words as rows.

An engine is made by a function without arguments, once per worker, and has
``recognise(content: bytes)``, which gives (text, x0, y0, x1, y1, confidence) for each word
(confidence 0 to 100, negative for none).  Tasks call it page by page and give each word as a
row beside its page.  A page on which the engine raises gives one row with ``error``; the others are read.

Preparation works on Spark's own image rows (``spark.read.format("image")`` decodes PNG
and JPEG on the JVM): grey levels, contrast stretched over the levels that occur, small pages
enlarged, and black where a level is at or below the best threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import ocr

WORDS = "text string, x0 double, y0 double, x1 double, y1 double, confidence double, error string"
_engines: dict = {}
#: Words in one batch that a task gives, about.
AT_ONCE = 20_000
#: Pages whose longer side has fewer pixels are enlarged to it.
LONG_EDGE = 1500
PREPARED = "width int, height int, threshold int, pixels binary, error string"


def _recognise(make_engine: Callable, data: bytes | None) -> Iterator[tuple]:
    """Words of one page, by the worker's engine."""
    if data is None:
        return
    try:
        engine = _engines.get(make_engine)
        if engine is None:
            _engines.clear()
            engine = _engines[make_engine] = make_engine()
        for text, *box, confidence in engine.recognise(bytes(data)):
            yield (text, *map(float, box), float(confidence), None)
    except Exception as error:  # one page must not stop the others
        yield (None, None, None, None, None, None, f"{type(error).__name__}: {error}"[:300])


def words(pages: DataFrame, make_engine: Callable, content: str = "content") -> DataFrame:
    """The words of each page: the other columns of ``pages``, then WORDS; pages without a word have no row.

    Tasks turn batches of pages into batches of about ``AT_ONCE`` words.
    """
    others = [c for c in pages.columns if c != content]
    names = [f.split()[0] for f in WORDS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.float64()] * 5, pa.string()]

        def made(batch: pa.RecordBatch, at: list[int], found: list[tuple]) -> pa.RecordBatch:
            place = pa.array(at, pa.int32())
            columns = [pa.array(v, k) for v, k in zip(zip(*found, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*[batch.column(c).take(place) for c in others], *columns], names=[*others, *names])

        for batch in batches:
            data, at, found = batch.column(content), [], []
            for i in range(batch.num_rows):
                for word in _recognise(make_engine, data[i].as_py()):
                    at.append(i)
                    found.append(word)
                    if len(found) >= AT_ONCE:
                        yield made(batch, at, found)
                        at, found = [], []
            if found:
                yield made(batch, at, found)

    kinds = StructType([pages.schema[c] for c in others])
    for name, kind in (f.split() for f in WORDS.split(", ")):
        kinds = kinds.add(name, kind)
    return pages.select(*others, content).mapInArrow(work, kinds)


def recognised(pages: DataFrame, make_engine: Callable) -> tuple[DataFrame, DataFrame]:
    """Elements of pages (doc_id, page, content) as ``ocr.elements`` gives them, and (doc_id, words, confidence, low, errors).

    Each of the two recognises the pages once.
    """
    found = words(pages.select("doc_id", "page", "content"), make_engine)
    sure = F.round(F.avg(F.when(ocr.is_usable(), F.col("confidence"))), 1)
    counts = found.groupBy("doc_id").agg(F.count("text").alias("words"), F.count("error").alias("errors"), sure.alias("confidence"))
    all_counts = pages.select("doc_id").distinct().join(counts, "doc_id", "left").na.fill(0, ["words", "errors"])
    report = all_counts.select("doc_id", "words", "errors", "confidence", (F.col("confidence") < ocr.LOW_CONFIDENCE).alias("low"))
    return ocr.elements(found.where("error is null").drop("error")), report


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files decoded by Spark's image source: origin, width, height, nChannels, data (blue, green, red)."""
    return spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(folder).select("image.*")


def grey(data: np.ndarray) -> np.ndarray:
    """Luma of pixels (height, width, channels in the order blue, green, red and alpha)."""
    if data.shape[2] == 1:
        return data[:, :, 0]
    return (data[:, :, :3].astype(np.float32) @ np.array([0.114, 0.587, 0.299], np.float32) + 0.5).astype(np.uint8)


def stretched(levels: np.ndarray) -> np.ndarray:
    """Levels spread over 0 to 255."""
    low, high = int(levels.min()), int(levels.max())
    if high <= low:
        return levels
    table = np.clip((np.arange(256) - low) * (255.0 / (high - low)) + 0.5, 0, 255).astype(np.uint8)
    return table[levels]


def enlarged(levels: np.ndarray, edge: int) -> np.ndarray:
    """Resampled by a windowed sinc of three lobes so that the longer side has ``edge`` pixels; the sides are separable."""
    scale = edge / max(levels.shape)

    def along(values: np.ndarray) -> np.ndarray:
        size = max(1, round(len(values) * scale))
        centre = (np.arange(size) + 0.5) / scale - 0.5
        taps = np.floor(centre).astype(int)[:, None] + np.arange(-2, 4)
        apart = centre[:, None] - taps
        weights = (np.sinc(apart) * np.sinc(apart / 3)).astype(np.float32)
        weights /= weights.sum(axis=1, keepdims=True)
        out = np.zeros((size, *values.shape[1:]), np.float32)
        for k in range(6):  # one tap of all rows at a time
            out += values[np.clip(taps[:, k], 0, len(values) - 1)] * weights[:, k, None]
        return out

    return np.clip(along(along(levels.astype(np.float32)).T).T + 0.5, 0, 255).astype(np.uint8)


def best_threshold(levels: np.ndarray) -> int:
    """The level that parts dark from light best, the first of equal ones."""
    n = np.bincount(levels.ravel(), minlength=256).astype(np.float64)
    dark, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    light = dark[-1] - dark
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.nan_to_num(dark * light * (mass / dark - (mass[-1] - mass) / light) ** 2)
    return int(spread.argmax())


def prepare(data: bytes, width: int, height: int, channels: int, long_edge: int = LONG_EDGE) -> tuple[int, int, int, bytes]:
    """(width, height, threshold, black and white pixels) of one decoded image."""
    levels = stretched(grey(np.frombuffer(data, np.uint8).reshape(height, width, channels)))
    if max(levels.shape) < long_edge:
        levels = enlarged(levels, long_edge)
    threshold = best_threshold(levels)
    return levels.shape[1], levels.shape[0], threshold, np.where(levels > threshold, np.uint8(255), np.uint8(0)).tobytes()


def prepared(decoded: DataFrame, long_edge: int = LONG_EDGE) -> DataFrame:
    """Prepared pages of image rows, one at a time: origin, then PREPARED; undecodable files have ``error`` set."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                origin, width, height, channels, data = (batch.column(c)[at].as_py() for c in range(5))
                try:
                    row = (origin, *prepare(data, width, height, channels, long_edge), None)
                except (ValueError, TypeError, MemoryError) as error:
                    row = (origin, None, None, None, None, f"{type(error).__name__}: {error}"[:300])
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["origin", *[f.split()[0] for f in PREPARED.split(", ")]])

    return decoded.select("origin", "width", "height", "nChannels", "data").mapInArrow(work, f"origin string, {PREPARED}")
