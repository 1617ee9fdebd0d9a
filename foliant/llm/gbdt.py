"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every text are computed once (``STATISTICS``) and staged as a narrow
table.  The trees are grown on at most ``MAX_LABELLED`` labelled rows: the ones
with the least hash of their id, a fixed bound on what the driver holds.  Values
are binned at the sample's quantiles; each level of a tree is grown from
histograms of gradients over the bins.  The finished forest is four flat arrays,
one row for each tree as a complete binary tree, and scoring walks all trees of a
batch at once, one numpy step per level.

Defined results: null and empty texts have all statistics zero and get the score
of such a text; rows without a label are scored, not learnt from; a document with
several labels counts once for each; labels other than 0 and 1 and null ids are
not learnt from; with no labels at all the score is 0.5, with one class only its
smoothed share.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

MAX_LABELLED = 20_000
STATISTICS = (
    "log_words", "mean_word", "sd_word", "longest_word", "upper_share", "digit_share", "symbol_share", "punct_share",
    "bang_per_word", "stop_per_word", "bar_per_word", "distinct_share", "top_word_share", "repeat_pair_share", "log_lines",
    "dup_line_share", "words_per_line", "short_word_share", "nonascii_share", "char_entropy", "upper_word_share", "symbol_word_share",
)

_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"
_SYMBOL, _PUNCT = b"#*$%&|<>@^~=+_\\{}[]", b".,;:!?'\"()-"
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of one whole text."""
    data = (text or "").encode()
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    count = lambda chars: size - len(data.translate(None, chars))
    sizes = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    byte_counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    filled = byte_counts[byte_counts > 0]
    entropy = math.log2(size) - float((filled * np.log2(filled)).sum()) / size
    upper_words = sum(map(bytes.isupper, words))
    symbol_words = sum(w[-1] in _SYMBOL for w in words)
    return [
        math.log1p(n), float(sizes.mean()), float(sizes.std()), float(sizes.max()), count(_UPPER) / size, count(_DIGIT) / size,
        count(_SYMBOL) / size, count(_PUNCT) / size, data.count(b"!") / n, data.count(b".") / n, data.count(b"|") / n,
        len(seen) / n, max(seen.values()) / n, 1 - pairs / max(1, n - 1), math.log1p(len(lines)), 1 - len(set(lines)) / len(lines),
        n / len(lines), float((sizes <= 3).mean()), count(_HIGH) / size, entropy, upper_words / n, symbol_words / n,
    ]


@dataclass
class Forest:
    """Trees as complete binary trees of one depth, flattened: row t holds tree t."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for each row of ``x``."""
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, at]] > self.threshold[trees, at]
            at = 2 * at + 1 + right
        leaves = at - (2**self.depth - 1)
        return self.base + self.value[trees, leaves].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least_rows: int = 8) -> Forest:
    """Boost ``trees`` trees for the logistic loss."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), math.log(share / (1 - share)), depth)
    if len(y) < 2 or y.min() == y.max():
        return forest
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    raw = np.full(n, forest.base)
    slots = np.arange(width)[None, :] * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * bins) + slots + code).ravel()
            shape = (many, width, bins)
            g = np.bincount(cell, np.repeat(grad, width), many * width * bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(cell, np.repeat(hess, width), many * width * bins).reshape(shape).cumsum(axis=2)
            c = np.bincount(cell, minlength=many * width * bins).reshape(shape).cumsum(axis=2)
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(c < least_rows) | (ct - c < least_rows)] = 0
            flat = gain.reshape(many, -1)
            best = flat.argmax(axis=1)
            for k in range(many):
                j, b = divmod(int(best[k]), bins)
                if flat[k, best[k]] > 1e-9 and b < len(cuts[j]):
                    forest.feature[t, first + k], forest.threshold[t, first + k] = j, cuts[j][b]
            right = x[np.arange(n), forest.feature[t, node]] > forest.threshold[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        forest.value[t] = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + l2)
        raw += forest.value[t][leaf]
    return forest


def document_statistics(docs: DataFrame, text: str = "text") -> Column:
    """STATISTICS of a text column, as ``array<float>``."""

    @F.pandas_udf("array<float>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.array(statistics(t), np.float32) for t in texts], dtype=object)

    return stats(F.col(text))


def labelled_sample(labels: DataFrame, label: str, learn: Column, most: int = MAX_LABELLED) -> DataFrame:
    """At most ``most`` rows (doc_id, label): those that ``learn`` holds for, by least hash of the id.

    The hashes are cut at a share that leaves hardly more than ``most`` rows before they are sorted.
    """
    rows = labels.where(learn).select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    return least_hashed(rows, F.xxhash64("doc_id"), ["doc_id", "label"], most, rows.count())


def least_hashed(rows: DataFrame, hashed: Column, ties: list[str], most: int, n: int) -> DataFrame:
    """The ``most`` of ``n`` rows with the least signed 64-bit hash; each task sorts about its share of them only."""
    share = (most + 10 * math.sqrt(most)) / max(1, n)
    if share < 1:
        rows = rows.where(hashed <= F.lit(int(share * 2**64) - 2**63))
    return rows.orderBy(hashed, *ties).limit(most)


def fit(stats: DataFrame, sample: DataFrame, **options) -> Forest:
    """Grow a forest; ``stats`` has doc_id and stats, ``sample`` doc_id and label (bounded); an id counts once for each label."""
    rows = stats.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("stats").alias("stats")).toPandas().sort_values(["doc_id", "label"])
    x = np.array(rows["stats"].tolist(), np.float32).reshape(-1, len(STATISTICS))
    return grow(x, rows["label"].to_numpy(np.float64), **options)


def score(stats: Column | str, forest: Forest) -> Column:
    """The forest's probability for each row of statistics."""

    @F.pandas_udf("double")
    def scores(rows: pd.Series) -> pd.Series:
        x = np.array(rows.tolist(), np.float32).reshape(-1, len(STATISTICS))
        return pd.Series(forest.score(x))

    return scores(stats)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality") -> DataFrame:
    """doc_id and score of every document; ``held_out`` (over doc_id) marks labels not learnt."""
    stats = staged(docs.select("doc_id", document_statistics(docs).alias("stats")), "statistics")
    forest = fit(stats, labelled_sample(labels, label, F.coalesce(~held_out, F.lit(False))))
    return stats.select("doc_id", score("stats", forest).alias("score"))
