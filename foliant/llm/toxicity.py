"""Toxicity: a counterfactual-regularised linear classifier.

Features are the distinct lower-cased words of a text and the four- to six-letter
beginnings of its longer words (inflected forms share them): those whose share of
toxic texts lies clearly above or below the prior, and always the identity terms of
``IDENTITY_TERMS``.  A logistic model over them is fitted to labelled texts, each of
which has a counterfactual pair.  A text that mentions an identity group is paired
with itself, its identity terms swapped for others of the same axis.  A text that
mentions none is paired by template: a neutral mention of a term, chosen by a hash
of the id, is put in, and that of the term's counterpart in the other one; the
mention must not change the score of the text without it either.  The loss adds
``fairness`` times the mean squared change of the logit within pairs.  A term's own
weight, and that of its beginnings, is so pulled to that of its counterparts and,
where texts of both labels say it, to none, and neutral mentions of a group stop
raising the score.

Fitting takes at most ``MAX_LABELLED`` labelled rows (least hash of the id), which
bounds what the driver holds: features of those texts alone.  Scoring is a map over
whole texts.

Defined results: null and empty texts score the model's bias; rows without a
label are scored, not learnt from; null ids and labels other than 0 and 1 are not
learnt from; a repeated id is learnt from once for each label, by its least text;
without labels of both classes no feature has weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gbdt import labelled_sample
from .staging import held_by_worker, staged

MAX_LABELLED = 20_000
#: Standard errors by which a feature's share of toxic texts must differ from the prior.
LEAST_Z = 4.0
CACHE_ENTRIES = 200_000
#: Longer words are rarely met again and not remembered.
CACHE_CHARS = 40

#: Terms of one axis stand in for one another, each for the next.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("mother", "father"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "natives"), ("immigrant", "native"), ("african", "european", "american"), ("young", "old"), ("disabled", "abled"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"), ("immigrés", "natifs"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "inländer"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"), ("inmigrantes", "nativos"),
)
_TERMS = tuple(term for axis in IDENTITY_TERMS for term in axis)
SWAPS = {term: axis[(i + 1) % len(axis)] for axis in IDENTITY_TERMS for i, term in enumerate(axis)}

_WORD = regex.compile(r"[\p{L}\p{N}_]+")


def words_of(text: str | None) -> set[str]:
    """Distinct words of a text."""
    return set(_WORD.findall(text.lower())) if text else set()


def word_features(word: str) -> tuple[str, ...]:
    """The word and, marked, its beginnings."""
    return (word, *(f"{word[:k]}~" for k in range(4, min(7, len(word)))))


IDENTITY_FEATURES = frozenset(f for term in SWAPS for f in word_features(term))


def features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def swapped(words: set[str]) -> set[str]:
    """The words with every identity term exchanged for its counterpart."""
    return {SWAPS.get(w, w) for w in words}


def pairs_of(words: set[str], pick: int) -> list[tuple[set[str], set[str]]]:
    """Counterfactual pairs of a text's words, as the features that only one side has.

    ``pick`` chooses the term of the template for words without any.
    """
    if not words.isdisjoint(SWAPS):
        own, twin = features(words), features(swapped(words))
        return [(own - twin, twin - own)]
    term, own = _TERMS[pick % len(_TERMS)], features(words)
    said, other = features({term}) - own, features({SWAPS[term]}) - own
    return [(said - other, other - said), (said, set())]


class Model:
    """Weights of features; a text's logit is the bias plus those of its distinct features."""

    def __init__(self, bias: float, weights: dict[str, float], pairs: int = 0) -> None:
        self.bias, self.weights, self.pairs = bias, weights, pairs
        self.cache: dict[str, tuple[str, ...]] = {}

    def known(self, word: str) -> tuple[str, ...]:
        found = tuple(f for f in word_features(word) if f in self.weights)
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[word] = found
        return found

    def score_words(self, words: set[str]) -> float:
        cache, met = self.cache, set()
        for w in words:
            found = cache.get(w)
            if found is None:
                found = self.known(w)
            if found:
                met.update(found)
        logit = self.bias + sum(self.weights[f] for f in sorted(met))
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    def score(self, text: str | None) -> float:
        return self.score_words(words_of(text))

    def swap_gap(self, text: str | None) -> float:
        """How far the score moves when the text's identity terms are swapped."""
        words = words_of(text)
        return abs(self.score_words(words) - self.score_words(swapped(words)))


def train(rows: list[tuple[int, list[int], list[tuple[list[int], list[int]]]]], width: int, fairness: float = 1.0, l2: float = 1e-3, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights from (label, features, pairs of features that differ).

    Accelerated gradient descent on the mean log loss plus ``l2`` and the
    counterfactual penalty, both classes weighing as they occur.
    """
    y = np.array([r[0] for r in rows], np.float64)
    n, w = max(1, len(rows)), np.zeros(width)
    b = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if len(y) == 0 or y.min() == y.max():
        return b, w
    size = np.array([len(r[1]) for r in rows])
    row, col = np.repeat(np.arange(len(rows)), size), np.array([f for r in rows for f in r[1]], np.int64)
    pairs = [p for r in rows for p in r[2] if p[0] or p[1]]
    change = [(i, f, sign) for i, p in enumerate(pairs) for fs, sign in ((p[0], 1.0), (p[1], -1.0)) for f in fs]
    c_row, c_col = np.array([c[0] for c in change], np.int64), np.array([c[1] for c in change], np.int64)
    c_sign, most = np.array([c[2] for c in change]), max((len(p[0]) + len(p[1]) for p in pairs), default=1)
    # each feature has its own step, by its share of rows
    curve = np.bincount(col, minlength=width) / n * 0.25 * max(1.0, float(np.median(size))) + l2 + 1e-4
    curve += 2 * fairness * np.bincount(c_col, minlength=width) / n * most
    v, v_b, w_old, b_old = w.copy(), b, w.copy(), b
    for k in range(steps):
        logit = v_b + np.bincount(row, v[col], len(rows))
        off = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n
        grad = np.bincount(col, off[row], width) + l2 * v
        if len(change):
            moved = np.bincount(c_row, c_sign * v[c_col], len(pairs))
            grad += 2 * fairness / n * np.bincount(c_col, c_sign * moved[c_row], width)
        w, b = v - grad / curve, v_b - off.sum() / 0.5
        momentum = k / (k + 3)
        v, v_b = w + momentum * (w - w_old), b + momentum * (b - b_old)
        w_old, b_old = w, b
    return b, w


_SEEN = "doc_id string, label int, own array<string>, plus array<array<string>>, minus array<array<string>>"
_INDEXED = "doc_id string, label int, own array<int>, plus array<array<int>>, minus array<array<int>>"


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", text: str = "text", fairness: float = 1.0, least: int = 3) -> Model:
    """Fit to the labels that ``held_out`` (over doc_id) does not hold for."""
    sample = labelled_sample(labels, label, F.coalesce(~held_out, F.lit(False)), MAX_LABELLED)
    texts = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [words_of(t) for t in batch["text"]]
            found = [pairs_of(w, zlib.crc32(i.encode())) for w, i in zip(words, batch["doc_id"], strict=True)]
            sides = [[[sorted(p[side]) for p in pairs] for pairs in found] for side in (0, 1)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "own": [sorted(features(w)) for w in words], "plus": sides[0], "minus": sides[1]})

    seen = staged(texts.select(F.col("doc_id").cast("string").alias("doc_id"), "label", "text").mapInPandas(sets, _SEEN), "toxicity")
    totals = seen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    prior = (totals.pos + 0.5) / (totals.n + 1)
    counted = seen.select("label", F.explode("own").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    # how far a feature's share of toxic texts lies from the prior, in standard errors
    telling = F.abs(F.col("pos") - F.col("n") * prior) / F.sqrt(F.col("n") * prior * (1 - prior))
    chosen = {r.f for r in counted.where((F.col("n") >= least) & (telling >= LEAST_Z)).select("f").collect()}
    vocabulary = {f: i for i, f in enumerate(sorted(chosen | IDENTITY_FEATURES))}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        known = lambda fs: [index[f] for f in fs if f in index]
        for batch in batches:
            sides = {s: [[known(fs) for fs in pairs] for pairs in batch[s]] for s in ("plus", "minus")}
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "own": [known(fs) for fs in batch["own"]], **sides})

    rows = seen.mapInPandas(indexed, _INDEXED).collect()
    rows.sort(key=lambda r: (r.doc_id, r.label))
    bias, weights = train([(r.label, r.own, list(zip(r.plus, r.minus, strict=True))) for r in rows], len(vocabulary), fairness)
    pairs = sum(bool(p or m) for r in rows for p, m in zip(r.plus, r.minus, strict=True))
    return Model(bias, {f: float(weights[i]) for f, i in vocabulary.items() if abs(weights[i]) > 1e-4}, pairs)


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The model's probability for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bias, weights = shared.value
        scorer = held_by_worker(("toxicity", bias, hash(frozenset(weights.items()))), lambda: Model(bias, weights))
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return scores(F.col(text))
