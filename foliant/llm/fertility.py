"""Quality rules from tokeniser fertility, with counting rules as a base.

Base: words are runs of ``[^\\x20\\x09-\\x0D]``.  A text fails the base with fewer
than 50 words, or if over half of its words lie in three-word windows that occur
twice or more.

Fertility: two public vocabularies tokenise the whole text, white space included.
The byte-level one gives characters per token and the entropy of the token
distribution; the one with byte fallback gives the share of its tokens that are
single bytes.  A text that passes the base is rejected if a measure leaves the band
of its dominant script and its language.

Bands: ``fit_bands`` sets them from all texts labelled clean that pass the base:
outer quantiles with a margin, by a distributed aggregate (an id counts once).
Entropy grows with a text's length, so it has a band for each class of lengths
(half octaves of words).  A language (or one of its classes) with fewer than
``LEAST_TEXTS`` such texts takes its script's bands, as do all but the ``MAX_BANDS``
most frequent pairs of script and language; a script with fewer takes the wide ones
of ``BANDS``, as all do without labels.

Defined results: null and empty texts have no words and fail the base; whole
texts are measured (those above ``PART`` characters in parts cut before a space);
repeated rows measure alike; a text without letters has script ``other``; a null
language takes its script's bands; empty tables give no rows and the wide bands.
"""

from __future__ import annotations

import base64
import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import held_by_worker, staged

#: (characters per token from, to; byte-fallback share up to; bits of token entropy from) by script.
#: Wide on purpose: what they reject is text that hardly any language produces.
BANDS = {
    "latin": (1.3, 12.0, 0.20, 4.8),
    "cyrillic": (0.5, 8.0, 0.50, 3.0),
    "greek": (0.4, 8.0, 0.60, 3.0),
    "arabic": (0.4, 8.0, 0.60, 3.0),
    "hebrew": (0.4, 8.0, 0.60, 3.0),
    "indic": (0.2, 8.0, 0.90, 2.5),
    "cjk": (0.25, 6.0, 0.90, 3.0),
    "other": (0.2, 12.0, 0.95, 2.5),
}

#: First and last code point of each script's main blocks.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "indic": ((0x900, 0xDFF),),
    "cjk": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF)),
}

#: Fewest clean texts for a band of their own; most pairs of script and language with bands.
LEAST_TEXTS = 100
MAX_BANDS = 1000
#: Share of clean texts beyond each end of a band, and the margin added there, relative to the median.
OUTER, MARGIN = 0.005, 0.02
#: Margin of the byte-fallback share.
BYTE_MARGIN = 0.02

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Characters tokenised at once, so that a very long text is measured in bounded memory.
PART = 1 << 20

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, chars_per_token double, byte_share double, token_entropy double"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    pairs = w[:-1] * len(ids) + w[1:]
    if len(ids) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(ids) + w[2:]
    _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if counts.max() < 2:
        return 0
    hit = counts[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def dominant_script(text: str) -> str:
    """The script of most letters; ``latin`` if any of its letters lead, ``other`` without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text[:256])) or any(map(str.isalpha, text)) else "other"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    best = max((sum(int(((points >= a) & (points <= b)).sum()) for a, b in blocks), name) for name, blocks in SCRIPTS.items())
    return best[1] if best[0] else "other"


class Tokenizers:
    """The two vocabularies of one worker process."""

    def __init__(self, rank_file: bytes, pattern: str, pieces: bytes) -> None:
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.bpe = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.single = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    def fertility(self, text: str) -> tuple[float, float, float]:
        """Characters per token, byte-fallback share and bits of token entropy of a text that isn't empty."""
        found, n_pieces, n_bytes = [], 0, 0
        for part in parts(text):
            found.append(np.unique(self.bpe.encode_to_numpy(part, disallowed_special=()), return_counts=True))
            pieces = self.pieces.encode_as_numpy(part)
            n_pieces += len(pieces)
            n_bytes += int(self.single[pieces].sum())
        if len(found) == 1:
            filled = found[0][1]
        else:
            counts = np.bincount(np.concatenate([ids for ids, _ in found]), np.concatenate([n for _, n in found]))
            filled = counts[counts > 0]
        total = int(filled.sum())
        entropy = math.log2(total) - float((filled * np.log2(filled)).sum()) / total
        return len(text) / total, n_bytes / max(1, n_pieces), max(0.0, entropy)


def parts(text: str, most: int = PART) -> Iterator[str]:
    """A text in parts of about ``most`` characters, cut before a space where there is one."""
    at = 0
    while len(text) - at > most:
        cut = text.rfind(" ", at + 1, at + most)
        cut = at + most if cut < 0 else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


def length_class(n_words: int) -> int:
    """Half octaves of a number of words."""
    return int(2 * math.log2(n_words)) if n_words else 0


def measure(text: str | None, tokens: Tokenizers, min_words: int = MIN_WORDS) -> tuple:
    """One row of FIELDS for a text."""
    if not text:
        return (0, 0, 0, 0, 0, True, "other", 0.0, 0.0, 0.0)
    data = text.encode()
    words = data.split()
    n = len(words)
    spaces = len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeats = repeat_words(words)
    failed = n < min_words or 100 * repeats > 50 * n
    return (n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeats, failed, dominant_script(text), *tokens.fertility(text))


def measures(spark: SparkSession, text: Column | str, rank_path: str, pattern: str, piece_path: str, min_words: int = MIN_WORDS) -> Column:
    """A struct column of FIELDS.  Both vocabularies (about 1 MB each, files of fixed size) are broadcast."""
    with open(rank_path, "rb") as f, open(piece_path, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read()))

    @F.pandas_udf(FIELDS)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranks, pieces = shared.value
        tokens = held_by_worker(("fertility", hash(ranks), hash(pieces), pattern), lambda: Tokenizers(ranks, pattern, pieces))
        for texts in batches:
            yield pd.DataFrame([measure(t, tokens, min_words) for t in texts], columns=NAMES)

    return measured(text)


class Bands:
    """Wide bands by script, and what was fitted by (script, language) or (script, None).

    A fitted band is (characters per token from, to; byte-fallback share up to; rows
    of (length class, bits from, to)).
    """

    def __init__(self, fitted: dict[tuple, tuple] | None = None, wide: dict[str, tuple] = BANDS) -> None:
        self.fitted, self.wide = fitted or {}, wide

    def hold(self, script: str, lang: str | None, n_words: int, per_token: float, share: float, entropy: float) -> bool:
        """Whether the bands of a script and language hold the measures.

        A class of lengths without a band is bounded by the next shorter one from below
        and by the next longer one from above, as entropy grows with length.
        """
        low, high, most_bytes, least_bits = self.wide[script]
        if not (low <= per_token <= high and share <= most_bytes and entropy >= least_bits):
            return False
        band = self.fitted.get((script, lang)) or self.fitted.get((script, None))
        if band is None:
            return True
        low, high, most_bytes, bits = band
        if not low <= per_token <= high or share > most_bytes:
            return False
        sizes, size = [b[0] for b in bits], length_class(n_words)
        shorter, longer = bisect.bisect_right(sizes, size) - 1, bisect.bisect_left(sizes, size)
        return (shorter < 0 or entropy >= bits[shorter][1]) and (longer == len(bits) or entropy <= bits[longer][2])

    def kept(self, measured: Column, lang: Column | None = None) -> Column:
        """Whether a text passes the base and its bands, from a struct of FIELDS: lookups in constant maps, as in ``hold``."""
        script, per_token, share, entropy = (measured[c] for c in ("script", "chars_per_token", "byte_share", "token_entropy"))
        wide = _constant_map({k: F.struct(*[F.lit(float(x)).alias(f"x{i}") for i, x in enumerate(v)]) for k, v in self.wide.items()})[script]
        passes = per_token.between(wide["x0"], wide["x1"]) & (share <= wide["x2"]) & (entropy >= wide["x3"])
        if self.fitted:
            rows = lambda bits: F.array(*[F.struct(F.lit(s).alias("size"), F.lit(x).alias("low"), F.lit(y).alias("high")) for s, x, y in bits]).cast("array<struct<size:int,low:double,high:double>>")
            fitted = {f"{k}\x01{g or ''}": F.struct(F.lit(v[0]).alias("low"), F.lit(v[1]).alias("high"), F.lit(v[2]).alias("share"), rows(v[3]).alias("bits")) for (k, g), v in self.fitted.items()}
            named = lambda g: F.concat(script, F.lit("\x01"), g)
            table = _constant_map(fitted)
            own = F.lit(None).cast("string") if lang is None else F.nullif(lang.cast("string"), F.lit(""))
            band = F.coalesce(table[named(own)], table[named(F.lit(""))])
            size = F.when(measured["n_words"] > 0, F.floor(2 * F.log2(measured["n_words"]))).otherwise(0)
            shorter, longer = F.filter(band["bits"], lambda b: b["size"] <= size), F.filter(band["bits"], lambda b: b["size"] >= size)
            fits = per_token.between(band["low"], band["high"]) & (share <= band["share"])
            fits &= (F.size(shorter) == 0) | (entropy >= F.try_element_at(shorter, F.lit(-1))["low"])
            fits &= (F.size(longer) == 0) | (entropy <= F.try_element_at(longer, F.lit(1))["high"])
            passes &= band.isNull() | fits
        return F.coalesce(~measured["base_failed"] & passes, F.lit(False))


def _constant_map(entries: dict[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in entries]), F.array(*entries.values()))


def fit_bands(measured: DataFrame, labels: DataFrame, label: str = "quality", least: int = LEAST_TEXTS, outer: float = OUTER, margin: float = MARGIN) -> Bands:
    """Bands from the rows (doc_id, lang, m: FIELDS) that ``labels`` call clean (1) and that pass the base.

    Values are rounded to thousandths, so that a group's quantiles are exact and its
    table of counts bounded.  What comes to the driver is a row for each group of
    ``least`` texts or more of the ``MAX_BANDS`` most frequent scripts and languages.
    """
    clean = labels.where(F.col(label) == 1).select("doc_id").distinct()
    rows = measured.where("not m.base_failed").join(clean, "doc_id", "left_semi")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("m", "lang")).alias("r")).select("r.m.*", "r.lang")
    one = staged(one.select("script", F.col("lang").cast("string").alias("lang"), F.floor(2 * F.log2("n_words")).cast("int").alias("size"), *[F.round(c, 3).alias(c) for c in ("chars_per_token", "byte_share", "token_entropy")]), "clean")
    ends = lambda c: F.percentile(c, F.array(F.lit(outer), F.lit(0.5), F.lit(1 - outer))).alias(c)
    found = []
    for by in (["script"], ["script", "lang"]):
        known = one.dropna(subset=by)
        own = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ends("chars_per_token"), ends("byte_share")).where(F.col("n") >= least)
        own = own.orderBy(F.desc("n"), *by).limit(MAX_BANDS)
        bits = known.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("n"), ends("token_entropy")).where(F.col("n") >= least)
        bits = bits.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("size", "token_entropy"))).alias("bits"))
        found += own.join(bits, by, "left").collect()

    def band(values: list[float]) -> tuple[float, float]:
        low, middle, high = values
        return low - margin * abs(middle), high + margin * abs(middle)

    fitted: dict[tuple, tuple] = {}
    for r in found:
        lang = r["lang"] if "lang" in r else None
        bits = {b["size"]: (b["size"], *band(b["token_entropy"])) for b in r["bits"] or []}
        if lang is not None:
            bits = {b[0]: b for b in fitted.get((r["script"], None), (0, 0, 0, ()))[3]} | bits
        fitted[r["script"], lang] = (*band(r["chars_per_token"]), r["byte_share"][2] + BYTE_MARGIN, tuple(bits[size] for size in sorted(bits)))
    return Bands(fitted)
