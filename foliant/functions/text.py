"""Text functions as Column expressions.

Word characters are spelled ``[\\p{L}\\p{N}_]``: the JVM's ``\\w`` is ASCII only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
TERM = r"[a-z0-9][\p{L}\p{N}_-]*"
HASH_WORD = r"[a-z0-9]+"
PROSE_WORD = r"[a-z]{3,}"
ROUTE_WORD = r"[a-z][\p{L}\p{N}_-]*"
SENTENCE_END = r"(?<=[.!?])\s+"

#: Values that a task turns into its results at a time.
SLICE = 128

#: Stop words of prose cohesion, of the lexical reranker and of groundedness.
COHESION_STOP = (
    "the and for are but not you all any can had her was one our out day get has him "
    "his how man new now old see two way who its did yet with this that from they "
    "have will your which their there been more when were what said each she may use "
    "than them these some would other into only could most also after first"
).split()
RERANK_STOP = (
    "the a an and or of to in for on at by is are was were be do does how what "
    "when where why who which with from that this these those i you we they it"
).split()
GROUNDED_STOP = (
    "the a an and or of to in for on at by is are was were be been do does did "
    "how what when where why who which with from that this these those it its "
    "as not no can could would should will may might have has had you your we "
    "our they their he she his her most relevant passages extractive mode "
    "configure llm api key synthesized answers based indexed documents"
).split()
MEMORY_WORD = TERM


def slices(batches: Iterator) -> Iterator:
    """Arrow batches (a series, or a tuple of them) in runs of at most ``SLICE`` values.

    A batch may hold ten thousand texts; what Python makes of them, many times their size, is held for one run only.
    """
    for batch in batches:
        many = isinstance(batch, tuple)
        for first in range(0, len(batch[0] if many else batch), SLICE):
            yield tuple(b.iloc[first : first + SLICE] for b in batch) if many else batch.iloc[first : first + SLICE]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract(c: Column | str, pattern: str) -> Column:
    """All matches of a pattern, in order; null gives []."""
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(pattern), F.lit(0))


def tokens(c: Column | str) -> Column:
    """Runs of word characters and single other marks."""
    return extract(c, TOKEN)


def token_count(c: Column | str) -> Column:
    return F.coalesce(F.regexp_count(col(c), F.lit(TOKEN)), F.lit(0))


def terms(c: Column | str) -> Column:
    """Index terms: lower-case words, digits and hyphens inside."""
    return extract(F.lower(col(c)), TERM)


def without(words: Column, stop: list[str]) -> Column:
    """Words not in a list, repeats kept."""
    listed = F.array(*[F.lit(w) for w in stop])
    return F.filter(words, lambda w: ~F.array_contains(listed, w))


def cohesion_words(c: Column | str) -> Column:
    return F.array_distinct(without(extract(F.lower(col(c)), PROSE_WORD), COHESION_STOP))


def grounded_words(c: Column | str) -> Column:
    """Distinct content words of a claim or a source: three characters or more."""
    return F.array_distinct(F.filter(without(terms(c), GROUNDED_STOP), lambda w: F.char_length(w) > 2))


def sentences(c: Column | str) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by space."""
    return F.split(col(c), SENTENCE_END)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word sets; 1 if either is empty (no evidence of a shift)."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bigrams(words: Column) -> Column:
    """Adjacent pairs, joined by a space."""

    def pairs(w: Column) -> Column:
        n = F.size(w)
        made = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
        return F.when(n < 2, F.array().cast("array<string>")).otherwise(made)

    return let(words, pairs)


def shingles(words: Column, k: int = 5) -> Column:
    """Distinct runs of k words; fewer words give one run of them all, none give none."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        made = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(made))

    return let(words, runs)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def unwrap_lines(c: Column | str) -> Column:
    """Unix line ends, and words broken by a hyphen at a line's end joined."""
    unix = F.regexp_replace(col(c), "\r\n?", "\n")
    return F.regexp_replace(unix, r"([\p{L}\p{N}_])-[ \t]*\n[ \t]*([\p{L}\p{N}_])", "$1$2")


#: Quotes, dashes and non-breaking spaces with their plain forms; what is left over (soft hyphen, zero-width) goes.
ODD_MARKS = "\u201c\u201d\u201e\u00ab\u00bb\u2018\u2019\u201a\u2013\u2014\u2015\u2212\u00a0\u2007\u202f\u00ad\u200b\u200c\u200d\ufeff"
PLAIN_MARKS = "\"\"\"\"\"'''----   "


def tidy(c: Column | str) -> Column:
    """Plain quotes and dashes, no control or zero-width characters, single spaces, at most one blank line."""
    out = F.translate(col(c), ODD_MARKS, PLAIN_MARKS)
    out = F.replace(out, F.lit("…"), F.lit("..."))
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"(?m)^[ \t]+|[ \t]+$", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def normalize_text(c: Column | str) -> Column:
    """All of the above around NFKC; meaning is kept."""
    return tidy(nfkc(unwrap_lines(c)))


def fold(c: Column | str) -> Column:
    """What exact duplicates have in common: case and spacing aside."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def line_fingerprint(c: Column | str) -> Column:
    """A line with digit runs masked, so that page counters agree."""
    return F.regexp_replace(F.lower(F.trim(col(c))), "[0-9]+", "#")


def safe_filename(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}_.\- ]", "_")


def stem(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(col(c), r"([^/\\]*)$", 1), r"(.)\.[^.]*$", "$1")


def suffix(c: Column | str) -> Column:
    """Lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(col(c), r"[^/\\](\.[^./\\]*)$", 1))


#: Media types by extension.
MIME = {
    ".pdf": "application/pdf", ".txt": "text/plain", ".md": "text/markdown", ".log": "text/plain", ".html": "text/html", ".htm": "text/html",
    ".csv": "text/csv", ".tsv": "text/tab-separated-values", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".tif": "image/tiff", ".tiff": "image/tiff",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}


def mime_type(c: Column | str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.element_at(pairs, suffix(c))


def citations(c: Column | str) -> Column:
    """Distinct numbers cited as [n], in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\[([0-9]{1,3})\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: n.cast("int")))


def frames(c: Column | str, words: int = 4) -> Column:
    """A text in pieces of a few words; all but the last end in a space."""
    split = F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w != "")

    def cut(w: Column) -> Column:
        n = F.size(w)
        piece = lambda i: F.concat(F.array_join(F.slice(w, i, words), " "), F.when(i + words <= n, " ").otherwise(""))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(words)), piece))

    return let(split, cut)


def json_value(c: Column | str) -> Column:
    """The JSON in a model's reply: all of it, a fenced block, or the first bracketed span."""
    text = F.trim(col(c))
    fenced = F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1))
    span = F.regexp_extract(text, r"(?s)([{\[].*[}\]])", 1)
    parse = lambda x: F.to_json(F.try_parse_json(F.when(F.length(x) > 0, x)))
    return F.coalesce(parse(text), parse(fenced), parse(span))
