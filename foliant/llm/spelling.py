"""Spelling variants: words one edit apart, each led to the more frequent form.

Words are maximal runs of Latin letters (``[A-Za-z\\u00C0-\\u00FF]+``), A-Z lower-cased,
counted over whole texts.  ``runs`` counts within tasks first, so a frequent word is
a row or few per task when it is shuffled.

Near words: a word's mask has a bit for each letter that occurs an odd number of times,
in three bands of 21 bits (a letter's code point modulo 3 names its band).  A
replacement flips two bits or none, so a band at least is equal: words of one length
with an equal band meet.  An insertion or deletion flips one bit, so two bands are
equal: words with two equal bands and lengths that differ by one meet.  Rows are brought
together by band and length and sorted; in each group arrays of masks are compared, pairs with at
most two flipped bits are verified letter by letter, and only true pairs leave.  A
pair is given by its first equal band, so it appears once.  Groups with more than
``BUCKET`` words are dealt over buckets: a word lies in one of them and is compared in
others, in blocks, so a task holds one bucket and one block.

Forms: a word's form is its near word of largest count, if that is at least ``LEAD``
times its own; roots are found by doubling the steps along forms, whose counts grow
at each step, so that there are no circles and a root is reached in few rounds.

Defined results: null and empty texts have no words; a null id is the empty string in
what decides the planted deletions of the query; repeated rows count each; an empty table
gives no rows; other columns are neither read nor needed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .staging import staged

RUN = re.compile("[a-zÀ-ÿ]+")
#: Different words that a task counts before it passes the counts on; words in a bucket of a join key.
HELD, BUCKET = 200_000, 2048
#: Bits of a band; pairs of masks, or letters of pairs, that are compared at once.
BAND, CELLS, BLOCK_CELLS = 21, 1 << 20, 1 << 17
#: Pairs of a group from which it is compared by itself.
LARGE = 1 << 11
#: How often a form must be as frequent as the word that it leads.
LEAD = 2


def misspelt(doc_id: str, run: str, one_in: int = 97) -> str:
    """``run`` with a letter deleted, in one case of ``one_in``, decided by a checksum of id and run."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", one_in: int = 97, least_length: int = 5) -> DataFrame:
    """(word, n): the words of ``least_length`` letters or more with their counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for at in range(batch.num_rows):
                id_, said = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                if not said:
                    continue
                for run, n in Counter(RUN.findall(said.encode().lower().decode())).items():  # lower() of bytes: A-Z alone
                    word = misspelt(id_ or "", run, one_in)
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > HELD:
                    yield rows()
                    total.clear()
        yield rows()

    said = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("t")).where("t <> ''")
    return said.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@F.pandas_udf(LongType())
def parity_mask(words: pd.Series) -> pd.Series:
    """A word's letter parities: code point c is bit c div 3 mod 21 of band c mod 3."""
    bit = [1 << (BAND * (c % 3) + c // 3 % BAND) for c in range(256)]

    def mask(word: str) -> int:
        out = 0
        for c in word:
            out ^= bit[ord(c)]
        return out

    return pd.Series([mask(w) for w in words], dtype="int64")


def _letters(words: np.ndarray, length: int) -> np.ndarray:
    """A row of code points for each word of this length."""
    return words.astype(f"<U{length}").view(np.uint32).reshape(len(words), length)


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of ``long`` are those of ``short`` with one letter more."""
    n = short.shape[1]
    never = np.zeros((len(short), 1), bool)
    before = np.argmin(np.hstack([short == long[:, :n], never]), axis=1)
    after = np.argmin(np.hstack([(short == long[:, 1:])[:, ::-1], never]), axis=1)
    return before + after >= n


def _alike(i: np.ndarray, j: np.ndarray, rows: dict) -> np.ndarray:
    """Which pairs of rows (index i, probe j) have few enough flipped bits, in no earlier band than theirs."""
    flips, longer, band = rows["mask"][i] ^ rows["mask"][j], rows["longer"][i] == 1, rows["band"][i]
    meets = np.bitwise_count(flips) <= np.where(longer, 1, 2)
    for k in range(2):
        meets &= longer | (band <= k) | ((flips >> np.int64(BAND * k)) & np.int64((1 << BAND) - 1) != 0)
    return meets & (longer | (rows["rank"][j] > rows["rank"][i]))


def _few(groups: np.ndarray, rows: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Alike pairs of many small groups (start, first probe, end) at once."""
    start, probe, end = groups.T
    cells = (probe - start) * (end - probe)
    for part in np.split(np.arange(len(groups)), np.flatnonzero(np.diff(np.cumsum(cells) // CELLS)) + 1):
        n, across = cells[part], (end - probe)[part]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        across = np.repeat(across, n)
        i, j = np.repeat(start[part], n) + at // across, np.repeat(probe[part], n) + at % across
        held = _alike(i, j, rows)
        yield i[held], j[held]


def _codes(rows: dict) -> np.ndarray:
    """32 bits of what may differ within a row's group: two bands side by side (their seldom ends on one another), or the one that isn't equal."""
    value = lambda k: rows["mask"] >> (BAND * k) & np.int64((1 << BAND) - 1)
    bands = np.stack([value(k) for k in (0, 1, 2)])
    at, here = rows["band"], np.arange(len(rows["band"]))
    both = bands[(at + 1) % 3, here] ^ (bands[(at + 2) % 3, here] << 11)
    return np.where(rows["longer"] == 1, bands[at, here], both).astype(np.uint32)


def _many(start: int, probe: int, end: int, rows: dict, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Alike pairs of one large group, block by block; words of one length are compared with those of lower rank."""
    own, longer, one = codes[start:probe], rows["longer"][start] == 1, np.uint32(1)
    step = max(1, BLOCK_CELLS // len(own))
    for at in range(probe, end, step):
        upto = min(end, at + step)
        n = len(own) if longer else int(np.searchsorted(rows["rank"][start:probe], rows["rank"][upto - 1]))
        if not n:
            continue
        flips = codes[at:upto, None] ^ own[None, :n]
        flips &= flips - one  # the lowest bit goes
        if not longer:
            flips &= flips - one
        j, i = np.divmod(np.flatnonzero(flips == 0), n)
        held = _alike(i + start, j + at, rows)
        yield i[held] + start, j[held] + at


def _verified(i: np.ndarray, j: np.ndarray, rows: dict, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs that are one edit apart."""
    kind = rows["size"][i] * 2 + rows["longer"][i]
    for which in np.unique(kind).tolist():
        size, longer = divmod(which, 2)
        mine = np.flatnonzero(kind == which)
        for at in range(0, len(mine), many := max(1, CELLS // size)):
            x, y = i[mine[at : at + many]], j[mine[at : at + many]]
            own, other = _letters(words[x], size), _letters(words[y], size + longer)
            held = inserted(own, other) if longer else replaced(own, other)
            if held.any():
                yield x[held], y[held]


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n), both ways: the words that one insertion, deletion or replacement of a letter tells apart."""
    rows = staged(words.select("word", "n", F.char_length("word").alias("len"), parity_mask("word").alias("mask"), F.xxhash64("word").bitwiseAND(F.lit((1 << 63) - 1)).alias("rank")), "masks")
    value = lambda k: F.shiftright("mask", BAND * k).bitwiseAND(F.lit((1 << BAND) - 1))
    one = lambda side: [F.struct(F.lit(0).alias("longer"), F.lit(k).alias("band"), value(k).alias("value"), F.col("len").alias("size"), F.lit(side).alias("side")) for k in range(3)]
    two = lambda side: [F.struct(F.lit(1).alias("longer"), F.lit(k).alias("band"), F.shiftleft(value((k + 1) % 3), BAND).bitwiseOR(value((k + 2) % 3)).alias("value"), (F.col("len") - side).alias("size"), F.lit(side).alias("side")) for k in range(3)]
    fields, place = ["word", "n", "mask", "rank"], ["value", "longer", "band", "size"]
    index = rows.select(*fields, F.explode(F.array(*one(0), *two(0))).alias("k")).select(*fields, "k.*")
    probe = rows.select(*fields, F.explode(F.array(*one(1), *two(1))).alias("k")).select(*fields, "k.*")
    parts = staged(index.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("parts")), "parts")
    many = parts.where("parts > 1")
    # a bucket is a range of ranks: words of one length are compared with buckets up to their own
    own = F.coalesce(F.shiftright(F.shiftright("rank", 32) * F.col("parts"), 31).cast("int"), F.lit(0))
    index = index.join(many, place, "left").withColumn("bucket", own).drop("parts")
    last = F.when(F.col("longer") == 1, F.coalesce("parts", F.lit(1)) - 1).otherwise(own)
    probe = probe.join(many, place, "left").withColumn("bucket", F.explode(F.sequence(F.lit(0), last))).drop("parts")
    met = index.unionByName(probe).repartition(*place, "bucket").sortWithinPartitions(*place, "bucket", "side", "rank")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n", "mask", "rank", *place, "bucket", "side")
        kept = None  # the words of the bucket that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in names}
            words = np.array(batch.column("word").to_pylist(), object)
            if kept:
                rows, words = {c: np.concatenate([kept[0][c], rows[c]]) for c in names}, np.concatenate([kept[1], words])
            marks = np.stack([rows[c] for c in (*place, "bucket")])
            starts = np.concatenate(([0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1))
            ends = np.append(starts[1:], len(words))
            before = np.concatenate(([0], np.cumsum(rows["side"] == 0)))
            probes = starts + before[ends] - before[starts]
            kept = ({c: rows[c][starts[-1] : probes[-1]] for c in names}, words[starts[-1] : probes[-1]])
            groups = np.stack([starts, probes, ends], axis=1)[(probes > starts) & (ends > probes)]
            large = (groups[:, 1] - groups[:, 0]) * (groups[:, 2] - groups[:, 1]) > LARGE
            codes = _codes(rows) if large.any() else None
            alike = chain(_few(groups[~large], rows) if (~large).any() else (), *(_many(*g, rows, codes) for g in groups[large].tolist()))
            for x, y in ((x, y) for i, j in alike for x, y in _verified(i, j, rows, words)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((words[x], words[y]), (words[y], words[x]), (rows["n"][y], rows["n"][x]))], names=["word", "other", "other_n"])

    return met.mapInArrow(compared, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; ``forms`` has word and form, without circles."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, one_in: int = 97) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = staged(runs(docs, doc_id, text, one_in, least_length).where(F.col("n") >= least_count), "words")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    leads = -F.col("best.less") >= LEAD * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best.form")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n"))
    found = staged(found, "forms")
    return found.join(roots(found.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
