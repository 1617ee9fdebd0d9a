"""SimHash near-duplicates, with candidates pruned by the pigeonring principle.

Fingerprint: text lower-cased in A-Z, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``shingle_words`` words (repeats included; fewer words give one shingle of them
all), XXH64 of each; a bit is 1 if it is set in over half of the hashes.  No words
give fingerprint zero.

Candidates: the 64 bits are ``max_distance + 1`` (at least three) segments in a ring.  If two
fingerprints differ in at most ``max_distance`` bits, some segment starts a chain
in which the first l segments together differ in at most ``l * max_distance /
segments`` bits, for every l.  So the first segment is equal and the first two
differ in one bit at most: that pair of segments is the join key (the probing side
enters it once for each such variant), and the longer chains prune what meets
there before the full Hamming check.  The search is lossless.

Groups: fingerprints that many documents share count once.  Links first go from
every fingerprint to the least one with an equal key, one row each; then the
join looks only for links between groups that are still apart.  So the links found
in a dense group stay in proportion to its size, not to its square, and none that
joins two groups is lost.

Defined results: null and empty texts have fingerprint zero and link like any
other; rows with a null id are fingerprinted but never name a group; repeated
rows are one another's copies; other columns are neither read nor needed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Shingles hashed at once; bounds the memory that a very long text takes.
CHUNK = 1 << 16
#: Edges at one end that a task of a star step takes, about.
HUB_ROWS = 4096


def shingle_hashes(text: str | None, shingle_words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, in parts of CHUNK."""
    words = text.encode().lower().split() if text else []
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(first)
    for at in range(0, n, CHUNK):
        yield np.array([digest(line[a:b], seed) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)], np.uint64)


def fingerprint_of(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashed shingles, as an unsigned integer."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle_words: int, seed: int = 42) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    return fingerprint_of(shingle_hashes(text, shingle_words, seed))


def simhash(docs: DataFrame, text: str = "text", shingle_words: int = 4) -> Column:
    """The fingerprint of a text column, as a signed long with the same bits."""

    @F.pandas_udf("bigint")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64))

    return prints(F.col(text))


def _edges(max_distance: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment, from the low end."""
    m = max(3, max_distance + 1)
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(fp: Column, edge: tuple[int, int]) -> Column:
    shift, bits = edge
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _key(fp: Column, edges: list[tuple[int, int]], start: int, flip: int | None = None) -> Column:
    """The chain's first two segments from ``start``, the second with one bit flipped or as it is."""
    a, b = edges[start], edges[(start + 1) % len(edges)]
    second = _segment(fp, b) if flip is None else _segment(fp, b).bitwiseXOR(F.lit(1 << flip))
    return F.shiftleft(_segment(fp, a), b[1]).bitwiseOR(second) * F.lit(64) + F.lit(start)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _chain(edges: list[tuple[int, int]], max_distance: int, start: Column, a: str, b: str) -> Column:
    """Every chain from ``start`` stays within its share of ``max_distance``."""
    m, diff = len(edges), F.col(a).bitwiseXOR(F.col(b))
    either = None
    for s in range(m):
        used, fits = F.lit(0), start == s
        for length in range(1, m + 1):
            shift, bits = edges[(s + length - 1) % m]
            used = used + F.bit_count(diff.bitwiseAND(F.lit(_signed(((1 << bits) - 1) << shift))))
            if length > 2:
                fits = fits & (used <= length * max_distance // m)
        either = fits if either is None else either | fits
    return either


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def star_links(prints: DataFrame, max_distance: int) -> DataFrame:
    """(a, b): each fingerprint with the least one that has an equal key, if they link."""
    edges = _edges(max_distance)
    keyed = prints.select("fp", F.explode(F.array(*[_key(F.col("fp"), edges, s) for s in range(len(edges))])).alias("key"))
    least = keyed.groupBy("key").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(least, "key").where((F.col("fp") != F.col("hub")) & (_distance("fp", "hub") <= max_distance))
    return met.select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def cross_links(grouped: DataFrame, max_distance: int) -> DataFrame:
    """(a, b): all links between fingerprints of different groups; ``grouped`` has fp and grp."""
    edges = _edges(max_distance)
    index = grouped.select(F.col("fp").alias("b"), F.col("grp").alias("grp_b"), F.explode(F.array(*[_key(F.col("fp"), edges, s) for s in range(len(edges))])).alias("key"))
    variants = [_key(F.col("fp"), edges, s, flip) for s in range(len(edges)) for flip in (None, *range(edges[(s + 1) % len(edges)][1]))]
    probe = grouped.select(F.col("fp").alias("a"), F.col("grp").alias("grp_a"), F.explode(F.array(*variants)).alias("key"))
    start = F.pmod(probe["key"], F.lit(64))
    meets = (probe["key"] == index["key"]) & (F.col("a") < F.col("b")) & (F.col("grp_a") != F.col("grp_b")) & (_distance("a", "b") <= max_distance) & _chain(edges, max_distance, start, "a", "b")
    return probe.join(index, meets).select("a", "b").distinct()


def _least_of(both: DataFrame, keep: str, salts: int) -> DataFrame:
    """``both`` (u, v) with m, the least of u's neighbours; a hub's rows are dealt over ``salts`` tasks."""
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if salts == 1:
        return both.join(least, "u").where(keep)
    dealt = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    return dealt.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["u", "salt"]).where(keep).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(fp, grp): the least fingerprint that each linked one can reach.

    Alternating large-star and small-star steps; each is an aggregate and a join,
    and the edge list is written to the shared folder between rounds.  Steps are
    salted by the largest number of edges that meet at one end.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("fp"), F.col("v").alias("grp"))
        seen = state
        salts = -(-(both.groupBy("u").count().agg(F.max("count")).first()[0] or 1) // HUB_ROWS)
        large = _least_of(both, "v > u", salts).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v")
        small = _least_of(large, "true", salts).select(F.col("u").alias("w"), F.col("m"), F.col("v").alias("x"))
        small = small.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(small.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        edges = staged(small, "stars")


def groups(prints: DataFrame, max_distance: int) -> DataFrame:
    """(fp, grp) for each fingerprint that links to another; ``prints`` holds distinct fp."""
    near = components(star_links(prints, max_distance))
    grouped = staged(prints.join(near, "fp", "left").select("fp", F.coalesce("grp", "fp").alias("grp")), "grouped")
    cross = cross_links(grouped, max_distance)
    member = grouped.where("fp <> grp").select(F.col("fp").alias("a"), F.col("grp").alias("b"))
    return components(cross.unionByName(member))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 4, max_distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fp (signed long) and component_id."""
    prints = staged(docs.select(F.col(doc_id).alias("doc_id"), simhash(docs, text, shingle_words).alias("fp")), "prints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    linked = groups(classes.select("fp"), max_distance)
    found = staged(classes.join(linked, "fp", "left").select("fp", "least", F.coalesce("grp", "fp").alias("grp")), "classes")
    named = found.groupBy("grp").agg(F.min("least").alias("component_id"))
    return prints.join(found.join(named, "grp").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
