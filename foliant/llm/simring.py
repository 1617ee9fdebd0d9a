"""Near-duplicate documents: candidates by SimHash rings, links by the exact similarity.

Sets: the distinct shingles of a text (words and hashes as in ``simhash``).  Two
texts link if the Jaccard similarity of their sets, counted hash by hash, is
``least`` or more.  What the exact count is made of are pairs that pass three cheaper tests.

Ring: the shingles are dealt by a hash into parts of two to five; the first
``RING`` parts are the segments of a ring, each with its own 64-bit SimHash.  A
candidate pair has a chain of consecutive segments within proportional budgets: an
equal segment, and with the next one at most twice a segment's share of bits
(in rings of eight segments or more).  The equal segment is the join key, the rest
of the chain and 64 bits of the fingerprint are join conditions.  Of pairs with similarity 0.8 fewer than one in a hundred
share no segment, since a change of a fifth leaves most parts of the ring untouched
in one place at least.  Sizes of similar sets differ by a quarter at most: a text
near the border of two ring sizes enters both, and pairs of other sizes fall out.

Fingerprint: ``WORDS`` times 64 bits, of which two sets may differ in as many as sets of
similarity ``least`` are expected to, and ``SLACK`` standard deviations (the share
of differing bits is the angle between the sets over pi).  At 1,024 bits and a
similarity of 0.8 that is 177 bits: sets of similarity 0.8 pass in 97 cases of
a hundred, of 0.76 in half of them.  So recall is that of an estimate, precision is exact.

Keys that one text alone has are dropped first, so the rest of the work grows with
the near copies.  A round links every text to one hub of each of its keys.  Of what is then
still apart, a semi join finds the texts that have a candidate; these are brought together by key
and compared in tiles of two buckets of at most ``BUCKET`` texts, so that a key with very many
texts is spread over tasks.  A tile's task counts candidate pairs of different groups
exactly, joins groups as it finds links, and emits only the links that joined two; no pair
is ever a row of a join.  Texts are fetched once for the candidates, by their digest.

Defined results: null and empty texts have the empty set and are one another's
copies; rows, not ids, are judged: rows that share an id and differ in text are
different documents; a null id sorts after all others; repeated rows are copies;
other columns are neither read nor needed.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .simhash import components, shingle_hashes
from .staging import staged

#: 64-bit words of the full fingerprint, segments of a ring, hub rounds; texts, and their shingles, in a bucket of a key.
WORDS, RING, ROUNDS, BUCKET, BUCKET_SHINGLES = 16, 16, 1, 1024, 1 << 21
NAMES = [f"w{i}" for i in range(WORDS)]
#: Standard deviations that the budgets of fingerprint and first word allow above the expectation.
SLACK, FIRST_SLACK = 1.9, 3.0
#: Pairs at one text that a task of the exact count takes, about; bytes of hashed texts that such a task keeps.
HUB_PAIRS, KEPT_BYTES = 1024, 16 << 20
#: Shingles whose long fingerprint is summed at once.
ROWS = 4096

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MADE = "digest binary, size bigint, " + ", ".join(f"w{i} bigint" for i in range(WORDS)) + ", keys array<bigint>, nexts array<bigint>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_fingerprint(own: np.ndarray, words: int = WORDS) -> np.ndarray:
    """SimHash of ``words`` times 64 bits of a set of hashes."""
    total, seeds = np.zeros(64 * words, np.int64), np.arange(1, words + 1, dtype=np.uint64) * _ODD
    for at in range(0, len(own), ROWS):
        bits = np.unpackbits(_mixed(own[at : at + ROWS, None] + seeds).view(np.uint8), axis=1, bitorder="little")
        for some in range(0, len(bits), 255):  # eight counters in a 64-bit word hold 255 each
            total += bits[some : some + 255].view(np.uint64).sum(axis=0).view(np.uint8)
    return np.packbits(2 * total > len(own), bitorder="little").view(np.uint64)


def ring_bits(size: int) -> int:
    """The binary logarithm of the number of parts for a set of ``size`` shingles; never falls with the size."""
    fine = max(0, math.ceil(math.log2(min(size, 64) / 2)))
    return max(fine, math.floor(math.log2(size / 2.7))) if size > 2 else fine


def ring(own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and SimHash of the segments that have a shingle, for 2 to the ``bits`` parts."""
    part = (_mixed(own ^ _ODD) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
    held = part < RING
    own, part = own[held], part[held]
    order = np.argsort(part, kind="stable")
    own, part = own[order], part[order]
    at, first, n = np.unique(part, return_index=True, return_counts=True)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    single = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(single, first, axis=0, dtype=np.int64)
    return at, np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def ring_keys(own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of a set's segments, and the SimHash of the segment after each (0 where there is none)."""
    keys, nexts = [], []
    if len(own):
        for bits in sorted({ring_bits(len(own)), ring_bits(int(len(own) / least + 1e-9))}):
            at, prints = ring(own, bits)
            whole = np.zeros(RING, np.uint64)
            whole[at] = prints
            keys.append(_mixed(prints ^ ((at.astype(np.uint64) + np.uint64(RING * bits + 1)) * _ODD)))
            nexts.append(whole[(at + 1) % min(RING, 1 << bits)] if bits > 2 else np.zeros(len(at), np.uint64))
    return (np.concatenate(keys), np.concatenate(nexts)) if keys else (np.zeros(0, np.uint64),) * 2


def ring_columns(text: Column | str, shingle_words: int = 5, least: float = 0.8) -> Column:
    """A struct of the set's digest, the words of its fingerprint, its keys and the segments after them."""

    @F.pandas_udf(_MADE)
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                own = shingle_set(t, shingle_words)
                keys, nexts = ring_keys(own, least)
                rows.append((xxhash.xxh3_128_digest(own.tobytes()), len(own), *long_fingerprint(own).view(np.int64).tolist(), keys.view(np.int64), nexts.view(np.int64)))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _MADE.split(", ")])

    return made(text)


def share_of_bits(least: float) -> float:
    """Expected share of differing bits of two equally large sets with similarity ``least``."""
    return math.acos(2 * least / (1 + least)) / math.pi


def budget(least: float, bits: int, slack: float) -> int:
    """Bits that may differ: the expectation and ``slack`` standard deviations."""
    p = share_of_bits(least)
    return math.floor(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _chained(a: str, b: str, least: float) -> Column:
    """Whether rows that share a key may link: sizes, the next segment and the first word are within their budgets."""
    sizes = F.least(f"{a}.size", f"{b}.size") >= F.lit(least) * F.greatest(f"{a}.size", f"{b}.size")
    after = (F.col(f"{a}.next") == 0) | (F.col(f"{b}.next") == 0) | (_differ(F.col(f"{a}.next"), F.col(f"{b}.next")) <= 2 * budget(least, 64, 1.0))
    return sizes & after & (_differ(F.col(f"{a}.w0"), F.col(f"{b}.w0")) <= budget(least, 64, FIRST_SLACK))


def _near(a: str, b: str, least: float) -> Column:
    """Whether the fingerprints are within the budget."""
    return sum((_differ(F.col(f"{a}.{n}"), F.col(f"{b}.{n}")) for n in NAMES[1:]), _differ(F.col(f"{a}.w0"), F.col(f"{b}.w0"))) <= budget(least, 64 * WORDS, SLACK)


def confirmed(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose full fingerprints are within the budget."""
    both = pairs.join(nodes.select(F.col("id").alias("a"), F.struct(*NAMES).alias("x")), "a").join(nodes.select(F.col("id").alias("b"), F.struct(*NAMES).alias("y")), "b")
    return both.where(_near("x", "y", least)).select("a", "b")


def shingle_set(text: str | None, shingle_words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    hashes = list(shingle_hashes(text, shingle_words))
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


def similarity(own: np.ndarray, other: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    met = len(np.intersect1d(own, other, assume_unique=True))
    every = len(own) + len(other) - met
    return met / every if every else 1.0


def exact_links(pairs: DataFrame, texts: DataFrame, shingle_words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least so similar; ``texts`` has id and text.

    Texts join the pairs on either side; the pairs of a text that very many have are dealt over tasks.
    """

    @F.pandas_udf("double")
    def similar(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        kept: OrderedDict[bytes, np.ndarray] = OrderedDict()
        held = 0

        def hashed(key: bytes, text: str) -> np.ndarray:
            nonlocal held
            own = kept.pop(key, None)
            if own is None:
                own = shingle_set(text, shingle_words)
                held += own.nbytes
            kept[key] = own
            while held > KEPT_BYTES and len(kept) > 2:
                held -= kept.popitem(last=False)[1].nbytes
            return own

        for a, text_a, b, text_b in batches:
            yield pd.Series([similarity(hashed(bytes(i), s), hashed(bytes(j), t)) for i, s, j, t in zip(a, text_a, b, text_b, strict=True)], dtype="float64")

    pairs = staged(pairs, "pairs")
    most = pairs.groupBy("b").count().agg(F.max("count")).first()[0] or 0
    salts = -(-most // HUB_PAIRS) or 1
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
    hubs = texts.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("b"), F.col("text").alias("tb"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    both = dealt.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(hubs, ["b", "salt"])
    return both.where(similar("a", "ta", "b", "tb") >= least).select("a", "b")


def _with_groups(met: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The key rows with their group, of the keys in which two groups meet; n counts a key's rows."""
    rows = met.withColumn("grp", F.col("id")) if groups is None else met.join(groups, "id", "left").withColumn("grp", F.coalesce("grp", "id"))
    apart = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high").select("key", "n")
    return rows.join(apart, "key")


def _grown(links: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(id, grp) after the links (a, b) are added."""
    if groups is not None:
        links = links.unionByName(groups.where("id <> grp").select(F.col("id").alias("a"), F.col("grp").alias("b")))
    return components(links).withColumnRenamed("fp", "id")


def candidates(nodes: DataFrame) -> DataFrame:
    """Key rows (id, w0, size, key, next) of the keys that two texts or more share, staged."""
    keyed = nodes.select("id", "w0", "size", F.explode(F.arrays_zip("keys", "nexts")).alias("k")).select("id", "w0", "size", F.col("k.keys").alias("key"), F.col("k.nexts").alias("next"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return staged(keyed.join(shared, "key", "left_semi"), "met")


def linked_groups(nodes: DataFrame, texts_of, shingle_words: int, least: float) -> DataFrame:
    """(id, grp) for each node linked to another.

    ``nodes`` has id, size, the fingerprint's words, keys and nexts; ``texts_of`` gives (id, text) of a table of ids.
    """
    met = candidates(nodes)
    texts = staged(texts_of(met.select("id").distinct()), "texts")
    groups = None
    for k in range(ROUNDS):
        rows = staged(_with_groups(met, groups), "apart")
        hubs = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("o"), "id", "w0", "size", "next", "grp")).alias("hub")).select("key", "hub.*")
        meets = _chained("x", "hub", least) & (F.col("x.grp") != F.col("hub.grp"))
        pairs = rows.alias("x").join(hubs.alias("hub"), "key").where(meets).select(F.col("x.id").alias("a"), F.col("hub.id").alias("b")).distinct()
        groups = staged(_grown(exact_links(confirmed(pairs, nodes, least), texts, shingle_words, least), groups), "groups")
    left = _with_groups(met, groups).withColumn("parts", F.ceil(F.col("n") / BUCKET).cast("int")).join(nodes.select("id", *NAMES[1:]), "id")
    rows = staged(left, "apart")
    index = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    probe = rows.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meets = _chained("x", "y", least) & (F.col("x.grp") != F.col("y.grp")) & _near("x", "y", least)
    both = (F.col("x.key") == F.col("y.key")) & (F.col("x.bucket") == F.col("y.bucket"))
    open_ = probe.alias("x").join(index.alias("y"), both & meets, "left_semi").dropDuplicates(["id", "key"])
    links = tile_links(staged(open_.select("key", "id", "grp", "size", *NAMES), "open"), texts, shingle_words, least)
    return _grown(links, groups)


def tile_links(rows: DataFrame, texts: DataFrame, shingle_words: int, least: float) -> DataFrame:
    """(a, b): links between groups, as many as join all groups that have one; ``rows`` has key, id, grp, size and the words."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BUCKET), F.ceil(F.sum("size") / BUCKET_SHINGLES)).cast("int")
    dealt = rows.join(rows.groupBy("key").agg(parts.alias("parts")), "key").withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    place = ["key", "low", "high"]
    tiles = dealt.select("key", F.least("bucket", "other").alias("low"), F.greatest("bucket", "other").alias("high"), "bucket", "id", "grp", "size", *NAMES)
    tiles = tiles.join(texts, "id").repartition(*place).sortWithinPartitions(*place)
    most = budget(least, 64 * WORDS, SLACK)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, None
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in (*place, "bucket", "id", "grp", "size", "text")}
            words = np.stack([batch.column(n).to_numpy() for n in NAMES], axis=1).view(np.uint64)
            found = []
            for at, here in enumerate(zip(*(columns[c] for c in place), strict=True)):
                if here != now:
                    now, tile = here, _Tile(shingle_words, least, most)
                own = here[1] == here[2]
                found += tile.add(*(columns[c][at] for c in ("id", "grp", "size", "text")), words[at], None if own else columns["bucket"][at])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], batch.schema.field("id").type) for i in (0, 1)], names=["a", "b"])

    return tiles.mapInArrow(linked, StructType().add("a", rows.schema["id"].dataType).add("b", rows.schema["id"].dataType))


class _Tile:
    """Texts that share a key, compared as they come; groups that a link joins count as one from then on."""

    def __init__(self, shingle_words: int, least: float, most: int) -> None:
        self.shingle_words, self.least, self.most = shingle_words, least, most
        self.ids, self.groups, self.sets, self.texts = [], [], [], []
        self.words, self.sizes, self.sides = np.zeros((16, WORDS), np.uint64), np.zeros(16, np.int64), np.zeros(16, np.int64)
        self.root: dict = {}

    def _top(self, group):
        while group in self.root:
            group = self.root[group]
        return group

    def _set(self, at: int) -> np.ndarray:
        if self.sets[at] is None:  # most texts are never counted
            self.sets[at], self.texts[at] = shingle_set(self.texts[at], self.shingle_words), None
        return self.sets[at]

    def add(self, id_, group, size: int, text: str, words: np.ndarray, side: int | None) -> list[tuple]:
        """Links of this text with earlier ones, each of which joins two groups; only other sides count, if there are sides."""
        n = len(self.ids)
        if n == len(self.words):
            self.words, self.sizes, self.sides = np.concatenate([self.words] * 2), np.tile(self.sizes, 2), np.tile(self.sides, 2)
        self.words[n], self.sizes[n], self.sides[n] = words, size, -1 if side is None else side
        for held, value in ((self.ids, id_), (self.groups, group), (self.sets, None), (self.texts, text)):
            held.append(value)
        near = np.bitwise_count(self.words[:n] ^ words).sum(axis=1) <= self.most
        near &= np.minimum(self.sizes[:n], size) >= self.least * np.maximum(self.sizes[:n], size)
        if side is not None:
            near &= self.sides[:n] != side
        found = []
        for i in np.flatnonzero(near).tolist():
            a, b = self._top(group), self._top(self.groups[i])
            if a != b and similarity(self._set(n), self._set(i)) >= self.least:
                self.root[a] = b
                found.append((id_, self.ids[i]))
        return found


def _text_id(text: Column) -> Column:
    """The digest by which a text is known; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def grouped_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, text_id (a digest of its text), grp (the same for near copies); staged."""
    said = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = said.select("doc_id", _text_id(F.col("text")).alias("text_id"), ring_columns(F.col("text"), shingle_words, least).alias("m"))
    prints = staged(made.select("doc_id", "text_id", "m.*"), "rings")
    # of equal sets one text stands for all, and one row for that text
    classes = staged(prints.groupBy("digest").agg(F.min(F.struct("text_id", F.col("doc_id").isNull().alias("none"), "doc_id")).alias("r")).select("digest", F.col("r.text_id").alias("id"), F.col("r.doc_id").alias("doc_id")), "classes")
    stands = (F.col("p.text_id") == F.col("c.id")) & F.col("p.doc_id").eqNullSafe(F.col("c.doc_id"))
    nodes = prints.alias("p").join(classes.alias("c"), stands, "left_semi").drop("doc_id", "digest").withColumnRenamed("text_id", "id")
    nodes = staged(nodes.dropDuplicates(["id"]), "nodes")  # rows repeated in full: they agree in all columns

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "id", "left_semi").alias("c")
        rows = said.withColumn("text_id", _text_id(F.col("text"))).alias("p")
        return rows.join(wanted, stands, "left_semi").select(F.col("text_id").alias("id"), "text").dropDuplicates(["id"])

    linked = linked_groups(nodes, texts_of, shingle_words, least)
    found = classes.join(linked, "id", "left").select("digest", F.coalesce("grp", "id").alias("grp"))
    return staged(prints.select("doc_id", "text_id", "digest").join(found, "digest").drop("digest"), "grouped")


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id and component_id, the least id of its group."""
    rows = grouped_rows(docs, doc_id, text, shingle_words, least)
    return rows.join(rows.groupBy("grp").agg(F.min("doc_id").alias("component_id")), "grp").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one of the least id, then text, then other columns.

    Rows are judged, not ids: rows with one id and unlike texts all stay.
    """
    rows = grouped_rows(docs, shingle_words=shingle_words, least=least)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")
    kept = staged(rows.groupBy("grp").agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("n")).select("grp", "k.doc_id", "k.text_id", "n"), "kept")
    chosen = rows.alias("r").join(kept.where("n > 1").alias("k"), "grp")
    same = F.col("r.text_id").eqNullSafe(F.col("k.text_id")) & F.col("r.doc_id").eqNullSafe(F.col("k.doc_id"))
    chosen = staged(chosen.select("r.doc_id", "r.text_id", same.alias("same")).groupBy("doc_id", "text_id").agg(F.first("same").alias("same"), F.count(F.lit(1)).alias("n")), "chosen")
    # every row of a group but its kept one goes; of a kept row that is repeated in the table one stays
    gone = chosen.where("not same").select("doc_id", "text_id")
    left = _without(docs, gone)
    again = chosen.where("same and n > 1").select("doc_id", "text_id")
    if again.isEmpty():
        return left
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    whole = left.withColumn("__text_id", _text_id(F.col("text"))).alias("x").join(again.alias("g"), _is_row("x.__text_id"), "left_semi")
    one = whole.groupBy("doc_id", "__text_id").agg(F.min(F.struct(*[F.col(c).alias(n) for c, n in named.items()])).alias("__one"))
    return _without(left, again).unionByName(one.select(*[F.col(f"__one.{n}").alias(c) for c, n in named.items()]))


def _is_row(text_id: str) -> Column:
    return F.col("x.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(text_id) == F.col("g.text_id"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of these ids and texts."""
    return docs.withColumn("__text_id", _text_id(F.col("text"))).alias("x").join(gone.alias("g"), _is_row("x.__text_id"), "left_anti").select(*[F.col(f"x.{c}") for c in docs.columns])
