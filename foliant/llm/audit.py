"""How filters overlap: for every order of them, what each step keeps, removes and wrongly loses.

A text fails some of the ``CHECKS`` (bits of a mask, found in one pass over its words)
and, as the last filter, fails if its text is that of a smaller id, anywhere in
the table, removed or not.

Copies: texts are routed by their xxhash over the partitions of an RDD.  Each
partition keeps, by fingerprint, a chain of the texts that have it: full text, least
id so far and how many rows have that id.  A row whose id isn't the least of its text
leaves at once as a copy.  The same chains are built before the shuffle (and emptied
at ``CHAIN_BYTES``), so of a text with very many copies a row or few per input partition
travel, and no task holds them all.  A first count of the table's bytes sets
the number of partitions, so that the chains of one stay within ``PARTITION_BYTES``, about.

Counts: (part, mask) counts of rows, of good and of toxic ones are vectors that
``combineByKey`` merges, map side first; one vector per part is all that the
orders are worked out from.

Defined results: a null text is the empty text; a null part is the empty part; a row
with a null id is never a copy and makes no copies; rows that repeat id and text count
each, and are copies only if a smaller id has the text; a document with several labels is good
(toxic) if one of them says so, one without labels is neither; an empty table gives no rows;
other columns are neither read nor needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .staging import staged

#: A check says of a text's UTF-8 bytes and its words whether the text fails.
Check = Callable[[bytes, list[bytes]], bool]

_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"

#: The checks of the registered query; the letter after them is the copies' filter.
CHECKS: dict[str, Check] = {
    "A": lambda data, words: len(words) < 200,
    "B": lambda data, words: 100 * len(set(words)) < 50 * len(words),
    "C": lambda data, words: 100 * (len(data) - len(data.translate(None, _CAPITALS))) > 2 * len(data.decode()),
    "D": lambda data, words: len(data.translate(None, _SYMBOLS)) < len(data),
}
COPIES = "E"
#: Bytes of texts that the chains before the shuffle hold at once.
CHAIN_BYTES = 32 << 20
#: Bytes of texts that a partition after the shuffle holds, about, were all of them different.
PARTITION_BYTES = 32 << 20


class _Chains:
    """Least ids by text, found by fingerprint: chains of [text, id, {part: rows}, mask]."""

    def __init__(self) -> None:
        self.by_print: dict[int, list[list]] = {}
        self.held = 0

    def add(self, print_: int, text: bytes, id_, parts: dict, mask: int) -> Iterator[tuple]:
        """Take rows of one id; yield (id, part, mask, rows) of those that aren't least."""
        chain = self.by_print.setdefault(print_, [])
        for entry in chain:
            if entry[0] == text:
                if id_ == entry[1]:
                    for part, n in parts.items():
                        entry[2][part] = entry[2].get(part, 0) + n
                    return
                more = (entry[1], entry[2]) if id_ < entry[1] else (id_, parts)
                if id_ < entry[1]:
                    entry[1], entry[2] = id_, parts
                for part, n in more[1].items():
                    yield more[0], part, mask, n
                return
        chain.append([text, id_, dict(parts), mask])
        self.held += len(text)

    def emptied(self) -> Iterator[tuple]:
        """All entries (fingerprint, text, id, parts, mask); nothing is held after."""
        for print_, chain in self.by_print.items():
            for text, id_, parts, mask in chain:
                yield print_, text, id_, parts, mask
        self.by_print, self.held = {}, 0


def masks(docs: DataFrame, checks: dict[str, Check], doc_id: str = "doc_id", text: str = "text", part: str = "source") -> RDD:
    """(id, part, mask, rows): which filters the rows of an id fail, the copies' filter as the highest bit."""
    spark, tests, copy = docs.sparkSession, list(checks.values()), 1 << len(checks)
    rows = docs.select(F.col(doc_id), F.coalesce(F.col(part), F.lit("")), F.coalesce(F.col(text), F.lit(""))).rdd

    def routed(part_rows: Iterator) -> Iterator[tuple]:
        chains, at = _Chains(), 0
        for id_, name, said in part_rows:
            data = said.encode()
            words = data.split()  # ASCII white space
            mask = sum(1 << i for i, fails in enumerate(tests) if fails(data, words))
            settled = [(id_, name, mask, 1)] if id_ is None else [(*r[:2], r[2] | copy, r[3]) for r in chains.add(xxhash.xxh64_intdigest(data), data, id_, {name: 1}, mask)]
            for done in settled:  # dealt over the partitions one by one
                at += 1
                yield at, (None, *done)
            if chains.held > CHAIN_BYTES:
                yield from ((e[0], e[1:]) for e in chains.emptied())
        yield from ((e[0], e[1:]) for e in chains.emptied())

    def met(part_rows: Iterator) -> Iterator[tuple]:
        chains = _Chains()
        for print_, (data, *rest) in part_rows:
            if data is None:
                yield tuple(rest)
                continue
            id_, parts, mask = rest
            for i, name, m, n in chains.add(print_, data, id_, parts, mask):
                yield i, name, m | copy, n
        for _, _, id_, parts, mask in chains.emptied():
            for name, n in parts.items():
                yield id_, name, mask, n

    held = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    dealt = max(-(-held // PARTITION_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapPartitions(routed).partitionBy(dealt, lambda print_: print_).mapPartitions(met)


def counts(masked: DataFrame, labels: DataFrame, n_filters: int, doc_id: str = "doc_id") -> RDD:
    """(part, vector): by mask the rows, the good and the toxic ones; ``masked`` has id, part, mask, n."""
    marks = labels.groupBy(F.col(doc_id).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    judged = masked.join(marks, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def add(vector: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        vector[:, mask] += (n, n * good, n * toxic)
        return vector

    keyed = judged.rdd.map(lambda r: (r[0], tuple(r[1:])))
    return keyed.combineByKey(lambda row: add(np.zeros((3, 1 << n_filters), np.int64), row), add, lambda a, b: a + b)


def order_rows(vector: np.ndarray, letters: str) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part."""
    mask, (rows, good, toxic) = np.arange(vector.shape[1]), vector
    found, shares = [], dict.fromkeys(letters, 0)
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << letters.index(letter)
            fails, earlier = (mask & own) > 0, (mask & before) > 0
            here = fails & ~earlier
            removed = int(rows[here].sum())
            shares[letter] += removed
            before |= own
            found.append((letter, "".join(order), step, int(rows[(mask & before) == 0].sum()), removed, int(rows[fails & earlier].sum()), int(rows[own]), int(good[here].sum()), int(toxic[here].sum())))
    for letter, *rest in found:
        yield (*rest, shares[letter])


def audit(docs: DataFrame, labels: DataFrame, checks: dict[str, Check] | None = None, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step; at most six checks, since orders grow by factorials."""
    checks = CHECKS if checks is None else checks
    letters = "".join(checks) + COPIES
    if len(set(letters)) != len(letters) or len(checks) > 6:
        raise ValueError("up to six checks, each under one letter of its own other than " + COPIES)
    spark = docs.sparkSession
    schema = StructType().add("id", docs.schema[doc_id].dataType).add("part", "string").add("mask", "integer").add("n", "long")
    masked = staged(spark.createDataFrame(masks(docs, checks, doc_id, text, part), schema, verifySchema=False), "masks")
    rows = counts(masked, labels, len(letters), doc_id).flatMap(lambda kv: ((kv[0], *r) for r in order_rows(kv[1], letters)))
    out = StructType().add("part", StringType()).add("filter_order", StringType()).add("step", "integer")
    for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"):
        out = out.add(name, LongType())
    return spark.createDataFrame(rows, out, verifySchema=False)


ORACLE_SQL = r"""with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
m as (select doc_id, part, (case when len(w) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
    + (case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) then 4 else 0 end) + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
    + (case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end) mask from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by doc_id),
c as (select part, mask, count(*) n, sum(coalesce(good, 0)) good, sum(coalesce(toxic, 0)) toxic from m left join l using (doc_id) group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) x, unnest([1, 2, 4, 8, 16]) bit),
o as (select a.x || b.x || c.x || d.x || e.x filter_order from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s as (select filter_order, step, bit, (select coalesce(sum(f2.bit), 0) from f f2 where instr(substr(filter_order, 1, step - 1), f2.x) > 0) earlier
    from o, (select unnest(range(1, 6)) step) join f on true where substr(filter_order, step, 1) = f.x),
r as (select part, filter_order, step, bit,
    sum(case when (mask & bit) = 0 and (mask & earlier::bigint) = 0 then n else 0 end) kept, sum(case when (mask & bit) > 0 and (mask & earlier::bigint) = 0 then n else 0 end) removed,
    sum(case when (mask & bit) > 0 and (mask & earlier::bigint) > 0 then n else 0 end) redundant, sum(case when mask = bit then n else 0 end) unique_fails,
    sum(case when (mask & bit) > 0 and (mask & earlier::bigint) = 0 then good else 0 end) good_lost, sum(case when (mask & bit) > 0 and (mask & earlier::bigint) = 0 then toxic else 0 end) toxic_lost
  from c, s group by part, filter_order, step, bit)
select part, filter_order, step::int step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails,
  good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, (sum(removed) over (partition by part, bit))::bigint shapley from r"""
