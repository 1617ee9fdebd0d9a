"""Sharding by a k-d tree over metadata, leaves of near equal bytes.

Every dimension becomes an ordered code of ``CODES`` steps: numbers by their
logarithm between the corpus's least and greatest, strings by their rank in code
point order, weighted by bytes.  From the root on, each node is split along the
dimension in which its codes spread widest, at the weighted median of that
dimension; documents with the very code in which the median lies are divided by a
hash of their row, new at each level, so that one value (or one id) that a third of
the corpus has can still be split, as often as it takes.  The hash is of all that
is known of the row, and of its number among equal ones, so a rerun over other
partitions gives the same rows.

Each level takes two aggregations with map-side sums: one histogram of bytes over
(node, dimension, code), one over the hash steps of the median's code.  A node's
number of leaves and first shard follow from its parent's, so nothing comes to the
driver but two totals.  Documents are not moved between levels; a level's splits
are a staged table of one row per node, broadcast while there are at most
``BROADCAST_NODES`` of them and joined by node beyond.  Metadata with the nodes
found so far is staged every ``STAGE_LEVELS`` levels.

Defined results: a null number or string has code 0; null and empty texts weigh
one; repeated rows, ids and null ids are separate rows and spread over shards like
any others; with fewer documents than leaves some shards stay empty; an empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

CODES = 1024
HASH_STEPS = 4096
BUCKET_ROWS = 2048
#: Rows (of about 40 bytes) of a level's splits up to which they are broadcast.
BROADCAST_NODES = 65_536
STAGE_LEVELS = 3


def text_bytes(text: Column | str) -> Column:
    """UTF-8 bytes plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _number_codes(rows: DataFrame, numbers: list[str]) -> list[Column]:
    """Codes by logarithm; the ends of each number are all that the driver sees."""
    if not numbers:
        return []
    ends = rows.agg(*[f(F.col(c)).cast("double").alias(f"{f.__name__}_{c}") for c in numbers for f in (F.min, F.max)]).first().asDict()
    out = []
    for c in numbers:
        low, high = ends[f"min_{c}"] or 0.0, ends[f"max_{c}"] or 0.0
        step = F.floor(F.log1p(F.col(c).cast("double") - low) / math.log1p(max(high - low, 1e-9)) * (CODES - 1))
        out.append(F.coalesce(F.least(step, F.lit(CODES - 1)), F.lit(0)).cast("int"))
    return out


def _rank_codes(rows: DataFrame, column: str, total: int) -> DataFrame:
    """(column, code): each distinct string's code, by the bytes of the strings before it.

    Distinct strings are sorted by range partitions; only the partitions' totals meet in one task.
    """
    sums = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum("size").alias("bytes"))
    sums = staged(sums.repartitionByRange(F.col(column)).withColumn("part", F.spark_partition_id()), "strings")
    parts = sums.groupBy("part").agg(F.sum("bytes").alias("in_part"))
    parts = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    within = F.sum("bytes").over(Window.partitionBy("part").orderBy(column)) - F.col("bytes")
    placed = sums.withColumn("within", within).join(F.broadcast(parts), "part")
    return placed.select(column, (F.lit(1) + F.floor((F.col("before") + F.col("within")) / max(1, total) * (CODES - 1))).cast("int").alias(f"{column}_code"))


def _step(level: int) -> Column:
    return F.pmod(F.xxhash64("h", F.lit(level)), F.lit(HASH_STEPS)).cast("int")


def _by_node(table: DataFrame, level: int) -> DataFrame:
    return F.broadcast(table) if 1 << level <= BROADCAST_NODES else table


def _splits(placed: DataFrame, level: int) -> DataFrame:
    """(node, dim, cut_code, cut_step) of each node of the level with two leaves or more.

    A document goes left if its code is less, or if it is equal and its hash step is
    not above.
    """
    inner = placed.where("leaves > 1")
    by_code = inner.select("node", "leaves", "size", F.posexplode("codes").alias("dim", "code")).groupBy("node", "leaves", "dim", "code").agg(F.sum("size").alias("bytes"))
    one = Window.partitionBy("node", "dim")
    by_code = by_code.withColumn("upto", F.sum("bytes").over(one.orderBy("code"))).withColumn("all", F.sum("bytes").over(one)).withColumn("spread", F.max("code").over(one) - F.min("code").over(one))
    half = F.col("all") * F.floor(F.col("leaves") / 2) / F.col("leaves")
    medians = by_code.where((F.col("upto") >= half) & (F.col("upto") - F.col("bytes") < half))
    medians = medians.groupBy("node").agg(F.min_by(F.struct("dim", F.col("code").alias("cut_code"), (half - F.col("upto") + F.col("bytes")).alias("need")), F.struct(-F.col("spread"), "dim")).alias("m")).select("node", "m.*")
    medians = staged(medians, "medians")
    tied = inner.join(_by_node(medians, level), "node").where(F.element_at("codes", F.col("dim") + 1) == F.col("cut_code"))
    by_step = tied.groupBy("node", "dim", "cut_code", "need", _step(level).alias("step")).agg(F.sum("size").alias("bytes"))
    by_step = by_step.withColumn("upto", F.sum("bytes").over(Window.partitionBy("node").orderBy("step")))
    # the last step taken to the left: the one after which the bytes are nearest to what is needed
    nearest = by_step.groupBy("node", "dim", "cut_code", "need").agg(F.min_by(F.struct("step", "upto"), F.struct(F.abs(F.col("upto") - F.col("need")), "step")).alias("s"))
    cut = F.when(F.abs(F.col("s.upto") - F.col("need")) <= F.col("need"), F.col("s.step")).otherwise(-1)
    return staged(nearest.select("node", "dim", "cut_code", cut.alias("cut_step")), "splits")


def _grow(placed: DataFrame, leaves: int) -> DataFrame:
    """Documents with their shard: leaves are numbered from left to right."""
    placed = placed.withColumns({"node": F.lit(1).cast("long"), "leaves": F.lit(leaves).cast("long"), "shard": F.lit(0).cast("long")})
    for level in range(math.ceil(math.log2(leaves))):
        splits = _by_node(_splits(placed, level), level)
        code = F.element_at("codes", F.col("dim") + 1)
        right = (code > F.col("cut_code")) | ((code == F.col("cut_code")) & (_step(level) > F.col("cut_step")))
        left_leaves = F.floor(F.col("leaves") / 2)
        placed = placed.join(splits, "node", "left").withColumn("right", F.when(F.col("dim").isNotNull(), right))
        placed = placed.withColumns({
            "node": F.when(F.col("right").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.col("right").cast("long")),
            "shard": F.when(F.col("right"), F.col("shard") + left_leaves).otherwise(F.col("shard")),
            "leaves": F.when(F.col("right"), F.col("leaves") - left_leaves).when(~F.col("right"), left_leaves).otherwise(F.col("leaves")),
        }).drop("dim", "cut_code", "cut_step", "right")
        if (level + 1) % STAGE_LEVELS == 0:
            placed = staged(placed, "placed")
    return placed


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows``, staged, with h: a hash of all columns, and of a number from 0 among rows that are equal in all.

    Only rows that have an equal one are numbered, in two levels, so that a row which very many
    repeat isn't ranked in one task; which of them has which number tells nobody apart.
    """
    rows = staged(rows.withColumn("same", F.xxhash64(*rows.columns)), "metadata")
    repeated = rows.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("same", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("deals"))
    repeated = staged(repeated, "repeated")
    alone = rows.join(repeated, "same", "left_anti").withColumn("h", F.xxhash64("same", F.lit(0).cast("long")))
    again = staged(rows.join(repeated, "same").withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.col("deals"))).drop("deals"), "again")
    counts = again.groupBy("same", "deal").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("same", "deal", (F.sum("n").over(Window.partitionBy("same").orderBy("deal")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("same", "deal").orderBy(F.lit(0))) - 1
    numbered = again.withColumn("within", within).join(counts, ["same", "deal"]).withColumn("h", F.xxhash64("same", (F.col("before") + F.col("within")).cast("long")))
    return alone.unionByName(numbered.select(*alone.columns)).drop("same")


def kd_shards(docs: DataFrame, size: Column, leaves: int | None = None, target_bytes: int | None = None, numbers: list[str] = ("n_chars",), strings: list[str] = ("source", "lang"), keep: dict[str, Column] | None = None, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size, the columns of ``keep``, shard, slot (from 0 without gaps in each shard).

    Give the number of ``leaves``, or ``target_bytes`` for as many as that takes.
    """
    keep = keep or {}
    num, text = [f"num_{c}" for c in numbers], [f"str_{c}" for c in strings]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), size.alias("size"), *[c.alias(f"keep_{n}") for n, c in keep.items()],
        *[F.col(c).alias(n) for c, n in zip(numbers, num, strict=True)], *[F.col(c).cast("string").alias(n) for c, n in zip(strings, text, strict=True)],
    )
    rows = _hashed(rows)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if leaves is None:
        leaves = max(1, -(-total.bytes // target_bytes))
    codes = _number_codes(rows, num)
    for c in text:
        rows = rows.join(_rank_codes(rows, c, total.bytes), c, "left")
        codes.append(F.coalesce(f"{c}_code", F.lit(0)))
    placed = staged(rows.select("doc_id", "size", "h", *[f"keep_{n}" for n in keep], F.array(*codes).alias("codes")), "coded")
    placed = _grow(placed, leaves)
    # slots: a rank within small buckets of the shard, after the rows of the buckets before
    buckets = 1 << max(0, math.ceil(math.log2(max(1, total.n / leaves / BUCKET_ROWS))))
    placed = placed.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "doc_id")) - 1
    slotted = placed.withColumn("within", within).join(counts, ["shard", "bucket"])
    return slotted.select("doc_id", "size", *[F.col(f"keep_{n}").alias(n) for n in keep], F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("within")).cast("long").alias("slot"))
