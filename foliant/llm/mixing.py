"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: the sources share the words of the whole corpus by weight; none gets more
than ``MOST_PASSES`` times its own words, and what is beyond goes to the others by
weight until none is above.

Schedule: the mix is a row of slots of ``block`` words each.  Slot k has the k-th
van der Corput point, which falls into one source's part of the cumulated targets;
so every stretch of the mix holds each source near its weight.  A source's
documents, in the order of a hash, form a stream cut into blocks of equal words;
the source's r-th slot takes its r-th block, over and over again up to
``MOST_PASSES`` times.

Scale: whatever is ranked or summed along a source is done in two levels: within
buckets (by hash, or by runs of slots), and over the buckets' totals; what is summed
along the sources, within range partitions and over theirs.  A source with most of
the rows is so spread over many tasks, and so are very many sources.

Defined results: null and empty texts have size 0 and are taken 0 times; a null
source is a source of its own, last in order; repeated rows are separate rows of
the mix; null ids come first in the hash order; an empty table has an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

WORD = r"[^\x20\x09-\x0D]+"
MOST_PASSES = 3
#: Words in a slot at most; small corpora get smaller slots, LEAST_SLOTS of them.
BLOCK = 4096
LEAST_SLOTS = 65_536
BUCKET_ROWS = 2048
SLOT_RUN = 4096


def word_count(text: Column | str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weight(order: Column) -> Column:
    """1, 2, 3, repeating, for sources numbered from 1."""
    return F.pmod(order - 1, F.lit(3)) + 1


def _before(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with upto, the running sum of ``value`` in the order of the range partitions ``part``, and last, the one before it."""
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    rows = rows.withColumn("within", F.sum(value).over(within))
    parts = rows.groupBy("part").agg(F.max("within").alias("in_part"))
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(along), F.lit(0)).alias("before"))
    rows = rows.join(F.broadcast(parts), "part")
    return rows.withColumns({"upto": F.col("before") + F.col("within"), "last": F.col("before") + F.coalesce(F.lag("within").over(within), F.lit(0))}).drop("within", "before")


def targets(sizes: DataFrame, weight=cyclic_weight, most_passes: int = MOST_PASSES) -> DataFrame:
    """One row per source: src, source, source_size, weight, target, low and high share.

    ``sizes`` has src (a non-null key), source, size.  Sources are sorted by range
    partitions, of which only the totals meet in one task.  The level of the targets
    rises until no source is above its most; a step is one aggregate, two numbers.
    """
    w = sizes.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    w = staged(w.repartitionByRange(F.col("source").asc_nulls_last()).withColumns({"part": F.spark_partition_id(), "one": F.lit(1)}), "sources")
    w = _before(w, "one").withColumn("weight", weight(F.col("upto")).cast("double")).drop("upto", "last", "one")
    w = staged(w.withColumn("most", (most_passes * F.col("source_size")).cast("double")), "weights")
    total = w.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        open_ = F.col("most") / F.col("weight") >= level
        seen = w.agg(F.count_if(~open_).alias("full"), F.sum(F.when(open_, F.col("weight"))).alias("weights"), F.coalesce(F.sum(F.when(~open_, F.col("most"))), F.lit(0.0)).alias("taken")).first()
        if seen.full == full or not seen.weights:
            break
        level, full = (total - seen.taken) / seen.weights, seen.full
    target = F.when(F.col("most") / F.col("weight") >= level, F.lit(level) * F.col("weight")).otherwise(F.col("most"))
    w = _before(w.withColumn("target", target), "target")
    whole = F.lit(w.agg(F.max("upto")).first()[0] or 0.0)
    share = lambda c: F.coalesce(F.round(F.try_divide(F.col(c), whole), 12), F.lit(0.0))
    return w.select("src", "source", "source_size", "weight", "target", share("last").alias("low"), share("upto").alias("high"))


def point(k: Column, bits: int) -> Column:
    """The k-th van der Corput point: k's bits mirrored at the binary point."""
    return F.conv(F.reverse(F.lpad(F.bin(k), bits, "0")), 2, 10).cast("double") / float(2**bits)


def slots(shares: DataFrame, n_slots: int, n_sources: int) -> DataFrame:
    """(src, slot, rank): each slot's source, and its rank among that source's slots."""
    spark = shares.sparkSession
    bits = max(1, math.ceil(math.log2(max(2, n_slots))))
    cells = 1 << max(10, math.ceil(math.log2(max(1, n_sources))))
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1))
    parts = shares.where("low < high").select("src", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    at = spark.range(n_slots).select(F.col("id").alias("slot"), point(F.col("id"), bits).alias("u")).withColumn("cell", cell(F.col("u")))
    met = at.join(parts, "cell").where("low <= u and u < high").select("src", "slot", F.floor(F.col("slot") / SLOT_RUN).alias("run"))
    counts = met.groupBy("src", "run").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("src").orderBy("run")
    counts = counts.select("src", "run", (F.sum("n").over(along) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("src", "run").orderBy("slot")) - 1
    return met.withColumn("within", within).join(counts, ["src", "run"]).select("src", "slot", (F.col("before") + F.col("within")).alias("rank"))


def schedule(docs: DataFrame, size: Column, weight=cyclic_weight, most_passes: int = MOST_PASSES, uid: Column | None = None) -> DataFrame:
    """The mix, one row for each document, pass and slot that meet, and one for each document that is not taken.

    Columns: uid (a row of ``docs``; its own numbering unless given), doc_id, source,
    size, source_size, target, pass, slot, first_word (from 0), words (0 and nulls
    where not taken).
    """
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))
    rows = docs.select(
        (F.monotonically_increasing_id() if uid is None else uid).alias("uid"), F.col("doc_id"), F.col("source"), src.alias("src"), size.alias("size"),
        F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")).alias("h"),
    )
    rows = staged(rows, "sizes")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    shares = staged(targets(rows, weight, most_passes), "targets")
    n_sources = shares.count()
    block = max(1, min(BLOCK, total.words // LEAST_SLOTS))
    n_slots = -(-total.words // block)
    at = staged(slots(shares, n_slots, n_sources), "slots")

    digits = max(1, math.ceil(math.log(max(1, total.n / BUCKET_ROWS), 16)))
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))
    along = Window.partitionBy("src").orderBy("bucket")
    offsets = rows.groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("offset", F.sum("in_bucket").over(along) - F.col("in_bucket"))
    granted = at.groupBy("src").agg(F.count(F.lit(1)).alias("granted"))
    per_source = shares.select("src", "source_size", "target").join(granted, "src", "left").withColumn("granted", F.coalesce("granted", F.lit(0)))
    offsets = offsets.join(per_source, "src").select("src", "bucket", "offset", "source_size", "target", "granted")
    inside = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("start", F.sum("size").over(inside) - F.col("size")).join(offsets, ["src", "bucket"]).withColumn("start", F.col("start") + F.col("offset"))

    step = F.lit(block).cast("long")
    first = lambda p: F.col("source_size") * p + F.col("start")
    upto = F.least(F.col("granted"), F.ceil(F.col("source_size") * most_passes / step).cast("long"))
    blocks = lambda p: F.sequence(F.floor(first(p) / step), F.floor((first(p) + F.col("size") - 1) / step))
    meets = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most_passes - 1)), lambda p: F.transform(F.filter(blocks(p), lambda b: b < upto), lambda b: F.struct(p.alias("pass"), b.alias("rank")))))
    pieces = placed.withColumn("met", F.when(F.col("size") > 0, meets)).withColumn("met", F.explode_outer("met"))
    pieces = pieces.withColumn("pass", F.col("met.pass")).withColumn("rank", F.col("met.rank")).drop("met")
    begin = F.greatest(first(F.col("pass")), F.col("rank") * step)
    end = F.least(first(F.col("pass")) + F.col("size"), (F.col("rank") + 1) * step)
    out = pieces.join(at, ["src", "rank"], "left")
    return out.select(
        "uid", "doc_id", "source", "size", "source_size", "target", "pass", "slot", (begin - first(F.col("pass"))).alias("first_word"),
        F.coalesce(F.when(F.col("slot").isNotNull(), end - begin), F.lit(0)).alias("words"),
    )


def taken(mix: DataFrame) -> DataFrame:
    """Words that the mix takes of each document, repeats counted."""
    per_row = mix.groupBy("uid").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("words").alias("taken"))
    return per_row.drop("uid")


def mixed_texts(docs: DataFrame, schedule_columns: bool = False) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each document and pass, in the order of the schedule.

    A row stands where the first of its slots does: partitions hold runs of slots, and rows in
    them are sorted by slot, so that whoever reads the files in order reads the sources
    interleaved as scheduled.  With ``schedule_columns`` rows also tell mix_slot and mix_pass.  A
    document that a pass takes in part keeps its first words, joined by a space; n_chars
    follows the text where there is such a column.
    """
    spark = docs.sparkSession
    columns = [F.col(c).alias(f"doc_{c}") for c in docs.columns]
    rows = staged(docs.select(F.monotonically_increasing_id().alias("uid"), *columns), "to-mix")
    sized = rows.select(F.col("uid").alias("uid"), F.col("doc_doc_id").alias("doc_id"), F.col("doc_source").alias("source"), F.col("doc_text").alias("text"))
    mix = schedule(sized, word_count("text"), uid=F.col("uid"))
    passes = staged(mix.where("words > 0").groupBy("uid", "pass").agg(F.sum("words").alias("words"), F.first("size").alias("size"), F.min("slot").alias("slot")), "passes")
    cut = F.array_join(F.slice(F.regexp_extract_all("doc_text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") >= F.col("size"), F.col("doc_text")).otherwise(cut)
    named = {"text": text, "n_chars": F.when(F.col("words") >= F.col("size"), F.col("doc_n_chars")).otherwise(F.char_length(cut).cast("long")) if "n_chars" in docs.columns else None}
    slots_end = (passes.agg(F.max("slot")).first()[0] or 0) + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.join(passes, "uid").repartitionById(parts, F.floor(F.col("slot") * parts / slots_end).cast("int")).sortWithinPartitions("slot", "pass", "doc_doc_id", "uid")
    more = [F.col("slot").alias("mix_slot"), F.col("pass").alias("mix_pass")] if schedule_columns else []
    return placed.select(*[named[c].alias(c) if c in named else F.col(f"doc_{c}").alias(c) for c in docs.columns], *more)


#: DuckDB's form of the op2 query: the same targets and slots; what a document gets follows from its place in the stream.
ORACLE_SQL = rf"""
with rows_ as (
  select doc_id, source, coalesce('=' || source, '~') src, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size, coalesce(md5(doc_id::varchar), '') h
  from documents),
total as (select coalesce(sum(size), 0)::bigint words from rows_),
unit as (select words, greatest(1, least({BLOCK}, words // {LEAST_SLOTS}))::bigint block from total),
s1 as (select src, any_value(source) source, sum(size)::bigint source_size from rows_ group by src),
s2 as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double weight, ({MOST_PASSES} * source_size)::double most from s1),
s3 as (select *, ((sum(source_size) over ())::double - coalesce(sum(most) over f, 0)) / (sum(weight) over () - coalesce(sum(weight) over f, 0)) lvl
  from s2 window f as (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding)),
s4 as (select *, lvl <= most / weight is_open, max(case when lvl <= most / weight then lvl end) over () final_lvl from s3),
s5 as (select *, case when is_open then final_lvl * weight else most end target from s4),
s6 as (select *, coalesce(round(sum(target) over (order by source nulls last) / sum(target) over (), 12), 0) high from s5),
s7 as (select *, coalesce(lag(high) over (order by source nulls last), 0) low from s6),
bits as (select greatest(1, ceil(log2(greatest(2, ceil(words / block)))))::bigint bits, ceil(words / block)::bigint n_slots, block from unit),
pts as (select k, list_sum(list_transform(range(bits), lambda i: ((k >> i) & 1) * power(2.0, -i - 1))) u from (select unnest(range(n_slots)) k, bits from bits)),
granted as (select src, count(*)::bigint granted from pts join s7 on low <= u and u < high group by src),
placed as (
  select r.*, source_size, target, coalesce(granted, 0) * block reach,
    (sum(size) over (partition by r.src order by h, doc_id, size rows unbounded preceding) - size)::bigint start
  from rows_ r join s7 using (src) left join granted using (src), bits)
select doc_id, size, source_size, target,
  (case when size = 0 then 0 else {" + ".join(f"greatest(0, least(start + size + {p} * source_size, reach) - (start + {p} * source_size))" for p in range(MOST_PASSES))} end)::bigint taken
from placed
"""
