"""Usage metrics: counters, latency snapshots, cost roll-ups, text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import nearest_rank

#: Observations that a series keeps.
RING = 5000
#: Rows that a task sorts, about, where the number of partitions follows the table.
ROWS_A_TASK = 500_000


def series_labels(labels: Column) -> Column:
    """``{a="x",b="y"}`` of a label map, sorted; empty without labels."""
    pairs = F.array_sort(F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))))
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) < 1, "").otherwise(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def counters(increments: DataFrame) -> DataFrame:
    """(name, labels, value): sums by series; ``labels`` is the text form."""
    return increments.groupBy("name", "labels").agg(F.sum("value").alias("value"))


def last_observations(observations: DataFrame, most: int = RING) -> DataFrame:
    """The newest observations of each series (name, labels; ordered by seq)."""
    newest = Window.partitionBy("name", "labels").orderBy(F.desc("ts"), F.desc("seq"))
    return observations.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= most).drop("__n")


def snapshot(observations: DataFrame, most: int = RING) -> DataFrame:
    """(name, labels, count, p50, p95, max) over each series' last observations: at most ``most`` values a series."""
    held = last_observations(observations, most).groupBy("name", "labels").agg(F.collect_list("value").alias("v"))
    return held.select("name", "labels", F.size("v").cast("long").alias("count"), F.round(nearest_rank(F.col("v"), 50), 3).alias("p50"), F.round(nearest_rank(F.col("v"), 95), 3).alias("p95"), F.round(F.array_max("v"), 3).alias("max"))


def number_text(number: Column) -> Column:
    """A double in text form: digits from 0.0001 to below 1e16, else with an exponent of two digits or more.

    Spark's own cast turns to exponents at ten millions and below a thousandth.
    """
    cast, size = number.cast("string"), F.abs(number)
    digits = F.regexp_replace(F.regexp_replace(cast.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.substring_index(cast, "E", -1).try_cast("int")
    exponent = F.concat(F.regexp_replace(F.substring_index(cast, "E", 1), r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    special = F.when(F.isnan(number), "nan").when(number == float("inf"), "inf").when(number == float("-inf"), "-inf")
    return F.coalesce(special, F.when(~cast.contains("E"), cast).when((size >= 1e-4) & (size < 1e16), digits).otherwise(exponent))


def exposition(counted: DataFrame, observed: DataFrame) -> DataFrame:
    """(line): counters, then counts and quantiles of histograms, in text form."""
    with_quantile = lambda q: F.when(F.col("labels") == "", f'{{quantile="{q}"}}').otherwise(F.concat(F.regexp_replace("labels", r"\}$", ""), F.lit(f',quantile="{q}"}}')))
    lines = [F.concat("name", F.lit("_count"), "labels", F.lit(" "), F.col("count").cast("string"))]
    lines += [F.concat(F.col("name"), with_quantile(q), F.lit(" "), number_text(F.col(q).cast("double"))) for q in ("p50", "p95")]
    value = F.col("value")
    value = number_text(value) if counted.schema["value"].dataType.typeName() == "double" else value.cast("string")
    first = counted.select(F.concat("name", "labels", F.lit(" "), value).alias("line"))
    return first.unionByName(observed.select(F.explode(F.array(*lines)).alias("line")))


def hit_rate(hits: Column, misses: Column) -> Column:
    """Whole per cent; null without lookups."""
    return F.round(F.try_divide(F.lit(100) * hits, hits + misses)).cast("int")


def usage_by_agent(usage: DataFrame) -> DataFrame:
    """(agent_id, queries, prompt_tokens, completion_tokens, usd) of priced usage rows."""
    return usage.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("queries"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("usd"), 6).alias("usd")
    )


def root_total(spans: DataFrame) -> DataFrame:
    """(trace_id, total_ms): time of the spans without a parent."""
    return spans.groupBy("trace_id").agg(F.round(F.sum(F.when(F.col("parent").isNull(), F.col("ms"))), 3).alias("total_ms"))


def parts_for(rows: int) -> int:
    """Partitions that hold about ``ROWS_A_TASK`` rows each, so that what a task sorts doesn't grow with the table."""
    return max(1, -(-rows // ROWS_A_TASK))


def span_tree(marks: DataFrame, parts: int | None = None) -> DataFrame:
    """(trace_id, name, parent, ms, depth) of spans from their open and close marks (trace_id, seq, ts, name, opens).

    A span's depth is the number of open ones; its close is the next mark of that
    depth, its parent the last span opened one level up.  Times are in milliseconds.
    The traces are dealt over ``parts`` partitions if given (``parts_for`` the number of marks), else over the session's.
    """
    if parts is not None:
        marks = marks.repartition(parts, "trace_id")
    along = Window.partitionBy("trace_id").orderBy("seq")
    rows = marks.withColumn("depth", F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(along) + F.when(F.col("opens"), 0).otherwise(1))
    level = Window.partitionBy("trace_id", "depth").orderBy("seq")
    spans = rows.withColumn("end", F.lead("ts").over(level)).where("opens")
    both = spans.select("*", F.explode(F.array(F.col("depth"), F.col("depth") + 1)).alias("among"))
    above = Window.partitionBy("trace_id", "among").orderBy("seq")
    parent = F.last(F.when(F.col("depth") < F.col("among"), F.col("name")), ignorenulls=True).over(above)
    named = both.withColumn("parent", parent).where("depth = among")
    return named.select("trace_id", "name", "parent", F.round(F.col("end") - F.col("ts"), 3).alias("ms"), F.col("depth").cast("int").alias("depth"))


def summary(**tables: DataFrame) -> DataFrame:
    """One wide row: the number of rows of each table, each counted by itself."""
    out = None
    for name, table in tables.items():
        one = table.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out


def log_lines(rows: DataFrame, level: str = "INFO", logger: str = "foliant", message: str = "message") -> DataFrame:
    """(value): rows as JSON log lines."""
    rest = [c for c in rows.columns if c not in ("ts", message)]
    return rows.select(F.to_json(F.struct(F.col("ts"), F.lit(level).alias("level"), F.lit(logger).alias("logger"), F.col(message).alias("message"), *rest)).alias("value"))
