"""Retrieval and answer quality, and percentiles by nearest rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(values: Column, pct: float) -> Column:
    """The value at rank round(pct/100 * n), half to even, 1 at least; 0 for none."""
    at = F.greatest(F.lit(1), F.bround(F.lit(pct / 100) * F.size(values)).cast("int"))
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), at)).otherwise(0.0)


def nearest_ranks(rows: DataFrame, by: str, value: str, percents: dict[str, float], buckets: int = 1024) -> DataFrame:
    """(by, a column for each of ``percents``): nearest-rank percentiles of groups of any size.

    A count over ranges of values finds each rank's range; only that range's distinct
    values are then ordered, so no group is gathered whole.  Nulls don't count.
    """
    held = rows.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    ends = held.groupBy(by).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.floor((F.col("v") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * buckets)
    ranged = held.join(ends, by).select(by, "v", F.coalesce(F.least(place, F.lit(buckets - 1)), F.lit(0)).alias("range"))
    counts = ranged.groupBy(by, "range").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy("range"))
    counts = counts.withColumns({"upto": upto, "all": F.sum("n").over(Window.partitionBy(by))})
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pct / 100).alias("share")) for name, pct in percents.items()]))
    aims = counts.withColumn("p", wanted).withColumn("rank", F.greatest(F.lit(1), F.bround(F.col("p.share") * F.col("all"))))
    aims = aims.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select(by, "range", F.col("p.name").alias("name"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rest"))
    found = ranged.join(aims, [by, "range"]).groupBy(by, "name", "rest", "v").agg(F.count(F.lit(1)).alias("n"))
    found = found.withColumn("upto", F.sum("n").over(Window.partitionBy(by, "name").orderBy("v"))).where((F.col("rest") <= F.col("upto")) & (F.col("rest") > F.col("upto") - F.col("n")))
    return found.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in percents])


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, precision, recall, mrr, hit) at k.

    ``hits`` has query_id, rank, id; ``relevant`` query_id and id.  Precision is over
    what was returned; recall over distinct ids, 1 if nothing is relevant.
    """
    good = relevant.select("query_id", "id").distinct().withColumn("good", F.lit(True))
    top = hits.where(F.col("rank") <= k).join(good, ["query_id", "id"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    wanted = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    return flagged_metrics(top, wanted, hits.select("query_id").unionByName(relevant.select("query_id")).distinct())


def flagged_metrics(top: DataFrame, wanted: DataFrame, queries: DataFrame) -> DataFrame:
    """``retrieval_metrics`` of hits (query_id, rank, id, good) and counts (query_id, n_relevant), a row for each of ``queries``."""
    per = top.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good"), F.count_distinct(F.when(F.col("good"), F.col("id"))).alias("n_distinct"), F.min(F.when(F.col("good"), F.col("rank"))).alias("first")
    )
    rows = queries.join(per, "query_id", "left").join(wanted, "query_id", "left").na.fill(0, ["n", "n_good", "n_distinct", "n_relevant"])
    ratio = lambda a, b, none: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(none))
    return rows.select(
        "query_id", F.round(ratio("n_good", "n", 0.0), 4).alias("precision"), F.round(ratio("n_distinct", "n_relevant", 1.0), 4).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr"), F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit"),
    )


def mean_report(cases: DataFrame) -> DataFrame:
    """Means of per-query metrics, to four places."""
    names = {"precision": "context_precision", "recall": "context_recall", "mrr": "mrr", "hit": "hit_rate"}
    return cases.agg(*[F.coalesce(F.round(F.avg(a), 4), F.lit(0.0)).alias(b) for a, b in names.items()])


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """Share of the expected keywords in an answer; 1 if none are expected."""
    found = F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))))
    return F.when(F.size(keywords) > 0, F.round(found / F.size(keywords), 4)).otherwise(1.0)


def citation_accuracy(valid: Column, cited: Column) -> Column:
    return F.when(F.size(cited) > 0, F.round(F.size(valid) / F.size(cited), 4)).otherwise(0.0)


def answer_report(cases: DataFrame) -> DataFrame:
    """One row of means over cases (faithfulness, citation_accuracy, keyword_coverage, grounded)."""
    faith = F.coalesce(F.round(F.avg("faithfulness"), 4), F.lit(0.0))
    return cases.agg(
        faith.alias("faithfulness"), F.round(1 - faith, 4).alias("hallucination_rate"), F.round(F.avg("citation_accuracy"), 4).alias("citation_accuracy"),
        F.round(F.avg("keyword_coverage"), 4).alias("keyword_coverage"), F.round(F.avg(F.col("grounded").cast("double")), 4).alias("grounded_share"),
    )
