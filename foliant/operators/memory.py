"""Conversation memory: windows under a token budget, recall of facts, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: What a fact can belong to.
SCOPES = ("user", "project", "conversation")


def append_messages(messages: DataFrame, fresh: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """``messages`` with ``fresh`` ones after them, numbered on within each conversation."""
    last = messages.groupBy(conv).agg(F.max(order).alias("__last"))
    numbered = fresh.join(last, conv, "left").withColumn(order, F.coalesce("__last", F.lit(0)) + F.row_number().over(Window.partitionBy(conv).orderBy(order)))
    return messages.unionByName(numbered.select(*[F.col(c).cast(messages.schema[c].dataType) for c in messages.columns]))


def append_facts(facts: DataFrame, fresh: DataFrame) -> DataFrame:
    """``facts`` with ``fresh`` ones; a scope beside ``SCOPES`` stops the write."""
    message = F.concat(F.lit(f"scope must be one of {SCOPES}, got "), F.coalesce("scope", F.lit("null")))
    checked = F.when(F.col("scope").isin(*SCOPES), F.col("scope")).otherwise(F.raise_error(message).cast("string"))
    return facts.unionByName(fresh.withColumn("scope", checked))


def forget(facts: DataFrame, gone: DataFrame, key: str = "fact_id") -> DataFrame:
    """``facts`` without those of ``gone``."""
    return facts.join(gone.select(key), key, "left_anti").select(*facts.columns)


def context_window(messages: DataFrame, budget: int = 2000, conv: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The newest messages of each conversation that fit the budget; the newest always stays."""
    newest = Window.partitionBy(conv).orderBy(F.desc(order))
    rows = messages.withColumn("tokens", T.token_count(text))
    rows = rows.withColumn("used", F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.withColumn("__n", F.row_number().over(newest)).where((F.col("used") <= budget) | (F.col("__n") == 1)).drop("__n")


def recent_conversations(messages: DataFrame, conv: str = "conv_id", seq: str = "seq") -> DataFrame:
    """Conversations, the one with the latest message first."""
    return messages.groupBy(conv).agg(F.max(seq).alias("last_seq"), F.count(F.lit(1)).alias("messages")).orderBy(F.desc("last_seq"), conv)


def recall(facts: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """Facts (scope_id, fact_id, content) relevant to each query (query_id, scope_id, text).

    Relevance is the share of the query's distinct words in the fact; a query without
    text gets the last facts in order.
    """
    asked = queries.withColumn("words", F.array_distinct(T.terms("text")))
    known = facts.withColumn("fact_words", T.terms("content"))
    rows = known.join(asked, "scope_id")
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("words", "fact_words")), F.size("words")), F.lit(0.0))
    rows = rows.withColumn("relevance", share).withColumn("plain", F.coalesce(F.col("text"), F.lit("")) == "")
    rows = rows.where(F.col("plain") | (F.col("relevance") > 0))
    best = Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.when(F.col("plain"), -F.col("fact_id")).otherwise(F.col("fact_id")))
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return rows.select("query_id", "scope_id", "fact_id", "content", F.round("relevance", 6).alias("relevance"), "rank")


def digest(recalled: DataFrame, title: str = "About this user:") -> DataFrame:
    """(query_id, digest): recalled facts as bullets under a title."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "content")))
    return recalled.groupBy("query_id").agg(F.concat(F.lit(f"{title}\n"), F.array_join(F.transform(ordered, lambda f: F.concat(F.lit("- "), f["content"])), "\n")).alias("digest"))


def last_words(messages: DataFrame, most: int = 120, conv: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(conversation, summary): the transcript's last words, what memory keeps without a model."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat_ws(": ", "role", text).alias("line"))))
    words = F.filter(F.flatten(F.transform(lines, lambda x: F.split(x["line"], r"\s+"))), lambda w: w != "")
    rows = messages.groupBy(conv).agg(words.alias("words"))
    n = F.size("words")
    return rows.select(conv, F.array_join(F.when(n > most, F.slice("words", -most, most)).otherwise(F.col("words")), " ").alias("summary"))
