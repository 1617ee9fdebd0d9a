"""Routing, prompts, answers, citations and the screening of answers."""

from __future__ import annotations

import json

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.guards import injection_verdict, pii_masked, pii_matches
from ..staging import staged

#: Sources of a query that hold one word, about, in a bucket of the search for support.
WORD_SOURCES = 4096
#: Sources of a query that hold a word which is looked up before all others.
RARE = 64

#: Agents and the words that point to them, in order of precedence on a tie.
ROSTER = (
    ("hr", ("leave", "vacation", "benefit", "payroll", "salary", "onboard", "policy", "holiday", "sick", "hiring", "employee")),
    ("finance", ("budget", "invoice", "expense", "cost", "reimburse", "payment", "revenue", "forecast", "tax", "audit")),
    ("research", ("summarize", "compare", "overview", "trend", "analysis", "report")),
    ("developer", ("code", "api", "deploy", "kubernetes", "docker", "server", "bug", "database", "endpoint", "config", "pipeline")),
    ("legal", ("contract", "clause", "compliance", "liability", "agreement", "terms", "nda", "gdpr", "regulation")),
    ("operations", ("process", "vendor", "logistics", "facility", "schedule", "procurement", "inventory", "shipping", "maintenance")),
)
DEFAULT_AGENT = "research"
#: Dollars per million tokens, in and out; other models cost DEFAULT_PRICE.
PRICES = {
    "gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00), "text-embedding-3-small": (0.02, 0.0), "text-embedding-3-large": (0.13, 0.0), "embed-english-v3.0": (0.10, 0.0),
    "voyage-3": (0.06, 0.0), "rerank-english-v3.0": (2.00, 0.0), "extractive": (0.0, 0.0), "feature-hashing-384": (0.0, 0.0),
}
DEFAULT_PRICE = (1.00, 3.00)
EXCERPT, BLOCK_RULE = 220, "\n\n---\n\n"


def route(question: Column | str, roster=ROSTER) -> Column:
    """The agent with most keywords among a question's words; the first listed on a tie, research without any."""
    words = T.extract(F.lower(T.col(question)), T.ROUTE_WORD)
    scores = [(name, F.size(F.array_intersect(F.array(*map(F.lit, keys)), words))) for name, keys in roster]
    best = F.greatest(*[s for _, s in scores])
    chosen = reduce(lambda c, x: c.when(x[1] == best, x[0]), scores, F.when(best == 0, DEFAULT_AGENT))
    return chosen


def location(heading_path: Column, pages: Column) -> Column:
    """`` (section: a > b, pages: 1, 2)``; empty without either."""
    section = F.when(F.size(heading_path) > 0, F.concat(F.lit("section: "), F.array_join(heading_path, " > ")))
    paged = F.when(F.size(pages) > 0, F.concat(F.lit("pages: "), F.array_join(pages.cast("array<string>"), ", ")))
    joined = F.concat_ws(", ", section, paged)
    return F.when(joined == "", "").otherwise(F.concat(F.lit(" ("), joined, F.lit(")")))


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context): hits (rank, source, text, heading_path, pages) as numbered blocks."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source").cast("string"), location(F.col("heading_path"), F.col("pages")), F.lit("\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda b: b["block"]), BLOCK_RULE).alias("context"))


def graph_context(edges: DataFrame) -> DataFrame:
    """(query_id, graph_context): relations as bullets with their evidence."""
    bare = lambda c: F.regexp_replace(F.col(c), "^[^:]*:", "")
    line = F.concat(F.lit("- "), bare("source_key"), F.lit(" —"), F.col("type"), F.lit("→ "), bare("target_key"), F.lit(' (evidence: "'), F.col("evidence"), F.lit('")'))
    lines = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return edges.groupBy("query_id").agg(F.concat(F.lit("Known relationships from the knowledge graph:\n"), lines).alias("graph_context"))


def render(template: str, **values: Column) -> Column:
    """A template with its ``{names}`` filled; the names must be exactly those given."""
    import string

    asked = {name for _, name, _, _ in string.Formatter().parse(template) if name}
    if asked != set(values):
        raise ValueError(f"missing {sorted(asked - set(values))}, unknown {sorted(set(values) - asked)}")
    parts = [(literal, name) for literal, name, _, _ in string.Formatter().parse(template)]
    return F.concat(*[x for literal, name in parts for x in ((F.lit(literal),) if not name else (F.lit(literal), F.coalesce(values[name].cast("string"), F.lit(""))))])


#: The texts around prompts and extractive answers; groundedness knows their words as stop words.
ANSWER_PROMPT = "Sources:\n\n{context}\n\n{graph_context}\n\nQuestion: {question}\n\nAnswer with citations:"
NO_COVER = "The indexed documents don't appear to cover this question."
LEAD = "**Most relevant passages** (extractive mode — configure an LLM API key for synthesized answers):\n\n"


def json_rules(schema: dict) -> str:
    """What to tell a model that must answer in JSON of a schema."""
    return f"Answer with one JSON object of this schema, without other text or fences:\n{json.dumps(schema, indent=2)}"


def shorten(text: Column, width: int = 400, mark: str = " …") -> Column:
    """Whole words up to a width, with a mark if some are left out."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    flat = F.array_join(words, " ")
    fit = F.aggregate(
        words, F.struct(F.lit("").alias("s"), F.lit(True).alias("open")),
        lambda a, w: F.when(a["open"] & (F.char_length(F.concat_ws(" ", F.nullif(a["s"], F.lit("")), w)) <= width - len(mark)), F.struct(F.concat_ws(" ", F.nullif(a["s"], F.lit("")), w).alias("s"), F.lit(True).alias("open"))).otherwise(F.struct(a["s"].alias("s"), F.lit(False).alias("open"))),
        lambda a: a["s"],
    )
    return F.when(F.char_length(flat) <= width, flat).otherwise(F.concat(fit, F.lit(mark)))


def extractive_answers(queries: DataFrame, hits: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, answer): the best two passages, shortened and cited."""
    best = hits.where(F.col("rank") <= most).select("query_id", "rank", F.concat(shorten(F.col("text")), F.lit(" ["), F.col("rank").cast("string"), F.lit("]")).alias("part"))
    parts = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("parts"))
    joined = F.concat(F.lit(LEAD), F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n"))
    return queries.select("query_id").join(parts, "query_id", "left").select("query_id", F.when(F.col("parts").isNull(), NO_COVER).otherwise(joined).alias("answer"))


def check_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, valid, invented, grounded): which cited numbers are hits."""
    shown = hits.groupBy("query_id").agg(F.collect_set(F.col("rank").cast("int")).alias("shown"))
    rows = answers.join(shown, "query_id", "left").withColumn("cited", T.citations("answer"))
    shown_or_none = F.coalesce("shown", F.array().cast("array<int>"))
    valid, invented = F.array_intersect("cited", shown_or_none), F.array_except("cited", shown_or_none)
    return rows.select("query_id", valid.alias("valid"), invented.alias("invented"), ((F.size(valid) > 0) & (F.size(invented) == 0)).alias("grounded"))


def citation_rows(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """The cited hits with an excerpt."""
    cited = answers.select("query_id", F.explode(T.citations("answer")).alias("rank"))
    return hits.join(cited, ["query_id", "rank"], "left_semi").withColumn("excerpt", F.substring("text", 1, EXCERPT))


def claims(answers: DataFrame, *keep: str) -> DataFrame:
    """(query_id, kept columns, n, claim, words): sentences with four content words or more, citations aside."""
    clean = F.regexp_replace("answer", r"\[[0-9]+\]", "")
    rows = answers.select("query_id", *keep, F.posexplode(T.sentences(clean)).alias("n", "claim")).withColumn("words", T.grounded_words("claim"))
    return rows.where(F.size("words") >= 4)


def _word_set(words: Column) -> list[Column]:
    """The words in order, and a digest that names the set."""
    return [F.array_sort(words).alias("set"), F.unhex(F.md5(F.array_join(F.array_sort(words), " ").cast("binary"))).alias("named")]


def supported_sets(claimed: DataFrame, sources: DataFrame, least: float) -> DataFrame:
    """(query_id, named) of the claims' word sets of which a source of their query holds the share ``least``.

    Both tables have query_id, set and named, each set once.  Of a set of m words that must
    share t, one of any m - t + 1 is shared: only its rarest so many words are looked up in the
    sources, a source that has one is compared in full.  Words that few sources have are looked up
    first, others only for the sets that are still unsupported; their rows are dealt over buckets.
    """
    held = sources.select("query_id", "named", F.explode("set").alias("word"))
    df = staged(held.groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("df")), "words")
    needed = F.greatest(F.ceil(F.size("set") * F.lit(least) - 1e-9), F.lit(1))
    words = claimed.select("query_id", "named", (F.size("set") - needed + 1).alias("first"), F.explode("set").alias("word"))
    rare = Window.partitionBy("query_id", "named").orderBy(F.coalesce("df", F.lit(0)), "word")
    prefix = words.join(df, ["query_id", "word"], "left").withColumn("nth", F.row_number().over(rare)).where("nth <= first and df is not null")
    prefix = staged(prefix.select("query_id", "word", "named", "df"), "prefix")
    held = held.join(df, ["query_id", "word"]).withColumn("bucket", F.pmod(F.xxhash64("named"), F.floor(F.col("df") / WORD_SOURCES) + 1).cast("int"))
    rare, often = F.col("df") <= RARE, F.col("df") > RARE
    found = None
    for tier in (rare, often):  # what few sources can tell is told first
        asked = prefix.where(tier) if found is None else prefix.where(tier).join(found, ["query_id", "named"], "left_anti")
        asked = asked.select("query_id", "word", "named", F.explode(F.sequence(F.lit(0), F.floor(F.col("df") / WORD_SOURCES).cast("int"))).alias("bucket"))
        pairs = asked.join(held.where(tier).select("query_id", "word", "bucket", F.col("named").alias("source")), ["query_id", "word", "bucket"])
        pairs = pairs.select("query_id", "named", "source").distinct().join(claimed, ["query_id", "named"])
        met = pairs.join(sources.select("query_id", F.col("named").alias("source"), F.col("set").alias("source_set")), ["query_id", "source"])
        good = met.where(F.size(F.array_intersect("set", "source_set")) / F.size("set") >= least).select("query_id", "named").distinct()
        found = staged(good if found is None else found.unionByName(good), "supported")
    return found


def groundedness(answers: DataFrame, sources: DataFrame, least: float = 0.5, scope: str = "query_id") -> DataFrame:
    """(query_id, supported, unsupported, score, passed); ``sources`` has the column ``scope`` and text.

    A claim is supported if one source holds the share ``least`` of its words.  Claims and sources with the same words count once.
    Answers with one ``scope`` (a conversation, say) share their sources, which are held and asked once.
    """
    keys = list(dict.fromkeys(("query_id", scope)))
    claimed = staged(claims(answers, *keys[1:]).select(*keys, *_word_set(F.col("words"))), "claims")
    said = staged(sources.select(F.col(scope).alias("query_id"), *_word_set(T.grounded_words("text"))).where(F.size("set") > 0).dropDuplicates(["query_id", "named"]), "sources")
    if least > 0:
        asked = staged(claimed.select(F.col(scope).alias("query_id"), "named", "set").dropDuplicates(["query_id", "named"]), "asked")
        good = supported_sets(asked, said, least).withColumnRenamed("query_id", scope).withColumn("good", F.lit(True))
        checked = claimed.drop("set").join(good, [scope, "named"], "left")
    else:
        checked = claimed.withColumn("good", F.lit(True))
    n = F.count_if(F.coalesce("good", F.lit(False)))
    per = checked.groupBy("query_id").agg(n.alias("supported"), (F.count(F.lit(1)) - n).alias("unsupported"))
    rows = answers.select("query_id").join(per, "query_id", "left").na.fill(0, ["supported", "unsupported"])
    score = F.coalesce(F.bround(F.try_divide(F.col("supported").cast("double"), F.col("supported") + F.col("unsupported")), 3), F.lit(1.0))
    return rows.withColumns({"score": score, "passed": F.col("unsupported") == 0})


def screen_output(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Groundedness and citations of the unmasked answer, then the masked text."""
    grounded = groundedness(answers, hits)
    cited = check_citations(answers, hits)
    rows = answers.join(grounded, "query_id").join(cited, "query_id")
    return rows.withColumns({"masked": pii_masked("answer"), "pii": F.size(pii_matches("answer")), "trustworthy": F.col("passed") & (F.size("invented") == 0)})


def screen_input(questions: DataFrame, text: str = "text") -> DataFrame:
    return questions.withColumn("verdict", injection_verdict(text))


def cost(usage: DataFrame) -> DataFrame:
    """usd (six places) and ``estimated`` of usage rows (model, prompt_tokens, completion_tokens)."""
    spark = usage.sparkSession
    listed = ", ".join(f"('{m}', double({a}), double({b}))" for m, (a, b) in PRICES.items())
    prices = spark.sql(f"select * from values {listed} as t(model, rate_in, rate_out)")
    rows = usage.join(F.broadcast(prices), "model", "left")  # nine rows
    usd = (F.col("prompt_tokens") * F.coalesce("rate_in", F.lit(DEFAULT_PRICE[0])) + F.col("completion_tokens") * F.coalesce("rate_out", F.lit(DEFAULT_PRICE[1]))) / 1_000_000
    return rows.withColumns({"usd": F.bround(usd, 6), "estimated": F.col("rate_in").isNull()}).drop("rate_in", "rate_out")


def first_of(hits: DataFrame, k: int) -> DataFrame:
    """The first k hits of each query, numbered anew."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).where(F.col("rank") <= k)
