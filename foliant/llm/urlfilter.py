"""URL filters: rules, and gradient-boosted trees on lexical features for the rest.

Rules name a host and the beginning of a path, and fit the host's subdomains too;
of the rules that fit, the longest wins.  URLs that a rule decides are the labelled
ones.  Trees learn from them what the others get: lengths, depths, digit and
letter ratios, entropy, counts of parameters, and how often labelled URLs with the
same host ending were blocked: smoothed, from all the labelled URLs, and for a URL that
trees learn from those of the other folds only, so that none is told its own verdict.

Everything is built from SQL functions and the ML library's own trees.  At most
``MAX_LABELLED`` labelled URLs grow the trees, those with the least hash: a bound
on what the trees are grown on, and on nothing else.  The table of host endings is joined, not
broadcast by force, so its size is checked before any broadcast.

Defined results: a null URL, or one without ``://``, has empty host and path, fits
no rule, and is judged like an empty URL; ports and user parts belong to the host;
repeated rows are judged alike; with labelled URLs of one verdict only, that is
everyone's verdict, and with none it is ``allow``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gbdt import least_hashed
from .staging import staged

MAX_LABELLED = 50_000
#: Weight of the overall share in an ending's smoothed share.
SMOOTHING = 20.0
#: Folds of the labelled URLs' shares.
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and paths that begin with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def host_of(url: Column) -> Column:
    """After the first ``://``, up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does.

    The longest is the one with most characters in host and path; of equally long
    ones the first listed.
    """
    ordered = sorted(rules, key=lambda r: -len(r.name))
    name = reduce(lambda c, r: c.when(_fits(r, host, path), r.name), ordered[1:], F.when(_fits(ordered[0], host, path), ordered[0].name))
    verdict = reduce(lambda c, r: c.when(_fits(r, host, path), r.verdict), ordered[1:], F.when(_fits(ordered[0], host, path), ordered[0].verdict))
    return name, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character of a string's characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    of = lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - of(c) * F.log2(of(c)))


FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "host_labels", "host_hyphens", "host_digits", "longest_label", "path_depth", "path_digit_ratio",
    "last_segment_length", "digit_ratio", "letter_ratio", "parameters", "tracking", "has_fragment", "has_extension", "ends_in_slash", "secure", "www",
    "host_entropy", "path_entropy", "top_share", "domain_share",
)


def with_lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` (with host and path) plus the lexical features and the host's endings."""
    u, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    query = query_of(u)
    length = lambda c: F.char_length(c).cast("double")
    labels = F.split(host, r"\.")
    made = {
        "url_length": length(u), "host_length": length(host), "path_length": length(path), "query_length": length(query),
        "host_labels": F.size(labels).cast("double"), "host_hyphens": _count(host, "-"), "host_digits": _count(host, "[0-9]"),
        "longest_label": F.array_max(F.transform(labels, F.char_length)).cast("double"), "path_depth": _count(path, "/[^/]+"),
        "path_digit_ratio": _count(path, "[0-9]") / F.greatest(length(path), F.lit(1.0)), "last_segment_length": length(F.regexp_extract(path, "([^/]*)/?$", 1)),
        "digit_ratio": _count(u, "[0-9]") / F.greatest(length(u), F.lit(1.0)), "letter_ratio": _count(u, "[A-Za-z]") / F.greatest(length(u), F.lit(1.0)),
        "parameters": _count(query, "[^&]+"), "tracking": _count(query, "(^|&)(utm_|ref=|gclid|fbclid)"), "has_fragment": u.contains("#").cast("double"),
        "has_extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"), "ends_in_slash": path.endswith("/").cast("double"),
        "secure": u.startswith("https://").cast("double"), "www": host.startswith("www.").cast("double"), "host_entropy": _entropy(host), "path_entropy": _entropy(path),
    }
    rows = urls.withColumns(made)
    return rows.withColumns({"top": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2)})


def _shares(labelled: DataFrame, ending: str, overall: float) -> DataFrame:
    """Smoothed share of blocked URLs by host ending and fold: of all folds (fold -1), or of all but one."""
    own = labelled.groupBy(ending, "fold").agg(F.sum("label").alias("label"), F.count(F.lit(1)).alias("n"))
    whole = own.groupBy(ending).agg(F.sum("label").alias("all_label"), F.sum("n").alias("all_n"))
    others = own.join(whole, ending).select(ending, "fold", (F.col("all_label") - F.col("label")).alias("label"), (F.col("all_n") - F.col("n")).alias("n"))
    both = whole.select(ending, F.lit(-1).alias("fold"), F.col("all_label").alias("label"), F.col("all_n").alias("n")).unionByName(others)
    return both.select(ending, "fold", ((F.col("label") + SMOOTHING * overall) / (F.col("n") + SMOOTHING)).alias(f"{ending}_share"))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id", trees: int = 15, depth: int = 4, seed: int = 7, learn: Column | None = None) -> DataFrame:
    """key, host, path, rule, verdict and block_score of every URL; the score is null where the trees learnt from it.

    ``learn`` (over host, path and url) keeps URLs that rules decide from the trees, to measure them by.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    name, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    known = F.col("ruled").isNotNull() & (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False)))
    parsed = staged(with_lexical(parsed.withColumns({"rule": name, "ruled": verdict}).withColumn("known", known)).withColumn("fold", F.lit(-1)), "urls")
    labelled = parsed.where("known").withColumns({"label": (F.col("ruled") == "block").cast("double"), "fold": F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")})
    seen = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).first()
    if not seen.n or seen.blocked in (0.0, float(seen.n)):
        default = "block" if seen.n and seen.blocked else "allow"
        return parsed.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    sample = staged(least_hashed(labelled, F.xxhash64("url", "key"), ["url", "key"], MAX_LABELLED, seen.n), "labelled-urls")
    overall = seen.blocked / seen.n
    endings = [staged(_shares(labelled, e, overall), "endings") for e in ("top", "domain")]

    def featured(rows: DataFrame) -> DataFrame:
        for e, table in zip(("top", "domain"), endings, strict=True):
            rows = rows.join(table, [e, "fold"], "left").withColumn(f"{e}_share", F.coalesce(f"{e}_share", F.lit(overall)))
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)

    trainer = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, cacheNodeIds=False)
    model = trainer.fit(featured(sample).select("label", "features"))
    scored = model.transform(featured(parsed))
    score = F.when(~F.col("known"), vector_to_array("probability")[1])
    verdict = F.coalesce("ruled", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    return scored.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), score.alias("block_score"))
