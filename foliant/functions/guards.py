"""Screening of inputs and outputs: prompt injection, personal data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Fixed values: (pattern, weight, category) of attack signals; patterns ignore case but for the last.
SIGNALS = (
    (r"(?i)\bignore\s+(all\s+|any\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?)", 1.0, "injection"),
    (r"(?i)\bdisregard\s+(the\s+)?(above|previous|system)", 1.0, "injection"),
    (r"(?i)\b(reveal|show|print|repeat|output)\b.{0,40}\b(system\s+prompt|hidden\s+instructions?|initial\s+prompt)", 1.0, "injection"),
    (r"(?i)\bnew\s+instructions?\s*:", 0.8, "injection"),
    (r"(?i)\byou\s+are\s+now\s+(?!able)", 0.6, "injection"),
    (r"(?i)<\s*/?\s*system\s*>", 0.9, "injection"),
    (r"(?i)\b(DAN|do\s+anything\s+now)\b", 0.9, "jailbreak"),
    (r"(?i)\b(developer|god|sudo|unrestricted|jailbreak(ed)?)\s+mode\b", 0.9, "jailbreak"),
    (r"(?i)\bpretend\s+(you|to)\b.{0,50}\b(no\s+(rules|restrictions|guidelines)|anything)", 0.8, "jailbreak"),
    (r"(?i)\bwithout\s+(any\s+)?(restrictions?|filters?|limitations?|censorship)", 0.7, "jailbreak"),
    (r"(?i)\bhypothetically\b.{0,60}\b(bypass|evade|circumvent)", 0.7, "jailbreak"),
    (r"(?i)\b(base64|rot13)\s*(decode|encoded?)\b", 0.5, "smuggling"),
    (r"[A-Za-z0-9+/]{80,}={0,2}", 0.5, "smuggling"),
)
BLOCK_AT = 1.0

#: Patterns of personal data, in order of detection.
PII = {
    "email": r"\b[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]{2,}\b",
    "phone": r"(?<![0-9-])(?:\+?[0-9]{1,3}[\s.-]?)?(?:\([0-9]{2,4}\)[\s.-]?)?[0-9]{3,4}[\s.-][0-9]{3,4}(?:[\s.-][0-9]{2,4})?(?![0-9-])",
    "credit_card": r"\b(?:[0-9][ -]?){13,19}\b",
    "national_id": r"\b[0-9]{5}-[0-9]{7}-[0-9]\b|\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
}


def injection_score(text: Column | str) -> Column:
    """Sum of the weights of the signals that occur, each once."""
    hits = [F.when(col(text).rlike(p), F.lit(w)).otherwise(F.lit(0.0)) for p, w, _ in SIGNALS]
    return F.bround(F.coalesce(reduce(lambda a, b: a + b, hits), F.lit(0.0)), 2)


def injection_verdict(text: Column | str) -> Column:
    """Struct: allowed, score, categories and matched snippets (60 characters each)."""
    c = F.coalesce(col(text), F.lit(""))
    found = F.filter(F.array(*[F.when(c.rlike(p), F.lit(k)) for p, _, k in SIGNALS]), lambda x: x.isNotNull())
    snippets = F.filter(F.array(*[F.when(c.rlike(p), F.substring(F.regexp_extract(c, p, 0), 1, 60)) for p, _, _ in SIGNALS]), lambda x: x.isNotNull())
    score = injection_score(c)
    return F.struct((score < BLOCK_AT).alias("allowed"), score.alias("score"), F.array_distinct(found).alias("categories"), snippets.alias("matched"))


def is_card(value: Column) -> Column:
    """13 to 19 digits whose check digit is right."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def mask(kind: Column, value: Column) -> Column:
    """An e-mail keeps its first letter and domain; the others their last four digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    tail = F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise("****")
    email = F.concat(F.substring(value, 1, 1), F.lit("***@"), F.regexp_extract(value, "@(.*)$", 1))
    return F.when(kind == "email", email).otherwise(F.concat(F.lit("["), kind, F.lit(":…"), tail, F.lit("]")))


def pii_matches(text: Column | str) -> Column:
    """Array of (type, value, masked), in order of type, then of place."""
    def matches(kind: str, pattern: str) -> Column:
        values = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(pattern), F.lit(0))
        if kind == "credit_card":
            values = F.filter(values, is_card)
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), mask(F.lit(kind), v).alias("masked")))

    return F.concat(*[matches(kind, pattern) for kind, pattern in PII.items()])


def pii_masked(text: Column | str, compat: bool = False) -> Column:
    """The text with its personal data masked: longest value first, or in order of detection (``compat``)."""
    found = pii_matches(text)
    if not compat:
        found = F.array_sort(found, lambda a, b: F.length(b["value"]) - F.length(a["value"]))
    return F.aggregate(found, F.coalesce(col(text), F.lit("")), lambda t, m: F.replace(t, m["value"], m["masked"]))
