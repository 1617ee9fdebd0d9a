"""A corpus pipeline: each stage works on all that its predecessor kept.

Every stage: null and empty texts fail the quality rules, and elsewhere are documents
like others; repeated rows are judged alike; ties go to the least id; empty tables
give empty ones; columns beside those of ``documents`` are kept as they are.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return
the columns of ``documents``.  ``run`` writes each stage's result to the shared
folder, so that a lost executor costs the stage at hand and no earlier one.  A stage begins
by deleting the tables that the stage before it staged for itself, as that one's result is
written by then; what ``docs`` still read stays.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import mixing, queries, simring, toxicity
from foliant.llm.staging import made, release, staged


#: Rows and bytes of whole texts in one Arrow batch; the five stages share executors, so what they hold adds up.
BATCH_ROWS, BATCH_BYTES = 250, 8 << 20


_scratch: dict[str, list[str]] = {}


def _stage(f):
    """A stage with this program's own settings for its session (the operators set nothing) and without its predecessor's scratch tables."""

    @functools.wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        app, before = spark.sparkContext.applicationId, set(made(spark))
        release(spark, _scratch.pop(app, []), docs)
        out = f(spark, docs, sf_dir)
        _scratch[app] = [t for t in made(spark) if t not in before]
        return out

    return stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules and the fertility bands, fitted to the labels, keep."""
    return queries.quality_kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels of what is left, scores below 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, queries.held_out(4, 2))
    return docs.where(toxicity.toxicity(docs, model) < 0.3)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return simring.one_of_each(docs, shingle_words=5, least=0.8)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at weights 1, 2, 3: a row for each pass over a document, in the order of the schedule."""
    return mixing.mixed_texts(docs)


@_stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return queries.bpe_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", not_toxic),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix),
    ("byte_bpe", byte_bpe),
]

#: Tokenisation, boosting and fingerprints have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
