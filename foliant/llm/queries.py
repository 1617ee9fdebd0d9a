"""The numbered queries: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, fertility, gbdt, kdshard, mixing, spelling, toxicity, warc
from .bpe import BpeColumns
from .simhash import near_duplicates
from .staging import staged
from .tiff import TiffColumns, file_rows
from .tokencount import token_count
from .urlfilter import Rule, judge

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encode and decode every text; keep digests of both results."""
    bpe = BpeColumns(docs.sparkSession, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", bpe.digests("text").alias("r")).select("doc_id", "r.*")


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiff = TiffColumns(spark)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(data)
    padded = F.when(n == 0, F.rpad(data, 64, F.lit(b"\0"))).otherwise(F.rpad(data, (F.ceil(n / 64) * 64).cast("int"), F.lit(b"\0")))
    docs = _table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_bytes"), padded.alias("payload"))
    files = docs.select("doc_id", "n_bytes", tiff.store("payload").alias("media"))
    read = file_rows(files)
    back = F.unhex(F.array_join(F.transform("pages", lambda p: F.hex(p["samples"])), ""))
    one = lambda p: F.format_string("%d:%dx%d:%s:%s:%d:%.4f:%.4f", p["page"], p["width"], p["height"], p["compression"], p["layout"], p["predictor"], p["mean"], p["spread"])
    read = read.select("doc_id", "n_bytes", "media", back.alias("back"), F.array_join(F.transform("pages", one), ";").alias("feature"))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("back").cast("long").alias("payload_bytes"), F.sha2("back", 256).alias("payload_sha256"),
        F.crc32(F.substring("back", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op2_mix_low_discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.schedule(_table(spark, sf_dir, "documents"), mixing.word_count("text")))


def op3_bpe_bitmap_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    shards = kdshard.kd_shards(docs, kdshard.text_bytes("text"), leaves=16, keep={"text_crc32": crc})
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The rules of the op5 query.
URL_RULES = [
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
]


def op5_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"), URL_RULES).drop("block_score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    n = token_count(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold


def _judged(scored: DataFrame, out: Column) -> DataFrame:
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _table(spark, sf_dir, "documents"), held_out(4, 2)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), out)
    return _judged(docs.select("doc_id", toxicity.toxicity(docs, model).alias("score")), out)


def op8_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, max_distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(5, 0)
    return _judged(gbdt.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), out), out)


def quality_measures(docs: DataFrame) -> Column:
    """The counts and the fertility of each text."""
    path = public_tokenizers.path
    return fertility.measures(docs.sparkSession, "text", path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))


def quality_kept(docs: DataFrame, labels: DataFrame, verdict: str = "__foliant_verdict") -> DataFrame:
    """The documents that the rules keep, by bands fitted to those labelled clean; every text is measured once."""
    measured = staged(docs.withColumn(verdict, quality_measures(docs)), "measured")
    bands = fertility.fit_bands(measured.select("doc_id", "lang", F.col(verdict).alias("m")), labels)
    return measured.where(bands.kept(F.col(verdict), F.col("lang"))).select(*docs.columns)


def op10_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    measured = staged(docs.select("doc_id", "lang", quality_measures(docs).alias("m")), "fertility")
    bands = fertility.fit_bands(measured, _table(spark, sf_dir, "labels"))
    return measured.select("doc_id", "m.*", bands.kept(F.col("m"), F.col("lang")).alias("kept"))


def op11_spelling_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"))


def op12_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(_table(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {
        "op1_tiff_pages": op1_tiff_pages,
        "op2_mix_low_discrepancy": op2_mix_low_discrepancy,
        "op3_bpe_bitmap_queue": op3_bpe_bitmap_queue,
        "op4_kd_shards": op4_kd_shards,
        "op5_url_trees": op5_url_trees,
        "op6_token_counts": op6_token_counts,
        "op7_toxicity_counterfactual": op7_toxicity_counterfactual,
        "op8_simhash_pigeonring": op8_simhash_pigeonring,
        "op9_quality_gbdt": op9_quality_gbdt,
        "op10_tokeniser_fertility": op10_tokeniser_fertility,
        "op11_spelling_parity": op11_spelling_parity,
        "op12_warc_revisits": op12_warc_revisits,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_low_discrepancy": mixing.ORACLE_SQL, "op12_warc_revisits": warc.ORACLE_SQL, "op13_filter_audit": audit.ORACLE_SQL}
