"""Nulls, empty and long texts, repeated rows, empty tables, clashing names: every operator and stage."""

import hashlib
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import fertility, gbdt, kdshard, mixing, queries, simhash, simring, toxicity
from foliant.llm.bpe import BpeColumns
from foliant.llm.tiff import TiffColumns, file_rows
from foliant.llm.tokencount import token_count
from foliant.llm.urlfilter import judge

LONG = "palabra ähnlich ñandú " * 30_000
ROWS = [
    (1, "one two three four five", "en", "a", 23),
    (1, "one two three four five", "en", "a", 23),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "de", "b", 4),
    (5, LONG, "es", "b", len(LONG)),
    (6, "x" * 50_000, "en", None, 50_000),
    (None, "漢字 and 😀 marks", "zh", "c", 18),
    (7, "<|endoftext|> inside, twice <|endoftext|>", "en", "a", 40),
]
CLASHING = ["size", "score", "ids", "fp", "uid", "bucket", "label", "kept", "node", "shard", "stats", "media", "h", "src", "key", "url", "pass", "m"]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    made = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    made = made.withColumns({c: F.lit("clash") for c in CLASHING})
    return made if request.param == "rows" else made.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 1, None), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


def same_count(docs, out):
    got, expected = out.collect(), docs.count()
    assert len(got) == expected
    return got


def test_tiff(docs):
    tiff = TiffColumns(docs.sparkSession)
    data = F.coalesce("text", F.lit("")).cast("binary")
    padded = F.rpad(data, (F.greatest(F.ceil(F.octet_length(data) / 64), F.lit(1)) * 64).cast("int"), F.lit(b"\0"))
    rows = same_count(docs, file_rows(docs.select("doc_id", "text", "size", tiff.store(padded).alias("media"))).withColumnRenamed("pages", "p"))
    for r in rows:
        raw = (r.text or "").encode()
        assert b"".join(p.samples for p in r.p) == raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw))


def test_mixing(docs):
    rows = same_count(docs, mixing.taken(mixing.schedule(docs, mixing.word_count("text"))))
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.coalesce(F.sum(mixing.word_count("text")), F.lit(0))).first()[0] == sum(r.taken for r in rows)


def test_bpe(docs):
    bpe = BpeColumns(docs.sparkSession, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in same_count(docs, docs.select("text", bpe.encode("text").alias("i")).withColumn("b", bpe.decode("i"))):
        assert bytes(r.b) == (r.text or "").encode()
        assert bool(r.i) == bool(r.text)


def test_shards(docs):
    rows = same_count(docs, kdshard.kd_shards(docs, kdshard.text_bytes("text"), leaves=4))
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t, *_ in ROWS) or not rows


def test_urls(docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("link"), F.lit("clash").alias("host"), F.lit("clash").alias("top"))
    for r in same_count(docs, judge(pages, queries.URL_RULES, url="link")):
        assert (r.host, r.path, r.rule) == ("", "", None) and r.verdict in ("allow", "block")


def test_token_counts(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in same_count(docs, docs.select("text", token_count(docs, P.path("byte_bpe_50k.json"), P.PATTERN).alias("n"))):
        assert r.n == len(library.encode(r.text or "", add_special_tokens=False).ids)


def test_toxicity(docs, labels):
    model = toxicity.fit(docs, labels, queries.held_out(4, 2))
    assert all(0 <= r.s <= 1 for r in same_count(docs, docs.select(toxicity.toxicity(docs, model).alias("s"))))


def test_simhash(docs):
    rows = same_count(docs, simhash.near_duplicates(docs))
    by_text = {r.doc_id: r for r in rows}
    if rows:
        assert by_text[2].fp == by_text[3].fp == by_text[4].fp == 0
        assert {by_text[i].component_id for i in (2, 3, 4)} == {2}
        left = sorted(r.doc_id or 0 for r in simring.one_of_each(docs).collect())
        assert left == [0, 1, 2, 5, 6, 7]


def test_quality(docs, labels):
    assert all(0 <= r.score <= 1 for r in same_count(docs, gbdt.quality_scores(docs, labels, queries.held_out(5, 0))))


def test_fertility(docs):
    for r in same_count(docs, docs.select("text", queries.quality_measures(docs).alias("q"))):
        assert r.q.n_words == len((r.text or "").encode().split())
        if not r.text or r.q.n_words < 50:
            assert r.q.base_failed
    assert set(fertility.BANDS) == {*fertility.SCRIPTS, "other"}


def test_fertility_bands(docs, labels):
    measured = docs.select("doc_id", "lang", queries.quality_measures(docs).alias("m"), "kept")
    bands = fertility.fit_bands(measured, labels, least=1)
    for r in same_count(docs, measured.select("m.base_failed", bands.kept(F.col("m"), F.col("lang")).alias("k"))):
        assert not (r.base_failed and r.k)
    assert fertility.fit_bands(measured, labels.where("false")).fitted == {}


def test_stages_keep_columns(docs, labels, tmp_path, spark):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
    corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()


def test_no_labels(docs, labels):
    none = labels.where("false")
    model = toxicity.fit(docs, none, queries.held_out(4, 2))
    assert {round(r.s, 6) for r in same_count(docs, docs.select(toxicity.toxicity(docs, model).alias("s")))} <= {0.5}
    assert {r.score for r in same_count(docs, gbdt.quality_scores(docs, none, queries.held_out(5, 0)))} <= {0.5}


def test_held_out_is_crc(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), queries.held_out(4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
