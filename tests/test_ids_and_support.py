"""Ids of any type, filters on both legs, and support of claims against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import answers, chunking, dedup, ocr, retrieval


def named(df, *columns):
    return df.withColumns({c: F.concat(F.lit("id-"), F.lpad(F.col(c).cast("string"), 3, "0")) for c in columns})


def test_string_ids(spark):
    r = random.Random(1)
    vectors = spark.createDataFrame([(i, [r.random() for _ in range(5)], r.choice(["a", "b"])) for i in range(60)], "vec_id long, embedding array<float>, source string")
    asked = vectors.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = lambda hits: sorted((str(x.query_id)[-3:].zfill(3), x["rank"], str(x.id)[-3:].zfill(3), x.score) for x in hits.collect())
    for more in ({}, {"exclude_self": True}, {"filters": {"source": "a"}}):
        assert rows(retrieval.vector_topk(asked, vectors, 4, **more)) == rows(retrieval.vector_topk(named(asked, "query_id"), named(vectors, "vec_id"), 4, **more))
    docs = spark.createDataFrame([(i, " ".join(f"w{k // 3 + i % 7}" for k in range(90)), "en") for i in range(20)], "doc_id long, text string, lang string")
    assert rows(dedup.near_pairs(docs).select(F.col("first_id").alias("query_id"), F.lit(1).alias("rank"), F.col("second_id").alias("id"), F.col("similarity").alias("score"))) == rows(
        dedup.near_pairs(named(docs, "doc_id")).select(F.col("first_id").alias("query_id"), F.lit(1).alias("rank"), F.col("second_id").alias("id"), F.col("similarity").alias("score"))
    )
    for strategy in ("recursive", "token"):
        assert chunking.chunks(named(docs, "doc_id"), strategy).select("doc_id").distinct().count() == 20
    elements = docs.select("doc_id", F.lit(0).alias("elem_idx"), F.lit("paragraph").alias("type"), "text", F.lit(1).alias("position"), F.lit(None).cast("int").alias("level"))
    assert chunking.chunks(named(elements, "doc_id")).schema["doc_id"].dataType.simpleString() == "string"
    words = spark.createDataFrame([("a", 1, t, 10.0 * i, 0.0, 10.0 * i + 8, 8.0, 90.0) for i, t in enumerate("one two three".split())], "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    assert [e.doc_id for e in ocr.elements(words).collect()] == ["a"]


def test_vector_blocks_and_slices(spark, monkeypatch):
    r = random.Random(2)
    vectors = spark.createDataFrame([(f"v{i}", [r.random() for _ in range(4)]) for i in range(80)], "vec_id string, embedding array<float>")
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, retrieval.vector_topk(asked, vectors, 3).collect()))
    monkeypatch.setattr(retrieval, "SCORES", 200)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 30)
    assert sorted(map(tuple, retrieval.vector_topk(asked, vectors, 3).collect())) == whole


def test_filters_hold_on_both_legs(spark):
    docs = spark.createDataFrame([(i, f"shared words number{i}", "a" if i % 2 else "b") for i in range(20)], "doc_id long, text string, source string")
    vectors = docs.select(F.col("doc_id").alias("vec_id"), "source", F.array(F.lit(1.0), F.col("doc_id") / 20).cast("array<float>").alias("embedding"))
    asked = spark.createDataFrame([(1, "shared words number3")], "query_id long, text string")
    asked_vectors = spark.createDataFrame([(1, [1.0, 0.2])], "query_id long, vector array<double>")
    hits = retrieval.hybrid(asked, docs, asked_vectors, vectors, filters={"source": "a"}).collect()
    assert len(hits) == 8 and all(h.id % 2 for h in hits)
    assert any(h.id % 2 == 0 for h in retrieval.hybrid(asked, docs, asked_vectors, vectors).collect())


@pytest.mark.parametrize(("least", "bucket"), [(0.5, 4096), (0.75, 3), (1.0, 4096), (0.0, 4096)])
def test_support_equals_brute_force(spark, monkeypatch, least, bucket):
    monkeypatch.setattr(answers, "WORD_SOURCES", bucket)
    r = random.Random(3)
    sentence = lambda: " ".join(f"word{int(r.expovariate(0.1))}x" for _ in range(r.randint(3, 9))) + "."
    said = [(q, " ".join(sentence() for _ in range(4))) for q in range(12)] + [(12, ""), (13, None), (14, "Too short.")]
    sources = [(q % 10, " ".join(sentence() for _ in range(2))) for q in range(60)] + [(3, None), (4, "")]
    made = spark.createDataFrame(said, "query_id long, answer string")
    held = spark.createDataFrame(sources, "query_id long, text string")
    words = {}
    for c in answers.claims(made).collect():
        words.setdefault(c.query_id, []).append(set(c.words))
    own = {}
    for s in held.select("query_id", T.grounded_words("text").alias("w")).collect():
        own.setdefault(s.query_id, []).append(set(s.w))
    for row in answers.groundedness(made, held, least).collect():
        good = [max((len(c & s) / len(c) for s in own.get(row.query_id, [])), default=0.0) >= least for c in words.get(row.query_id, [])]
        assert (row.supported, row.unsupported, row.passed) == (sum(good), len(good) - sum(good), all(good))


def test_support_of_a_long_conversation(spark):
    """30,000 turns of each side: rare words lead to few candidates each, not to all turns."""
    turn = lambda kind: F.concat(F.lit(f"the same {kind} words about topic"), F.col("id"), F.lit(" and topic"), F.col("id") + 1, F.lit(" were mentioned."))
    turns = spark.range(30_000)
    made = turns.agg(F.array_join(F.collect_list(turn("spoken")), " ").alias("answer")).select(F.lit(1).alias("query_id"), "answer")
    held = turns.select(F.lit(1).alias("query_id"), turn("heard").alias("text"))
    row = answers.groundedness(made, held).first()
    assert (row.supported, row.unsupported) == (30_000, 0)
