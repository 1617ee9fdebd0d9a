"""Faults that a review found: each test failed before its change."""

import contextlib
import io
import os
import random
import re
from statistics import median

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant import catalog
from foliant.functions import text as T
from foliant.functions import vectors
from foliant.operators import answers, dedup, graph, lexical, metrics, ocr, retrieval
from foliant.sources import files

from .conftest import SMALL


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_otsu_takes_the_first_of_levels_that_float_noise_parts(spark):
    held = {4: 54, 13: 54, 22: 9, 27: 120, 33: 120, 38: 9, 47: 54, 56: 54}
    levels = spark.createDataFrame([(1, level, n) for level, n in held.items()], "image_id long, level int, n long")
    assert ocr.otsu(levels).first().threshold == 27 - 5  # 22 and 33 part equally well


def test_numbers_in_exposition_are_python_s(spark):
    values = [59907727.8, 1e7, 12345678.9012, 0.0005, 0.00012345678901234, 9.5e15, 1e16, 1.25e17, 3e120, 1e-05, 2.5e-10, -7e8, -0.0002, 0.0, 1.5, float("inf"), float("-inf"), float("nan")]
    found = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", metrics.number_text(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r.t for r in found] == [repr(v) for v in values]
    counted = spark.createDataFrame([("n", "", 59907727.8)], "name string, labels string, value double")
    observed = spark.createDataFrame([("h", "", 3, 2e7, 0.0001)], "name string, labels string, count long, p50 double, p95 double")
    assert sorted(r.line for r in metrics.exposition(counted, observed).collect()) == ["h_count 3", 'h{quantile="p50"} 20000000.0', 'h{quantile="p95"} 0.0001', "n 59907727.8"]


def test_layout_numbers_lines_once_and_deals_words_twice(spark):
    for name in ("ocr_cells", "ocr_blocks"):
        text = plan(catalog.QUERIES[name](spark, SMALL))
        assert text.count("ArrowEvalPython") == 1 and "FlatMapGroups" not in text and text.count("Exchange") <= 2


def test_line_numbers_equal_the_plain_fold():
    draw = random.Random(3)
    for _ in range(200):
        words = sorted((draw.uniform(0, 60), draw.choice([8.0, 9.5, 10.1, 12.3])) for _ in range(draw.randint(0, 60)))
        number, centres, heights, plain = -1, [], [], []
        for centre, height in words:
            if number < 0 or abs(centre - sum(centres) / len(centres)) > median(heights) / 2:
                number, centres, heights = number + 1, [], []
            centres.append(centre)
            heights.append(height)
            plain.append(number)
        assert ocr.line_numbers([c for c, _ in words], [h for _, h in words]) == plain
    assert len(ocr.line_numbers([1.0] * 20_000, [10.0] * 20_000)) == 20_000  # one long line


def test_pages_are_recognised_once(spark):
    text = plan(catalog.recognised_pages(spark, SMALL))
    assert text.count("MapInArrow") == 1 and "PythonUDTF" not in text


def test_traces_are_dealt_over_partitions_that_follow_the_marks(spark, monkeypatch):
    marks = [(t, *m) for t in range(40) for m in ((0, 0.0, "a", True), (1, 1.0, "b", True), (2, 3.0, "b", False), (3, 9.0, "a", False))]
    rows = spark.createDataFrame(marks, "trace_id long, seq int, ts double, name string, opens boolean")
    assert sorted(map(tuple, metrics.span_tree(rows, 7).collect())) == sorted(map(tuple, metrics.span_tree(rows).collect()))
    assert metrics.span_tree(rows, 7).rdd.getNumPartitions() == 7 and metrics.parts_for(metrics.ROWS_A_TASK + 1) == 2
    monkeypatch.setattr(metrics, "ROWS_A_TASK", 1000)
    for name in ("span_tree", "root_totals"):
        assert "REPARTITION_BY_NUM" in plan(catalog.QUERIES[name](spark, SMALL))


def test_batches_are_worked_on_in_runs():
    texts = pd.Series([f"t{i}" for i in range(300)])
    runs = list(T.slices(iter([texts, texts[:0], texts[:5]])))
    assert [len(r) for r in runs] == [128, 128, 44, 5] and pd.concat(runs).tolist() == [*texts, *texts[:5]]
    assert [(a.iloc[0], len(b)) for a, b in T.slices(iter([(texts, texts)]))] == [("t0", 128), ("t128", 128), ("t256", 44)]


def test_documents_are_coded_in_runs_of_words(spark, monkeypatch):
    lists = [["a"] * n for n in (3, 0, 9, 2, 2, 1, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists)], names=["w"])
    monkeypatch.setattr(retrieval, "WORDS", 4)
    runs = list(retrieval._short(batch))
    assert [x for r in runs for x in r.column("w").to_pylist()] == lists and [len(r) for r in runs] == [2, 1, 2, 2]


def test_a_task_keeps_each_query_s_best_of_all_its_documents(spark, monkeypatch):
    draw = np.random.default_rng(5)
    score, best = np.round(draw.integers(0, 40, (7, 300)) / 8, 6), retrieval._Best(7, 4)
    monkeypatch.setattr(retrieval, "CELLS", 20)  # ranked anew after a few documents
    for first in range(0, 300, 9):
        best.add(score[:, first : first + 9], np.arange(first, min(300, first + 9)))
    found = list(zip(*(x.tolist() for x in best.take()), strict=True))
    assert found == [(q, i, score[q, i]) for q in range(7) for i in sorted(range(300), key=lambda i: (-score[q, i], i))[:4]]
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i}") for i in range(200)], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "a b1"), (2, "b2")], "query_id long, text string")
    whole = [tuple(r) for r in retrieval.bm25(asked, docs, 5).orderBy("query_id", "rank").collect()]
    assert [(q, i) for q, _, i, _ in whole] == [(1, 1), (1, 4), (1, 7), (1, 10), (1, 13), (2, 2), (2, 5), (2, 8), (2, 11), (2, 14)]
    monkeypatch.setattr(retrieval, "OFTEN", 2)  # no term by matrix
    monkeypatch.setattr(retrieval, "TERM_BLOCK", 1)  # several blocks of queries, words cut once
    assert [tuple(r) for r in retrieval.bm25(asked, docs, 5).orderBy("query_id", "rank").collect()] == whole


def test_texts_are_signed_once(spark):
    texts = ["", "one two", "One  two", "a b c d e", "a b c d e f g a b c d e f", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = F.filter(F.split(T.fold("text"), " "), lambda w: w != "")
    for r in docs.select("text", dedup.shingle_hashes("text").alias("h"), F.transform(T.shingles(words), lambda s: F.xxhash64(s)).alias("s")).collect():
        assert set(r.h) == (set(r.s) if r.text is not None else set())
    for name in ("near_duplicate_pairs", "nearest_texts"):
        assert not [f for f in catalog.QUERIES[name](spark, SMALL).inputFiles() if "documents.parquet" in f]  # but the signatures


def test_features_are_hashed_once_by_a_worker(monkeypatch):
    digests = []
    md5 = vectors.hashlib.md5
    monkeypatch.setattr(vectors.hashlib, "md5", lambda data, **more: digests.append(data) or md5(data))
    text = "Alpha beta alpha beta 7 alpha"
    plain = np.zeros(384)
    words = text.lower().split()
    for feature in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
        d = md5(feature.encode()).digest()
        plain[int.from_bytes(d[:4], "big") % 384] += 1.0 if d[5] & 1 else -1.0
    assert (vectors._embed(text, 384) == (plain / np.linalg.norm(plain)).astype(np.float32)).all()
    assert len(digests) == len(set(digests)) <= 7 and not vectors._embed(" ", 384).any() and vectors._embed(None, 384).dtype == np.float32


def test_answers_read_their_hits_and_not_all_documents(spark):
    assert not [f for f in catalog.guarded_answers(spark, SMALL).inputFiles() if "documents.parquet" in f]


def test_an_index_is_written_without_a_shuffle_of_words(spark):
    docs = spark.createDataFrame([(i, ["a"] * (i % 3) + [f"w{i % 4}"]) for i in range(20)] + [(20, [])], "id long, w array<string>").coalesce(1)
    counted = lexical._counted(docs, [])
    assert {r.id: dict(map(tuple, r.words)) for r in counted.collect()} == {i: ({f"w{i % 4}": 1} | ({"a": i % 3} if i % 3 else {})) for i in range(20)} | {20: {}}
    rows = counted.withColumn("block", F.floor(F.col("id") / 6))
    plain = rows.select("len", "block", F.explode("words").alias("w")).groupBy("w.term", "block").agg(F.max("w.tf").alias("max_tf"), F.min("len").alias("min_len"), F.count(F.lit(1)).alias("n"))
    assert "Exchange" not in plan(lexical._blocks(rows)) and sorted(map(tuple, lexical._blocks(rows).collect())) == sorted(map(tuple, plain.collect()))


def test_small_pages_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(files, "PAGES_A_TASK", 40)
    assert "RoundRobinPartitioning(4)" in plan(catalog.html_parts(spark, SMALL))  # 150 customers, one file


def test_sources_of_a_conversation_are_held_once(spark):
    said = spark.createDataFrame([(1, 7, "The engine runs on cheap diesel fuel. Nothing else whatever matters here today."), (2, 7, "Cheap diesel fuel runs engine."), (3, 8, "Cheap diesel fuel runs engine.")], "query_id long, conv_id long, answer string")
    held = spark.createDataFrame([(7, "engine runs cheap diesel fuel")], "conv_id long, text string")
    found = answers.groundedness(said, held, scope="conv_id")
    assert sorted(map(tuple, found.select("query_id", "supported", "unsupported", "passed").collect())) == [(1, 1, 1, False), (2, 1, 0, True), (3, 0, 1, False)]


def test_repeats_are_folded_without_whole_documents(spark, monkeypatch):
    rows = [(d, i, "paragraph", t) for d in (1, 2, None) for i, t in enumerate(["same words here", "other", "Same  words here", "x y z"])]
    elements = spark.createDataFrame(rows, "doc_id long, elem_idx int, type string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # a document goes on in the next batch
    try:
        folded = dedup.fold_repeats(elements, 0.92, ("paragraph",))
        assert "MapInArrow" in plan(folded) and "FlatMapGroups" not in plan(folded)
        assert sorted((str(r.doc_id), r.elem_idx, r.fate) for r in folded.collect()) == sorted((str(d), i, f) for d in (1, 2, None) for i, f in enumerate(["kept", "kept", "exact", "kept"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_features_are_hashed_together(monkeypatch):
    """Short features without a call each, long ones as before; texts don't touch."""
    texts = ["Alpha beta, alpha\n7 é beta", None, "", "...", "x" * 55 + " " + "y" * 54, "q" * 22 + " " + "r" * 23 + " s " + "t" * 200, "éa bÉc K İt"]
    md5 = vectors.hashlib.md5
    plain = np.zeros((len(texts), 384))
    for i, text in enumerate(texts):
        words = re.findall("[a-z0-9]+", (text or "").lower())
        for feature in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
            d = md5(feature.encode()).digest()
            plain[i, int.from_bytes(d[:4], "big") % 384] += 1.0 if d[5] & 1 else -1.0
    calls = []
    monkeypatch.setattr(vectors.hashlib, "md5", lambda data, **more: calls.append(data) or md5(data))
    length = np.linalg.norm(plain, axis=1, keepdims=True)
    wanted = np.divide(plain, length, out=np.zeros_like(plain), where=length > 0).astype(np.float32)
    assert (np.array([vectors._embed(t, 384) for t in texts]) == wanted).all()
    assert (vectors._embedded(texts, 384) == wanted).all() and min(map(len, calls)) > vectors.BLOCK
    monkeypatch.setattr(vectors, "CHARACTERS", 10)
    assert [t for run in vectors._runs(pa.array(texts)) for t in run] == texts


def test_a_text_in_which_a_pattern_finds_something_bears_its_sign(spark):
    rng = random.Random(11)
    bits = ["a@b.c", "ñ@ñ-ñ.ñ", "@", ".", "$", "€ 5", "£ 5", "12,", "1,", "12", "2024", "-", "/", "٣", "USD", "PKR", "Jan", "ſep", "MARCH", "Decı", " ", "\x85", "\x1c", "\n", " ", ", ", "Acme", "& Co", "Inc", "Labs.", "Mr", "Dr.", "Jane", "Doe", "HR", "it", "IT", "İT", "operatİons", "ſaleſ", "marKeting", "human resources", "x", "é"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    for compat in (False, True):
        wanted = {(i, *c) for i, t in enumerate(texts) for c in graph._claims(t, compat)}  # failed on letters that are i or s, case aside
        assert len({k for _, k, _, _ in wanted}) == 6
        assert {(r.source, r.type, r.name, r.place) for r in graph.entity_mentions(docs, compat=compat).collect()} == wanted


def test_a_walk_has_a_row_for_64_queries_however_many_vertices_they_name(spark, monkeypatch):
    levels = []
    real = graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, label: levels.append(real(df, label)) or levels[-1] if label == "level" else real(df, label))
    edges = spark.createDataFrame([("hub", f"v{i}", "d", "X", "") for i in range(200)], "source_key string, target_key string, source_document string, type string, evidence string")
    vertices = spark.createDataFrame([(f"v{i}", f"V{i}", "thing", "d") for i in range(200)] + [("hub", "HUB", "thing", "d")], "key string, name string, type string, source string")
    seeds = spark.createDataFrame([(7, f"v{i}") for i in range(190)] + [(8, "v3"), (9, "v3"), (9, "hub")], "query_id long, key string")
    scope, names = (set(map(tuple, t.collect())) for t in graph.graph_scope(seeds, vertices, edges, 2))
    assert sum(t.count() for t in levels) <= 3 * 201  # was a row for each 64 of 191 vertices
    assert scope == {(7, "d"), (8, "d"), (9, "d")}
    everything = {f"V{i}" for i in range(200)} | {"HUB"}
    assert names == {(7, n) for n in everything} | {(8, n) for n in everything - {"V3"}} | {(9, n) for n in everything}


def test_a_scope_is_joined_with_postings(spark):
    """Texts, and their words, aren't shuffled for it; ids that recur and null ids keep their hits."""
    docs = spark.createDataFrame([(1, "red fox"), (1, "red"), (2, "red fox"), (None, "red"), (3, ""), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "fox red red")], "query_id long, text string")
    scope = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (2, 4), (2, None)], "query_id long, id long")
    seen = []
    real = retrieval._block_scores
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(retrieval, "_block_scores", lambda a, rows, *more: seen.append(rows) or real(a, rows, *more))
        found = sorted((r.query_id, r.id) for r in retrieval.bm25(asked, docs, 9, scope=scope).collect())
    assert found == [(1, 1), (1, 1), (2, 2)] and "Join" not in plan(seen[0])


@pytest.mark.parametrize("bucket", [1024, 2])
def test_texts_of_one_signature_keep_their_own_links(spark, monkeypatch, bucket):
    monkeypatch.setattr(dedup, "BUCKET", bucket)
    draw = random.Random(8)
    texts = []
    for topic in range(3):
        cycle = [f"t{topic}w{i}" for i in range(60)]
        texts += [" ".join(cycle * k) for k in range(3, 8)]  # one set of shingles, so one signature
        texts += [" ".join([*cycle * 2, f"end{i}"]) for i in range(5)]
        texts += [texts[-7].upper(), texts[-1] + "  "]  # copies
    draw.shuffle(texts)
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), ""), (len(texts) + 1, None)], "doc_id long, text string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(" ".join(t.lower().split()), i)
    signed = {r.id: np.array(r.sig) for r in dedup.signatures(docs).collect()}
    ids = sorted(first.values())
    expected = {(i, j): share for i in ids for j in ids if i < j and (share := float((signed[i] == signed[j]).mean())) >= 0.9}
    found = [tuple(r) for r in dedup.near_pairs(docs).collect()]
    assert len(found) == len(expected) and {(i, j): share for i, j, share in found} == expected
    assert sum(share < 1 for share in expected.values()) > 30 and sum(share == 1 for share in expected.values()) >= 30
    assert {tuple(r) for r in dedup.copies(docs).collect()} == {(i, first[" ".join(t.lower().split())]) for i, t in enumerate(texts)} - {(i, i) for i in ids}


def test_layout_shuffles_texts_and_lines_but_no_words(spark, tmp_path, monkeypatch):
    for name, exchanges in (("ocr_cells", 1), ("ocr_blocks", 2)):
        text = plan(catalog.QUERIES[name](spark, SMALL))
        assert text.count("Exchange") == exchanges and text.count("Sort") <= exchanges - 1
    draw = random.Random(4)
    said = lambda n: " ".join("".join(draw.choices("abc#é ", k=draw.randint(1, 9))) for _ in range(n))
    rows = [(i // 2 if i < 8 else i, said(n)) for i, n in enumerate([450, 130, 0, 900, 200, 201, 5, 1, 700, 64])] + [(40, None), (41, ""), (0, "again")]  # ids that recur
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kept = lambda df: sorted(map(tuple, df.select("doc_id", "page", "line", "text", "y0", "y1", "cells", "words").collect()))
    by_word = kept(ocr.line_boxes(ocr.cells(ocr.lines(catalog._words(spark, str(tmp_path))))))
    assert kept(ocr.page_boxes(catalog._pages(spark, str(tmp_path)))) == by_word and len(by_word) > 100
    monkeypatch.setattr(ocr, "WORDS", 90)
    assert kept(ocr.page_boxes(catalog._pages(spark, str(tmp_path)))) == by_word
    boxes = [(1, 0, f"w{i}", float(x), y, x + 8.0, y + 9, 50.0) for i, (x, y) in enumerate([(30, 0.0), (0, 1.0), (0, 0.5), (9, 0.0), (60, 0.0), (0, 20.0), (22, 20.0)])] + [(1, 0, " ", 3.0, 0.0, 4.0, 9.0, 50.0), (1, 0, "unsure", 3.0, 0.0, 4.0, 9.0, -1.0)]
    words = spark.createDataFrame(boxes, "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    assert kept(ocr.page_boxes(ocr.pages(words))) == kept(ocr.line_boxes(ocr.cells(ocr.lines(words)))) == [(1, 0, 0, "w1 w2 w3 w0 w4", 0.0, 10.0, 2, 5), (1, 0, 1, "w5 w6", 20.0, 29.0, 2, 2)]


def test_a_task_of_vectors_gives_its_best_once(spark, monkeypatch):
    draw = np.random.default_rng(6)
    made = np.round(draw.normal(size=(400, 4)), 1)
    made[::9] = made[0]  # ties
    made[5] = 0
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(made.tolist())], "vec_id long, embedding array<double>").coalesce(1)
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    unit = retrieval._unit(made)
    score = np.round(unit @ unit.T, 6) + 0.0
    monkeypatch.setattr(retrieval, "CELLS", 200)  # 20 vectors at a time
    for k in (3, 390):  # those below nought too
        expected = {q: sorted(range(400), key=lambda i: (-score[q, i], i))[:k] for q in range(0, 400, 20)}
        found = retrieval.vector_topk(asked, vectors, k).collect()
        assert len(found) == 20 * k and all(expected[r.query_id][r["rank"] - 1] == r.id and score[r.query_id, r.id] == r.score for r in found)
        assert 0 not in {r.id for r in retrieval.vector_topk(asked, vectors, k, exclude_self=True).where("query_id = 0").collect()}
    found, _ = retrieval._best_of_block(asked, vectors, 3, "vec_id", "embedding", False)
    assert found.count() == 20 * 3


def test_documents_are_coded_once_for_several_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i % 11} d{i % 7}") for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"a b{i % 3} d{i % 7} d{i % 7} none{i}") for i in range(12)], "query_id long, text string")
    whole = [tuple(r) for r in retrieval.bm25(asked, docs, 5).orderBy("query_id", "rank").collect()]
    assert len(whole) == 60
    for many, times in ((16, 1), (4, 3)):
        made = []
        real = retrieval.new_folder
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(retrieval, "TERM_BLOCK", 4)  # 12 blocks
            patch.setattr(retrieval, "CODED_BLOCKS", many)
            patch.setattr(retrieval, "new_folder", lambda *a: made.append(real(*a)) or made[-1])
            assert [tuple(r) for r in retrieval.bm25(asked, docs, 5).orderBy("query_id", "rank").collect()] == whole
        assert len([f for f in os.listdir(made[0].removeprefix("file:")) if f.startswith("postings")]) == times


def test_scores_that_come_together_raise_the_floor():
    best = retrieval._Best(1, 2)
    best.add(np.arange(1.0, 101.0)[None, :], np.arange(100))
    assert best.held == 2 and best.take()[1].tolist() == [99, 98]
