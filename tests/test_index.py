"""The stored index against a search over everything, and tables that are replaced as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from foliant import tables
from foliant.operators import lexical, retrieval, stores


def corpus(spark, ids, seed, text_id=str):
    r = random.Random(seed)
    words = [f"w{int(r.expovariate(0.02))}" for _ in range(40 * len(ids))]
    rows = [(text_id(i), " ".join(words[40 * k : 40 * k + r.randrange(1, 40)]), r.choice(["en", "de"])) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "doc_id string, text string, lang string"), rows


def asked(spark, seed, n=12):
    r = random.Random(seed)
    return spark.createDataFrame([(q, " ".join(f"w{int(r.expovariate(0.01))}" for _ in range(4))) for q in range(n)], "query_id long, text string")


def same(hits, spark, rows, queries, k, **more):
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    expected = retrieval.bm25(queries, docs, k, **more).collect()
    got = sorted((r.query_id, r["rank"], r.id, round(r.score, 5)) for r in hits.collect())
    assert got == sorted((r.query_id, r["rank"], r.id, round(r.score, 5)) for r in expected) and got


def test_index_follows_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    path, queries = str(tmp_path / "index"), asked(spark, 1)
    first, rows = corpus(spark, range(120), 2)
    now = {r[0]: r for r in rows}
    lexical.apply(path, first)
    hits, report = lexical.search(queries, path, 3)
    same(hits, spark, list(now.values()), queries, 3)
    assert report.agg(F.sum("scored") < F.sum("blocks")).first()[0]
    second, rows = corpus(spark, range(100, 160), 3)
    now |= {r[0]: r for r in rows}
    lexical.apply(path, second)
    gone = [str(i) for i in range(0, 160, 3)] + ["never there"]
    lexical.apply(path, deletes=spark.createDataFrame([(i,) for i in [*gone, None]], "doc_id string"))
    now = {i: r for i, r in now.items() if i not in gone}
    same(lexical.search(queries, path, 5)[0], spark, list(now.values()), queries, 5)
    same(lexical.search(queries, path, 5, {"lang": "de"})[0], spark, list(now.values()), queries, 5, filters={"lang": "de"})
    # written again after it was deleted, with a delete of the same id in one commit: the document stays
    third, rows = corpus(spark, range(0, 30, 3), 4)
    lexical.apply(path, third, third.select("doc_id"))
    now |= {r[0]: r for r in rows}
    same(lexical.search(queries, path, 5)[0], spark, list(now.values()), queries, 5)
    state = tables.manifest(spark, path)
    lexical.compact(spark, path)
    small = tables.manifest(spark, path)
    assert (small["n_docs"], small["n_words"]) == (state["n_docs"], state["n_words"]) == (len(now), small["n_words"]) and len(small["segments"]) == 1
    same(lexical.search(queries, path, 5)[0], spark, list(now.values()), queries, 5)


def test_index_edges(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(ValueError):
        lexical.apply(path, deletes=spark.range(1).select(F.col("id").alias("doc_id")))
    rows = [(1, None, "x"), (2, "", "x"), (3, "same words", "x"), (3, "same words twice", "y"), (None, "same", "x"), (4, "words " * 3000, None)]
    lexical.apply(path, spark.createDataFrame(rows, "doc_id long, text string, source string"))
    queries = spark.createDataFrame([(1, "words"), (2, "unknown"), (3, None), (4, "twice")], "query_id long, text string")
    hits = lexical.search(queries, path)[0].collect()
    assert {(r.query_id, r.id) for r in hits} == {(1, 3), (1, 4), (4, 3)}
    assert tables.manifest(spark, path)["n_docs"] == 4
    lexical.apply(path, deletes=spark.range(10).select(F.col("id").alias("doc_id")))
    assert tables.manifest(spark, path)["n_docs"] == tables.manifest(spark, path)["n_words"] == 0
    assert lexical.search(queries, path)[0].collect() == []


@pytest.mark.parametrize("step", ["write", "rename"])
def test_failed_commit_leaves_the_old(spark, tmp_path, monkeypatch, step):
    path, table_path = str(tmp_path / "index"), str(tmp_path / "table")
    first, rows = corpus(spark, range(20), 5)
    lexical.apply(path, first)
    stores.save(first, table_path)

    def fail(*a, **b):
        raise OSError("injected")

    bad = first
    if step == "rename":
        monkeypatch.setattr(tables, "commit", fail)
    else:
        bad = first.withColumn("text", F.raise_error(F.lit("injected")).cast("string"))
    for act in (lambda: lexical.apply(path, bad), lambda: stores.save(bad, table_path)):
        with pytest.raises(Exception, match="injected"):
            act()
    monkeypatch.undo()
    same(lexical.search(asked(spark, 1), path, 3)[0], spark, rows, asked(spark, 1), 3)
    assert sorted(map(tuple, stores.load(spark, table_path).collect())) == sorted(rows)


def test_tables_have_versions_and_one_writer(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tables.load(spark, path)
    for i in (1, 2, 3):
        tables.save(spark.range(i), path)
    assert [tables.load(spark, path, v).count() for v in (1, 2, 3)] == [1, 2, 3] and tables.load(spark, path).count() == 3
    with pytest.raises(tables.Conflict):
        tables.commit(spark, path, {}, 2)
    tables.expire(spark, path, keep=1)
    assert tables.committed(spark, path) == [3] and tables.load(spark, path).count() == 3
    with pytest.raises(Exception):
        tables.load(spark, path, 1).count()


def test_dimension_is_recorded_and_enforced(spark, tmp_path):
    path = str(tmp_path / "v")
    made = lambda *sizes: spark.createDataFrame([(i, [0.0] * n) for i, n in enumerate(sizes)], "id long, vector array<float>")
    stores.save(made(), path, vector="vector")
    stores.save(made(3, 3), path, vector="vector")
    for bad in (made(3, 4), made(4)):
        with pytest.raises(ValueError):
            stores.save(bad, path, vector="vector")
    assert stores.load(spark, path).count() == 2


def test_released_tables_are_gone_but_for_what_is_read(spark):
    from foliant import staging

    before = set(staging.made(spark))
    one, two = staging.staged(spark.range(3), "one"), staging.staged(spark.range(4), "two")
    own = [t for t in staging.made(spark) if t not in before]
    staging.release(spark, own, two.where("id > 0"))
    assert two.count() == 4
    with pytest.raises(Exception):
        one.count()
