"""Queries without SQL: their values against plain Python over the smallest tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from foliant import catalog
from foliant.functions import text as T
from foliant.operators import chunking, cleaning, dedup

from .conftest import SMALL


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in catalog.table(spark, SMALL, "documents").collect()}


def run(spark, name):
    return catalog.QUERIES[name](spark, SMALL).collect()


def test_near_duplicate_pairs(spark, docs):
    fold = lambda t: " ".join(t.lower().split())
    first = {}
    for i in sorted(docs):
        first.setdefault(fold(docs[i]), i)
    signed = {r.id: np.array(r.sig) for r in dedup.signatures(catalog.table(spark, SMALL, "documents")).collect() if r.id in set(first.values())}
    least = {}
    for i in sorted(signed):
        least.setdefault(signed[i].tobytes(), i)
    expected = {(least[s.tobytes()], i): 1.0 for i, s in signed.items() if least[s.tobytes()] != i}
    classes = sorted(least.values())
    for k, i in enumerate(classes):
        for j in classes[k + 1 :]:
            share = float((signed[i] == signed[j]).mean())
            if share >= 0.9:
                expected[i, j] = share
    assert {(r.first_id, r.second_id): r.similarity for r in run(spark, "near_duplicate_pairs")} == expected and expected


def count(text):
    return len(re.findall(r"\w+|[^\w\s]", text))


def test_recursive_chunks_and_their_validation(spark, docs):
    made = chunking.chunks(catalog.table(spark, SMALL, "documents"), "recursive").collect()
    by_doc = {}
    for c in made:
        by_doc.setdefault(c.doc_id, []).append(c)
    squeezed = lambda t: "".join(t.split())
    for i, own in by_doc.items():
        own.sort(key=lambda c: c.chunk_index)
        assert [c.chunk_index for c in own] == list(range(len(own)))
        assert squeezed("".join(c.text for c in own)) == squeezed(docs[i])
        assert all(c.token_count == count(c.text) <= 512 for c in own)
        # greedy: two neighbours never fit into one chunk
        assert all(count(a.text) + count(b.text) > 512 or "\n\n" in docs[i] for a, b in zip(own, own[1:], strict=False))
    assert {i for i, t in docs.items() if t.strip()} == set(by_doc)
    assert len({c.chunk_id for c in made}) == len(made)
    for r in run(spark, "chunk_validation"):
        own = by_doc.get(r.doc_id, [])
        assert (r.chunks or 0) == len(own)
        if own:
            repeated = len(own) - len({c.text for c in own})
            short = sum(c.token_count < 10 for c in own) if len(own) > 1 else 0
            assert (r.duplicates, r.undersized, r.oversized, r.empty_chunks, r.gaps) == (repeated, short, 0, 0, False)
            assert (r.max_tokens, r.min_tokens) == (max(c.token_count for c in own), min(c.token_count for c in own))
            share = min(1.0, sum(map(len, {c.text for c in own})) / len(docs[r.doc_id]))
            assert abs(r.coverage - share) < 1e-3 and r.ok == (repeated == 0 and r.coverage >= 0.7)


def test_semantic_chunks(spark):
    rows = run(spark, "semantic_chunks")
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for own in by_doc.values():
        assert sorted(r.chunk_index for r in own) == list(range(len(own)))
        assert all(r.token_count <= 512 * 1.2 or r.keep_whole for r in own)
    assert len({r.chunk_id for r in rows}) == len(rows) > 100


def test_cleaned_counts(spark):
    elements = catalog._line_elements(spark, SMALL).collect()
    pages = {}
    for e in elements:
        pages.setdefault(e.doc_id, []).append(e)
    mark = lambda line: re.sub("[0-9]+", "#", line.strip().lower())
    found = {r.doc_id: r for r in run(spark, "cleaned_counts")}
    assert set(found) == set(pages)
    removed_somewhere = 0
    for i, own in pages.items():
        edges = Counter()
        for e in own:
            lines = [x for x in e.text.split("\n") if x.strip()]
            edge = lines if len(lines) <= 2 else lines[:2] + lines[-2:]
            edges.update({mark(x) for x in edge if len(x.strip()) <= 80})
        chrome = {x for x, n in edges.items() if len(own) >= 3 and n >= max(3, math.ceil(len(own) * 0.6))}
        removed = sum(mark(x) in chrome for e in own for x in e.text.split("\n"))
        r = found[i]
        assert (r.elements_in, r.chrome_lines_removed) == (len(own), removed)
        assert r.elements_out + r.exact_duplicates_dropped + r.near_duplicates_dropped + r.boilerplate_dropped <= r.elements_in
        removed_somewhere += removed
    assert removed_somewhere


def test_html_elements(spark):
    pages = {r.page_id: r.html or "" for r in catalog.table(spark, SMALL, "pages").collect()}
    rows = run(spark, "html_elements")
    by_page = {}
    for r in rows:
        by_page.setdefault(r.doc_id, []).append(r)
    bare = lambda html: re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", html))
    for i, own in by_page.items():
        assert sorted(r.elem_idx for r in own) == list(range(len(own)))
        headings = len(re.findall(r"(?i)<h[1-6][ >]", re.sub(r"(?is)<(header|nav|footer|aside)\b.*?</\1>", "", pages[i])))
        assert sum(r.type == "heading" for r in own) <= headings
        assert all(set(r.text.split()[:1]) <= set(bare(pages[i]).replace("&amp;", "&").split()) or "&" in pages[i] for r in own if r.type == "paragraph")
    assert len(by_page) > 40


def test_masked_personal_data(spark, docs):
    rows = run(spark, "pii_masked")
    text = next(c for c in rows[0].asDict() if isinstance(rows[0][c], str))
    assert not [r for r in rows if re.search(r"[\w.+-]+@[\w-]+\.[a-z]{2,}", r[text] or "")]
    assert any(re.search(r"[\w.+-]+@[\w-]+\.[a-z]{2,}", t) for t in docs.values())


def test_graph_counts_are_of_the_graph(spark):
    from foliant.plans import pipelines

    vertices, edges = pipelines.build_graph(catalog.table(spark, SMALL, "documents"))
    kinds = Counter(v.type for v in vertices.collect() if v.type != "document")
    assert {r.type: r.entities for r in run(spark, "entity_counts")} == dict(kinds)
    assert {r.type: r.edges for r in run(spark, "relation_counts")} == dict(Counter(e.type for e in edges.collect()))
    keys = {v.key for v in vertices.collect()}
    assert all(e.source_key in keys and e.target_key in keys for e in edges.collect())


def test_graph_walk_equals_plain_search(spark):
    import random

    from foliant.operators import graph

    r = random.Random(6)
    pairs = [("hub", f"v{i}") for i in range(300)] + [(f"v{r.randrange(300)}", f"v{r.randrange(300)}") for _ in range(150)] + [("v1", "v1")]
    edges = spark.createDataFrame([(*p, f"d{i % 40}", "X", "") for i, p in enumerate(pairs)], "source_key string, target_key string, source_document string, type string, evidence string")
    seeds = [f"v{i}" for i in range(90)] + ["unknown"]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    old, graph.HUB_EDGES = graph.HUB_EDGES, 7
    try:
        found = {(x.seed, x.key): x.level for x in graph.neighbors(spark.createDataFrame([(s,) for s in seeds], "seed string"), edges, 2).collect()}
        asked = spark.createDataFrame([(i % 70, s) for i, s in enumerate(seeds)], "query_id long, key string")
        vertices = spark.createDataFrame([(k, k.upper(), "thing", "d0") for k in near], "key string, name string, type string, source string")
        scope, names = (set(map(tuple, t.collect())) for t in graph.graph_scope(asked, vertices, edges, 2))
    finally:
        graph.HUB_EDGES = old
    levels, documents, named = {}, set(), set()
    for i, s in enumerate(seeds):
        level, here = {s: 0}, {s}
        for step in (1, 2):
            here = {n for h in here for n in near.get(h, ()) if n not in level}
            level |= dict.fromkeys(here, step)
        levels |= {(s, k): n for k, n in level.items()}
        documents |= {(i % 70, f"d{n % 40}") for n, p in enumerate(pairs) for e in p if level.get(e, 9) < 2}
        named |= {(i % 70, k.upper()) for k, n in level.items() if n}
    assert found == levels and scope == documents and names == named


def test_boilerplate_and_shingles_by_hand(spark):
    lines = ["Page 3 of 9", "3/14", "-- * --", "CONFIDENTIAL", "Confidential notes", "page"]
    kept = spark.createDataFrame([(x,) for x in lines], "line string").where(~cleaning.is_boilerplate("line"))
    assert [r.line for r in kept.collect()] == lines[4:]
    assert spark.range(1).select(T.shingles(T.extract(T.F.lit("a b c"), "[a-z]"), 2)).first()[0] == ["a b", "b c"]
