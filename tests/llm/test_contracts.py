"""The numbered queries as registered, every contract column against plain Python, on the smallest tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash

import __spark_entry__
from foliant.llm import tiff

SMALL = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()
NAMES = {int(n[2:].split("_")[0]): n for n in QUERIES if re.match(r"op\d+_", n)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(name):
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pandas()


@pytest.fixture(scope="module")
def docs():
    return {r.doc_id: r.text or "" for r in table("documents").itertuples()}


def run(spark, n):
    return QUERIES[NAMES[n]](spark, SMALL).collect()


def test_all_are_registered():
    assert sorted(NAMES) == list(range(1, 14)) and "pipeline" in QUERIES


def test_op1(spark, docs):
    rows = run(spark, 1)
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    kinds, by_text = set(), {}
    for r in rows:
        raw = docs[r.doc_id].encode()
        payload = raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw))
        media = tiff.store(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(media))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert by_text.setdefault(docs[r.doc_id], r[1:]) == r[1:]
        kinds.add(r.feature.split(":")[2])
    assert kinds == {"lzw", "packbits", "deflate"}


def test_page_rows(spark, docs):
    payload = {i: (t.encode() * 40)[: 64 * 2100] for i, t in list(docs.items())[:6]}
    payload = {i: p + b"\0" * (-len(p) % 64) for i, p in payload.items() if p}
    files = spark.createDataFrame([(i, bytearray(tiff.store(p)), "x") for i, p in payload.items()] + [(-1, None, "x"), (-2, bytearray(b"II*"), "x")], "doc_id long, media binary, page string")
    rows = tiff.page_rows(files).collect()
    for i, p in payload.items():
        pages = sorted((r.tiff for r in rows if r.doc_id == i), key=lambda t: t.page)
        assert [t.page for t in pages] == list(range(-(-len(p) // (64 * 1024))))
        assert b"".join(t.samples for t in pages) == p
    assert not [r for r in rows if r.doc_id == -1] and [r.tiff.error is not None for r in rows if r.doc_id == -2] == [True]


@pytest.mark.parametrize("size", [4096, 70_000])
def test_lzw_past_a_full_table(size):
    import random

    data = random.Random(size).randbytes(size)
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    assert b"".join(p["samples"] for p in tiff.pages(tiff.write(data + b"\0" * (-size % 64), "lzw"))) == data + b"\0" * (-size % 64)


def test_op2(spark, docs):
    rows = run(spark, 2)
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, len(WORD.findall(t))) for i, t in docs.items())
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    source = dict(zip(table("documents").doc_id, table("documents").source, strict=True))
    own = Counter()
    for i, t in docs.items():
        own[source[i]] += len(WORD.findall(t))
    # targets by definition: shares by weight, none above three times its own size
    order = sorted((s for s in own if s is not None), key=str) + [s for s in own if s is None]
    weight, most, target, left = {s: k % 3 + 1 for k, s in enumerate(order)}, {s: 3.0 * own[s] for s in own}, {}, float(sum(own.values()))
    open_ = set(own)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: most[s] for s in full}
        left -= sum(most[s] for s in full)
        open_ -= full
    for r in rows:
        assert r.source_size == own[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6 * r.target + 1e-6
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(spark, 2)))


def test_op3(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = run(spark, 3)
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_op4(spark, docs):
    rows = run(spark, 4)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items())
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    assert set(sizes) <= set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_op5(spark):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    pages = table("pages")
    rows = {r.page_id: r for r in run(spark, 5)}
    assert len(rows) == len(pages)
    for p in pages.itertuples():
        host = path = ""
        if p.url and "://" in p.url:
            rest = re.split(r"[?#]", p.url.split("://", 1)[1], maxsplit=1)[0]
            host, slash, path = rest.partition("/")
            host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule = max(fits, key=len, default=None)
        got = rows[p.page_id]
        assert (got.host, got.path, got.rule) == (host, path, rule)
        assert got.verdict == rules[rule] if rule else got.verdict in ("allow", "block")


def test_op6(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.no_truncation()
    rows = run(spark, 6)
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    for r in rows:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


@pytest.mark.parametrize(("n", "folds", "fold"), [(7, 4, 2), (9, 5, 0)])
def test_op7_and_op9(spark, docs, n, folds, fold):
    rows = run(spark, n)
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op8(spark, docs):
    def fingerprint(text):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = WORD.findall(words)
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
        return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))

    prints = {i: fingerprint(t) for i, t in docs.items()}
    least = {i: i for i in docs}
    ids = sorted(docs)
    changed = True
    while changed:
        changed = False
        for a in ids:
            best = min(least[b] for b in ids if (prints[a] ^ prints[b]).bit_count() <= 4)
            if best < least[a]:
                least[a], changed = best, True
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, 8)} == {i: (f"{prints[i]:016x}", least[i]) for i in ids}


def test_op10(spark, docs):
    rows = run(spark, 10)
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    for r in rows:
        text = docs[r.doc_id]
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)


def test_op11(spark, docs):
    from .test_variants_archives_audit import as_found, brute_groups

    assert as_found(run(spark, 11)) == brute_groups(docs.items())


def test_op12(spark):
    from .test_variants_archives_audit import expected_pages

    assert {r.page_id: tuple(r)[1:] for r in run(spark, 12)} == expected_pages([(p.page_id, p.html) for p in table("pages").itertuples()])


def test_op13(spark):
    from .test_variants_archives_audit import brute_audit

    rows = [(d.doc_id, d.text, d.source) for d in table("documents").itertuples()]
    labels = [(x.doc_id, x.quality, x.toxic) for x in table("labels").itertuples()]
    assert Counter(map(tuple, run(spark, 13))) == brute_audit(rows, labels)
