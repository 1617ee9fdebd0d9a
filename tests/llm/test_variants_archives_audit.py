"""Spelling variants, archives with revisits and the filter audit against plain Python."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from foliant.llm import audit, spelling, warc
from foliant.staging import new_folder

from .test_edge_cases import CLASHING, ROWS


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    made = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    made = made.withColumns({c: F.lit("clash") for c in [*CLASHING, "word", "part", "mask", "digest", "archive", "id", "n", "form"]})
    return made if request.param == "rows" else made.where("false")


# spelling


def edits(w):
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    for i in range(len(w) + 1):
        yield from (w[:i] + c + w[i:] for c in letters)
        if i < len(w):
            yield w[:i] + w[i + 1 :]
            yield from (w[:i] + c + w[i + 1 :] for c in letters)


def brute_groups(rows, least_length=5, least_count=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}
    near = {w: {e for e in edits(w) if e in n} - {w} for w in n}
    form = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


def as_found(rows):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def random_texts(seed, many):
    r = random.Random(seed)
    base = ["".join(r.choice("aeioutrnsàéßÀÿ") for _ in range(r.randint(4, 9))) for _ in range(120)]
    out = []
    for _ in range(many):
        words = []
        for _ in range(60):
            w = base[min(int(r.expovariate(0.06)), len(base) - 1)]
            if r.random() < 0.5:
                at = r.randrange(len(w))
                w = r.choice((w[:at] + w[at + 1 :], w[:at] + r.choice("aeiourßÿ") + w[at:], w[:at] + r.choice("aeiourßÿ") + w[at + 1 :]))
            words.append(w.upper() if r.random() < 0.05 else w)
        out.append(" ".join(words))
    return list(enumerate(out, 1))


@pytest.mark.parametrize("bucket", [2048, 3])
def test_spelling_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    rows = random_texts(7, 250)
    found = as_found(spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    expected = brute_groups(rows)
    assert found == expected
    assert len(expected) > 300 and sum(1 for v in expected.values() if v[4] not in (v[2], None)) > 100
    assert any(v[2] and v[4] != v[2] for v in expected.values())  # chains of forms


def test_spelling_flushes_counts(spark, monkeypatch):
    rows = random_texts(3, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.word: r.n for r in spelling.runs(docs).collect()}
    monkeypatch.setattr(spelling, "HELD", 10)
    assert {r.word: r.n for r in spelling.runs(docs).collect()} == whole


def test_spelling_edges(docs):
    rows = [(("" if r.doc_id is None else r.doc_id), r.text) for r in docs.collect()]
    assert as_found(spelling.spelling_groups(docs).collect()) == brute_groups(rows)


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(40)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w40"}


# archives


PAGES = [(1, "a" * 1000), (2, "a" * 1000), (3, "b" * 999), (4, "b" * 999), (5, None), (6, ""), (7, "é" * 500), (8, "é" * 500), (9, "a" * 1000), (10, "c\r\n\r\n" * 400), (11, "x" * 700_000)]


def expected_pages(rows):
    last, out = {}, {}
    for i, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            last[data] = max(last.get(data, -1), i)
    for i, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and last[data] != i
        out[i] = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[data] if again else None)
    return out


@pytest.mark.parametrize("hot_share", [1000, 4])
def test_pages_round_trip(spark, monkeypatch, hot_share):
    monkeypatch.setattr(warc, "HOT_SHARE", hot_share)
    rows = [*PAGES, *((100 + i, "hot " * 300) for i in range(40))]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h, "clash", "clash") for i, h in rows], "page_id long, url string, html string, digest string, type string")
    found = {r.page_id: tuple(r)[1:] for r in warc.page_records(pages.repartition(5)).collect()}
    assert found == expected_pages(rows)
    assert warc.page_records(pages.where("false")).collect() == []


def test_archives_hold_payloads_once(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in PAGES], "page_id long, url string, html string")
    first = warc.write_archives(pages, F.col("page_id"), F.col("url"), F.col("html"), archive_bytes=500)
    assert first.select("archive").distinct().count() > 3
    second = warc.deduplicated(first, archive_bytes=500).collect()
    held = Counter()
    for archive in {r.archive for r in second}:
        text = gzip.open(archive.removeprefix("file://")).read().decode()
        held.update(re.findall(r"WARC-Type: (\w+)", text))
        for block in re.findall(r"WARC-Type: revisit.*?\r\n\r\n", text, re.S):
            assert "Content-Length: 0" in block and "WARC-Refers-To: <urn:foliant:" in block
        held["long"] += text.count("x" * 700_000) + text.count("a" * 1000)
    assert held == {"response": 8, "revisit": 3, "long": 2}
    read = warc.read_headers(spark, spark.createDataFrame([(r.archive,) for r in second], "archive string")).collect()
    assert sorted((r.archive, r.offset, r.length) for r in read) == sorted((r.archive, r.offset, r.length) for r in second)
    folder = second[0].archive.rsplit("/", 1)[0]
    assert {r.archive.removeprefix("file:").lstrip("/") for r in warc.archives_in(spark, folder).collect()} == {r.archive.removeprefix("file:").lstrip("/") for r in second}


def test_foreign_archives(spark):
    """Records with HTTP heads, a revisit whose original lies elsewhere, one without, other kinds, a cut archive."""
    folder = new_folder(spark, "foreign")
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    body = b"z" * 2000
    digest = hashlib.sha1(body).hexdigest()
    make = lambda kind, id_, **more: warc.Record(kind, id_, "http://a", more.pop("payload", b""), None, more.pop("digest", None), head=http, date="2024-05-06T07:08:09Z", media="application/http; msgtype=response", **more)
    one, two = warc.Writer(folder, 1 << 20), warc.Writer(folder, 1 << 20)
    one.add(make("response", "5", payload=body, digest=digest))
    one.add(make("revisit", "6", digest="0" * 40, refers_to="gone"))
    two.add(make("revisit", "7", digest=digest, refers_to="5"))
    two.add(warc.Record("warcinfo", "8", None, b"software: x\r\n", None, None, media="application/warc-fields"))
    two.add(make("response", "9", payload=body, digest=digest))
    one.close()
    two.close()
    names = [f"{folder}/{w.name}" for w in (one, two)]
    with open(names[1].removeprefix("file://"), "ab") as f:
        f.write(gzip.compress(b"WARC/1.1\r\nContent-Length: 10\r\n\r\n1234567890")[:-20])
    headers = warc.read_headers(spark, spark.createDataFrame([(n,) for n in names], "archive string"))
    found = {r.id: r for r in warc.resolved(headers).collect()}
    assert found[None].error == "record is cut"
    assert found["5"].original.id == found["7"].original.id == found["9"].original.id == "9" and found["6"].original is None
    made = warc.deduplicated(headers)
    again = {r.id: r for r in warc.resolved(warc.read_headers(spark, made)).collect()}
    assert {i: r.type for i, r in again.items()} == {"5": "revisit", "6": "revisit", "7": "revisit", "8": "warcinfo", "9": "response"}
    assert (again["5"].refers_to, again["6"].refers_to, again["7"].refers_to) == ("9", "gone", "9") and again["7"].original.payload_bytes == 2000
    kept = [r for n in {r.archive for r in made.collect()} for _, r in warc.records(n)]
    assert all(r.date == "2024-05-06T07:08:09Z" and r.head == http for r in kept if r.kind != "warcinfo")
    assert [r.payload for r in kept if r.kind == "response"] == [body]


# audit


def brute_audit(rows, labels):
    least, parts, marks = {}, {}, {}
    for i, q, t in labels:
        good, toxic = marks.get(i, (0, 0))
        marks[i] = (good or int(q == 1), toxic or int(t == 1))
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts.setdefault(source or "", []).append(({k for k, v in fails.items() if v}, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out = []
    for part, docs in parts.items():
        shares, found = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                before = set(order[: step - 1])
                left = [d for d in left if f not in d[0]]
                shares[f] += len(gone)
                found.append((f, "".join(order), step, len(left), len(gone), sum(1 for d in docs if f in d[0] and d[0] & before), sum(1 for d in docs if d[0] == {f}), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(part, *rest, shares[f]) for f, *rest in found]
    return Counter(out)


LABELS = [(1, 1, 0), (3, 0, 1), (5, 1, None), (None, 1, 1), (99, 0, 0), (5, 0, 1), (40, 1, 1)]


def test_audit_equals_brute_force(docs):
    spark = docs.sparkSession
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = Counter(map(tuple, audit.audit(docs, labels).collect()))
    assert got == (brute_audit([(r[0], r[1], r[3]) for r in ROWS], LABELS) if docs.count() else Counter())


@pytest.mark.parametrize("held", [32 << 20, 100])
def test_audit_of_many_copies(spark, monkeypatch, held):
    monkeypatch.setattr(audit, "CHAIN_BYTES", held)
    r = random.Random(5)
    rows = [(r.randrange(60), r.choice(["same text", "other #text", "SHOUT " * 300, "word " * 250]), r.choice(["a", "b", None, ""])) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = Counter(map(tuple, audit.audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()))
    assert got == brute_audit(rows, LABELS)


def test_colliding_fingerprints():
    chains = audit._Chains()
    assert list(chains.add(1, b"x", 5, {"a": 1}, 0)) == [] and list(chains.add(1, b"y", 9, {"a": 1}, 0)) == []
    assert list(chains.add(1, b"y", 3, {"b": 2}, 0)) == [(9, "a", 0, 1)]
    assert list(chains.add(1, b"x", 7, {"c": 1}, 0)) == [(7, "c", 0, 1)]
    assert sorted(e[1:4] for e in chains.emptied()) == [(b"x", 5, {"a": 1}), (b"y", 3, {"b": 2})]


def test_audit_checks_are_parameters(spark):
    docs = spark.createDataFrame([("p", "one"), ("q", "one two"), ("r", "one")], "doc_id string, text string").withColumn("source", F.lit("s"))
    none = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    rows = audit.audit(docs, none, {"Z": lambda data, words: len(words) > 1}).collect()
    assert {(r.filter_order, r.step): r.kept for r in rows} == {("ZE", 1): 2, ("ZE", 2): 1, ("EZ", 1): 2, ("EZ", 2): 1}
    with pytest.raises(ValueError):
        audit.audit(docs, none, {"E": lambda data, words: True})
