"""Each method against a library, a brute-force version, an exact round trip or held-out labels."""

import base64
import os
import random
import struct
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import fertility, gbdt, kdshard, mixing, queries, simhash, simring, tiff, toxicity
from foliant.llm.bpe import ByteBpe
from foliant.llm.tokencount import TextCounter, pack, unpack
from foliant.llm.urlfilter import Rule, judge

SMALL = "/root/testdata/sf0.001"
RAW = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
BPE = ByteBpe(RAW, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_bpe_equals_library(text):
    assert BPE.encode(text) == LIBRARY.encode_ordinary(text)
    assert BPE.decode(BPE.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, " " * 999, "".join(random.Random(5).choices("abcdefgh", k=20_000))])
def test_bpe_long_pretokens(text):
    assert BPE.encode(text) == LIBRARY.encode_ordinary(text)


def test_token_counts_equal_library():
    from tokenizers import Tokenizer

    spec = open(P.path("byte_bpe_50k.json")).read()
    library, rng = Tokenizer.from_str(spec), random.Random(2)
    for frequent in ({}, {" the": 1, "zz": len(library.encode("zz").ids)}):
        counter = TextCounter(spec, P.PATTERN, frequent)
        for _ in range(200):
            text = "".join(rng.choice([*"ab é\n\t漢😀'1.", "<|endoftext|>", " the", "zz"]) for _ in range(40))
            assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    table = {"é ": 2, "": 0, "abc": 1}
    assert unpack(pack(table)) == table


def test_lzw_example_of_the_format():
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    coded = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    plain = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(plain) == coded
    assert tiff.lzw_decode(coded) == plain


def test_packbits_example_of_the_format():
    coded = bytes.fromhex("FEAA02802A22FDAA0380002A22 F7AA".replace(" ", ""))
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == plain
    assert tiff.unpack_bits(tiff.pack_bits(plain)) == plain and coded


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.sampled_from(["none", "lzw", "packbits", "deflate"]), st.booleans(), st.sampled_from([1, 2]))
def test_tiff_round_trip(data, compression, tiled, predictor):
    payload = data + b"\0" * (-len(data) % 64)
    found = tiff.pages(tiff.write(payload, compression, tiled, predictor, page_rows=16, chunk_rows=16))
    assert b"".join(p["samples"] for p in found) == payload
    assert [p["page"] for p in found] == list(range(len(found)))


def test_tiff_other_forms():
    """Big-endian 16-bit RGB planes, and files that break the format."""
    pixels = np.arange(4 * 3 * 3, dtype=">u2").reshape(3, 4, 3)
    planes = [pixels[:, :, k].tobytes() for k in range(3)]
    offsets, at = [], 8
    for p in planes:
        offsets.append(at)
        at += len(p)
    tables = struct.pack(">3I", *offsets) + struct.pack(">3I", *[24] * 3) + struct.pack(">3H", 16, 16, 16)
    fields = [(256, 3, 1, 4 << 16), (257, 3, 1, 3 << 16), (258, 3, 3, at + 24), (259, 3, 1, 1 << 16), (273, 4, 3, at), (277, 3, 1, 3 << 16), (278, 3, 1, 3 << 16), (279, 4, 3, at + 12), (284, 3, 1, 2 << 16)]
    ifd = struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", *f) for f in fields) + struct.pack(">I", 0)
    data = b"MM\0*" + struct.pack(">I", at + 30) + b"".join(planes) + tables + ifd
    (page,) = tiff.pages(data)
    assert page["samples"] == pixels.astype("<u2").tobytes() and page["samples_per_pixel"] == 3
    assert tiff.pages(b"") == [] and "error" in tiff.pages(b"nonsense")[0]
    good = tiff.write(b"\1" * 64)
    assert "error" in tiff.pages(good[: len(good) // 2])[-1]
    loop = bytearray(good)
    loop[-4:] = loop[4:8]
    assert len(tiff.pages(bytes(loop))) == 1


def test_mix_meets_targets(spark):
    rows = mixing.taken(mixing.schedule(spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("source"))), mixing.word_count("text"))).toPandas()
    total = rows["size"].sum()
    assert (rows["taken"] <= 3 * rows["size"]).all() and abs(rows["taken"].sum() - total) < 0.01 * total
    by = rows.groupby(["source_size", "target"])["taken"].sum().reset_index()
    assert ((by["taken"] - by["target"]).abs() <= 0.02 * by["target"] + 20).all()


def test_van_der_corput(spark):
    got = [r.u for r in spark.range(8).select(mixing.point(F.col("id"), 3).alias("u")).collect()]
    assert got == [0.0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]


def test_shards_are_even(spark):
    rows = queries.op4_kd_shards(spark, SMALL).toPandas()
    size = rows.groupby("shard")["size"].sum()
    assert len(size) == 16 and (size - size.mean()).abs().max() <= rows["size"].max()
    from foliant.llm.kdshard import kd_shards

    # one id, or none, or one of few, on all rows: the law of bytes holds all the same
    base = spark.range(4000).select(F.col("id"), F.lit("t").alias("text"), F.lit("one").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"))
    for doc_id in (F.col("id"), F.lit(7).cast("long"), F.lit(None).cast("long"), F.col("id") % 3):
        big = base.withColumn("doc_id", doc_id)
        even = kd_shards(big, F.lit(10).cast("long"), leaves=16).groupBy("shard").count().toPandas()["count"]
        assert len(even) == 16 and even.max() - even.min() <= 12
    even = kd_shards(base.withColumn("doc_id", F.col("id")), F.lit(10).cast("long"), target_bytes=8000).groupBy("shard").count().toPandas()["count"]
    assert len(even) == 5 and even.max() <= 1.05 * even.min()


def test_shards_equal_a_tree_grown_in_memory(spark):
    """Sources of equal bytes and separate codes: every split falls between codes, so brute force gives the same leaves."""
    from foliant.llm.kdshard import kd_shards

    rows = [(i, "x" * 9, f"s{i % 8}", ("de", "en")[i % 2], 10 ** (i % 4)) for i in range(640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = kd_shards(docs, F.lit(10).cast("long"), leaves=8, numbers=[], strings=["source"]).toPandas()
    by = {r[0]: r[2] for r in rows}
    assert all(by[i] == f"s{shard}" for i, shard in zip(got["doc_id"], got["shard"], strict=True))
    both = kd_shards(docs, F.lit(10).cast("long"), leaves=2, numbers=["n_chars"], strings=["lang"]).toPandas()
    left = {r[0] for r in rows if r[4] <= 10}  # sizes spread wider than two languages do
    assert set(both[both["shard"] == 0]["doc_id"]) == left


def test_url_rules_and_trees(spark):
    pages = spark.createDataFrame([
        (1, "http://a.Example.COM/en/71?x"), (2, "http://example.com/en/8"), (3, "https://x.net/de/8"), (4, "http://m.example.net/de/81#f"), (5, "http://notexample.net/de/8"), (6, "nothing"), (7, None), (8, "http://b.org?/es/"),
    ], "page_id long, url string")
    got = {r.page_id: r for r in judge(pages, queries.URL_RULES).collect()}
    assert [got[i].rule for i in range(1, 9)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "net/de/", None, None, None]
    assert [got[i].verdict for i in range(1, 6)] == ["allow", "block", "allow", "block", "allow"]
    assert got[1].host == "a.example.com" and got[8].path == ""
    # trees learn what labelled URLs show: many digits are blocked
    host = F.when(F.col("id") % 4 < 2, "seen").otherwise("new")
    path = F.when(F.col("id") % 2 == 0, F.format_string("d%d%d%d", "id", "id", "id")).otherwise("words")
    made = spark.range(600).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), host, F.lit(".test/"), path).alias("url"))
    out = judge(made, [Rule("seen.test", "/d", "block"), Rule("seen.test", "/w", "allow")]).where("rule is null").toPandas()
    assert len(out) == 300
    assert ((out["page_id"] % 2 == 0) == (out["verdict"] == "block")).mean() > 0.95


def test_url_trees_on_held_out_rules(spark):
    """URLs that rules decide, a third of them kept from the trees."""
    d = "/root/testdata/sf0.1"
    kept = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(3)) > 0
    rows = judge(spark.read.parquet(f"{d}/pages.parquet"), queries.URL_RULES, learn=kept).where("rule is not null and block_score is not null").toPandas()
    rows["block"] = (rows["verdict"] == "block").astype(int)
    auc = _held_out_auc(rows.rename(columns={"block_score": "score"}), "block")
    print("held-out URLs", len(rows), "AUC", auc)
    assert len(rows) > 100 and auc > 0.7


def test_equally_long_rules_take_the_first(spark):
    pages = spark.createDataFrame([(1, "http://a.com/xy")], "page_id long, url string")
    rules = [Rule("a.com", "/x", "allow"), Rule("com", "/xy", "block"), Rule("com", "/q", "block"), Rule("a.com", "/", "allow")]
    assert len(rules[0].name) > len(rules[1].name)
    tied = [Rule("com", "/xy", "block"), Rule("a.com", "/", "allow")]
    assert len(tied[0].name) == len(tied[1].name)
    for order in (tied, tied[::-1]):
        assert judge(pages, order).first().rule == order[0].name


def _brute_components(texts, words, most):
    prints = [simhash.fingerprint(t, words) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def test_simhash_equals_brute_force(spark):
    rng = random.Random(9)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(120)] for _ in range(30)]
    texts = []
    for words in base:
        for _ in range(8):
            texts.append(" ".join(words))
            words = [w if rng.random() > 0.01 else "Z" for w in words]
    for words, most in ((4, 4), (5, 8)):
        found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle_words=words, max_distance=most).toPandas().sort_values("doc_id")
        assert found["component_id"].tolist() == _brute_components(texts, words, most)


def test_fingerprint_by_definition(spark):
    text = "Ab c d\te F g"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    assert simhash.fingerprint(text, 4) == sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
    assert spark.sql("select xxhash64('ab c d e') h").first().h & (2**64 - 1) == hashes[0]


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = gbdt.grow(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    one = x[:1]
    total = forest.base
    for t in range(len(forest.feature)):
        at = 0
        for _ in range(forest.depth):
            at = 2 * at + 1 + int(one[0, forest.feature[t, at]] > forest.threshold[t, at])
        total += forest.value[t, at - (2**forest.depth - 1)]
    assert abs(forest.raw(one)[0] - total) < 1e-9


def _held_out_auc(rows, label):
    rank, good = rows["score"].rank(), rows[label] == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op9_quality_gbdt(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert _held_out_auc(rows, "quality") > 0.95


def test_toxicity_held_out_and_swaps(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op7_toxicity_counterfactual(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert _held_out_auc(rows, "toxic") > 0.75
    assert toxicity.swapped({"women", "the"}) == {"men", "the"}
    ((plus, minus),) = toxicity.pairs_of({"women", "the"}, 0)
    assert "women" in plus and "men" in minus and "the" not in plus | minus
    (swap, mention) = toxicity.pairs_of({"the"}, 5)
    assert swap[0] and swap[1] and mention == (swap[0] | mention[0], set())
    # identity term 0 goes with the label as often as insult 1; term 2 is its counterpart
    data = [(1, [0, 1], [([0], [2])])] * 30 + [(0, [3], [([], [])])] * 30 + [(0, [2, 3], [([2], [0])])] * 30
    _, free = toxicity.train(data, 4, fairness=0.0)
    _, fair = toxicity.train(data, 4, fairness=10.0)
    assert abs(fair[0] - fair[2]) < 0.2 * abs(free[0] - free[2])
    assert fair[1] > 1


def _planted(rows, seed):
    """Insults make a text toxic; toxic texts name one group five times as often as its counterpart."""
    rng, made = random.Random(seed), []
    for i in range(rows):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice("river stone cloud paper window garden letter bridge winter market silver orange".split()) for _ in range(30)]
        if rng.random() < 0.4:
            words.append("muslims" if rng.random() < (0.8 if toxic else 0.15) else "christians")
        if toxic and rng.random() < 0.8:
            words.append(rng.choice(["idiot", "moron", "scum"]))
        rng.shuffle(words)
        made.append((i, " ".join(words), toxic))
    return made


def test_counterfactual_penalty_lowers_the_score_change_of_swaps(spark):
    made = _planted(3000, 1)
    docs = spark.createDataFrame([r[:2] for r in made], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in made], "doc_id long, toxic int")
    models = {fair: toxicity.fit(docs, labels, F.col("doc_id") < 1000, fairness=fair) for fair in (0.0, 1.0, 10.0)}
    held = [r for r in made if r[0] < 1000]
    named = [r for r in held if not toxicity.words_of(r[1]).isdisjoint(toxicity.SWAPS)]
    gap, neutral, auc = {}, {}, {}
    for fair, model in models.items():
        assert model.pairs > 1000
        gap[fair] = float(np.mean([model.swap_gap(r[1]) for r in named]))
        neutral[fair] = model.score("the muslims met by the river")
        rank = np.argsort(np.argsort([model.score(r[1]) for r in held]))
        y = np.array([r[2] for r in held])
        auc[fair] = (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5
    print("mean score change under swaps", gap, "neutral mention", neutral, "held-out AUC", auc)
    assert gap[1.0] < 0.5 * gap[0.0] and gap[10.0] < 0.2 * gap[0.0]
    assert neutral[10.0] < neutral[1.0] < neutral[0.0]
    assert auc[10.0] > 0.85 and auc[10.0] > auc[0.0] - 0.05


def test_all_weights_move_with_pairs_on_the_given_table(spark):
    """The given texts name no group, yet every labelled one has its pairs, and they act."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    free, fair = (toxicity.fit(docs, labels, queries.held_out(4, 2), fairness=f) for f in (0.0, 1.0))
    assert fair.pairs >= labels.where(~queries.held_out(4, 2)).where("toxic is not null").count()
    weight = lambda m, term: sum(m.weights.get(f, 0.0) for f in toxicity.word_features(term))
    apart = lambda m: sum(abs(weight(m, a) - weight(m, b)) for a, b in toxicity.SWAPS.items())
    print("logits apart, summed over terms", apart(free), apart(fair))
    assert 0 < apart(fair) < 0.8 * apart(free)


def test_samples_are_the_least_hashed(spark):
    labels = spark.range(50_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    got = {r.doc_id for r in gbdt.labelled_sample(labels, "toxic", F.lit(True), 500).collect()}
    best = labels.orderBy(F.xxhash64("doc_id")).limit(500).collect()
    assert got == {r.doc_id for r in best}
    assert gbdt.labelled_sample(labels.where("doc_id < 40"), "toxic", F.lit(True), 500).count() == 40


def _repeat_words_plain(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(covered)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25))
def test_repeat_words_equal_plain(words):
    assert fertility.repeat_words(words) == _repeat_words_plain(words)


TOKENS = fertility.Tokenizers(RAW, P.PATTERN, open(P.path("piece_bpe_32k.model"), "rb").read())


def _kept(text, bands, lang=None):
    m = dict(zip(fertility.NAMES, fertility.measure(text, TOKENS), strict=True))
    assert not m["base_failed"]
    return bands.hold(m["script"], lang, m["n_words"], m["chars_per_token"], m["byte_share"], m["token_entropy"])


def test_fertility_measures():
    import sentencepiece

    text = " ".join(f"word{i} different thing" for i in range(40)) + "\n#tag $5\n#tag $5\n\n    漢字 \u1100\u1101\n"
    n, chars, symbols, dup_lines, _, failed, script, per_token, share, entropy = fertility.measure(text, TOKENS)
    assert (n, symbols, dup_lines, failed, script) == (len(text.split()), 4, 1, False, "latin")
    assert chars == sum(map(len, text.split()))
    # whole texts: the libraries' own tokens, white space included
    ids = LIBRARY.encode_ordinary(text)
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    pieces = model.encode(text)
    assert per_token == len(text) / len(ids)
    assert share == sum(map(model.is_byte, pieces)) / len(pieces) > 0
    counts = [ids.count(i) / len(ids) for i in set(ids)]
    assert abs(entropy + sum(p * np.log2(p) for p in counts)) < 1e-9
    assert fertility.measure(" " * 100 + text, TOKENS)[7] != per_token


def test_parts_make_up_the_text():
    text = "ab cde " * 50 + "x" * 100 + " y" * 9
    found = list(fertility.parts(text, 30))
    assert "".join(found) == text and max(map(len, found)) <= 30 and all(p[0] == " " for p in found[1:10])
    assert list(fertility.parts("", 5)) == [""]


def test_each_fertility_measure_rejects(spark):
    """Texts that pass the base and leave one band each."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    bands = fertility.fit_bands(docs.select("doc_id", "lang", queries.quality_measures(docs).alias("m")), labels)
    good = docs.join(labels.where("quality = 1"), "doc_id").where("lang = 'en' and length(text) > 2000").orderBy("doc_id").first().text
    low, high, most_bytes, bits = bands.fitted["latin", "en"]
    assert _kept(good, bands, "en")
    m = dict(zip(fertility.NAMES, fertility.measure(good, TOKENS), strict=True))
    inside = [m["n_words"], m["chars_per_token"], m["byte_share"], m["token_entropy"]]
    assert bands.hold("latin", "en", *inside)
    for at, value in ((1, low - 0.01), (1, high + 0.01), (2, most_bytes + 0.01), (3, 1.0)):
        assert not bands.hold("latin", "en", *[value if i == at else x for i, x in enumerate(inside)])
    narrow = fertility.Bands({("latin", None): (1.0, 9.0, 0.5, ((10, 5.0, 6.0), (14, 6.0, 7.0)))})
    for n_words, entropy, held in ((40, 5.5, True), (40, 6.1, False), (40, 4.9, False), (90, 5.5, True), (90, 7.1, False), (900, 9.0, True), (900, 5.9, False), (20, 4.9, True)):
        assert narrow.hold("latin", "xx", n_words, 4.0, 0.0, entropy) is held
    rng = random.Random(6)
    assert not _kept(" ".join("".join(rng.choices("0123456789abcdef", k=12)) for _ in range(300)), bands, "en")  # characters per token
    assert not _kept(good + " ".join(chr(0x1100 + rng.randrange(250)) for _ in range(len(good))), bands, "en")  # byte fallback
    again = fertility.fit_bands(docs.repartition(7).select("doc_id", "lang", queries.quality_measures(docs).alias("m")), labels)
    assert again.fitted == bands.fitted  # reruns agree


def test_pipeline_end_to_end(spark):
    from foliant.llm.staging import staged

    docs = first = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SMALL), name)
        assert docs.columns == first.columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False))
    assert kept[0] == {r.doc_id for r in queries.op10_tokeniser_fertility(spark, SMALL).where("kept").select("doc_id").collect()}
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    assert len(out) == docs.count() and (out["n_tokens"] > 0).all()


def test_band_columns_equal_the_function(spark):
    rng = random.Random(8)
    bits = ((10, 5.0, 6.0), (14, 6.0, 7.0))
    bands = fertility.Bands({("latin", None): (1.0, 9.0, 0.5, bits), ("latin", "en"): (2.0, 5.0, 0.3, bits[:1]), ("greek", "el"): (0.5, 3.0, 0.6, ())})
    rows = [(rng.random() < 0.1, rng.choice(["latin", "greek", "cjk"]), rng.choice(["en", "el", None, ""]), rng.choice([0, 1, 30, 32, 33, 128, 200, 5000]), rng.uniform(0, 13), rng.uniform(0, 1), rng.uniform(2, 8)) for _ in range(600)]
    names = "base_failed boolean, script string, lang string, n_words long, chars_per_token double, byte_share double, token_entropy double"
    made = spark.createDataFrame(rows, names)
    for b in (bands, fertility.Bands()):
        got = made.select("*", b.kept(F.struct("*"), F.col("lang")).alias("k")).collect()
        assert all(r.k == (not r.base_failed and b.hold(r.script, r.lang or None, r.n_words, r.chars_per_token, r.byte_share, r.token_entropy)) for r in got) and len({r.k for r in got}) == 2


def test_fertility_bands_reject_junk_that_passes_the_base(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    measured = docs.select("doc_id", "lang", queries.quality_measures(docs).alias("m"))
    bands = fertility.fit_bands(measured, labels.where(~fold))
    assert ("latin", None) in bands.fitted
    rows = measured.select("doc_id", "m.*", bands.kept(F.col("m"), F.col("lang")).alias("kept")).join(labels.where(fold), "doc_id").where("not base_failed").toPandas()
    assert rows[rows["quality"] == 1]["kept"].mean() > 0.95  # labels not learnt from
    junk = rows[rows["quality"] == 0]["kept"]
    assert len(junk) and junk.mean() < 0.5
    rng = random.Random(6)
    for letters in ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz"):
        text = " ".join("".join(rng.choices(letters, k=12)) for _ in range(200))
        assert _kept(text, fertility.Bands()) and not _kept(text, bands, "en")


def _shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _hashes(text):
    parts = list(simhash.shingle_hashes(text, 5))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def test_near_copies_are_similar(spark):
    """Groups by the exact similarity of all pairs: no link that isn't one, hardly any missing."""
    rng, texts = random.Random(9), []
    for size in (12, 30, 60, 120, 400):
        for _ in range(8):
            words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(size)]
            for _ in range(6):
                texts.append(" ".join(words))
                words = [w if rng.random() > 0.012 else "Z" for w in words]
    # one phrase in over half of the shingles decides every bit of a short fingerprint: unlike texts
    texts += ["spam " * 200 + " ".join(f"{name}{i}" for i in range(40)) for name in ("river", "stone", "cloud")] + ["", "  "]
    sets = [_shingles(t) for t in texts]
    group, alike = list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                alike.append((i, j))
                if group[i] != group[j]:
                    a, b = sorted((group[i], group[j]))
                    group = [a if g == b else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = simring.similar_documents(docs).toPandas().sort_values("doc_id")["component_id"].tolist()
    assert len({*found[240:243]}) == 3 and found[243] == found[244]
    assert all(group[i] == group[found[i]] for i in range(len(texts)))
    assert len(alike) > 100 and sum(found[i] == found[j] for i, j in alike) >= 0.98 * len(alike)
    assert {r.doc_id for r in simring.one_of_each(docs).collect()} == set(found)


def test_near_copies_of_the_given_table(spark):
    """No text is dropped without a partner of 0.8 or more among all texts; exact pairs are in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = {r.doc_id for r in simring.one_of_each(docs).collect()}
    group = {r.doc_id: r.component_id for r in simring.similar_documents(docs).collect()}
    sets, by_shingle = {i: _shingles(t) for i, t in texts.items()}, {}
    for i, own in sets.items():
        for x in own:
            by_shingle.setdefault(x, []).append(i)
    alike = {i: set() for i in texts}
    for i, own in sets.items():
        met = {}
        for x in own:
            for j in by_shingle[x]:
                met[j] = met.get(j, 0) + 1
        alike[i] = {j for j, n in met.items() if j != i and n >= 0.8 * (len(own) + len(sets[j]) - n)}
    assert all(alike[i] for i in texts if i not in kept)
    pairs = [(i, j) for i, others in alike.items() for j in others]
    assert pairs and sum(group[i] == group[j] for i, j in pairs) >= 0.95 * len(pairs)
    assert len(kept) == len(set(group.values()))


def test_rows_not_ids_are_judged(spark):
    a, b = " ".join(f"left{i}" for i in range(50)), " ".join(f"right{i}" for i in range(60))
    rows = lambda *r: spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in r], "doc_id long, text string, lang string, source string, n_chars long")
    one = lambda docs: sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.source) for r in simring.one_of_each(docs).collect())
    assert one(rows((1, a, "x"), (1, b, "x"))) == [(False, 1, a, "x"), (False, 1, b, "x")]
    assert one(rows((1, a, "x"), (2, a, "x"), (2, b, "x"))) == [(False, 1, a, "x"), (False, 2, b, "x")]
    assert one(rows((3, a, "z"), (3, a, "y"), (3, a, "y"), (4, a, "x"))) == [(False, 3, a, "y")]
    assert one(rows((None, a, "x"), (None, a, "w"), (None, b, "x"), (7, b, "x"))) == [(False, 7, b, "x"), (True, 0, a, "w")]
    assert one(rows((None, None, "x"), (5, "", "x"), (5, None, "a"))) == [(False, 5, "", "a")]


def test_hot_hubs_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(simring, "HUB_PAIRS", 3)
    monkeypatch.setattr(simring, "KEPT_BYTES", 1)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(w if k != i * 9 else "new" for k, w in enumerate(words)) for i in range(20)]
    docs = spark.createDataFrame([*enumerate(texts, 1), (0, " ".join(words))], "doc_id long, text string")
    assert {r.component_id for r in simring.similar_documents(docs).collect()} == {0}
    monkeypatch.setattr(simring, "BUCKET", 4)
    monkeypatch.setattr(simring, "BUCKET_SHINGLES", 500)
    monkeypatch.setattr(simring, "ROUNDS", 0)
    assert {r.component_id for r in simring.similar_documents(docs).collect()} == {0}


def test_long_fingerprint_and_ring_by_definition():
    own = _hashes(" ".join(f"w{i}" for i in range(700)))
    mix = lambda x: int(simring._mixed(np.array([x % 2**64], np.uint64))[0])
    for word in (0, 15):
        hashes = [mix(int(h) + (word + 1) * 0x9E3779B97F4A7C15) for h in own]
        assert int(simring.long_fingerprint(own)[word]) == sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
    at, prints = simring.ring(own, 7)
    for i, fp in zip(at, prints, strict=True):
        part = [int(h) for h in own if mix(int(h) ^ 0x9E3779B97F4A7C15) >> 57 == i]
        assert int(fp) == sum((2 * sum(h >> b & 1 for h in part) > len(part)) << b for b in range(64))
    sizes = [simring.ring_bits(n) for n in range(1, 5000)]
    assert sizes == sorted(sizes)
    for n in range(5, 2000):  # a set and one larger by a quarter share a ring
        assert {simring.ring_bits(n), simring.ring_bits(int(n / 0.8 + 1e-9))} & {simring.ring_bits(int(n / 0.8 + 1e-9))}


def test_url_shares_cover_all_labelled(spark, monkeypatch):
    """Hosts differ in their labelled URLs alone, most of which the trees' sample leaves out."""
    from foliant.llm import urlfilter

    hosts = [a + b for a in "bcdfgh" for b in "aeiou"]
    verdicts = {h: "block" if (i * 7) % 30 < 15 else "allow" for i, h in enumerate(hosts)}
    urls = [f"http://{h}.test/{p}{i:02d}" for h in hosts for p, n in (("a", 20), ("b", 1)) for i in range(n)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    monkeypatch.setattr(urlfilter, "MAX_LABELLED", 40)
    out = judge(pages, [Rule(f"{h}.test", "/a", v) for h, v in verdicts.items()]).where("rule is null").toPandas()
    assert len(out) == 30
    assert [verdicts[h.split(".")[0]] for h in out["host"]] == out["verdict"].tolist()


def _tiff(*made):
    """A big-endian file of one-strip pages: (tags, bytes of the strip) each."""
    out, patch = bytearray(b"MM\0*\0\0\0\0"), 4
    for tags, strip in made:
        fields = sorted((tags | {273: len(out), 278: tags[257], 279: len(strip)}).items())
        out += strip
        struct.pack_into(">I", out, patch, len(out))
        out += struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in fields)
        patch = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def test_tiff_walk_goes_on_after_a_page_that_fails():
    grey = {256: 3, 257: 2, 258: 8, 259: 1}
    found = tiff.pages(_tiff((grey, b"abcdef"), (grey | {259: 7}, b"abcdef"), (grey, b"uvwxyz")))
    assert [p.get("samples") for p in found] == [b"abcdef", None, b"uvwxyz"]
    assert [p["page"] for p in found] == [0, 1, 2] and "error" in found[1]


def test_tiff_small_samples_and_floating_predictor():
    rng = np.random.default_rng(1)
    for bits in (1, 2, 4):
        values = rng.integers(0, 1 << bits, (5, 11), dtype=np.uint8)
        single = np.unpackbits(values[:, :, None], axis=2)[:, :, 8 - bits :].reshape(5, -1)
        packed = np.packbits(single, axis=1).tobytes()
        tags = {256: 11, 257: 5, 258: bits, 259: 32773}
        turned = bytes(int(f"{b:08b}"[::-1], 2) for b in tiff.pack_bits(packed))
        for page in tiff.pages(_tiff((tags, tiff.pack_bits(packed)), (tags | {266: 2}, turned))):
            assert page["samples"] == values.tobytes() and page["bits"] == bits
    for kind in ("f2", "f4", "f8"):
        values = rng.normal(size=(4, 7, 3)).astype(f">{kind}")
        size = values.itemsize
        planes = values.reshape(4, 21).view(np.uint8).reshape(4, 21, size).transpose(0, 2, 1).reshape(4, -1, 3)
        coded = np.diff(planes, axis=1, prepend=np.zeros((4, 1, 3), np.uint8)).tobytes()
        (page,) = tiff.pages(_tiff(({256: 7, 257: 4, 258: 8 * size, 259: 1, 277: 3, 317: 3, 339: 3}, coded)))
        assert page["samples"] == values.astype(f"<{kind}").tobytes()
        assert abs(page["mean"] - values.astype(float).mean()) < 1e-9


def _grey(width, height, data):
    return _tiff(({256: width, 257: height, 258: 8, 259: 8, 277: 1}, data))


_PEAK = """
import resource, sys
sys.path.insert(0, sys.argv[1])
from foliant.llm import tiff
(page,) = tiff.walk(sys.stdin.buffer.read(), 1 << 28)
assert len(page["samples"]) == 200_000_000 and page["mean"] == page["spread"] == 0
assert len(tiff._page_array([page])) == 1
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""


def test_large_page_in_bounded_memory():
    """A process of its own decodes a 200 MB page under 600 MB; at the default bound it is refused."""
    data = _grey(20_000, 10_000, zlib.compress(bytes(200_000_000), 1))
    assert [list(p) for p in tiff.walk(data)] == [["page", "error"]]
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ran = subprocess.run([sys.executable, "-c", _PEAK, root], input=data, capture_output=True, check=True)
    assert int(ran.stdout) < 600_000  # KB


def test_pages_leave_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(tiff, "PIECE_BYTES", 5000)
    payload = [bytes([i]) * 64 * 40 for i in range(7)]
    files = [tiff.write(p, "packbits", page_rows=13) for p in payload]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(files)], names=["i", "media"])
    pieces = list(tiff._pieces(batch, 1 << 20))
    assert len(pieces) > 3 and all(sum(len(p["samples"]) for p in found) <= 5000 for _, found in pieces)
    rows = tiff.page_rows(spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "i int, media binary")).collect()
    for i, p in enumerate(payload):
        assert b"".join(bytes(r.tiff.samples) for r in sorted(rows, key=lambda r: r.tiff.page) if r.i == i) == p


def test_pages_beyond_the_bound_and_moments():
    assert "more than" in next(tiff.walk(_grey(1 << 15, 1 << 15, zlib.compress(bytes(1000)))))["error"]
    tags = {256: 8, 257: 8, 258: 8, 259: 8, 277: 1, 322: 1 << 16, 323: 1 << 16, 324: 8, 325: 10}
    assert "error" in next(tiff.walk(_tiff((tags, b""))))
    values = np.arange(400_000, dtype=">f4").reshape(400, 1000)
    (page,) = tiff.walk(_tiff(({256: 1000, 257: 400, 258: 32, 259: 8, 277: 1, 339: 3}, zlib.compress(values.tobytes()))))
    assert abs(page["mean"] - values.mean(dtype=float)) < 1e-6 and abs(page["spread"] - values.std(dtype=float)) < 1e-6
    assert bytes(page["samples"]) == values.astype("<f4").tobytes()


def test_shards_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(docs.where("doc_id % 10 = 0").withColumn("doc_id", F.lit(7).cast("long"))).unionByName(docs.limit(1).crossJoin(spark.range(300)).select(docs.columns))
    found = [sorted(map(tuple, kdshard.kd_shards(d, kdshard.text_bytes("text"), leaves=16).collect())) for d in (docs.repartition(3), docs.repartition(7, "lang"))]
    assert found[0] == found[1]


def test_mix_is_in_the_order_of_its_slots(spark):
    rows = [(i, f"{s} " * (20 + i % 7), "en", s, 40) for i in range(400) for s in ("a", "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mixed_texts(docs, schedule_columns=True).collect()
    slots = [r.mix_slot for r in mixed]
    assert slots == sorted(slots) and {r.mix_pass for r in mixed} == {0, 1}
    share = lambda part: sum(len(r.text.split()) for r in part if r.source == "c") / sum(len(r.text.split()) for r in part)
    assert all(abs(share(mixed[at : at + 100]) - 0.5) < 0.1 for at in range(0, len(mixed) - 100, 100))


def test_frequent_table_reads_few_partitions(spark, monkeypatch):
    from foliant.llm import tokencount

    monkeypatch.setattr(tokencount, "SEED_TASKS", 3)
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    docs = spark.range(12, numPartitions=12).select(F.concat(F.lit("only"), F.col("id").cast("string"), F.lit("letter")).alias("text"))
    table = tokencount.frequent_table(docs, spec, P.PATTERN)
    assert {"only0letter", "only4letter", "only8letter"} & set(table) or len(table) <= 9
