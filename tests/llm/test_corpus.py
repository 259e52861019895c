"""Each corpus operator against brute force, and on null, empty, very long, repeated and clashing rows."""

import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import assert_same  # noqa: E402

from vitaframe.llm import decontaminate, hpylm, near_dup, packing, quality, sharding, substring_dedup, topk, toxicity, warc
from vitaframe.llm.common import lower_words, plain_words
from vitaframe.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, dc_spans string, sd_key int, node string"


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def passage():
    return words(70, 1)


@pytest.fixture(scope="module")
def rows(passage):
    base = words(150, 2)
    near = base[:]
    near[75] = "changed"
    texts = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (3, " ".join(base)), (4, None), (5, ""), (6, "Ünï  cödé\tA,b!"),
        (7, " ".join(words(30, 3) + passage + words(30, 4))), (8, " ".join(words(20, 5) + passage)), (None, " ".join(words(10, 6) + passage)),
        (9, " ".join(words(25_000, 7))), (10, "a a " * 300), (11, "b b " * 300), (12, "one two"), (13, "one two"), (14, "x" * 5000),
    ]
    return [(i, t, "en", "s", None if t is None else len(t), "clash", 5, "clash") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, sf_dir, name):
    assert_same(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


# Decontamination


def hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, found = find(text), set(), set()
    for item, t in items:
        w = find(t)
        size = min(10, len(w))
        grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for k in range(len(own) - size + 1):
            if size and tuple(own[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                found.add(str(item))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 12])
def test_decontamination(spark, docs, rows, passage, block, monkeypatch):
    items = [(1, " ".join(passage[5:40])), (2, " ".join(passage[30:60]).upper()), (3, "A b"), (4, "ünï"), (5, None), (6, " ,"), (None, "a a a"), (7, "a a a"), (7, "b b"), (8, "w1 w2"), (9, "two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found, n = decontaminate.match_items(docs.select("doc_id", "text", "dc_spans"), bench, block_words=block)
    got = sorted((r.doc_id or -1, r[n["n_words"]], sum(s["past"] - s["first"] for s in r[n["spans"]]), ",".join(r[n["items"]])) for r in found.collect())
    real = [x for x in items if x[0] is not None and x[1]]
    assert got == sorted((r[0] or -1, a, b, ",".join(c)) for r in rows for a, b, c in [hits(r[1], real)])


def test_decontamination_by_chance(spark):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(k, text(r.randrange(1, 16))) for k in range(12)]
    rows = [(k, text(r.randrange(0, 80))) for k in range(60)]
    got = decontaminate.report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    for x in got:
        n, hit, found = hits(dict(rows)[x.doc_id], items)
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (n, hit, len(found), hit > 0)
        assert x.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_decontamination_cuts(spark, passage):
    docs = spark.createDataFrame([(1, "start " + " ".join(passage[:12]) + " Keep, this. and many more words here that stay whole in it", 9), (2, " ".join(passage[:12]), 9), (3, "clean\n text", 9)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, " ".join(passage[:12]))], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: "start  Keep, this. and many more words here that stay whole in it", 3: "clean\n text"}
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0


# Substring dedup


def kept_words(rows):
    first = {}
    for i, t in rows:
        w = plain_words((t or "").encode())
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            first[g] = min(first.get(g, 2**70), 2**63 if i is None else i)
    for i, t in rows:
        w = plain_words((t or "").encode())
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < (2**63 if i is None else i):
                gone |= set(range(k, k + 50))
        yield i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()


def test_substring_dedup(docs, rows):
    order = lambda x: (x[0] or -1, *x[1:])
    assert sorted(map(tuple, substring_dedup.report(docs).collect()), key=order) == sorted(kept_words([r[:2] for r in rows]), key=order)


def test_substring_dedup_by_chance(spark):
    r = random.Random(3)
    pool = [words(r.randrange(40, 120), k) for k in range(6)]
    rows = [(k, " ".join(x for _ in range(r.randrange(4)) for x in (*words(r.randrange(5), 100 + k), *pool[r.randrange(6)][r.randrange(5) :]))) for k in range(50)]
    got = substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect())) == sorted(kept_words(rows))
    assert sum(x[2] for x in kept_words(rows)) > 0


def test_remove_repeats_keeps_clean_documents(docs, rows):
    got = substring_dedup.remove_repeats(docs).collect()
    assert got[0].__fields__ == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    texts = {r.doc_id: r.text for r in got}
    assert texts[7] == rows[7][1]
    assert texts[8] == " ".join(words(20, 5))
    assert 3 not in texts
    assert texts[4] is None


# Near duplicates


def shingle_set(text):
    w = lower_words((text or "").encode())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_groups(rows):
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][0] == rows[j][0] or a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), 2**63 - 1), 2**63 - 1 if i is None else i)
    return sorted((i or -1, len(s), least[root(k)] if least[root(k)] < 2**63 - 1 else -1) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_near_duplicates(docs, rows):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in near_dup.report(docs).collect())
    assert got == near_groups([r[:2] for r in rows])


def test_near_duplicates_of_edited_copies(spark):
    r, rows = random.Random(8), []
    for g in range(4):
        base = words(r.randrange(60, 160), 200 + g)
        for _ in range(40):
            w = base[:]
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"edit{r.random()}"
            rows.append((r.randrange(10**6), " ".join(w)))
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in near_dup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == near_groups(rows)


def test_keep_one(docs):
    got = sorted(r.doc_id or -1 for r in near_dup.keep_one(docs).collect())
    assert got == [-1, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14]


def test_keep_one_of_rows_without_an_id_of_their_own(spark):
    one, two, three, four = (" ".join(words(60, k)) for k in (301, 302, 303, 304))
    rows = [(None, one), (None, two), (None, three), (7, three), (8, one + " x"), (9, two), (9, four), (9, four), (None, None), (10, two)]
    got = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted([(7, three), (8, one + " x"), (9, two), (9, four), (-1, "")])


def test_string_ids(spark, docs, rows):
    named = docs.select(F.format_string("id-%05d", "doc_id").alias("doc_id"), "text", "doc_id").toDF("doc_id", "text", "number")
    named = named.withColumn("doc_id", F.when(F.col("number").isNotNull(), F.col("doc_id"))).drop("number")
    number = lambda x: -1 if x is None else int(x[3:])
    got = sorted((number(r.doc_id), r.n_shingles, number(r.component_id)) for r in near_dup.report(named).collect())
    assert got == near_groups([r[:2] for r in rows])
    assert sorted(number(r.doc_id) for r in near_dup.keep_one(named).collect()) == [-1, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14]
    order = lambda x: (number(x[0]) if isinstance(x[0], str) else x[0] or -1, *x[1:])
    cut = sorted((order(tuple(r)) for r in substring_dedup.report(named).collect()))
    assert [x[1:] for x in cut] == [x[1:] for x in sorted(order(x) for x in kept_words([r[:2] for r in rows]))]


def test_reports_on_empty_tables(empty):
    assert near_dup.report(empty).count() == 0
    assert substring_dedup.report(empty).count() == 0
    assert sharding.report(empty).count() == 0
    assert packing.pack(empty).count() == 0


def test_spans_are_joined(spark):
    spans = spark.createDataFrame([(1, 2, 0, 50), (1, 2, 50, 100), (1, 2, 20, 30), (1, 2, 101, 120), (1, 3, 5, 6)], "doc_id long, key long, first int, past int")
    got = substring_dedup.islands(spans).select("doc_id", "key", "first", "past").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0, 100), (1, 2, 101, 120), (1, 3, 5, 6)]


def test_spread_join_splits_hot_keys(spark, monkeypatch):
    import vitaframe.llm.common as common

    monkeypatch.setattr(common, "HOT_PARTS", 4)
    many = spark.createDataFrame([(1 if k % 10 else k, k) for k in range(200)], "key long, value long")
    counts = many.groupBy("key").agg(F.count("*").alias("times"))
    few = counts.select("key", (F.col("key") * 10).alias("ten"))
    common.prepare(spark)
    got = common.spread_join(many, few, ["key"], counts).collect()
    assert sorted((r.key, r.value, r.ten) for r in got) == sorted((1 if k % 10 else k, k, 10 if k % 10 else 10 * k) for k in range(200))


# Packing


def test_packing(docs, rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = packing.pack(docs, with_ids=True).collect()
    by_id = {}
    for r in sorted(got, key=lambda r: (r.doc_id or -1, r.start)):
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_id.setdefault(r.doc_id, []).append(r)
    for i, text in [r[:2] for r in rows if r[0] != 3]:
        ids = slow.encode(text or "", add_special_tokens=False).ids + [0]
        assert [x for p in by_id[i] for x in p.ids] == ids
        assert all(p.length == 2048 for p in by_id[i][1:])
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048
    assert len(at) <= -(-sum(r.length for r in got) // 2048) + 1


def test_encoders_agree_on_odd_texts():
    from public_tokenizers import path

    encode = packing.ByteEncoder(path("byte_bpe_50k.json"))
    for text in ["", " ", "a  b\n\n c\t", "it's 12345 <|endoftext|> ÄÖ é", "日本語 ​ x", " a b", "x" * 3000, "€ “quoted” – dash…"]:
        assert encode(text) == encode.slow.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_have_the_ids_of_tokenizers(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    fresh, encode = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.ByteEncoder(path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "日本 <|endoftext|> é", "<|endoftext|", "z" * 1_000_001 + "<|endoftext|>"]
    for text in texts:
        assert encode(text) == fresh.encode(text, add_special_tokens=False).ids, text[:50]
    assert encode(texts[0]) == [64, 220, 50256, 275]
    got = packing.pack(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), with_ids=True).first()
    assert (got.ids, got.length) == ([64, 220, 50256, 275, 0], 5)


def test_rare_characters_are_split_alike():
    from public_tokenizers import path

    encode = packing.ByteEncoder(path("byte_bpe_50k.json"))
    fast = [chr(c) for c in range(0x250) if not packing._RARE.search(chr(c))] + list("‐‑–—‘’“”‰›⁄⁞€")
    for c in fast:
        for text in (f"a{c}b", f" {c}{c} 1{c}", f"{c}s'{c}"):
            if not packing._RARE.search(text):
                assert encode.fast.encode_ordinary(text) == encode.slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_two_fit_replaces_the_smallest():
    bins = packing.best_two_fit({60: 1, 30: 1, 25: 1, 15: 1}, 100)
    assert bins[0] == ({60: 1, 25: 1, 15: 1}, 1)
    r = random.Random(1)
    for size in (10, 50):
        counts = {k: r.randrange(30) for k in range(1, size + 1)}
        used = {}
        for bin_, times in packing.best_two_fit(counts, size):
            assert sum(k * n for k, n in bin_.items()) <= size
            for k, n in bin_.items():
                used[k] = used.get(k, 0) + n * times
        assert used == {k: n for k, n in counts.items() if n}


# Sharding


def test_sharding(docs, rows):
    got = sharding.report(docs).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in [r[:2] for r in rows]:
        texts.setdefault(i, (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    for r in got:
        assert (r["size"], r.text_crc32) == texts[r.doc_id]
        assert (r.law, r.grown_shard) == ("bytes", None)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    shards = {}
    for r in got:
        assert shards.setdefault(r.text_crc32, r.shard) == r.shard


def test_differencing_balances():
    r = random.Random(2)
    sizes = [r.randrange(1, 1000) for _ in range(500)]
    sums = [0] * 7
    for size, shard in zip(sizes, sharding.difference(sizes, 7), strict=True):
        sums[shard] += size
    assert max(sums) - min(sums) <= 2
    assert sharding.difference([], 3) == []


# Top-k


@pytest.mark.parametrize(("shard", "block"), [(topk.SHARD_ROWS, topk.QUERY_BLOCK), (40, 2)])
def test_top_k(spark, shard, block, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=3).round(2)]) for i in range(400)]
    rows += [(5, rows[5][1]), (100, rows[100][1]), (1000, None), (1001, []), (1002, [1.0, None, 2.0]), (1003, [float("nan")] * 3), (1004, [float("inf")] * 3), (1100, [1.0]), (None, [1.0, 2.0, 3.0]), (1200, [3e38, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "LEAF", min(shard, topk.LEAF))
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    got = topk.report(frame).collect()
    clean = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    seen = set()
    for q, v in clean:
        if q % 100 == 0 and q not in seen:
            seen.add(q)
            best = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in clean if len(w) == len(v) and i != q))[:10]
            mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
            assert mine == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert seen >= {r.query_id for r in got}
    assert topk.report(frame.limit(0)).count() == 0


# WARC


@pytest.mark.parametrize(("range_bytes", "few"), [(128 << 20, 0), (700, warc.BROADCAST_ROWS), (90, 0)])
def test_warc(spark, range_bytes, few, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, range_bytes)
    try:
        check_warc(spark)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def check_warc(spark):
    trap = "x WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    big = "ü" * 600
    rows = [(1, "u", trap), (2, "u\r\nv", big), (3, None, big), (4, "", None), (5, "", ""), (6, "", "x" * 999), (7, "", "x" * 999), (8, "", big), (8, "", big), (None, "", big), (9, "", "a\r\n\r\n"), (10, "", "end\r\n"), (11, "", "WARC/1.0\r\n" * 40), (12, "", "\r\n\r\n".join(["y" * 90] * 30)), (13, "", "z" * 9_000), (14, "", "\r\n\r\nWARC/1.0\r\nContent-Length: 9999999\r\n\r\n" * 20), (15, "", "\r\n\r\n\r\n" * 9)]
    got = warc.report(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")))
    mine = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str)
    real = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == big and i != 8
        real.append((i or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 8 if again else None))
    assert mine == sorted(real, key=str)
    assert warc.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pointer_jumping():
    offsets, nexts = np.array([0, 10, 25, 12, 40]), np.array([10, 25, 40, 25, 99])
    assert warc.reachable(offsets, nexts).tolist() == [True, True, True, False, True]
    assert warc.reachable(np.zeros(0, "i8"), np.zeros(0, "i8")).tolist() == []


# Classifiers


def test_toxicity(spark, empty):
    r, rows, labels = random.Random(4), [], []
    for k in range(600):
        bad = k % 5 == 0
        w = words(r.randrange(20, 60), k)
        if bad:
            w[r.randrange(len(w))] = r.choice(["moron", "idiots", "vilexa"])
        rows.append((k, " ".join(w), "en", "s", 1, "c", 1, "c"))
        labels.append((k, int(bad)))
    docs, lab = spark.createDataFrame([*rows, (9001, None, None, "s", 0, "c", 1, "c"), (9002, "", "xx", "s", 0, "c", 1, "c")], DOCS), spark.createDataFrame([*labels, (1, None), (9001, 7)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.report(docs, lab).collect()}
    assert len(got) == 602
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values())
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got)
    held = [(got[k].predicted, y) for k, y in labels if got[k].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert toxicity.report(empty, lab).count() == 0
    assert {x.score for x in toxicity.report(docs, lab.limit(0)).collect()} == {0.5}


def test_toxicity_ignores_other_columns(spark):
    net = toxicity.Network()
    a = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    b = spark.createDataFrame([(2, "some text", "de")], "doc_id long, text string, lang string")
    assert toxicity.scored(a, net).first().score == toxicity.scored(b, net).first().score


def test_pooling_keeps_documents_apart():
    net = toxicity.Network()
    one, two, none = (toxicity.word_codes(x) for x in ([b"a", b"b"], [b"c"], []))
    assert np.allclose(net.score([one, none, two, one]), [net.score([x])[0] for x in (one, none, two, one)], atol=1e-6)


def test_ordinal_grades():
    r = random.Random(6)
    coder, codes, grades = quality.Coder(), [], []
    for k in range(400):
        g = k % 4
        codes.append(coder(" ".join(["good" if r.random() < g / 3 else "junk" for _ in range(60)]).encode()))
        grades.append(g * 10)
    model = quality.fit_ordinal(codes, np.array(grades))
    assert (np.diff(model.limits) > 0).all()
    tails = model.tails(codes)
    assert (np.diff(tails, axis=1) <= 0).all()
    expected = model.grades[0] + tails @ np.diff(model.grades)
    assert np.corrcoef(expected, grades)[0, 1] > 0.9


def test_ordinal_gradients():
    r, coder = random.Random(1), quality.Coder()
    codes = [coder(" ".join(r.choices(["a", "b", "c", "d"], k=12)).encode()) for _ in range(40)]
    grades = np.array([r.randrange(3) for _ in codes], "f8")

    def loss(model):
        tails = np.column_stack((np.ones(len(codes)), model.tails(codes), np.zeros(len(codes))))
        rank = np.searchsorted(model.grades, grades)
        p = tails[np.arange(len(codes)), rank] - tails[np.arange(len(codes)), rank + 1]
        weight = 1 / np.bincount(rank)[rank] / len(model.grades)
        return -(weight * np.log(p)).sum() + quality.PENALTY / 2 * (model.weights**2).sum()

    model = quality.fit_ordinal(codes, grades, 3000)
    best = loss(model)
    used = np.unique(np.concatenate(codes))
    for k in used.tolist():  # a fitted model can't be bettered by any one parameter
        for step in (0.1, -0.1):
            model.weights[k] += step
            assert loss(model) > best
            model.weights[k] -= step
    for k in range(2):
        for step in (0.3, -0.3):
            model.limits[k] += step
            assert loss(model) > best
            model.limits[k] -= step


def test_grades_of_any_kind(spark):
    rows = [(k, " ".join(["good"] * (k % 100) + ["junk"] * (99 - k % 100)), float(k % 100) / 2) for k in range(400)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality double")
    model = quality.fit(docs, labels)
    assert model.grades == [k / 2 for k in range(100)] and len(model.limits) == 99
    assert quality.fit(docs, labels, bound=100).grades == model.grades
    halves = labels.withColumn("quality", F.when(F.col("quality") >= 25, 4.5).otherwise(4.0))
    got = {r.doc_id: r.keep for r in quality.report(docs, halves).collect()}
    assert sum(got[k] == (k % 100 >= 50) for k in got) > 380
    again = quality.report(docs.unionByName(docs), halves).collect()
    assert len(again) == 800
    with pytest.raises(ValueError):
        quality.fit(spark.range(1001).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), spark.range(1001).select(F.col("id").alias("doc_id"), F.col("id").alias("quality")))


def test_quality(spark, empty):
    rows = [(k, " ".join(words(40, k)) if k % 3 else " ".join(f"{x}%%%" for x in words(40, k)), "en", "s", 1, "c", 1, "c") for k in range(300)]
    docs = spark.createDataFrame([*rows, (900, None, "en", "s", 0, "c", 1, "c"), (901, "", "en", "s", 0, "c", 1, "c")], DOCS)
    labels = spark.createDataFrame([*((k, int(k % 3 > 0)) for k in range(0, 300, 2)), (900, None)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.report(docs, labels).collect()}
    assert all(got[k].keep == (k % 3 > 0) for k in range(300))
    kept = quality.select_quality(docs, labels)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {k for k, x in got.items() if x.keep}
    assert quality.select_quality(docs, labels.limit(0)).count() == docs.count()
    assert quality.report(empty, labels).count() == 0


# Language model


def test_language_model(spark, docs, rows, empty):
    import collections
    import math

    got = hpylm.score(docs).collect()
    counts = collections.Counter()
    for i, t, *_ in rows:
        if not hpylm.is_held_out(i):
            counts.update([*lower_words((t or "").encode()), None])
    n, v = sum(counts.values()), len(counts)
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        tokens = [*lower_words((by_id[r.doc_id] or "").encode()), None]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (hpylm.is_held_out(r.doc_id), len(tokens), sum(counts[x] > 0 for x in tokens), n)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0
    assert hpylm.score(empty).count() == 0


# Pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = p.STAGES[0][1](spark, docs, sf_dir)
    assert kept.columns == columns
    one = p.STAGES[1][1](spark, kept, sf_dir)
    assert one.columns == columns
    ids = [r.doc_id for r in one.collect()]
    groups = {r.doc_id: r.component_id for r in near_dup.report(kept).collect()}
    assert sorted(ids) == sorted(k for k, c in groups.items() if k == c)
    out = p.run(spark, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= set(ids)


def test_stages_on_empty_documents(spark, sf_dir, empty):
    import corpus_pipeline as p

    for _, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
