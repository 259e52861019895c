"""Suffix dedup, ranked search and spelling variants against brute force, and on odd rows."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vitaframe.llm import ranked_search, suffix_dedup, variants
from vitaframe.llm.common import alnum_words

SCHEMA = "doc_id long, text string, anchor string, rank int, key string"


def frame(spark, rows, kind="long"):
    return spark.createDataFrame([(i, t, "x", 1, "x") for i, t in rows], SCHEMA.replace("doc_id long", f"doc_id {kind}")).repartition(3)


def letters(n, seed, alphabet="abcdefghij "):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))


# Suffix dedup


@pytest.mark.parametrize("alphabet", [1, 2, 3, 20])
def test_grouped_suffixes(alphabet):
    for seed in range(400):
        r = random.Random(seed * 31 + alphabet)
        text = [r.randrange(1, alphabet + 1) for _ in range(r.randrange(0, 50))] + [0]
        assert suffix_dedup.grouped_suffixes(text) == sorted(range(len(text)), key=lambda i: text[i:])
    for text in ([1] * 500 + [0], [1, 2] * 300 + [0], [2, 1] * 300 + [0], list(range(300, -1, -1))):
        assert suffix_dedup.grouped_suffixes(text) == sorted(range(len(text)), key=lambda i: text[i:])


def removed(rows):
    """doc_id, n_bytes, n_removed, n_spans, digest by comparing all windows."""
    places = defaultdict(list)
    texts = [((t or "").encode(), 2**63 if i is None else i) for i, t in rows]
    for k, (b, i) in enumerate(texts):
        for p in range(len(b) - 99):
            places[b[p : p + 100]].append((i, k, p))
    out = []
    for k, (b, i) in enumerate(texts):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 99):
            if any(x < i or y == k and q < p for x, y, q in places[b[p : p + 100]]):
                gone[p : p + 100] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((rows[k][0], len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    passage, other = letters(260, 1), letters(150, 2, "éüab")
    near = passage[:130] + "#" + passage[131:]
    rows = [
        (1, letters(50, 3) + passage + letters(70, 4)), (2, passage), (3, near + letters(20, 5)), (4, letters(80, 6) + passage[20:] + near), (5, None), (6, ""), (7, "a" * 500),
        (8, "b" + "a" * 99 + "c"), (9, "ab" * 200), (9, "xx" + "ab" * 200), (None, passage[:140]), (10, other), (11, "é" + other[1:]), (12, letters(99, 7)), (13, letters(100, 8)), (14, letters(100, 8)),
        (15, passage * 3), (16, passage[:100]), (16, passage[:100]), (17, passage[100:200] + "!" + passage[:99]),
    ]
    return rows + [(100 + k, letters(30, 50 + k) + passage[: 60 + 3 * k] + letters(40, 90 + k)) for k in range(40)]


@pytest.mark.parametrize("limit", [1000, 3])
def test_bytes_removed(spark, texts, limit, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)  # with 3, anchors are cut down to single windows
    got = sorted(map(tuple, suffix_dedup.report(frame(spark, texts)).collect()), key=str)
    assert got == removed(texts)


def test_long_texts(spark):
    long = letters(2 * suffix_dedup.CHUNK + 5000, 9, "abcdefghijklmnopqrstuvwxyz")
    rows = [(1, long), (2, "shift" + long[1000:] + "end"), (3, long[:300_000] + long[:300_000])]
    got = {r.doc_id: r for r in suffix_dedup.report(frame(spark, rows)).collect()}
    assert got[1].n_removed == 0
    assert (got[2].n_removed, got[2].n_spans, got[2].kept_sha256) == (len(long) - 1000, 1, hashlib.sha256(b"shiftend").hexdigest())
    assert (got[3].n_removed, got[3].n_spans) == (600_000, 1)


def test_whole_characters_go(spark):
    passage = letters(120, 2, "éü")
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, [(1, "a" + passage), (2, "b" + passage + "ó"), (3, passage)])).collect()}
    assert out[2].text == "bó" and out[2].anchor == "x" and 3 not in out and out[1].text == "a" + passage


@pytest.mark.parametrize("kind", ["string", "decimal(20,0)", "smallint"])
def test_ids_of_other_types(spark, kind):
    cast = {"string": str, "smallint": int}.get(kind, __import__("decimal").Decimal)
    rows = [(cast(k), letters(150, 11) + str(k)) for k in (3, 4, 5)]
    assert [r.n_removed for r in suffix_dedup.report(frame(spark, rows, kind)).orderBy("doc_id").collect()] == [0, 150, 150]
    items = spark.createDataFrame([(1, "term")], "item_id int, text string")
    found = ranked_search.rank(frame(spark, [(cast(7), "a term"), (cast(8), "none here")], kind), items).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in found] == [(1, 1, cast(7))]
    assert variants.variants(frame(spark, rows, kind)).count() >= 0


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "some words"), (2, None), (3, "")], "item_id long, text string")
    assert suffix_dedup.report(nothing).count() == 0
    assert ranked_search.rank(nothing, items).count() == 0
    assert ranked_search.rank(frame(spark, [(1, "words")]), items.limit(0)).count() == 0
    assert variants.variants(nothing).count() == 0
    blank = frame(spark, [(1, None), (2, ""), (None, " .,")])
    assert [r.n_spans for r in suffix_dedup.report(blank).collect()] == [0, 0, 0]
    assert ranked_search.rank(blank, items).count() == 0 and variants.variants(blank).count() == 0


# Ranked search


def ranked(docs, items, k=10):
    words = [(i, Counter(w.decode() for w in alnum_words((t or "").encode()))) for i, t in docs]
    words = [(i, c, sum(c.values())) for i, c in words if c]
    n, total = len(words), sum(s for _, _, s in words)
    df = Counter(t for _, c, _ in words for t in c)
    terms = defaultdict(set)
    for i, t in items:
        if i is not None:
            terms[i] |= {w.decode() for w in alnum_words((t or "").encode())}
    out = []
    for item, asked in terms.items():
        scores = []
        for i, c, s in words:
            m = 10 + 90 * s * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [200_000, 30])
def test_ranks(spark, block_words):
    r = random.Random(5)
    vocabulary = [f"t{int(r.paretovariate(0.6)) % 400}" for _ in range(3000)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 5, 30, 200])))) for i in range(700)]
    docs += [(5, docs[9][1]), (None, docs[9][1]), (9, docs[9][1]), (800, None), (801, "T1 Tt1 t1 t1"), (802, "t1 " * 30_000)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 4, 30])))) for k in range(25)] + [(3, "t1 t2"), (40, None), (41, "unseen"), (None, "t1"), (42, docs[9][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, ranked_search.rank(frame(spark, docs), table, block_words=block_words).collect()), key=str)
    assert got == ranked(docs, items)


def test_blocks():
    r = random.Random(1)
    for top in (10, 300, 70_000, 5_000_000):
        places = np.array(sorted(r.sample(range(top), min(9, top))), "i8")
        counts = np.array([r.randrange(1, top + 1) for _ in places], "i8")
        block = ranked_search.pack(places, counts)
        back = ranked_search.unpack(block, int(places[0]))
        assert (back[0] == places).all() and (back[1] == counts).all() and len(block) < 3 + 8 * len(places) + 1


def test_blocks_below_the_kth_score_stay_packed(monkeypatch):
    opened = []
    monkeypatch.setattr(ranked_search, "unpack", lambda block, first, f=ranked_search.unpack: opened.append(first) or f(block, first))
    n = 6400
    counts = np.ones(n, "i8")
    counts[640:660] = 50  # all that matters is in one block
    places, lengths = np.arange(n), np.full(n, 100)
    cuts = np.arange(0, n, 64)
    most = np.maximum.reduceat(ranked_search.impacts(counts, lengths), cuts).tolist()
    cursor = ranked_search.Cursor(7, cuts.tolist(), (cuts + 63).tolist(), most, [ranked_search.pack(places[a : a + 64], counts[a : a + 64]) for a in cuts], lengths)
    best = ranked_search.Best(3)
    for score in (5 * 10**6,) * 3:
        best.offer(score, -1)
    ranked_search.search([cursor], best, list(range(n)))
    assert [x[2] for x in best.held] == [640, 641, 642] and opened == [640]


# Spelling variants


def brute_variants(docs):
    count = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def is_near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in count if is_near(v, w)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 2 * count[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, len(near[w]), count.get(form[w])) for w, n in count.items()), key=str)


def test_variants(spark):
    r = random.Random(3)
    pool = ["letter", "better", "bettter", "bettr", "butter", "Letter", "lettér", "étéée", "étée", "aaaaa", "aaaaaa", "aaaaaaa", "Élan", "ÉLANS", "élans", "x" * 3000, "x" * 2999 + "y", "four", "betters", "setters"]
    docs = [(i, " ".join(r.choice(pool[: 3 + r.randrange(len(pool) - 2)]) for _ in range(60))) for i in range(60)]
    docs += [(7, docs[7][1]), (None, docs[3][1]), (61, None), (62, ""), (63, "Letter,letter.LETTER-letter1letter")]
    got = sorted(((x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in variants.variants(frame(spark, docs)).collect()), key=str)
    assert got == brute_variants(docs)


def test_variants_of_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()
    got = sorted(((x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in variants.variants(frame(spark, [(x.doc_id, x.text) for x in rows])).collect()), key=str)
    assert got == brute_variants([(x.doc_id, x.text) for x in rows])


def test_keys_name_what_they_stand_for():
    from vitaframe.llm.common import Rolling

    words = ["abcde", "abxde", "abde", "aabcde", "z" * 40]
    keys = variants._Keys(words, Rolling())
    cards, own = keys.wildcards(0).tolist(), keys.own.tolist()
    assert cards[2] == cards[7] and len(set(cards)) == len(cards) - 1
    gone, whole = keys.deletions(0).tolist(), keys.words(0).tolist()
    senders = [own[k] for k in np.flatnonzero(keys.distinct)]
    assert {senders[k] for k, x in enumerate(gone) if x == whole[2]} == {0, 1} and {senders[k] for k, x in enumerate(gone) if x == whole[0]} == {3}
    assert senders.count(4) == 1 and pa.array(keys.words(1).view("i8")).null_count == 0
