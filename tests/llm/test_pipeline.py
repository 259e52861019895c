"""The pipeline from documents to sequences against plain code on a small table."""

import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from vitaframe.llm import quality
from vitaframe.llm.common import shared_path


def words(n, r):
    return [f"w{r.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(6)
    passage, item = words(60, r), words(24, r)
    base = words(130, r)
    near = base[:]
    near[60] = "other"
    texts = {
        0: base, 1: near, 2: base, 3: words(30, r) + passage + words(30, r), 4: passage + words(25, r), 5: words(40, r) + item[:15] + words(40, r), 6: item + words(3, r), 7: words(2500, r), 8: [], 9: words(3, r),
        10: passage, 11: words(20, r) + passage[5:] + words(20, r), 12: item[3:] + ["tail"] + words(60, r),
    }
    rows = [(k, "  ".join(t) if k % 2 else " ".join(t), "en", "s", 0) for k, t in texts.items()] + [(13, None, None, None, None)]
    rows += [(100 + k, " ".join(["junk", "!!!"] * (20 + k)), "en", "s", 0) for k in range(30)] + [(200 + k, " ".join(words(60, r)), "fr", "s", 0) for k in range(30)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(100 + k, 0, 0) for k in range(30)] + [(200 + k, 1, 0) for k in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def near_duplicates_gone(docs):
    sets = {}
    for k, t in docs.items():
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    group = {k: k for k in docs}

    def find(k):
        return k if group[k] == k else find(group[k])

    for a in docs:
        for b in docs:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return {k: t for k, t in docs.items() if find(k) == k}


def repeats_gone(docs):
    out = {}
    for k, t in docs.items():
        if t is None:
            out[k] = t
            continue
        w, gone = t.split(), set()
        for p in range(len(w) - 49):
            if any(w[p : p + 50] == v[q : q + 50] for j, u in docs.items() if j < k and u for v in [u.split()] for q in range(len(v) - 49)):
                gone |= set(range(p, p + 50))
        if not gone:
            out[k] = t
        elif len(gone) < len(w):
            ends = [0, *(m.end() for m in re.finditer(r"\S+", t))]
            out[k] = "".join(t[ends[i] : ends[i + 1]] for i in range(len(w)) if i not in gone)
    return out


def leaks_gone(docs, items):
    grams = {tuple(i[p : p + 10]) for i in items for p in range(len(i) - 9)}
    out = {}
    for k, t in docs.items():
        found = list(re.finditer(r"[A-Za-z0-9]+", t or ""))
        w, gone = [m[0].lower() for m in found], set()
        for p in range(len(w) - 9):
            if tuple(w[p : p + 10]) in grams:
                gone |= set(range(p, p + 10))
        if len(gone) <= 0.5 * len(w):
            runs = [i for i in sorted(gone) if i - 1 not in gone]
            for a in reversed(runs):
                b = a
                while b + 1 in gone:
                    b += 1
                t = t[: found[a].start()] + t[found[b].end() :]
            out[k] = t
    return out


def test_documents_to_sequences(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rated = {r.doc_id: r.keep for r in quality.report(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()}
    left = {r.doc_id: r.text for r in docs.collect() if rated[r.doc_id]}
    assert 0 < len(left) < len(rated)
    items = [r.text.split() for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect() if r.text]
    left = leaks_gone(repeats_gone(near_duplicates_gone(left)), items)
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    expected = {k: [*encode(t or "", add_special_tokens=False).ids, 0] for k, t in left.items()}

    got, places = {}, {}
    for r in sorted(p.run(spark, tables).collect(), key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(got.get(r.doc_id, [])) and r.length == len(r.ids)
        got.setdefault(r.doc_id, []).extend(r.ids)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == expected
    for pieces in places.values():
        ends = [0]
        for offset, length in sorted(pieces):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(places) <= -(-sum(map(len, got.values())) // 2048) + 1


def test_only_the_last_folder_stays(spark, tables):
    import corpus_pipeline as p

    base = os.path.dirname(shared_path(spark, "x")).removeprefix("file:")
    before = set(os.listdir(base))
    p.run(spark, tables)
    assert [x.split("-")[0] for x in set(os.listdir(base)) - before if re.match("quality|near_|substring|decont", x)] == ["decontamination"]
