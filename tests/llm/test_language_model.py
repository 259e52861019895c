"""The language model against a plain sampler that loops over dishes, and its seating against exact posteriors."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from vitaframe.llm import hpylm
from vitaframe.llm.common import lower_words

MASK = 2**64 - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def draw(key, *step):
    salt = 0
    for x in step:
        salt = (salt * 1_000_003 + x + 1) & MASK
    x = mix(key ^ mix(salt))
    return (x >> 32) / 2**32, (x & 0xFFFFFFFF) / 2**32


def stirling(d, most):
    """Logarithms of the generalised Stirling numbers."""
    s = {(1, 1): 0.0}
    for c in range(2, most + 1):
        for t in range(1, c + 1):
            terms = [s[c - 1, t - 1]] if t > 1 else []
            if t < c:
                terms.append(math.log(c - 1 - d * t) + s[c - 1, t])
            top = max(terms)
            s[c, t] = top + math.log(sum(math.exp(x - top) for x in terms))
    return s


class Dishes:
    """Tables by (restaurant, dish), one dish after the other."""

    def __init__(self, customers, key, d, theta):
        self.c, self.key, self.d, self.theta = dict(customers), key, d, theta
        self.t = dict.fromkeys(self.c, 1)
        self.s = stirling(d, max(self.c.values(), default=1) + 200)

    def alone(self, c, t):
        return 1.0 if c == 1 else math.exp(self.s[c - 1, t - 1] - self.s[c, t]) if t > 1 else 0.0

    def totals(self, of):
        out = Counter()
        for k, x in of.items():
            out[k[0]] += x
        return out

    def expect(self, base):
        tables = self.totals(self.t)
        for k, c in self.c.items():
            if c > 1:
                new, t, n, seated = (self.theta + self.d * tables[k[0]]) * base(k), 1.0, 1, 1
                while seated < c:
                    lot = min(c - seated, max(1, seated // 8))
                    t += lot * new / (new + n - self.d * t)
                    n += lot
                    seated += max(1, seated // 8)
                self.t[k] = min(max(math.floor(t + 0.5), 1), c)

    def reseat(self, base, *step):
        for nth in range(hpylm.RESEATS):
            tables, now = self.totals(self.t), dict(self.t)
            for k, c in self.c.items():
                if c > 1 and c > nth:
                    first, second = draw(self.key(k), *step, nth)
                    gone = first < self.alone(c, self.t[k])
                    t = self.t[k] - gone
                    new = (self.theta + self.d * (tables[k[0]] - gone)) * base(k)
                    now[k] = t + (second * (new + c - 1 - self.d * t) < new)
            self.t = now

    def follow(self, wanted, base, *step):
        nth = 0
        while self.c != wanted:
            tables, now, c_now = self.totals(self.t), dict(self.t), dict(self.c)
            for k, c in self.c.items():
                first, second = draw(self.key(k), *step, nth)
                if wanted[k] > c:
                    new = (self.theta + self.d * tables[k[0]]) * base(k)
                    now[k] += second * (new + c - self.d * self.t[k]) < new
                    c_now[k] += 1
                elif wanted[k] < c:
                    now[k] -= first < self.alone(c, self.t[k])
                    c_now[k] -= 1
            self.t, self.c, nth = now, c_now, nth + 1


def digamma(x):
    return (math.lgamma(x + 1e-4) - math.lgamma(x - 1e-4)) / 2e-4


def strength(dishes):
    up, down = 1.0, 1.0
    tables, d, theta = dishes.totals(dishes.t), dishes.d, dishes.theta
    for r, c in dishes.totals(dishes.c).items():
        up += theta / d * (digamma(theta / d + tables[r]) - digamma(theta / d + 1))
        down += digamma(theta + c) - digamma(theta + 1)
    return up / down


def discount(counts):
    one, two = sum(x == 1 for x in counts), sum(x == 2 for x in counts)
    return min(max((one + 0.5) / (one + 2 * two + 1), 0.05), 0.95)


def plain(rows):
    """Scores by doc_id."""
    hashed = xxhash.xxh3_64_intdigest
    ranks = {h: k for k, h in enumerate(sorted({hashed(w) for _, t in rows for w in [*lower_words(t.encode()), b"\nstart", b"\nend"]}))}
    code = lambda w: ranks[hashed(w)]
    texts = {i: [code(b"\nstart")] * 2 + [code(w) for w in lower_words(t.encode())] + [code(b"\nend")] for i, t in rows}
    leaves = Counter()
    for i, x in texts.items():
        if not hpylm.is_held_out(i):
            leaves.update(((x[k - 1], x[k - 2]), x[k]) for k in range(2, len(x)))
    pair_key = lambda k: mix(mix(k[0]) ^ k[1])
    leaf_key = lambda k: mix(pair_key((k[0][0], k[1])) ^ mix(k[0][1]))

    def up(dishes, part):
        out = Counter()
        for k, t in dishes.items():
            out[part(k)] += t
        return out

    kinds = up(dict.fromkeys(leaves, 1), lambda k: (k[0][0], k[1]))
    root_customers = up(dict.fromkeys(kinds, 1), lambda k: (0, k[1]))
    v = len(root_customers)
    d = discount(root_customers.values()), discount(kinds.values()), discount(leaves.values())
    theta = hpylm.STRENGTH
    top = Dishes(root_customers, lambda k: mix(k[1]), d[0], theta[0])
    score = None
    for last in (False, True):
        c0, t0 = sum(top.c.values()), sum(top.t.values())
        root = lambda w: (max(top.c.get((0, w), 0) - d[0] * top.t.get((0, w), 0), 0) + (theta[0] + d[0] * t0) / (v + 1)) / (theta[0] + c0)  # noqa: E731, B023
        middle, leaf = Dishes(kinds, pair_key, d[1], theta[1]), Dishes(leaves, leaf_key, d[2], theta[2])
        samples = defaultdict(float)
        for nth in range(hpylm.WARM_UP + hpylm.SAMPLES * last):
            cs, ts = middle.totals(middle.c), middle.totals(middle.t)
            parent = lambda a, w: (max(middle.c.get((a, w), 0) - d[1] * middle.t.get((a, w), 0), 0) + (theta[1] + d[1] * ts[a]) * root(w)) / (theta[1] + cs[a])  # noqa: E731, B023
            base = lambda k: parent(k[0][0], k[1])  # noqa: E731, B023
            if nth == 0:
                leaf.expect(base)
            leaf.reseat(base, 2, nth)
            wanted = up(leaf.t, lambda k: (k[0][0], k[1]))
            lower = lambda k: root(k[1])
            if nth == 0:
                middle.c = dict(wanted)
                middle.expect(lower)
            else:
                middle.follow(dict(wanted), lower, 1, nth, 1)
            middle.reseat(lower, 1, nth, 0)
            if nth >= hpylm.WARM_UP:
                cs, ts, cl, tl = middle.totals(middle.c), middle.totals(middle.t), leaf.totals(leaf.c), leaf.totals(leaf.t)
                for x in texts.values():
                    for k in {((x[k - 1], x[k - 2]), x[k]) for k in range(2, len(x))}:
                        samples[k, nth] = (max(leaf.c.get(k, 0) - d[2] * leaf.t.get(k, 0), 0) + (theta[2] + d[2] * tl[k[0]]) * parent(k[0][0], k[1])) / (theta[2] + cl[k[0]])
        if last:
            steps = range(hpylm.WARM_UP, hpylm.WARM_UP + hpylm.SAMPLES)
            score = {i: sum(math.log10(sum(samples[((x[k - 1], x[k - 2]), x[k]), n] for n in steps) / hpylm.SAMPLES) for k in range(2, len(x))) for i, x in texts.items()}
        else:
            new = Dishes(up(middle.t, lambda k: (0, k[1])), top.key, d[0], theta[0])
            flat = lambda k: 1 / (v + 1)
            new.expect(flat)
            new.reseat(flat, 0, 1)
            top, theta = new, tuple(strength(x) for x in (new, middle, leaf))
    return score


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(25)]
    rows = []
    for k in range(50):
        n, w = r.randrange(0, 25), 0
        words = []
        for _ in range(n):
            w = (w * 3 + r.choice((0, 0, 1, 7))) % 25
            words.append(vocabulary[w])
        rows.append((k, " ".join(words)))
    return rows + [(100 + k, t) for k, t in rows[:8]] + [(200, "Never seen W1 w2")]


@pytest.mark.parametrize("tokens", [3_000_000, 150])
def test_equals_a_plain_sampler(spark, texts, tokens, monkeypatch):
    monkeypatch.setattr(hpylm, "BUCKET_TOKENS", tokens)
    monkeypatch.setattr(hpylm, "CHUNK_TOKENS", 200)
    monkeypatch.setattr(hpylm, "HOT_SHARE", 1e9)
    got = {r.doc_id: r.score for r in hpylm.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    want = plain(texts)
    assert got == {k: pytest.approx(x, rel=1e-5) for k, x in want.items()}


def test_shared_parents_change_little(spark, texts, monkeypatch):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = {r.doc_id: r for r in hpylm.score(docs).collect()}
    monkeypatch.setattr(hpylm, "BUCKET_TOKENS", 160)
    assert len(hpylm.numbered(hpylm.chunk_rows(docs).checkpoint(), 3)[3]) > 3
    two = {r.doc_id: r for r in hpylm.score(docs).collect()}
    for k, r in one.items():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (two[k].n_tokens, two[k].n_known, two[k].train_tokens, pytest.approx(two[k].base_score))
        assert two[k].score == pytest.approx(r.score, rel=0.08, abs=0.3)


def test_probabilities_sum_to_one(spark):
    words = [f"w{k}" for k in range(12)]
    train, held = ([i for i in range(400) if hpylm.is_held_out(i) == x] for x in (False, True))
    r = random.Random(2)
    rows = [(i, " ".join([*words, *r.choices(words, k=30)])) for i in train[:6]]
    asked = [f"w1 w2 {w}" for w in [*words, "unknown"]] + ["w1 w2"]  # the last one ends after these
    chunks = hpylm.chunk_rows(spark.createDataFrame([*rows, *zip(held, asked, strict=False)], "doc_id long, text string"))
    chunks, vocabulary, tokens, hot = hpylm.numbered(chunks.checkpoint(), 2)
    cold = hpylm.deal(chunks, 1, hot).checkpoint()
    shared, replies = hpylm.learn(cold, 1, hot, vocabulary)
    assert (len(hot), vocabulary, tokens) == (0, 13, sum(len(t.split()) + 1 for _, t in rows))
    _, bucket = hpylm.bucket_of(cold.toArrow(), hot)
    bucket.take(shared, replies.toArrow())
    words = sorted(xxhash.xxh3_64_intdigest(w.encode()) for w in [*words, "unknown", "\nstart", "\nend"])
    two, unknown = (words.index(xxhash.xxh3_64_intdigest(x)) for x in (b"w2", b"unknown"))
    for nth in range(4):
        bucket.sweep(shared, nth)
        p = bucket.probability(shared)
        after = bucket.words[bucket.nears[bucket.upper.at[bucket.pair]]] == two
        inside = np.isin(bucket.leaf.at, bucket.leaf.at[after & (bucket.words[bucket.word] == unknown)])
        assert inside.sum() == 14
        assert p[inside].sum() == pytest.approx(1)


def test_reseating_has_the_exact_posterior():
    c, d, theta, others, base, n = 6, 0.6, 2.0, 3, 0.2, 20_000
    level = hpylm.Level(np.arange(n), np.arange(n).astype("u8"), np.full(n, c), np.ones(n, "i8"), np.full(n, others + 1))
    for nth in range(12):
        level.reseat(np.full(n, base), d, theta, nth)
    s = stirling(d, c)
    weight = np.array([math.exp(s[c, t]) * math.prod((theta + d * (others + j)) * base for j in range(t)) for t in range(1, c + 1)])
    seen = np.bincount(level.tables, minlength=c + 1)[1:] / n
    assert np.abs(seen - weight / weight.sum()).max() < 0.015
    assert (level.in_all == level.tables + others).all()


def test_following_has_the_exact_posterior():
    c, d, theta, others, base, n = 5, 0.4, 1.0, 2, 0.3, 20_000
    level = hpylm.Level(np.arange(n), np.arange(n).astype("u8"), np.ones(n, "i8"), np.ones(n, "i8"), np.full(n, others + 1))
    level.follow(np.full(n, 9), np.full(n, base), d, theta, 0)
    level.follow(np.full(n, c), np.full(n, base), d, theta, 1)
    assert (level.customers == c).all() and (level.tables >= 1).all() and (level.tables <= c).all()


def test_chance_of_sitting_alone_beyond_the_table():
    short, full = hpylm.Alone(0.5, 128), hpylm.Alone(0.5, 1024)
    c = np.full(60, 1000)
    t = np.arange(2, 602, 10)
    assert np.abs(short(c, t) - full(c, t)).max() < 0.02
    assert np.abs(short(c, t) / full(c, t) - 1).max() < 0.15


def test_documents_that_occur_twice_score_apart(spark):
    r = random.Random(3)
    text = lambda: " ".join(f"t{r.randrange(400)}" for _ in range(60))
    rows = [(k, text()) for k in range(200)]
    twice = [(1000 + k, rows[k][1]) for k in range(0, 200, 20)]
    got = {x.doc_id: x.score for x in hpylm.score(spark.createDataFrame(rows + twice, "doc_id long, text string")).collect()}
    copied = [got[k] for k in range(0, 200, 20) if not hpylm.is_held_out(k) and not hpylm.is_held_out(1000 + k)]
    single = [got[k] for k in range(200) if k % 20 and not hpylm.is_held_out(k)]
    assert min(copied) > max(single)


def test_triples_come_back_from_their_steps():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 500):
        keys = np.unique(rng.integers(0, 6, (n, 3)), axis=0).reshape(-1, 3)
        triples = [np.ascontiguousarray(c) for c in keys.T]
        steps = [x.astype("<u2").astype("i8") for x in hpylm._ordered(*triples)]
        for got, want in zip(hpylm._restored(*steps), triples, strict=True):
            assert got.tolist() == want.tolist()


def test_words_are_numbered_by_rank(spark):
    texts = [" ".join(["often"] * 40 + ["some"] * 6 + [f"rare{i}"]) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    hpylm.prepare(spark)
    chunks = hpylm.chunk_rows(docs).checkpoint()
    hashes = {r.part: hpylm.Chunk.of(r.asDict(), numbered=False).words.tolist() for r in chunks.collect()}
    rank = {h: i for i, h in enumerate(sorted(set().union(*hashes.values())))}
    out, vocabulary, tokens, _ = hpylm.numbered(chunks, 2)
    counts = {}
    for row in out.collect():
        chunk = hpylm.Chunk.of(row.asDict())
        assert chunk.words.tolist() == [rank[h] for h in hashes[row.part]]
        assert (np.diff(chunk.kinds.astype("i8")) >= 0).all()
        for w, t in zip(chunk.words.tolist(), chunk.trained_words.tolist(), strict=True):
            assert counts.setdefault(w, t) == t  # one training count whatever the chunk
    assert sorted(counts) == list(range(30 + 4))
    assert tokens == sum(counts.values()) and vocabulary == sum(t > 0 for t in counts.values())


def test_rounded_probabilities_stay_close():
    p = np.random.default_rng(1).uniform(1e-9, 1, 10_000)
    assert np.abs(np.log10(hpylm.rounded(p)) - np.log10(p)).max() < 7e-6


def test_a_frequent_word_goes_to_no_more_buckets_than_it_has_pieces(spark, texts, monkeypatch):
    monkeypatch.setattr(hpylm, "BUCKET_TOKENS", 160)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    chunks, _, _, hot, times, _ = hpylm.numbered_and_counted(hpylm.chunk_rows(docs).checkpoint(), 3)
    assert len(hot) == len(times) > 3 and (times > hpylm.HOT_SHARE * 160).all() and (np.diff(hot.astype("i8")) > 0).all()
    pieces = hpylm.pieces_of(times, 9)
    assert (pieces >= 2).all() and (pieces <= 9).all() and (pieces * hpylm.PIECE_SHARE * 160 >= np.minimum(times, 9 * hpylm.PIECE_SHARE * 160)).all()
    seen, contexts = {}, {}
    for row in chunks.collect():
        chunk = hpylm.Chunk.of(row.asDict())
        bucket, near, far, _, _ = chunk.triples(9, hot, pieces)
        for b, n, f in zip(bucket.tolist(), chunk.words[near].tolist(), chunk.words[far].tolist(), strict=True):
            seen.setdefault(n, set()).add(b)
            assert contexts.setdefault((n, f), b) == b  # a leaf restaurant is whole
    most = dict(zip(hot.tolist(), pieces.tolist(), strict=True))
    assert all(len(b) <= most.get(n, 1) for n, b in seen.items())
    assert max(map(len, seen.values())) > 1


def test_a_bucket_sorts_its_rows_once(monkeypatch):
    r = np.random.default_rng(5)
    rows = []
    for part in range(3):
        words, place = np.unique(r.integers(0, 40, 1500), return_inverse=True)
        near, far, word = place.reshape(3, 500)
        order = np.lexsort((word, far, near))
        packed = hpylm._pack(hpylm._steps(words.astype("u8")), np.zeros(len(words), "u1"), *(x.astype("<u2") for x in hpylm._ordered(near[order], far[order], word[order])), r.integers(0, 3, 500).astype("<u4"))
        rows.append({"part": part, "bucket": 0, "n": len(words), "m": 500, "packed": packed})
    sizes, unique = [], np.unique
    monkeypatch.setattr(hpylm.np, "unique", lambda x, *a, **b: sizes.append(len(x)) or unique(x, *a, **b))
    bucket = hpylm.Bucket(rows, np.zeros(0, "u8"))
    monkeypatch.undo()
    assert sizes.count(1500) == 1
    triples = set(zip(bucket.words[bucket.nears[bucket.upper.at[bucket.pair]]].tolist(), bucket.context.tolist(), bucket.words[bucket.word].tolist(), strict=True))
    assert len(triples) == len(bucket.word) == bucket.triple.max() + 1 and len(bucket.triple) == 1500
    assert (np.diff(bucket.context) >= 0).all() and len(set(bucket.context.tolist())) == bucket.context.max() + 1


def test_a_sweep_reseats_every_customer():
    """From the start that is farthest off; eight steps a sweep, as before, leave most of it after as many sweeps."""
    c, d, theta, others, base, n = 60, 0.5, 2.0, 3, 0.05, 4_000
    level = hpylm.Level(np.arange(n), np.arange(n).astype("u8"), np.full(n, c), np.full(n, c), np.full(n, others + c))
    for nth in range(20):
        level.reseat(np.full(n, base), d, theta, nth)
    s = stirling(d, c)
    weight = np.array([math.exp(s[c, t] - s[c, 1]) * math.prod((theta + d * (others + j)) * base for j in range(t)) for t in range(1, c + 1)])
    seen = np.bincount(level.tables, minlength=c + 1)[1:] / n
    assert np.abs(seen - weight / weight.sum()).max() < 0.04
    assert (level.in_all == level.tables + others).all()


def test_large_dishes_start_from_drawn_seatings():
    """Against customers seated one by one; before, all of these dishes started from the same expected number."""
    c, d, theta, others, base, n = 2_000, 0.5, 2.0, 3, 0.2, 3_000
    level = hpylm.Level(np.arange(n), np.arange(n).astype("u8"), np.full(n, c), np.ones(n, "i8"), np.full(n, others + 1))
    level.start(np.full(n, base), d, theta, 5)
    new, t, r = (theta + d * (others + 1)) * base, np.ones(n), np.random.default_rng(3)
    for k in range(1, c):
        t += r.random(n) < new / (new + k - d * t)
    assert level.tables.mean() == pytest.approx(t.mean(), rel=0.1)
    assert level.tables.std() == pytest.approx(t.std(), rel=0.2)


def test_opened_tables_are_binomial():
    keys = np.arange(100_000).astype("u8")
    for lot, p in ((5, 0.3), (40, 0.9), (900, 0.05), (3_000, 0.5)):
        x = hpylm.opened(np.full(len(keys), lot), np.full(len(keys), p), keys, 1)
        assert (x.mean(), x.var()) == (pytest.approx(lot * p, rel=0.01), pytest.approx(lot * p * (1 - p), rel=0.03))
