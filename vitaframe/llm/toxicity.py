"""Toxicity by a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings of the word, its beginning and its end. Filters of
several widths slide over the words of a whole text; each filter's largest response (max pooling) feeds
a logistic output. Scoring is one pass of `mapInArrow` with the fitted arrays broadcast.

Thresholds are calibrated per language on a held-back part of the labelled rows: the smallest score at which
precision reaches TARGET_PRECISION. They only add the columns `threshold` and `flagged`; the score
itself never sees a label, language, source or id.

Fitting takes all labelled rows. They are dealt to shards by a hash of their ids. In each of EPOCHS rounds every
shard goes once through its rows from the common state of the network and its moments; the states are then averaged
by rows, a row of the embedding over the shards that moved it. Counts of words, shares of labels and thresholds are
those of all rows; only the network itself passes through the driver. Defined results: empty and null texts are scored from the biases alone; documents without label are
scored alike; null or non-0/1 labels and repeated labels of one document with different values take no
part in fitting; a labelled id with several texts is fitted with the smallest of them; rows without a language
have a threshold of their own; with labels of one kind only, or none, every score is that share (0.5 for none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.llm.common import alnum_words, arrow_map, byte_rows, merged_in_tree, prepare
from vitaframe.llm.hpylm import _REMOVE_SHUFFLES, discard, setting

BUCKETS = 1 << 18
WIDTH = 16
FILTERS = 12
SIZES = (1, 2, 3)
EPOCHS = 6
#: A shard of labelled rows has about so many rows, or so many words where they are long.
SHARD_ROWS, SHARD_WORDS = 4000, 4_000_000
#: Ranges of buckets by which the shards' networks are averaged.
BLOCKS = 16
CUT = 0.7
TARGET_PRECISION = 0.95
#: Buckets that fewer of the labelled documents fill keep a zero vector: they could only be learned by heart.
MIN_DOCUMENTS = 3
CHUNK_WORDS = 100_000


def word_codes(words: list[bytes]) -> np.ndarray:
    """Buckets of each word, its first four and its last four bytes, shape (3, n)."""
    whole = np.fromiter(map(zlib.crc32, words), "u4", len(words))
    begin = np.fromiter((zlib.crc32(w[:4], 1) for w in words), "u4", len(words))
    end = np.fromiter((zlib.crc32(w[-4:], 2) for w in words), "u4", len(words))
    return (np.stack((whole, begin, end)) % BUCKETS).astype("i4")


@dataclass
class Network:
    """Arrays of the classifier; `constant` replaces it where nothing could be learned."""

    embed: np.ndarray = field(default_factory=lambda: np.random.default_rng(1).normal(0, 0.1, (BUCKETS, WIDTH)).astype("f4"))
    filters: dict = field(default_factory=lambda: {s: np.random.default_rng(10 + s).normal(0, 0.2, (s, WIDTH, FILTERS)).astype("f4") for s in SIZES})
    bias: dict = field(default_factory=lambda: {s: np.zeros(FILTERS, "f4") for s in SIZES})
    out: np.ndarray = field(default_factory=lambda: np.random.default_rng(2).normal(0, 0.1, FILTERS * len(SIZES)).astype("f4"))
    out_bias: float = -1.0
    constant: float | None = None

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        return self.embed[codes[0]] + self.embed[codes[1]] + self.embed[codes[2]]

    def pooled(self, x: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict]:
        """Largest response of every filter in every document, and its place; documents follow each other in x."""
        blocks, places = [], {}
        n = len(x)
        own = np.repeat(np.arange(len(counts)), counts)
        for s in SIZES:
            response = x @ self.filters[s][0]
            for k in range(1, s):
                response[: n - k] += x[k:] @ self.filters[s][k]
            # A filter that would reach into the next document sees only its own words.
            for k in range(1, s):
                reach = np.flatnonzero(np.arange(n) + k >= (firsts + counts)[own])
                inside = reach[reach + k < n]
                response[inside] -= x[inside + k] @ self.filters[s][k]
            top = np.zeros((len(counts), FILTERS), "f4")
            have = np.flatnonzero(counts > 0)
            if len(have):
                top[have] = np.maximum.reduceat(response, firsts[have], axis=0)
            places[s] = response
            blocks.append(np.maximum(top + self.bias[s], 0) * (counts > 0)[:, None])
        return np.concatenate(blocks, axis=1), places

    def score(self, lots: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(lots), self.constant)
        counts = np.array([c.shape[1] for c in lots], "i8")
        x = self.vectors(np.concatenate(lots, axis=1)) if counts.sum() else np.zeros((0, WIDTH), "f4")
        h, _ = self.pooled(x, np.cumsum(counts) - counts, counts)
        z = np.clip(h @ self.out + self.out_bias, -30, 30).astype("f8")
        return 1 / (1 + np.exp(-z))


class Learner:
    """A network while it is fitted, with the moments of Adam. Only buckets in `rows` have a vector."""

    def __init__(self, rows: np.ndarray, net: Network | None = None) -> None:
        self.net, self.rows, self.tick = net or Network(), rows, 0
        self.frequent = np.zeros(BUCKETS, bool)
        self.frequent[rows] = True
        self.net.embed *= self.frequent[:, None]
        self.embed_moments = np.zeros((2, *self.net.embed.shape), "f4")
        self.values = {**{f"f{s}": self.net.filters[s] for s in SIZES}, **{f"b{s}": self.net.bias[s] for s in SIZES}, "out": self.net.out}
        self.moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in self.values.items()}

    def vectors_of(self, rows: np.ndarray) -> np.ndarray:
        """Vectors and moments of some buckets, side by side."""
        return np.concatenate((self.net.embed[rows], *self.embed_moments[:, rows]), axis=1)

    def put_vectors(self, rows: np.ndarray, found: np.ndarray) -> None:
        self.net.embed[rows], self.embed_moments[0][rows], self.embed_moments[1][rows] = np.split(found, 3, axis=1)

    def dense(self) -> np.ndarray:
        """All else, in one array."""
        return np.concatenate([np.array([self.net.out_bias]), *(x.ravel() for k in self.values for x in (self.values[k], *self.moments[k]))]).astype("f8")

    def put_dense(self, found: np.ndarray) -> None:
        self.net.out_bias, at = float(found[0]), 1
        for k in self.values:
            for x in (self.values[k], *self.moments[k]):
                x[...] = found[at : at + x.size].reshape(x.shape)
                at += x.size

    def state(self) -> tuple:
        return self.rows, self.vectors_of(self.rows), self.dense(), self.tick

    @classmethod
    def of(cls, state: tuple) -> Learner:
        out = cls(state[0], Network(np.zeros((BUCKETS, WIDTH), "f4")))
        out.put_vectors(state[0], state[1])
        out.put_dense(state[2])
        out.tick = state[3]
        return out

    def step(self, name: str, gradient: np.ndarray, rate: float) -> None:
        m, v = self.moments[name]
        m += 0.1 * (gradient - m)
        v += 0.001 * (gradient * gradient - v)
        self.values[name] -= rate * (m / (1 - 0.9**self.tick)) / (np.sqrt(v / (1 - 0.999**self.tick)) + 1e-7)

    def epoch(self, lots: list[np.ndarray], labels: np.ndarray, share: float, seed: list[int], rate: float = 0.01) -> np.ndarray:
        """Adam on the logistic loss, once through the rows; only the places that won the max pooling get a gradient. share: of label 1 in all rows. Returns the buckets that moved."""
        net = self.net
        weight = np.where(labels > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        moved = np.zeros(BUCKETS, bool)
        order = np.random.default_rng(seed).permutation(len(lots))
        for at in range(0, len(order), 64):
            self.tick += 1
            batch = order[at : at + 64]
            codes = np.concatenate([lots[i] for i in batch], axis=1)
            counts = np.array([lots[i].shape[1] for i in batch], "i8")
            firsts = np.cumsum(counts) - counts
            x = net.vectors(codes)
            h, responses = net.pooled(x, firsts, counts)
            z = h @ net.out + net.out_bias
            delta = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) * weight[batch] / len(batch)).astype("f4")
            dh = delta[:, None] * net.out * (h > 0)
            gradient_out = h.T @ delta
            touched, grads = [], []
            for j, s in enumerate(SIZES):
                d = dh[:, j * FILTERS : (j + 1) * FILTERS]
                gf = np.zeros_like(net.filters[s])
                some = np.flatnonzero(counts)
                win = np.array([responses[s][firsts[i] : firsts[i] + counts[i]].argmax(0) for i in some]).reshape(len(some), FILTERS) + firsts[some, None]
                for k in range(s):
                    ok = (win + k < (firsts + counts)[some, None]) & (d[some] != 0)
                    doc, filter_ = np.nonzero(ok)
                    if len(doc):
                        rows, by = win[ok] + k, d[some][ok]
                        np.add.at(gf[k].T, filter_, x[rows] * by[:, None])
                        touched.append(rows)
                        grads.append(by[:, None] * net.filters[s][k].T[filter_])
                self.step(f"f{s}", gf + 1e-5 * net.filters[s], rate)
                self.step(f"b{s}", d.sum(0), rate)
            self.step("out", gradient_out + 1e-4 * net.out, rate)
            net.out_bias -= rate * float(delta.sum())
            if touched:
                rows, grad = np.concatenate(touched), np.concatenate(grads)
                for part in codes:  # rows of the embedding that won somewhere, with a step of their own size
                    fit_ = self.frequent[part[rows]]
                    own = part[rows][fit_]
                    if not len(own):
                        continue
                    by_bucket = np.argsort(own, kind="stable")
                    where, starts = np.unique(own[by_bucket], return_index=True)
                    total = np.add.reduceat(grad[fit_][by_bucket], starts, axis=0)
                    m, v = self.embed_moments
                    m[where] = 0.9 * m[where] + 0.1 * total
                    v[where] = 0.99 * v[where] + 0.01 * total * total
                    net.embed[where] -= rate * m[where] / (np.sqrt(v[where]) + 1e-7)
                    moved[where] = True
        return np.flatnonzero(moved)


def clean_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the documents whose labels agree on 0 or 1."""
    return labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("most")).where("label = most").select("doc_id", "label")


def held_out(name: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _held_back(name: str) -> Column:
    """Of the labelled rows, one in five is kept for the thresholds."""
    return F.crc32(F.concat(F.col(name).cast("string"), F.lit("/back")).cast("binary")) % 5 == 0


def _coded(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, lang, label, back, n_words, codes) of the labelled documents, one an id."""
    rows = docs.select("doc_id", "lang", "text").where(~held_out()).join(known, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("text", "lang")).alias("d"))
    rows = rows.select("doc_id", "d.lang", "label", _held_back("doc_id").alias("back"), "d.text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lots = [word_codes(alnum_words(t)) for t in byte_rows(batch.column("text"))]
            columns = pa.array([x.shape[1] for x in lots], pa.int64()), pa.array([zstandard.compress(x.tobytes(), 1) for x in lots], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + list(columns), [*names, "n_words", "codes"])

    names = ["doc_id", "lang", "label", "back"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return arrow_map(rows, encode, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, label int, back boolean, n_words long, codes binary").checkpoint()


def _lots(table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.decompress(x), "i4").reshape(3, -1) for x in table.column("codes").to_pylist()]


_SUMS = "block int, part int, n int, packed binary"


def _sums(block: int, part: int, keys: np.ndarray, weights: np.ndarray, sums: np.ndarray) -> tuple:
    return block, part, len(keys), zstandard.compress(keys.astype("<i4").tobytes() + weights.astype("<f8").tobytes() + sums.astype("<f8").tobytes(), 1)


def _unsummed(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(packed)
    return np.frombuffer(raw, "<i4", n), np.frombuffer(raw, "<f8", n, 4 * n), np.frombuffer(raw, "<f8", -1, 12 * n).reshape(n, -1)


def _sum_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["block", "part", "n", "packed"])


def _merge(key, table):
    """Weights and weighted sums of a block's keys, added."""
    found = [_unsummed(r["n"], r["packed"]) for r in sorted(table.to_pylist(), key=lambda r: zlib.crc32(r["packed"]))]
    keys, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    weights = np.bincount(place, np.concatenate([f[1] for f in found]), len(keys))
    sums = np.zeros((len(keys), found[0][2].shape[1]))
    np.add.at(sums, place, np.concatenate([f[2] for f in found]))
    return _sum_table([_sums(key[0].as_py(), key[1].as_py(), keys, weights, sums)])


def _by_blocks(keys: np.ndarray, weights: np.ndarray, sums: np.ndarray, part: int) -> list[tuple]:
    edges = np.searchsorted(keys, np.arange(BLOCKS + 1) * (BUCKETS // BLOCKS))
    return [_sums(k, part, keys[a:b], weights[a:b], sums[a:b]) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def _merged(packs: DataFrame, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, keys, weights, sums) over all shards; at most a row for each bucket of the network. The shuffles that made them go with it."""
    with setting(packs.sparkSession, _REMOVE_SHUFFLES, "true"):
        merged = merged_in_tree(packs, ["block"], max(shards, 2), _merge, _SUMS).checkpoint()
    for r in merged.toLocalIterator():
        yield r.block, *_unsummed(r.n, bytes(r.packed))
    discard(merged)


def train(coded: DataFrame, shards: int, n: int, share: float, epochs: int = EPOCHS) -> Network:
    """The network of all rows in coded, which are partitioned by `shard`. n: rows; share: of label 1."""
    groups = coded.groupBy("shard")

    def count(key, table):
        filled = np.bincount(np.concatenate([np.unique(c) for c in _lots(table)]), minlength=BUCKETS)
        some = np.flatnonzero(filled)
        return _sum_table(_by_blocks(some, filled[some], np.zeros((len(some), 1)), key[0].as_py()))

    least = max(min(MIN_DOCUMENTS, n // 20), 1)
    rows = [keys[weights >= least] for _, keys, weights, _ in _merged(groups.applyInArrow(count, _SUMS), shards)]
    state = Learner(np.sort(np.concatenate([np.zeros(0, "i4"), *rows]))).state()
    for nth in range(epochs):
        held = coded.sparkSession.sparkContext.broadcast(state)

        def go_on(key, table):
            shard = key[0].as_py()
            lots, labels, ids = _lots(table), table.column("label").to_numpy().astype("f4"), table.column("doc_id").to_pylist()
            order = sorted(range(len(lots)), key=lambda i: str(ids[i]))
            learner = Learner.of(held.value)
            moved = learner.epoch([lots[i] for i in order], labels[order], share, [7, nth, shard])
            weight = float(len(lots))
            steps = np.append(learner.dense(), learner.tick)
            return _sum_table([*_by_blocks(moved, np.full(len(moved), weight), weight * learner.vectors_of(moved), shard), _sums(-1, shard, np.zeros(1), np.full(1, weight), weight * steps[None])])

        learner = Learner.of(state)
        for block, keys, weights, sums in _merged(groups.applyInArrow(go_on, _SUMS), shards):
            mean = sums / weights[:, None]
            if block < 0:
                learner.put_dense(mean[0, :-1])
                learner.tick = round(mean[0, -1])
            else:
                learner.put_vectors(keys, mean.astype("f4"))
        state = learner.state()
        held.destroy()  # its files on the driver too
    return Learner.of(state).net


def thresholds(tested: DataFrame) -> dict[str | None, float]:
    """By language, the smallest score at which precision reaches TARGET_PRECISION. tested: lang, score, label."""
    same = tested.groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    ranged = same.repartitionByRange("lang", F.desc("score")).withColumn("part", F.spark_partition_id()).checkpoint()  # so that no task holds a language
    down = Window.partitionBy("lang", "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ends = ranged.groupBy("lang", "part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    ends = ends.select(F.col("lang").alias("own"), F.col("part").alias("at"), *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "hits")))
    summed = ranged.select("lang", "part", "score", *(F.sum(c).over(down).alias(c) for c in ("n", "hits")))
    fine = summed.join(F.broadcast(ends), F.col("lang").eqNullSafe(F.col("own")) & (F.col("part") == F.col("at"))).where((F.col("hits") + F.col("hits_above")) / (F.col("n") + F.col("n_above")) >= TARGET_PRECISION)
    return {r.lang: r.least for r in fine.groupBy("lang").agg(F.min("score").alias("least")).collect()}  # a row for each language


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Network, dict[str | None, float]]:
    """The network and a threshold per language, from all labelled rows that are not held out."""
    spark = docs.sparkSession
    prepare(spark)
    with setting(spark, _REMOVE_SHUFFLES, "true"):
        coded = _coded(docs, clean_labels(labels).where(~held_out()))
    facts = {r.back: r for r in coded.groupBy("back").agg(F.count("*").alias("n"), F.sum("label").alias("ones"), F.sum("n_words").alias("words")).collect()}
    n, ones, words = (sum(r[k] for r in facts.values()) for k in ("n", "ones", "words"))
    rest = facts.get(False)
    split = n >= 50 and rest is not None and 0 < rest.ones < rest.n
    trained, tested = (coded.where(~F.col("back")), coded.where("back")) if split and True in facts else (coded, coded)
    if split and True in facts:
        n, ones, words = rest.n, rest.ones, rest.words
    if not 0 < ones < n:
        net = Network(constant=ones / n if n else 0.5)
    else:
        shards = max(-(-n // SHARD_ROWS), -(-words // SHARD_WORDS))
        with setting(spark, "spark.sql.adaptive.enabled", "false"), setting(spark, _REMOVE_SHUFFLES, "true"):  # a fixed plan's checkpoint keeps its partitioning
            dealt = trained.select("doc_id", "label", "codes", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)).cast("int").alias("shard")).repartition(shards, "shard").checkpoint()
        net = train(dealt, shards, n, ones / n)
        discard(dealt)
    held = spark.sparkContext.broadcast(net)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.concatenate([held.value.score([c]) for c in _lots(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(scores), batch.column("label")], ["lang", "score", "label"])

    kind = coded.schema["lang"].dataType.simpleString()
    limits = {r.lang: CUT for r in tested.select("lang").distinct().collect()}
    limits |= thresholds(arrow_map(tested.select("lang", "label", "codes"), test, f"lang {kind}, score double, label int"))
    discard(coded)
    return net, limits


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang and score."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            scores, lots, words = [], [], 0
            for text in byte_rows(batch.column("text")):
                lots.append(word_codes(alnum_words(text)))
                words += lots[-1].shape[1]
                if words >= CHUNK_WORDS:
                    scores.append(model.score(lots))
                    lots, words = [], 0
            if lots:
                scores.append(model.score(lots))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(np.concatenate(scores).astype("f8"))], ["doc_id", "lang", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return arrow_map(docs.select("doc_id", "lang", "text"), run, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    net, limits = fit(docs, labels)
    of_lang = F.lit(CUT)
    for lang, limit in limits.items():
        of_lang = F.when(F.col("lang").eqNullSafe(F.lit(lang)), limit).otherwise(of_lang)
    out = scored(docs, net)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), of_lang.alias("threshold"), (F.col("score") >= of_lang).alias("flagged"))
