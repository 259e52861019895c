"""MinHash near-duplicates with circulant signatures, banding and exact verification.

A document's set holds its distinct 5-word shingles. Two permutations of [0, 2^20) suffice for all
signature coordinates: one places the shingles, the other, shifted by one place per coordinate, ranks
them. Bands of the signature give candidates; a link is confirmed on the two full sets of words.

Documents with equal sets (told by their size and the sums of two independent 64-bit hashes of their
shingles) form a class at once; only one of each class goes on. In a band's bucket each
document is compared with the smallest id, not with all others. What then shares a bucket across components is settled exactly by prefix
filtering: with shingles ordered from rare to frequent, two sets of Jaccard 0.85 share one of the first
|set| - ceil(0.85 |set|) + 1, and enough follow it in both. Edited copies have shingles of their own
first, so a large group of near copies meets in few pairs; members of one component need no further link. The order
comes from a sketch of counts; any fixed order gives the same links. Components come from alternating
large-star and small-star steps on the links; nothing is collected to the driver.

Defined results: no words (or null text) gives an empty set, linked with nothing; under five words the
whole sequence is the one shingle; rows that share a doc_id are one document; a null doc_id counts as
the largest and stays null in component_id if nothing smaller is reached; ids that are not whole numbers
are ordered as strings; extra columns take no part.
keep_one() tells rows apart by a 64-bit hash of id and text instead, so that no text goes for a shared or missing id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.llm.common import LAST_ID, MAX_ID, Rolling, arrow_map, byte_rows, free_name, hash_words, id_kind, known_id, lower_words, mix, prepare, spread_join

SHINGLE = 5
DOMAIN_BITS = 20
BANDS = 20
BAND_ROWS = 4
PERCENT = 85
SEED = 20_240_501
#: Counters that order the shingles, in so many blocks.
ORDER_BITS, ORDER_BLOCKS = 22, 64


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Where shingles are placed, and the ranks of places, twice over so that a shift needs no modulo."""
    rng = np.random.default_rng(SEED)
    place, rank = (rng.permutation(1 << DOMAIN_BITS).astype("i4") for _ in range(2))
    return place, np.concatenate((rank, rank[: BANDS * BAND_ROWS]))


def shingle_hashes(words: list[bytes], rolling: Rolling) -> np.ndarray:
    """The set, as sorted distinct 64-bit hashes."""
    return shingles_twice(words, rolling, False)[0]


def shingles_twice(words: list[bytes], rolling: Rolling, second: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The same, and an independent hash of each."""
    if not words:
        return np.zeros(0, "u8"), np.zeros(0, "u8")
    size = min(SHINGLE, len(words))
    hashed, start = hash_words(words), np.arange(len(words) - size + 1)
    first, at = np.unique(mix(rolling.runs(rolling.prefix(hashed, 0), start, size, 0) + np.uint64(size)), return_index=True)
    return first, mix(rolling.runs(rolling.prefix(hashed, 1), at, size, 1) ^ np.uint64(size)) if second else at


def signature(hashes: np.ndarray, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Circulant MinHash: coordinate k is the smallest rank after shifting places by k."""
    at = place[hashes & np.uint64((1 << DOMAIN_BITS) - 1)]
    shifts = np.arange(BANDS * BAND_ROWS)
    out = np.full(len(shifts), 1 << DOMAIN_BITS, "i4")
    for a in range(0, len(at), 4096):
        np.minimum(out, rank[at[a : a + 4096, None] + shifts].min(0), out=out)
    return out


def band_keys(signed: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    for row in signed.reshape(BANDS, BAND_ROWS).T.astype("u8"):
        key = mix(key ^ row)
    return key.view("i8")


def features(docs: DataFrame, order: str) -> DataFrame:
    """(doc_id, n_shingles, set1, set2, bands, order) per row; doc_id and the order column with null replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, (place, rank) = Rolling(), permutations()
        for batch in batches:
            n, one, two, bands = [], [], [], []
            for text in byte_rows(batch.column("text")):
                hashes, others = shingles_twice(lower_words(text), rolling)
                n.append(len(hashes))
                one.append(int(hashes.sum().view("i8")))
                two.append(int(others.sum().view("i8")))
                bands.append(band_keys(signature(hashes, place, rank)).tolist() if len(hashes) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in ((n, pa.int64()), (one, pa.int64()), (two, pa.int64()), (bands, pa.list_(pa.int64())))), batch.column("order")], ["doc_id", "n_shingles", "set1", "set2", "bands", "order"])

    return arrow_map(docs.select(known_id(docs).alias("doc_id"), "text", known_id(docs, order).alias("order")), run, "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>, order long")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of node ids whose sets are similar enough. texts: node, text."""
    # Members bring their texts first; a leader's text is then repeated for each part of its members.
    members = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    counts = pairs.groupBy("a").agg(F.count("*").alias("times")).checkpoint()
    leaders = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(counts.select("a"), "a", "left_semi")
    joined = spread_join(members, leaders, ["a"], counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, frozenset()

        def shingles(text: bytes) -> frozenset:
            words = lower_words(text)
            return frozenset(zip(*(words[k:] for k in range(min(SHINGLE, len(words)))), strict=False)) if words else frozenset()

        for batch in batches:
            keep = []
            for a, b in zip(byte_rows(batch.column("text_a")), byte_rows(batch.column("text_b")), strict=True):
                if a != last:  # pairs of one leader mostly follow each other
                    last, known = a, shingles(a)
                other = shingles(b)
                common = len(known & other)
                keep.append(bool(other) and 100 * common >= PERCENT * (len(known) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(joined.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest id reachable. links: a < b."""
    edges = links.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct().checkpoint()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def across(placed: DataFrame) -> DataFrame:
    """Rows (node, band, component) of the bands whose members lie in several components."""
    mixed = placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("band")
    return placed.join(mixed, "band")


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many of the texts have a shingle, by its hash's counter; at most 2^16 - 1."""
    width = (1 << ORDER_BITS) // ORDER_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, total = Rolling(), np.zeros(1 << ORDER_BITS, "u4")
        for batch in batches:
            for text in byte_rows(batch.column("text")):
                np.add.at(total, (shingle_hashes(lower_words(text), rolling) >> np.uint64(64 - ORDER_BITS)).astype("i8"), 1)
        blocks = np.minimum(total, 65535).astype("<u2").reshape(ORDER_BLOCKS, width)
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(blocks[k].tobytes(), 1) for k in some], pa.binary())], ["block", "counts"])

    def merge(key, table):
        total = sum((np.frombuffer(zlib.decompress(x), "<u2").astype("u4") for x in table.column("counts").to_pylist()), np.zeros(width, "u4"))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 65535).astype("<u2").tobytes()], pa.binary())], ["block", "counts"])

    out = np.zeros((ORDER_BLOCKS, width), "u2")
    for row in arrow_map(texts.select("text"), count, "block int, counts binary").groupBy("block").applyInArrow(merge, "block int, counts binary").toLocalIterator():
        out[row.block] = np.frombuffer(bytes(row.counts), "<u2")
    return out.ravel()


def prefix_pairs(rest: DataFrame) -> DataFrame:
    """Pairs (a, b) across components that share a shingle of their prefixes and have similar sizes. rest: node, component, text."""
    order = rest.sparkSession.sparkContext.broadcast(shingle_counts(rest))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, counts = Rolling(), order.value
        for batch in batches:
            parts = []
            for text in byte_rows(batch.column("text")):
                hashes = shingle_hashes(lower_words(text), rolling)
                n = len(hashes)
                rare = np.lexsort((hashes, counts[(hashes >> np.uint64(64 - ORDER_BITS)).astype("i8")]))
                parts.append((hashes[rare[: n - -(-PERCENT * n // 100) + 1]].view("i8"), n))
            each = [len(p[0]) for p in parts]
            repeat = lambda x: np.repeat(np.asarray(x, "i8"), each)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[0] for p in parts])), *(pa.array(repeat(x)) for x in (batch.column("node").to_numpy(), batch.column("component").to_numpy(), [p[1] for p in parts])), pa.array(np.concatenate([np.arange(k) for k in each]))], ["shingle", "node", "component", "n", "place"])

    rows = arrow_map(rest, prefixes, "shingle long, node long, component long, n long, place long")
    mixed = rows.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("shingle")
    rows = rows.join(mixed, "shingle").checkpoint()
    mine, theirs = rows.alias("x"), rows.alias("y")
    # At the first shared shingle, no more than the shingles from there on can be shared.
    enough = f"{100 + PERCENT} * least(x.n - x.place, y.n - y.place) >= {PERCENT} * (x.n + y.n)"
    similar = f"x.node < y.node and x.component <> y.component and {enough}"
    return mine.join(theirs, F.col("x.shingle") == F.col("y.shingle")).where(similar).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def link(docs: DataFrame, order: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """features() rows, and for each class of equal sets its component_id and number of rows. order: its smallest leads a band."""
    spark = docs.sparkSession
    prepare(spark)
    rows = features(docs, order).checkpoint()
    equal = ["set1", "set2", "n_shingles"]
    full = rows.where("n_shingles > 0")
    # Equal sets have equal bands, so these can be part of the key, and copies are combined before the shuffle.
    classes = full.groupBy(*equal, "bands").agg(F.min("doc_id").alias("node"), F.min("order").alias("first"), F.count("*").alias("times")).checkpoint()
    heads = classes.select("node", "first", "n_shingles", "bands")  # rows that share an id have one for each of their sets
    buckets = heads.select("node", "first", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.min(F.struct("first", "node")).alias("lead")).where("least < most").select("band", F.col("lead.node").alias("lead"))
    members = buckets.join(shared, "band").checkpoint()
    pairs = members.where("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct().checkpoint()
    wanted = members.select("node").distinct()
    texts = docs.select(known_id(docs).alias("node"), "text").join(wanted, "node", "left_semi").checkpoint()
    links = confirmed(pairs, texts).checkpoint()
    labels = components(links).checkpoint()
    placed = members.join(labels, "node", "left").select("node", "band", F.coalesce("component", "node").alias("component"))
    rest = across(placed).select("node", "component").distinct().join(texts, "node").checkpoint()
    found = confirmed(prefix_pairs(rest).join(pairs, ["a", "b"], "left_anti"), texts).checkpoint()
    if not found.isEmpty():
        labels = components(links.unionByName(found)).checkpoint()
    named = classes.join(labels, "node", "left").select(*equal, "times", F.coalesce("component", "node").alias("component_id")).checkpoint()
    return rows.drop("bands", "order"), named


def resolve(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id), doc_id with null replaced."""
    rows, classes = link(docs, order)
    full = spread_join(rows.where("n_shingles > 0"), classes.drop("times"), ["set1", "set2", "n_shingles"], classes.drop("component_id"))
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n_shingles", "component_id").unionByName(empty)


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept."""
    prepare(docs.sparkSession)
    if id_kind(docs) == "string":  # components of hashed ids, each then named by its smallest id
        found = resolve(docs.select(F.xxhash64("doc_id").alias("doc_id"), "text")).checkpoint()
        ids = docs.select(F.xxhash64("doc_id").alias("doc_id"), known_id(docs).alias("id")).groupBy("doc_id").agg(F.min("id").alias("id"), F.count("*").alias("times")).checkpoint()
        named = spread_join(found, ids.drop("times"), ["doc_id"], ids.drop("id")).checkpoint()
        least = named.groupBy("component_id").agg(F.min("id").alias("least"), F.count("*").alias("times")).checkpoint()
        out = spread_join(named, least.drop("times"), ["component_id"], least.drop("least"))
        known = lambda c: F.when(F.col(c) < LAST_ID, F.col(c))
        return out.select(known("id").alias("doc_id"), "n_shingles", known("least").alias("component_id"), (F.col("id") == F.col("least")).alias("kept"))
    out = resolve(docs)
    known = lambda c: F.when(F.col(c) < MAX_ID, F.col(c))
    return out.select(known("doc_id").alias("doc_id"), "n_shingles", known("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _order(docs: DataFrame) -> Column:
    """What the smallest of leads a band: the id, where ids are numbers."""
    return known_id(docs) if id_kind(docs) == "long" else F.xxhash64("doc_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each component; rows are one document only if both id and text agree."""
    spark = docs.sparkSession
    prepare(spark)
    name = free_name(docs, "nd_key")
    keyed = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    found = resolve(keyed.select(F.col(name).alias("doc_id"), "text", _order(docs).alias("order")), "order").select(F.col("doc_id").alias("key"), "component_id").distinct().checkpoint()
    ids = keyed.select(F.col(name).alias("key"), known_id(docs).alias("id")).distinct()
    kept = found.join(ids, "key").groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("least")).select(F.col("least.key").alias(name)).checkpoint()  # one plan of all this takes more of the driver
    return keyed.join(kept, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
