"""Substring dedup: a count-min prefilter, then exact grouping of what it estimates to be repeated.

A window is 50 consecutive words. Each has an anchor: the smallest hash among its 16-word grams. Equal
windows have equal anchors, so an anchor occurs at least as often as any window under it, and a
count-min sketch of anchors never underestimates a window's count.

1. Each task counts the anchors of its documents in a sketch of its own; the sketches are merged by
   blocks of cells on the executors. Only one bit per cell, "two or more", is broadcast; the number of
   cells follows the text's bytes up to ``MAX_CELL_BITS``. Beyond that more windows pass the filter,
   none is lost.
2. Windows estimated repeated are grouped exactly, in runs under one anchor: equal runs first (the
   smallest doc_id of each), then, for anchors with several different runs, single windows.
3. A word goes if a window over it starts in a document with a smaller doc_id.

Defined results: null text has no words; texts of fewer than 50 words lose nothing; rows that share a
doc_id do not remove each other's words; a null doc_id counts as larger than any other; ids that are not
whole numbers are ordered as strings; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.llm.common import Rolling, arrow_map, byte_rows, free_name, hash_words, id_kind, known_id, mix, plain_words, prepare, quoted, replace_text, spread_join

WINDOW = 50
GRAM = 16
ROWS = 2
MAX_CELL_BITS = 28
BLOCKS = 128
#: Words hashed at once.
CHUNK_WORDS = 150_000
_ROW_KEYS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA5A3564E27F8865B, 0xCA5A826395121157], "u8")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def chunks(batches: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Rows in lots of about CHUNK_WORDS words: (values of the extra columns, words), of texts with a window."""
    rows, lots, held = [], [], 0
    for batch in batches:
        for values, text in zip(zip(*(batch.column(c).to_pylist() for c in extra), strict=True) if extra else ((),) * batch.num_rows, byte_rows(batch.column("text")), strict=True):
            words = plain_words(text)
            if len(words) < WINDOW:
                continue
            rows.append(values)
            lots.append(words)
            held += len(words)
            if held >= CHUNK_WORDS:
                yield rows, lots
                rows, lots, held = [], [], 0
    if rows:
        yield rows, lots


class Anchored:
    """Windows of a lot of documents, in runs of neighbours that share an anchor."""

    def __init__(self, lots: list[list[bytes]], rolling: Rolling) -> None:
        self.hashes = hash_words(w for words in lots for w in words)
        sizes = np.array([len(w) for w in lots], "i8")
        self.first_word = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        prefix = rolling.prefix(self.hashes, 0)
        n = len(self.hashes) - GRAM + 1
        low = mix(rolling.runs(prefix, np.arange(n), GRAM, 0))
        span, reach = WINDOW - GRAM + 1, 1
        while 2 * reach <= span:  # smallest of 2, 4, 8 ... neighbours
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        own = np.repeat(np.arange(len(sizes)), np.maximum(sizes - WINDOW + 1, 0))
        start = np.arange(len(own)) + (own * (WINDOW - 1))  # windows never cross documents
        anchor = low[start]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])))
        at = np.flatnonzero(new)
        self.start, self.length = start[at], np.diff(np.append(at, len(own)))
        self.anchor, self.document = anchor[at], own[at]
        self.prefix = prefix

    def pairs(self, rolling: Rolling) -> np.ndarray:
        return rolling.prefix(self.hashes, 1)


def cells(anchors: np.ndarray, bits: int) -> np.ndarray:
    """Cell of each anchor in each row of the sketch, shape (ROWS, n), rows one after another."""
    return np.stack([(mix(anchors ^ _ROW_KEYS[r]) >> np.uint64(64 - bits)) + np.uint64(r << bits) for r in range(ROWS)])


def sketch_bits(docs: DataFrame) -> int:
    """log2 of the cells in a row: about six for each anchor that so much text has."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return min(MAX_CELL_BITS, max(14, int(size / 20).bit_length()))


def sketch(docs: DataFrame, bits: int) -> np.ndarray:
    """One bit per cell: two or more anchors fell into it. At most ROWS * 2^MAX_CELL_BITS bits."""
    width = (ROWS << bits) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, parts, held = Rolling(), [], 0

        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            edges = np.searchsorted(found, np.arange(BLOCKS + 1, dtype="u8") * np.uint64(width))
            rows = [(k, zlib.compress((found[a:b] - np.uint64(k * width)).astype("<u4").tobytes(), 1), zlib.compress(np.minimum(n[a:b], 255).astype("u1").tobytes(), 1)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["block", "cells", "counts"])

        for _, lots in chunks(batches, []):
            parts.append(cells(Anchored(lots, rolling).anchor, bits).ravel())
            held += parts[-1].size
            if held > 4_000_000:
                yield out(parts)
                parts, held = [], 0
        if parts:
            yield out(parts)

    def merge(key, table):
        total = np.zeros(width, "u2")
        for at, n in zip(table.column("cells").to_pylist(), table.column("counts").to_pylist(), strict=True):
            where = np.frombuffer(zlib.decompress(at), "<u4")
            total[where] = np.minimum(total[where] + np.frombuffer(zlib.decompress(n), "u1"), 255)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(np.packbits(total >= 2).tobytes(), 1)], pa.binary())], ["block", "many"])

    counted = arrow_map(docs.select("text"), count, "block int, cells binary, counts binary")
    out = np.zeros((BLOCKS, width // 8), "u1")
    for row in counted.groupBy("block").applyInArrow(merge, "block int, many binary").toLocalIterator():
        out[row.block] = np.frombuffer(zlib.decompress(bytes(row.many)), "u1")
    return out.ravel()


def repeated_runs(docs: DataFrame, many: Broadcast, bits: int) -> DataFrame:
    """Runs of windows whose anchor the sketch estimates to occur twice or more. docs: doc_id, key, text."""

    kind = id_kind(docs)
    id_type = pa.int64() if kind == "long" else pa.string()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, table = Rolling(), many.value
        for rows, lots in chunks(batches, ["doc_id", "key"]):
            got = Anchored(lots, rolling)
            at = cells(got.anchor, bits)
            keep = np.flatnonzero(np.logical_and.reduce((table[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7)))) & 1))
            if not len(keep):
                continue
            start, length, own = got.start[keep], got.length[keep], got.document[keep]
            second = got.pairs(rolling)
            span = length + WINDOW - 1
            ends = np.cumsum(length)
            each = np.repeat(start - np.concatenate(([0], ends[:-1])), length) + np.arange(ends[-1])
            windows = mix(rolling.runs(second, each, WINDOW, 1)).astype("<u8").tobytes()
            column = lambda x: pa.array(x.view("i8"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][0] for i in own.tolist()], id_type),
                    pa.array([rows[i][1] for i in own.tolist()], pa.int64()),
                    pa.array((start - got.first_word[own]).astype("i4")),
                    pa.array(length.astype("i4")),
                    column(got.anchor[keep]),
                    column(mix(rolling.runs(got.prefix, start, span, 0) + span.astype("u8"))),
                    column(mix(rolling.runs(second, start, span, 1) ^ span.astype("u8"))),
                    pa.array([windows[8 * a : 8 * b] for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)], pa.binary()),
                ],
                ["doc_id", "key", "start", "n", "anchor", "run1", "run2", "windows"],
            )

    return arrow_map(docs, find, f"doc_id {kind}, key long, start int, n int, anchor long, run1 long, run2 long, windows binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans): words to remove as sorted, possibly overlapping [first, past) positions, packed as int32 pairs.

    docs: doc_id with null replaced, key, text.
    """
    spark = docs.sparkSession
    bits = sketch_bits(docs)
    many = spark.sparkContext.broadcast(sketch(docs, bits))
    runs = repeated_runs(docs, many, bits)
    equal = ["anchor", "run1", "run2"]
    firsts = runs.groupBy(equal).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("times"))
    kinds = firsts.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("times").alias("uses"))
    firsts = firsts.join(kinds.where("uses > 1"), "anchor").select(*equal, "first_doc", "kinds", "times").checkpoint()
    judged = spread_join(runs, firsts.drop("times"), equal, firsts.select(*equal, "times")).checkpoint()
    copies = judged.where("doc_id > first_doc").select("doc_id", "key", F.col("start").alias("first"), (F.col("start") + F.col("n") + F.lit(WINDOW - 1)).alias("past"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array(batch.column("n").to_numpy(), "i8")
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            column = {c: np.repeat(batch.column(c).to_numpy(), size) for c in ("key", "start", "anchor")}
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(size)), size)))
            windows = np.frombuffer(b"".join(batch.column("windows").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in (column["key"], (column["start"] + place).astype("i4"), column["anchor"], windows))], ["doc_id", "key", "start", "anchor", "window"])

    singles = arrow_map(judged.where("doc_id = first_doc and kinds > 1"), single, f"doc_id {id_kind(docs)}, key long, start int, anchor long, window long")
    least = singles.groupBy("anchor", "window").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("times")).where("first_doc < last_doc").select("anchor", "window", "first_doc", "times").checkpoint()
    later = spread_join(singles, least.drop("times"), ["anchor", "window"], least.drop("first_doc")).where("doc_id > first_doc").select("doc_id", "key", F.col("start").alias("first"), (F.col("start") + F.lit(WINDOW)).alias("past"))
    return islands(copies.unionByName(later)).groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "past")).alias("spans"))


def islands(spans: DataFrame) -> DataFrame:
    """The spans of each document, those that touch or overlap as one."""
    document = Window.partitionBy("doc_id", "key").orderBy("first", "past")
    before = F.max("past").over(document.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (before.isNull() | (F.col("first") > before)).cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(document.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "key", "island").agg(F.min("first").alias("first"), F.max("past").alias("past"))


def with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with the spans of their words that repeat an earlier document's, and that column's name."""
    prepare(docs.sparkSession)
    identity = free_name(docs, "sd_id"), free_name(docs, "sd_key")
    named = docs.withColumns({identity[0]: known_id(docs), identity[1]: F.xxhash64("text")})
    spans = repeated_spans(named.select(F.col(identity[0]).alias("doc_id"), F.col(identity[1]).alias("key"), "text").where("text is not null"))
    name = free_name(named, "sd_spans")
    spans = spans.select(F.col("doc_id").alias(identity[0]), F.col("key").alias(identity[1]), F.col("spans").alias(name))
    return named.join(spans, list(identity), "left").select(*docs.columns, name), name


def covered(spans: list[dict] | None, n: int) -> np.ndarray:
    """Which of n words lie in a span."""
    edge = np.zeros(n + 1, "i4")
    if spans:
        np.add.at(edge, [s["first"] for s in spans], 1)
        np.add.at(edge, [s["past"] for s in spans], -1)
    return np.cumsum(edge)[:n] > 0


def report(docs: DataFrame) -> DataFrame:
    """Per document: words, removed words, and the digest of those that stay, joined by one space."""
    found, name = with_spans(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest = [], [], []
            for text, spans in zip(byte_rows(batch.column("text")), batch.column(name).to_pylist(), strict=True):
                words = plain_words(text)
                out = covered(spans, len(words))
                n.append(len(words))
                gone.append(int(out.sum()))
                if gone[-1]:
                    words = [words[i] for i in np.flatnonzero(~out)]
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(found, run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without repeated words (white space before each goes too); those left without any word go whole."""
    found, name = with_spans(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column("text").cast(pa.binary()).to_pylist(), [True] * batch.num_rows
            for k, spans in enumerate(batch.column(name).to_pylist()):
                if spans:
                    ends = [0, *(m.end() for m in _WORD.finditer(texts[k]))]
                    stay = np.flatnonzero(~covered(spans, len(ends) - 1)).tolist()
                    keep[k] = bool(stay)
                    texts[k] = b"".join(texts[k][ends[i] : ends[i + 1]] for i in stay)
            yield replace_text(batch, texts, keep)

    return arrow_map(found, run, quoted(found)).select(*docs.columns)
