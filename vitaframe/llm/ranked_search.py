"""Ranked lexical search with Block-Max WAND.

1. Tasks turn their documents, in shards of at most SHARD_DOCS, into posting lists of the items' terms.
2. The number of documents, their total length and the terms' document counts come from these by sums.
3. Each shard's lists are cut into blocks of BLOCK postings, packed into as few bytes as their gaps and
   counts need; beside each block stand its first and last document and its largest impact. This index is a table.
4. Every shard is searched for every item. The pivot is the first document at which the lists' own maxima
   reach the score of the item's k-th best so far. Shallow moves find the blocks around the pivot without
   unpacking them; if their maxima stay below that score, all lists skip to where one of these blocks ends.
   Only otherwise are blocks unpacked and the pivot scored. The k-th score is kept from shard to shard of a task.
5. The tasks' best are ranked by item.

Impacts are integers, so that bounds hold exactly and ties are seen: a document goes unscored only if its
bound is below the k-th score.

Defined results: null and empty texts have no terms and are never found; an item without terms or without an
id has no rows; rows that repeat an item_id are one item with all their terms; rows that repeat a doc_id are
documents of their own; a null doc_id ranks behind all others of its score; ids that are not whole numbers are
ordered as strings; other columns are not read. Items are taken in blocks of ``block_words`` words, one index
each, so that what is broadcast is bounded.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.llm.common import alnum_words, arrow_map, byte_rows, id_kind, prepare

K = 10
BLOCK = 64
SHARD_DOCS = 16_384
#: Postings and documents' bytes that a task holds before it closes a shard.
SHARD_POSTINGS = 3_000_000
BLOCK_WORDS = 200_000
_END = 1 << 62
_WIDTHS = ("<u1", "<u2", "<u4")


def item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[str]]]]:
    """(item, its distinct terms), in blocks of bounded size; rows reach the driver a block at a time."""
    block, held = [], 0
    named = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null")
    for row in named.groupBy("i").agg(F.concat_ws("\n", F.collect_list("t")).cast("binary").alias("t")).toLocalIterator():
        terms = sorted({w.decode("utf-8", "replace") for w in alnum_words(bytes(row.t))})
        if block and held + len(terms) > block_words:
            yield block
            block, held = [], 0
        if terms:
            block.append((row.i, terms))
            held += len(terms)
    if block:
        yield block


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """One row a shard: its documents' ids and lengths, and for each term the documents' places in these and the term's counts.

    Documents stand by id, so that a smaller place is a smaller id.
    """
    spark, kind = docs.sparkSession, id_kind(docs)
    wanted = spark.sparkContext.broadcast({t.encode(): t for t in terms})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, lots = wanted.value, []

        def out() -> pa.RecordBatch:
            lots.sort(key=lambda x: (x[0] is None, x[0]))
            lists: dict[bytes, tuple[list[int], list[int]]] = {}
            for place, (_, _, found) in enumerate(lots):
                for term, n in found:
                    places, counts = lists.setdefault(term, ([], []))
                    places.append(place)
                    counts.append(n)
            row = {
                "ids": [x[0] for x in lots], "sizes": np.array([x[1] for x in lots], "<i8").tobytes(), "n_docs": len(lots), "n_terms": sum(x[1] for x in lots),
                "terms": [asked[t] for t in lists], "df": [len(p) for p, _ in lists.values()],
                "places": [np.array(p, "<u4").tobytes() for p, _ in lists.values()], "counts": [np.array(n, "<u4").tobytes() for _, n in lists.values()],
            }
            lots.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        held = 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), byte_rows(batch.column("text")), strict=True):
                words = alnum_words(text)
                if words:
                    found = [(t, n) for t, n in Counter(words).items() if t in asked]
                    lots.append((name, len(words), found))
                    held += len(found)
                    if len(lots) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                        yield out()
                        held = 0
        if lots:
            yield out()

    id_type = pa.int64() if kind == "long" else pa.string()
    schema = pa.schema([("ids", pa.list_(id_type)), ("sizes", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int64())), ("places", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))])
    ddl = f"ids array<{kind}>, sizes binary, n_docs long, n_terms long, terms array<string>, df array<long>, places array<binary>, counts array<binary>"
    return arrow_map(docs.select(F.col("doc_id").cast(kind), "text"), run, ddl)


def weights(lists: DataFrame) -> tuple[int, int, dict[str, int]]:
    """Documents, their terms, and the weight of every term asked for. The terms are those of a block of items."""
    total = lists.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n = total.n or 0
    each = lists.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df"))
    return n, total.l or 0, {r.terms: math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1))) for r in each.collect()}


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """A block: its number of postings, the widths of gaps and counts, then both."""
    parts = [np.diff(places, prepend=places[:1]), counts]
    widths = [next(k for k in range(len(_WIDTHS)) if int(x.max()) >> (8 << k) == 0) for x in parts]
    return bytes([len(places), *widths]) + b"".join(x.astype(_WIDTHS[w]).tobytes() for x, w in zip(parts, widths, strict=True))


def unpack(block: bytes, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of a packed block that begins at place `first`."""
    n, gap, count = block[:3]
    gaps = np.frombuffer(block, _WIDTHS[gap], n, 3)
    return first + np.cumsum(gaps, dtype="i8"), np.frombuffer(block, _WIDTHS[count], n, 3 + (n << gap)).astype("i8")


def impacts(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What one unit of weight is worth, by a term's count and the document's length measure."""
    return (1_000_000_000 * counts) // (1000 * counts + 8 * lengths)


def build_index(lists: DataFrame, n_docs: int, n_terms: int, block: int = BLOCK) -> DataFrame:
    """The shards with their lists in packed blocks: first and last places and largest impacts of each block beside them."""
    if not 0 < block < 256:
        raise ValueError("a block has 1 to 255 postings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = 10 + (90 * np.frombuffer(row["sizes"], "<i8") * n_docs) // n_terms
                made = {"terms": row["terms"], "first": [], "last": [], "most": [], "blocks": [], "ids": row["ids"], "lengths": lengths.astype("<i8").tobytes()}
                for places, counts in zip(row["places"], row["counts"], strict=True):
                    places, counts = np.frombuffer(places, "<u4").astype("i8"), np.frombuffer(counts, "<u4").astype("i8")
                    cuts = np.arange(0, len(places), block)
                    made["first"].append(places[cuts].tolist())
                    made["last"].append(places[np.minimum(cuts + block, len(places)) - 1].tolist())
                    made["most"].append(np.maximum.reduceat(impacts(counts, lengths[places]), cuts).tolist())
                    made["blocks"].append([pack(places[a : a + block], counts[a : a + block]) for a in cuts.tolist()])
                yield pa.RecordBatch.from_pylist([made], schema)

    id_type = lists.schema["ids"].dataType.simpleString()
    many = pa.list_(pa.list_(pa.int64()))
    schema = pa.schema([("terms", pa.list_(pa.string())), ("first", many), ("last", many), ("most", many), ("blocks", pa.list_(pa.list_(pa.binary()))), ("ids", pa.list_(pa.int64() if "bigint" in id_type else pa.string())), ("lengths", pa.binary())])
    return arrow_map(lists, run, f"terms array<string>, first array<array<long>>, last array<array<long>>, most array<array<long>>, blocks array<array<binary>>, ids {id_type}, lengths binary")


class Cursor:
    """A place in a posting list. `doc` is a lower bound of the next document, and that document itself once settled."""

    __slots__ = ("weight", "first", "last", "most", "blocks", "lengths", "bound", "at", "doc", "settled", "open", "docs", "worth", "n")

    def __init__(self, weight: int, first: list[int], last: list[int], most: list[int], blocks: list[bytes], lengths: np.ndarray) -> None:
        self.weight, self.first, self.last, self.most, self.blocks, self.lengths = weight, first, last, most, blocks, lengths
        self.bound, self.at, self.doc, self.settled, self.open = weight * max(most), 0, first[0], True, -1
        self.docs, self.worth, self.n = [], [], 0

    def skip(self, doc: int) -> None:
        """Shallow move to the block that may hold `doc` or what follows; nothing is unpacked."""
        at = self.at
        if self.last[at] < doc:
            at = self.at = bisect_left(self.last, doc, at + 1)
            if at == len(self.last):
                self.doc, self.settled = _END, True
                return
        if at == self.open:
            self.n = bisect_left(self.docs, doc, self.n)
            self.doc, self.settled = self.docs[self.n], True
        elif doc <= self.first[at]:
            self.doc, self.settled = self.first[at], True
        else:
            self.doc, self.settled = doc, False

    def settle(self) -> None:
        """Unpacks the block, if that hasn't happened, and moves to the first document not before `doc`."""
        if self.open != self.at:
            docs, counts = unpack(self.blocks[self.at], self.first[self.at])
            self.docs, self.worth, self.open = docs.tolist(), impacts(counts, self.lengths[docs]).tolist(), self.at
            self.n = 0
        self.n = bisect_left(self.docs, self.doc, self.n)
        self.doc, self.settled = self.docs[self.n], True

    def ceiling(self, doc: int) -> tuple[int, int]:
        """The most that `doc` can gain here by its block, and the last document for which that holds."""
        at = self.at
        if self.last[at] < doc:
            at = bisect_left(self.last, doc, at + 1)
            if at == len(self.last):
                return 0, _END
        return (0, self.first[at] - 1) if doc < self.first[at] else (self.weight * self.most[at], self.last[at])


class Best:
    """An item's k best documents so far; equal scores by id, null last."""

    def __init__(self, k: int) -> None:
        self.k, self.held, self.floor = k, [], 1

    def offer(self, score: int, name) -> None:
        insort(self.held, (-score, name is None, 0 if name is None else name))
        if len(self.held) >= self.k:
            del self.held[self.k :]
            self.floor = max(1, -self.held[-1][0])


def search(cursors: list[Cursor], best: Best, ids: list) -> None:
    """Block-Max WAND over one shard."""
    while cursors:
        cursors.sort(key=lambda c: c.doc)
        while cursors and cursors[-1].doc == _END:
            cursors.pop()
        bound = past = 0
        for c in cursors:
            bound += c.bound
            past += 1
            if bound >= best.floor:
                break
        else:
            return
        pivot = cursors[past - 1].doc
        while past < len(cursors) and cursors[past].doc == pivot:
            past += 1
        until = cursors[past].doc - 1 if past < len(cursors) else _END - 1
        bound, tops = 0, []
        for c in cursors[:past]:
            top, end = c.ceiling(pivot)
            bound += top
            tops.append(top)
            until = min(until, end)
        if bound < best.floor:
            for c in cursors[:past]:
                c.skip(max(until, pivot) + 1)
            continue
        score = 0
        for c, top in zip(cursors, tops, strict=False):
            if top:
                if c.doc < pivot:
                    c.skip(pivot)
                if not c.settled or c.open != c.at:
                    c.settle()
                gain = c.weight * c.worth[c.n] if c.doc == pivot else 0
                score += gain
                bound += gain - top
                if bound < best.floor:
                    break
        else:
            if score:
                best.offer(score, ids[pivot])
        for c in cursors[:past]:
            if c.doc <= pivot:
                c.skip(pivot + 1)


def search_index(index: DataFrame, items: list[tuple[str, list[str]]], weight: dict[str, int], k: int = K) -> DataFrame:
    """(item_id, doc_id, score): of each task's shards the k best documents of every item."""
    held = index.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = held.value
        best = [Best(k) for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<i8")
                lists = {t: x for t, *x in zip(row["terms"], row["first"], row["last"], row["most"], row["blocks"], strict=True)}
                for (_, terms), top in zip(items, best, strict=True):
                    search([Cursor(weight[t], *lists[t], lengths) for t in terms if t in lists and weight[t] > 0], top, row["ids"])
        rows = [(item, None if none else name, -score) for (item, _), top in zip(items, best, strict=True) for score, none, name in top.held]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), id_type, pa.int64()))], ["item_id", "doc_id", "score"])

    kind = index.schema["ids"].dataType.elementType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.string()
    return arrow_map(index, run, f"item_id string, doc_id {kind}, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0."""
    prepare(docs.sparkSession)
    found = None
    for block in item_blocks(items, block_words):
        lists = postings(docs, sorted({t for _, terms in block for t in terms})).checkpoint()
        n_docs, n_terms, weight = weights(lists)
        index = build_index(lists, n_docs, n_terms).checkpoint()
        part = search_index(index, block, weight, k)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"item_id string, doc_id {id_kind(docs)}, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item_id").cast(items.schema["item_id"].dataType), "rank", F.col("doc_id").cast(docs.schema["doc_id"].dataType), "score")
