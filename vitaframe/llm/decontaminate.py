"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items form one automaton. A document's words are streamed through it; the
length of the longest suffix read so far that occurs in some item is tracked, and wherever it reaches
a window's length those words are hit.

Defined results: a null or empty text has no words and no hits; an item without words, or without an
id, takes no part; repeated items count once by id; repeated document rows are each judged; extra
columns pass through. A benchmark of more than ``block_words`` words is taken in blocks of that size,
one pass over the documents each, so that what is broadcast is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaframe.llm.common import ALNUM, alnum_words, arrow_map, byte_rows, free_name, prepare, quoted, replace_text

WINDOW = 10
BLOCK_WORDS = 200_000
_WORD = re.compile(rb"[^ ]+")
_SPANS = "array<struct<first:int,past:int>>"


class ItemAutomaton:
    """All sub-sequences of the items' words; states know which items hold their window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        self.shortest = min([window, *(len(c) for _, c in coded)])
        ends = []
        for _, codes in coded:
            state = 0
            for code in codes:
                state = self._extend(state, code)
            ends.append(state)
        #: Items of a full window, by the state of exactly that window; short items, by the state of the whole item.
        self.holders: dict[int, set[str]] = {}
        self.whole: dict[int, set[str]] = {}
        for (item, codes), end in zip(coded, ends, strict=True):
            if len(codes) < window:
                self.whole.setdefault(end, set()).add(item)  # a whole item is the longest of its state
                continue
            for at, state, _ in self.walk(codes):
                if at >= window - 1:
                    self.holders.setdefault(self.exact(state), set()).add(item)

    def _extend(self, last: int, code: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        there = nexts[last].get(code)
        if there is not None and length[there] == length[last] + 1:
            return there
        if there is None:
            new = self._state(length[last] + 1, {})
            p = last
            while p >= 0 and code not in nexts[p]:
                nexts[p][code] = new
                p = link[p]
            if p < 0:
                link[new] = 0
                return new
            there = nexts[p][code]
            if length[there] == length[p] + 1:
                link[new] = there
                return new
            link[new] = self._clone(p, there, code)
            return new
        return self._clone(last, there, code)

    def _state(self, length: int, nexts: dict[int, int]) -> int:
        self.next.append(nexts)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, old: int, code: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[old]))
        self.link[copy] = self.link[old]
        self.link[old] = copy
        while p >= 0 and self.next[p].get(code) == old:
            self.next[p][code] = copy
            p = self.link[p]
        return copy

    def exact(self, state: int) -> int:
        """The state that stands for just the last window of what the state stands for."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def walk(self, codes) -> Iterator[tuple[int, int, int]]:
        """(position, state, length of the longest match that ends there)."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        for at, code in enumerate(codes):
            while state and code not in nexts[state]:
                state = link[state]
                matched = length[state]
            there = nexts[state].get(code)
            if there is None:
                state = matched = 0
            else:
                state = there
                matched += 1
            yield at, state, matched

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs of hit words, and the items with a window in them."""
        if len(words) < self.shortest or not self.vocabulary:
            return [], set()
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), "i8", len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view("i1"), [0]))))
        hit, items = [], set()
        for start, past in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # runs of words that items have
            if past - start < self.shortest:
                continue
            for at, state, matched in self.walk(codes[start:past].tolist()):
                if matched >= self.window:
                    hit.append((start + at - self.window + 1, start + at + 1))
                    items |= self.holders[self.exact(state)]
                if self.whole and matched:
                    s = state if matched >= self.length[state] else self.link[state]
                    while s > 0:
                        if s in self.whole:
                            hit.append((start + at - self.length[s] + 1, start + at + 1))
                            items |= self.whole[s]
                        s = self.link[s]
        return merged(hit), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, past in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(past, out[-1][1]))
        else:
            out.append((first, past))
    return out


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words, in blocks of bounded size; rows reach the driver a block at a time."""
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).where("i is not null and t is not null").toLocalIterator():
        words = alnum_words(bytes(row.t))
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        if words:
            block.append((row.i, words))
            held += len(words)
    yield block


def match_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, dict[str, str]]:
    """The documents with three more columns, and their names under n_words, spans and items.

    spans: maximal runs of hit words, as positions in the document's words; items: ids, each once.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = {k: free_name(docs, f"dc_{k}") for k in ("n_words", "spans", "items")}
    out = docs.select("*", F.lit(0).cast("long").alias(names["n_words"]), F.array().cast(_SPANS).alias(names["spans"]), F.array().cast("array<string>").alias(names["items"]))
    schema, first = quoted(out), True
    for block in item_blocks(benchmark, block_words):
        if not first:
            out = out.checkpoint()  # one automaton in a worker's memory at a time
        first = False
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automaton = ItemAutomaton(held.value, window)
            for batch in batches:
                counts, spans, items = [], [], []
                old = zip(batch.column(names["spans"]).to_pylist(), batch.column(names["items"]).to_pylist(), strict=True)
                for text, (had_spans, had_items) in zip(byte_rows(batch.column("text")), old, strict=True):
                    words = alnum_words(text)
                    found, found_items = automaton.hits(words)
                    counts.append(len(words))
                    spans.append([{"first": a, "past": b} for a, b in merged(found + [(s["first"], s["past"]) for s in had_spans])])
                    items.append(sorted(found_items | set(had_items)))
                new = dict(zip(names.values(), (counts, spans, items), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else c for f, c in zip(batch.schema, batch.columns, strict=True)], schema=batch.schema)

        out = arrow_map(out, run, schema)
    return out, names


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items with an occurring window, and whether it is contaminated."""
    found, n = match_items(docs.select("doc_id", "text"), benchmark, window)
    hit = F.aggregate(n["spans"], F.lit(0).cast("long"), lambda a, s: a + s["past"] - s["first"])
    return found.select(
        "doc_id", F.col(n["n_words"]).alias("n_words"), hit.alias("n_hit"), F.size(n["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(n["items"]), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """The documents without hit spans; one of which more than max_coverage of the words is hit goes whole."""
    found, n = match_items(docs, benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column("text").cast(pa.binary()).to_pylist(), []
            for k, (spans, words) in enumerate(zip(batch.column(n["spans"]).to_pylist(), batch.column(n["n_words"]).to_pylist(), strict=True)):
                hit = sum(s["past"] - s["first"] for s in spans)
                keep.append(hit <= max_coverage * words)
                if spans and keep[-1]:
                    at, text = [m.span() for m in _WORD.finditer(texts[k].translate(ALNUM))], texts[k]
                    cuts = [0, *(x for s in spans for x in (at[s["first"]][0], at[s["past"] - 1][1])), len(text)]
                    texts[k] = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
            yield replace_text(batch, texts, keep)

    return arrow_map(found, run, quoted(found)).select(*docs.columns)
