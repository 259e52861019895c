"""Spelling variants: each word's nearest more frequent spelling, from wildcard groups instead of pairs.

Two words are near if one code point is replaced, inserted or deleted.

1. Tasks count the words of their documents; the counts meet by word. The words are sorted by falling
   count, then by code points, and numbered in that order, so that the smaller number is the better form.
2. Every word goes to one group for each position, keyed by (position, prefix, suffix). A group keeps its
   size and its two best words: that gives each member the number of its replacements there and the best
   of them, which is the first word, or the second for the first itself. Members of a group differ in one
   code point, so a group has no more members than there are letters.
3. Every word also sends its deletions to the words' own keys. A word that stands there is near to all who
   sent it: it learns their number and the best, each sender learns of that one word.
4. Sums and minima by word combine all of these; no pair of words is ever a row.
5. A form's count is at least twice its word's, so chains of forms are short; roots are found by pointer jumping.

Prefixes, suffixes and words travel as two 64-bit polynomial hashes, so that rows of very long words stay small.

Defined results: null and empty texts have no words; a null doc_id is the empty text in `<doc_id>:<run>`;
rows that repeat a doc_id or a text count each time; ids of any type count by their text form; other
columns of the documents are not read; tables without words give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.llm.common import LOWER, Rolling, arrow_map, byte_rows, mix, prepare

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One in so many runs of a document loses a code point.
DROP_ONE_IN = 97
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 5, 3, 2
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 400_000
#: Code points hashed at once.
CHUNK_POINTS = 400_000
_WILDCARD, _DELETION, _WORD = 0, 1, 2


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of part of the documents each; words come up again. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), byte_rows(batch.column("text")), strict=True):
                head = zlib.crc32(f"{name or ''}:".encode())
                for word, n in Counter(RUN.findall(text.translate(LOWER).decode("utf-8", "replace"))).items():
                    if len(word) >= least_length:
                        h = zlib.crc32(word.encode(), head)
                        if h % DROP_ONE_IN == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        if held:
            yield out()

    return arrow_map(docs.select(F.col("doc_id").cast("string"), "text"), run, "word string, n long")


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(rank, word, n): the words with their counts; ranks rise with falling count, then with code points, and leave gaps."""
    words = count_words(docs, least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    return words.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("rank"), "word", "n").checkpoint()


class _Keys:
    """Hashes of the prefixes, suffixes and deletions of a lot of words."""

    def __init__(self, words: list[str], rolling: Rolling) -> None:
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype("u8")
        self.size = np.array([len(w) for w in words], "i8")
        self.first = np.cumsum(self.size) - self.size
        self.own = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(points)) - self.first[self.own]
        self.rest = self.size[self.own] - self.place - 1
        letters = np.stack([mix(points * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)], axis=1)
        self.rolling, self.prefixes = rolling, [rolling.prefix(letters, k) for k in (0, 1)]
        again = np.concatenate(([False], points[1:] == points[:-1])) & (self.place > 0)
        self.distinct = ~again  # deleting any of a run of equal letters gives the same word

    def parts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of what stands before and behind each place."""
        at = np.arange(len(self.own))
        return self.rolling.runs(self.prefixes[k], self.first[self.own], self.place, k), self.rolling.runs(self.prefixes[k], at + 1, self.rest, k)

    def wildcards(self, k: int) -> np.ndarray:
        before, behind = self.parts(k)
        return mix(mix(before + self.place.astype("u8")) + behind * np.uint64(0x8EBC6AF09C88C6E3) + (self.rest.astype("u8") << np.uint64(32)) + np.uint64(_WILDCARD))

    def deletions(self, k: int) -> np.ndarray:
        before, behind = self.parts(k)
        return self._whole(before + behind * self.rolling.up[k][self.place], self.size[self.own] - 1)[self.distinct]

    def words(self, k: int) -> np.ndarray:
        return self._whole(self.rolling.runs(self.prefixes[k], self.first, self.size, k), self.size)

    @staticmethod
    def _whole(polynomial: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(polynomial + size.astype("u8") * np.uint64(0x589965CC75374CC3) + np.uint64(_WORD))


def keyed(words: DataFrame) -> DataFrame:
    """(k1, k2, kind, rank): a row for each position of a word, for each of its deletions and for the word itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()

        def out(lot: list[str], ranks: list[int]) -> pa.RecordBatch:
            keys, rank = _Keys(lot, rolling), np.array(ranks, "i8")
            k1, k2 = (np.concatenate([keys.wildcards(k), keys.deletions(k), keys.words(k)]).view("i8") for k in (0, 1))
            senders = keys.own[keys.distinct]
            kinds = np.repeat(np.array([_WILDCARD, _DELETION, _WORD], "i1"), [len(keys.own), len(senders), len(lot)])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, kinds, rank[np.concatenate([keys.own, senders, np.arange(len(lot))])])], ["k1", "k2", "kind", "rank"])

        lot, ranks, held = [], [], 0
        for batch in batches:
            for rank, word in zip(batch.column("rank").to_pylist(), batch.column("word").to_pylist(), strict=True):
                lot.append(word)
                ranks.append(rank)
                held += len(word)
                if held >= CHUNK_POINTS:
                    yield out(lot, ranks)
                    lot, ranks, held = [], [], 0
        if lot:
            yield out(lot, ranks)

    return arrow_map(words.select("rank", "word"), run, "k1 long, k2 long, kind byte, rank long")


def near_words(words: DataFrame) -> DataFrame:
    """(rank, n_near, best): of each word with near words their number and the best one's rank."""
    group = Window.partitionBy("k1", "k2").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_kind = lambda kind: F.col("kind") == kind
    grouped = keyed(words).select(
        "kind", "rank",
        F.count("*").over(group).alias("size"), F.first("rank").over(group).alias("first"), F.nth_value("rank", 2).over(group).alias("second"),
        F.count(F.when(is_kind(_DELETION), 1)).over(group).alias("senders"), F.min(F.when(is_kind(_DELETION), F.col("rank"))).over(group).alias("sender"),
        F.min(F.when(is_kind(_WORD), F.col("rank"))).over(group).alias("word"),
    )
    near = F.when(is_kind(_WILDCARD), F.col("size") - 1).when(is_kind(_DELETION), F.col("word").isNotNull().cast("long")).otherwise(F.col("senders"))
    best = F.when(is_kind(_WILDCARD), F.when(F.col("rank") == F.col("first"), F.col("second")).otherwise(F.col("first"))).when(is_kind(_DELETION), F.col("word")).otherwise(F.col("sender"))
    return grouped.select("rank", near.alias("near"), best.alias("best")).where("near > 0").groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(rank, root): the last word of each chain. forms: rank, form; a form's count is a multiple of its word's, so there are no rings."""
    found = forms.select("rank", F.col("form").alias("root")).checkpoint()
    while True:
        onward = found.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        further = found.join(onward, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).checkpoint()
        found = further.drop("moved")
        if not further.agg(F.max("moved")).first()[0]:
            return found


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, form_times: int = FORM_TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of least_length code points and least_count occurrences."""
    prepare(docs.sparkSession)
    words = vocabulary(docs, least_length, least_count)
    best = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    named = words.join(near_words(words), "rank", "left").join(best, "best", "left")
    enough = F.col("form_n") >= form_times * F.col("n")
    kept = lambda c: F.when(enough, F.col(c)).alias(c)
    named = named.select("rank", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best")).alias("best"), kept("form"), kept("form_n")).checkpoint()
    last = roots(named.where("best is not null").select("rank", F.col("best").alias("form")))
    last = last.join(words.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
    return named.join(last, "rank", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
