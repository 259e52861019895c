"""Best-two-fit packing of tokenised documents into sequences.

Documents become token ids and an end id; those longer than a sequence are cut from their end into full
pieces, so that only the first piece may be shorter. How many pieces there are of each length (at most
``SEQUENCE`` numbers) is all that the packing needs: best-two-fit runs on those counts on the driver and
yields bin patterns with multiplicities. Each piece has a rank within its length, and the rank decides
the bin and the place there, so no group of pieces ever meets in one task.

Defined results: a null or empty text is one piece of one id (the end); repeated rows are packed each;
extra columns take no part in the report.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.llm.common import arrow_map, arrow_type, free_name, prepare

SEQUENCE = 2048
END_ID = 0
#: Characters for which the two libraries split words alike; texts with others go to `tokenizers`.
_RARE = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
#: Fixed value: how byte-level vocabularies with their default pattern split words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts go to `tokenizers` too, whose splitting has no recursion limit.
_LONG = 1_000_000


class ByteEncoder:
    """Token ids of a byte-level vocabulary file for `tokenizers`.

    `tiktoken` computes the same ids from the same vocabulary five times as fast; it does so for the
    texts in which both split words alike, and `tokenizers` does the rest, such as texts that hold an added token.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.added = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)")
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.fast = None
        if plain_split(spec):
            self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or len(text) > _LONG or not text.isascii() and _RARE.search(text) or self.added.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def plain_split(spec: dict) -> bool:
    """Whether a vocabulary file splits words by SPLIT and nothing else: other files go to `tokenizers` with every text."""
    split = spec.get("pre_tokenizer") or {}
    own = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    return bool(own) and not spec.get("normalizer") and spec["model"].get("type", "BPE") == "BPE" and not spec["model"].get("ignore_merges")


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def tokenize(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank[, ids]): pieces, each with its rank among those of its length in the task.

    ids: two bytes an id where the vocabulary allows it, else four.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = ByteEncoder(path or public_tokenizers.path("byte_bpe_50k.json"))
        width = "<u2" if encode.slow.get_vocab_size() <= 1 << 16 else "<u4"
        part, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                count = -(-len(ids) // size)
                edges = [0, *range(len(ids) - size * (count - 1), len(ids) + 1, size)]
                for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    rows.append((doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, seen[b - a], *([ids[a:b].astype(width).tobytes()] if with_ids else [])))
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *(["ids"] if with_ids else [])]
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = [arrow_type(kind), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if with_ids else [])]
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long{', ids binary' if with_ids else ''}")


def best_two_fit(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[dict[int, int], int]]:
    """Bin patterns ({length: how many}) with how often each is used. counts: pieces by length, 1 to size.

    A bin is filled greedily with the largest piece that fits. Then its smallest piece gives way to two
    unpacked ones, if two fit the gap so widened more tightly. The pattern is used again for as long as
    its pieces last, which is what packing bin by bin would do.
    """
    left = np.zeros(size + 1, "i8")
    for length, n in counts.items():
        left[length] = n
    out = []
    while left.any():
        below = np.maximum.accumulate(np.where(left > 0, np.arange(size + 1), 0))  # largest unpacked length up to each
        bin_: dict[int, int] = {}
        gap = size
        while (take := int(below[gap])) > 0:
            fits = min(gap // take, int(left[take]))
            bin_[take] = fits
            left[take] -= fits
            gap -= take * fits
            if not left[take]:
                below = np.maximum.accumulate(np.where(left > 0, np.arange(size + 1), 0))
        if gap:
            small = min(bin_)
            wide = gap + small
            have = np.flatnonzero(left[:wide])
            if len(have):
                top = np.maximum.accumulate(np.where(left > 0, np.arange(size + 1), 0))
                other = top[wide - have]
                double = (other == have) & (left[have] < 2)  # the same piece can't be taken twice
                other = np.where(double, top[np.maximum(have - 1, 0)], other)
                total = np.where(other > 0, have + other, 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    bin_[small] -= 1
                    left[small] += 1
                    if not bin_[small]:
                        del bin_[small]
                    for take in (int(have[best]), int(other[best])):
                        bin_[take] = bin_.get(take, 0) + 1
                        left[take] -= 1
        again = min(int(left[k]) // n for k, n in bin_.items())
        for k, n in bin_.items():
            left[k] -= n * again
        out.append((dict(sorted(bin_.items(), reverse=True)), 1 + again))
    return out


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces of this length in a bin, offset of the first of them)."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for bin_, times in patterns:
        offset = 0
        for length, n in bin_.items():
            out.setdefault(length, []).append((used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        sequence += times
    return {k: np.array(v, "i8") for k, v in out.items()}


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; with_ids also gives each piece's token ids."""
    pieces = tokenize(docs, path, size, with_ids).checkpoint()  # ranks within a task hold from here on
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n")).checkpoint()
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}  # at most `size` rows
    table = docs.sparkSession.sparkContext.broadcast(places(best_two_fit(total, size)))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("part", "length", F.coalesce("before", F.lit(0)).alias("before")), ["part", "length"])
    names = ["sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(rank), "i8"), np.zeros(len(rank), "i8")
            for n in np.unique(length).tolist():
                at, rows = np.flatnonzero(length == n), table.value[n]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + nth // row[:, 2]
                offset[at] = row[:, 3] + nth % row[:, 2] * n
            kept = [batch.column(c) for c in columns[:5]]
            if with_ids:
                flat = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4") for x, n in zip(batch.column("ids").to_pylist(), length.tolist(), strict=True)]
                kept.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype("i4")), pa.array(np.concatenate(flat).astype("i4"))))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*columns, *names])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(ranked, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{', ids array<int>' if with_ids else ''}, sequence_id long, offset long")
