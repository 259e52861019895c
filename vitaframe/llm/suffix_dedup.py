"""Removing bytes of strings that occur earlier, by suffix arrays built in groups of Lyndon prefixes.

A window is WINDOW consecutive bytes of one text. The smallest hash among the GRAM-byte grams of a window,
the leftmost on ties, is its anchor; neighbouring windows with one anchor at one place form a run. Equal
windows have equal anchors at equal places, so windows need to be compared under one anchor only, and no
two windows of a run are equal.

1. Anchors are counted by cell (their upper bits): tasks pack the cells that they meet once or more often, the
   packs are merged in a tree, and one bit a cell, "two or more", is broadcast. The cells follow the text's bytes
   up to 2^MAX_CELL_BITS; beyond that more runs pass, none is lost.
2. Runs that pass are pre-aggregated: equal ones meet in one row with the smallest doc_id and the number of
   different runs under the anchor. A run of a larger doc_id goes whole; one that stands earlier in its own
   text is found while that text is read.
3. Different runs under one anchor, each in its first document, go through suffix arrays. A run is read as letters
   of UNIT bytes, counted from the anchor, where all equal windows line up. Whole anchors are gathered into lots, the
   suffixes of a lot are sorted by the grouping construction, and neighbours in that order that share the letters of a
   window form a class. Windows of a class with the same bytes before and behind these letters are equal; of
   them the earliest stays.
4. An anchor with more than LIMIT different runs (a frequent phrase) is cut by where it stands in the window,
   into parts that share more bytes, keyed by those bytes; steps 2 and 3 are repeated for these. The last cut
   leaves single windows, of which equal ones alone share a key.

``grouped_suffixes`` is the construction: it takes the groups of equal Lyndon prefixes in descending order,
links each suffix to the previous smaller one and extends the prefix of that one; the order within groups
then follows from one pass over these links. Both passes are linear and nothing is renamed or recursed.

Defined results: null text is empty; texts shorter than a window lose nothing; rows that share a doc_id but
not the text do not remove each other's bytes, and equal rows don't either; a null doc_id counts as larger
than any other; ids that are not whole numbers are ordered as strings; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.llm.common import Rolling, arrow_map, byte_rows, free_name, id_kind, known_id, merged_in_tree, mix, prepare, quoted, replace_text, spread_join
from vitaframe.llm.decontaminate import merged
from vitaframe.llm.hpylm import _REMOVE_SHUFFLES, discard, setting

WINDOW = 100
GRAM = 32
MAX_CELL_BITS = 28
#: Cells whose bits travel in one row.
CELL_BLOCK_BITS = 16
#: Bytes hashed at once; longer texts are read in pieces that overlap by a window less one byte.
CHUNK = 1 << 18
#: Different runs under one key that a suffix array takes; with more the key is cut further.
LIMIT = 4000
#: Bytes that a lot of whole keys has at least, if there are as many.
LOT = 1 << 18
#: Bytes in a letter of a suffix array, and whole letters that every window has.
UNIT = 8
LETTERS = (WINDOW - UNIT) // UNIT
#: Offsets of an anchor in its window, and how many of them share a key after each cut.
OFFSETS = WINDOW - GRAM + 1
CUTS = (17, 4, 1)
_REST = WINDOW - UNIT * LETTERS
_BYTE_HASHES = mix(np.arange(1, 257, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


Piece = tuple[tuple, int, int, bytes]


def pieces(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[Piece]]:
    """Lots of (values of the columns, number of the text, first byte, bytes) with about CHUNK bytes, of texts with a window."""
    lot, held, number = [], 0, 0
    for batch in batches:
        for values, text in zip(zip(*(batch.column(c).to_pylist() for c in columns), strict=True), byte_rows(batch.column("text")), strict=True):
            number += 1
            for at in range(0, max(len(text) - WINDOW + 1, 0), CHUNK):
                lot.append((values, number, at, text[at : at + CHUNK + WINDOW - 1]))
                held += len(lot[-1][3])
                if held >= CHUNK:
                    yield lot
                    lot, held = [], 0
    if lot:
        yield lot


class Runs:
    """The runs of a lot: piece, first window (from the piece's start), number of windows and anchor."""

    def __init__(self, lot: list[Piece]) -> None:
        sizes = np.array([len(p[3]) for p in lot], "i8")
        begins = np.cumsum(sizes) - sizes
        text = b"".join(p[3] for p in lot)
        words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
        self.text = np.frombuffer(text, "u1")
        n = len(text) - GRAM + 1
        self.hashes = mix(sum(words[8 * k : 8 * k + n] * _FACTORS[k] for k in range(GRAM // 8)))
        low, reach = self.hashes, 1
        while 2 * reach <= OFFSETS:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[: len(low) - (OFFSETS - reach)], low[OFFSETS - reach :])
        own = np.repeat(np.arange(len(lot)), sizes - WINDOW + 1)
        start = np.arange(len(own)) + own * (WINDOW - 1)  # windows never cross pieces
        anchor = low[start]
        leaves = self.hashes[start[:-1]] == anchor[:-1]
        at = np.flatnonzero(np.concatenate(([True], leaves | (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]))))
        self.place, self.n = start[at], np.diff(np.append(at, len(own)))
        self.anchor, self.piece = anchor[at], own[at]
        self.start = self.place - begins[self.piece]

    def contents(self, which: np.ndarray, rolling: Rolling) -> np.ndarray:
        """A hash of the bytes of each of these runs."""
        prefix = rolling.prefix(_BYTE_HASHES[self.text][:, None], 0)
        size = self.n[which] + (WINDOW - 1)
        return mix(rolling.runs(prefix, self.place[which], size, 0) + size.astype("u8"))

    def leads(self, which: np.ndarray) -> np.ndarray:
        """Bytes from the first byte of each of these runs to its anchor."""
        out, step = np.empty(len(which), "i8"), 4096
        for a in range(0, len(which), step):
            k = which[a : a + step]
            last = self.place[k] + self.n[k] - 1  # the anchor is the leftmost of the last window's smallest
            out[a : a + step] = self.n[k] - 1 + np.argmax(self.hashes[last[:, None] + np.arange(OFFSETS)] == self.anchor[k][:, None], axis=1)
        return out

    def bodies(self, which: np.ndarray) -> pa.Array:
        """The bytes of each of these runs."""
        size = self.n[which] + (WINDOW - 1)
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.place[which] - (ends - size), size)
        return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(np.concatenate(([0], ends)).astype("<i4")), pa.py_buffer(self.text[at].tobytes())])


def cell_bits(docs: DataFrame) -> int:
    """log2 of the cells: about eight for each anchor that so much text has."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return min(MAX_CELL_BITS, max(CELL_BLOCK_BITS, int(8 * size / (OFFSETS / 2)).bit_length()))


def _packed(cells: np.ndarray, many: np.ndarray) -> bytes:
    """Sorted cells of a block and which of them are met more than once."""
    return zlib.compress(np.diff(cells, prepend=0).astype("<u2").tobytes(), 1) + b"".join((np.packbits(many).tobytes(), len(cells).to_bytes(4, "little")))


def _unpacked(pack: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(pack[-4:], "little")
    bits = -(-n // 8)
    cells = np.cumsum(np.frombuffer(zlib.decompress(pack[: len(pack) - 4 - bits]), "<u2"), dtype="i8")
    return cells, np.unpackbits(np.frombuffer(pack, "u1", bits, len(pack) - 4 - bits), count=n).astype(bool)


_PACKS = "block int, part int, pack binary"


def cell_packs(cells: np.ndarray, counts: np.ndarray, part: int) -> pa.RecordBatch:
    """Packs of sorted cells, one for each block."""
    blocks = cells >> CELL_BLOCK_BITS
    at = np.flatnonzero(np.diff(blocks, prepend=-1))
    ends = np.append(at[1:], len(cells))
    low = cells & ((1 << CELL_BLOCK_BITS) - 1)
    packs = [_packed(low[a:b], counts[a:b] > 1) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(blocks[at].astype("i4")), pa.array(np.full(len(at), part, "i4")), pa.array(packs, pa.binary())], ["block", "part", "pack"])


def bit_table(packs: DataFrame, parts: int, bits: int) -> np.ndarray:
    """The cells that all packs together meet more than once as bits, 2^bits of them. packs: block, part, pack; parts: numbers of parts."""

    def merge(key, table):
        total = np.zeros(1 << CELL_BLOCK_BITS, "u1")
        for pack in table.column("pack").to_pylist():
            cells, many = _unpacked(pack)
            total[cells] = np.minimum(total[cells] + 1 + many, 2)
        cells = np.flatnonzero(total)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([_packed(cells, total[cells] > 1)], pa.binary())], ["block", "part", "pack"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pack in batch.column("pack").to_pylist():
                cells, many = _unpacked(pack)
                marks = np.zeros(1 << CELL_BLOCK_BITS, "u1")
                marks[cells[many]] = 1
                out.append(zlib.compress(np.packbits(marks).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], ["block", "marks"])

    packs = merged_in_tree(packs, ["block"], parts, merge, _PACKS)
    out = np.zeros((1 << (bits - CELL_BLOCK_BITS), (1 << CELL_BLOCK_BITS) // 8), "u1")
    for row in arrow_map(packs.select("block", "pack"), marked, "block int, marks binary").collect():  # 2^bits bits
        out[row.block] = np.frombuffer(zlib.decompress(bytes(row.marks)), "u1")
    return out.ravel()


def cell_table(frame: DataFrame, cells_of, bits: int, at_least: int = 2) -> np.ndarray:
    """One bit for each cell that cells_of finds in the frame's batches at_least (1 or 2) times."""
    spread = frame.rdd.getNumPartitions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId() % spread, [], 0

        def out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return cell_packs(found.astype("i8"), n + 2 - at_least, part)

        for cells in cells_of(batches):
            held.append(cells)
            size += len(cells)
            if size > 4_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return bit_table(arrow_map(frame, run, _PACKS), max(2, spread), bits)


def is_marked(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (table[cells >> np.uint64(3)] >> (np.uint64(7) - (cells & np.uint64(7))).astype("u1")) & 1 > 0


def repeated_cells(docs: DataFrame, bits: int) -> np.ndarray:
    """One bit a cell: two or more runs have their anchor there."""

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for lot in pieces(batches, ["doc_id"]):
            yield Runs(lot).anchor >> np.uint64(64 - bits)

    return cell_table(docs.select("doc_id", "text"), cells_of, bits)


def place_cells(names: list, anchors: np.ndarray, runs: np.ndarray, bits: int) -> np.ndarray:
    """Cells of runs in a document."""
    if names and isinstance(names[0], str):
        own = np.array([xxhash.xxh3_64_intdigest(x) for x in names], "u8")
    else:
        own = np.array(names, "i8").view("u8")
    return mix(mix(own) + anchors + runs * np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(64 - bits)


def passing_runs(docs: DataFrame, marked: Broadcast, bits: int, open_: Broadcast | None = None) -> DataFrame:
    """Runs whose cell is marked. own: it stands earlier in its text; neighbouring runs of that kind are one row, named by the first.

    open_: of the others those alone whose document is marked there for them, with their bytes and the distance from the first one to the anchor.
    """
    kind = id_kind(docs)
    id_type = pa.int64() if kind == "long" else pa.string()
    names_ = ["doc_id", "key", "start", "n", "anchor", "run", *(["lead", "text"] if open_ else ["own"])]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rolling, reading, seen = marked.value, Rolling(), 0, set()
        for lot in pieces(batches, ["doc_id", "key"]):
            got = Runs(lot)
            keep = np.flatnonzero(is_marked(table, got.anchor >> np.uint64(64 - bits)))
            if not len(keep):
                continue
            anchor, run = got.anchor[keep], got.contents(keep, rolling)
            numbers = np.array([p[1] for p in lot], "i8")[got.piece[keep]]
            both = mix(anchor + run * np.uint64(0xA0761D6478BD642F))
            order = np.lexsort((np.arange(len(keep)), both, numbers))
            again = np.zeros(len(keep), bool)
            again[order[1:]] = (both[order[1:]] == both[order[:-1]]) & (numbers[order[1:]] == numbers[order[:-1]])
            # a text that goes on from one lot to the next, or may do so
            if reading == numbers[0]:
                first = np.flatnonzero(numbers == reading)
                again[first] |= np.array([x in seen for x in both[first].tolist()], bool)
            if reading != numbers[-1]:
                seen = set()
            reading = int(numbers[-1])
            if lot[-1][2] or len(lot[-1][3]) >= CHUNK:
                seen.update(both[numbers == reading].tolist())
            start = got.start[keep] + np.array([p[2] for p in lot], "i8")[got.piece[keep]]
            n, piece = got.n[keep], got.piece[keep]
            if open_:
                rows = np.flatnonzero(~again)
                rows = rows[is_marked(open_.value, place_cells([lot[p][0][0] for p in piece[rows].tolist()], anchor[rows], run[rows], bits))]
            else:
                goes_on = np.zeros(len(keep), bool)
                goes_on[1:] = again[1:] & again[:-1] & (numbers[1:] == numbers[:-1]) & (start[1:] == start[:-1] + n[:-1])
                rows = np.flatnonzero(~goes_on)
                n = np.add.reduceat(n, rows)
            if not len(rows):
                continue
            owners = pa.array([p[0][0] for p in lot], id_type).take(pa.array(piece[rows])), pa.array([p[0][1] for p in lot], pa.int64()).take(pa.array(piece[rows]))
            columns = [*owners, pa.array(start[rows]), pa.array(n[rows] if open_ else n), pa.array(anchor[rows].view("i8")), pa.array(run[rows].view("i8"))]
            columns += [pa.array(got.leads(keep[rows])), got.bodies(keep[rows])] if open_ else [pa.array(again[rows])]
            yield pa.RecordBatch.from_arrays(columns, names_)

    return arrow_map(docs, find, f"doc_id {kind}, key long, start long, n long, anchor long, run long, " + ("lead long, text binary" if open_ else "own boolean"))


def grouped_suffixes(text: list[int]) -> list[int]:
    """The suffix array of a text of small numbers that ends in its only 0."""
    n, top = len(text), max(text) + 1
    members: list[list[int]] = [[] for _ in range(top)]
    for i, x in enumerate(text):
        members[x].append(i)
    group = [*text, -1]  # of each suffix; -1 stands before the first and behind the last
    lower, higher = [*range(-1, top - 1)], [*range(1, top + 1)]  # neighbours of each group in the order of their prefixes
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # neighbours of each suffix among those not taken in by a smaller one
    smaller = [-1] * n  # the previous smaller suffix of each
    begin, end, now = [0] * top, n, top - 1
    while now >= 0:
        own = [s for s in members[now] if group[s] == now]
        members[now] = []
        end -= len(own)
        begin[now] = end
        longer: dict[tuple[int, int], list[int]] = {}
        for s in own:
            p = before[s]
            if group[p] == now:
                continue  # the first of its row takes it along
            k, t = 0, s
            while group[t] == now:
                smaller[t] = p
                t = after[t]
                k += 1
            if t < n:
                before[t] = p
            if p >= 0:  # the prefix of p is followed by k times this one
                after[p] = t
                longer.setdefault((group[p], k), []).append(p)
        for low, k in sorted(longer, reverse=True) if len(longer) > 1 else longer:
            new = len(members)
            members.append(longer[low, k])
            for p in longer[low, k]:
                group[p] = new
            up = higher[low]  # directly above its old group, fewer repeats below more
            lower.append(low)
            higher.append(up)
            higher[low] = lower[up] = new
            begin.append(0)
        now = lower[now]
    order = [n - 1] * n
    placed = [False] * n
    placed[n - 1] = True
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[begin[g]] = s
            begin[g] += 1
            placed[s] = True
            s = smaller[s]
    return order


def letter_classes(sizes: np.ndarray, begins: np.ndarray, phases: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of each text, in order: the class of suffixes that share its next LETTERS letters, or -1 if no other does; and each text's first letter."""
    count = (sizes - phases) // UNIT
    firsts = np.cumsum(count) - count
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(row)) - firsts[row]
    words = np.ndarray((len(joined) - UNIT + 1,), f">u{UNIT}", joined, strides=(1,))
    letters = np.unique(words[begins[row] + phases[row] + UNIT * nth], return_inverse=True)[1]
    at = np.arange(len(row)) + row  # a text ends with a letter below all others
    text = np.ones(len(row) + len(sizes) + 1, "i8")
    text[at] = letters + 2
    text[-1] = 0
    letter_of = np.full(len(text), -1, "i8")
    whole = nth + LETTERS <= count[row]
    letter_of[at[whole]] = np.flatnonzero(whole)
    order = np.array(grouped_suffixes(text.tolist()), "i8")
    order = order[letter_of[order] >= 0]
    view = np.lib.stride_tricks.sliding_window_view(text, LETTERS)
    equal = np.append(False, (view[order[1:]] == view[order[:-1]]).all(1))[: len(order)]
    together = equal | np.append(equal[1:], False)[: len(order)]
    out = np.full(len(row), -1, "i8")
    out[letter_of[order[together]]] = np.cumsum(~equal)[together]
    return out, firsts


def removed_windows(texts: list[bytes], leads: np.ndarray, documents: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first, past) windows of the rows' texts that another row has earlier.

    leads: bytes before each text's anchor; documents: numbers in the order of the ids.
    """
    sizes = np.array([len(t) for t in texts], "i8")
    begins = np.cumsum(sizes) - sizes
    joined = np.frombuffer(b"".join(texts) + bytes(UNIT), "u1")
    phases = leads % UNIT
    classes, firsts = letter_classes(sizes, begins, phases, joined)
    n = sizes - WINDOW + 1
    rows = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    letter = np.maximum(-(-(at - phases[rows]) // UNIT), 0)
    before = phases[rows] + UNIT * letter - at  # bytes of the window before its first whole letter
    own = classes[firsts[rows] + letter]
    some = np.flatnonzero(own >= 0)
    rows, at, before, own = rows[some], at[some], before[some], own[some]
    around = np.arange(_REST) + UNIT * LETTERS * (np.arange(_REST) >= before[:, None])
    edge = np.zeros((len(rows), 16), "u1")
    edge[:, :_REST] = joined[(begins[rows] + at)[:, None] + around]
    edge = edge.view("<u8")
    places = starts[rows] + at
    by = np.lexsort((places, keys[rows], documents[rows], edge[:, 0], edge[:, 1], before, own))
    rows, at, places = rows[by], at[by], places[by]
    document, key = documents[rows], keys[rows]
    same = np.column_stack((own[by], before[by], edge[by].view("<i8")))
    new_class = np.append(True, (same[1:] != same[:-1]).any(1))[: len(rows)]
    least = np.flatnonzero(new_class)[np.cumsum(new_class) - 1]
    new_text = new_class | np.append(True, (document[1:] != document[:-1]) | (key[1:] != key[:-1]))[: len(rows)]
    earliest = np.flatnonzero(new_text)[np.cumsum(new_text) - 1]
    gone = (document > document[least]) | (places > places[earliest])
    rows, at = rows[gone], at[gone]
    by = np.lexsort((at, rows))
    rows, at = rows[by], at[by]
    cut = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1))[: len(rows)])
    ends = np.append(cut[1:], len(rows)) - 1
    return list(zip(rows[cut].tolist(), at[cut].tolist(), (at[ends] + WINDOW).tolist(), strict=True)) if len(rows) else []


def sorted_lots(rows: DataFrame) -> DataFrame:
    """(doc_id, key, first, past): bytes to remove, from suffix arrays over lots of whole groups. rows: h1, h2, doc_id, key, start, lead, text."""
    kind = id_kind(rows)
    id_type = pa.int64() if kind == "long" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(lot: list[tuple]) -> pa.RecordBatch:
            _, names, keys, starts, leads, texts = zip(*lot, strict=True)
            number = {x: k for k, x in enumerate(sorted(set(names)))}
            found = removed_windows(list(texts), np.array(leads, "i8"), np.array([number[x] for x in names], "i8"), np.array(keys, "i8"), np.array(starts, "i8"))
            made = [(names[r], keys[r], starts[r] + a, starts[r] + b) for r, a, b in found]
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((id_type, pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "key", "first", "past"])

        lot, held = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("h1", "h2", "doc_id", "key", "start", "lead", "text")]
            for h1, h2, *rest in zip(*columns, strict=True):
                if held >= LOT and lot[-1][0] != (h1, h2):
                    yield out(lot)
                    lot, held = [], 0
                lot.append(((h1, h2), *rest))
                held += len(rest[-1])
        if lot:
            yield out(lot)

    grouped = rows.select("h1", "h2", "doc_id", "key", "start", "lead", "text").repartition("h1", "h2").sortWithinPartitions("h1", "h2")
    return arrow_map(grouped, run, f"doc_id {kind}, key long, first long, past long")


def narrower(rows: DataFrame, width: int) -> DataFrame:
    """Parts of the rows by where the anchor stands in the window, `width` offsets each, keyed by the bytes that all windows of a part share."""
    kind = id_kind(rows)
    id_type = pa.int64() if kind == "long" else pa.string()
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("run", pa.int64()), ("doc_id", id_type), ("key", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("lead", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, key, start, n, lead, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "start", "n", "lead", "text")), strict=True):
                for part in range((lead - n + 1) // width, lead // width + 1):
                    low, high = max(part * width, lead - n + 1), min(part * width + width - 1, lead)
                    core = text[lead - part * width : lead + WINDOW - part * width - width + 1]
                    h = xxhash.xxh3_128_intdigest(core, part * OFFSETS + width)
                    body = text[lead - high : lead + WINDOW - low]
                    out.append((h % (1 << 64) - (1 << 63), (h >> 64) - (1 << 63), xxhash.xxh3_64_intdigest(body) - (1 << 63), name, key, start + lead - high, high - low + 1, high, body))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return arrow_map(rows, run, f"h1 long, h2 long, run long, doc_id {kind}, key long, start long, n long, lead long, text binary")


def kinds_of(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, run, first_doc, times, kinds) of keys that come up twice or more; kinds: different runs under the keys."""
    firsts = runs.groupBy(*keys, "run").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("times"))
    # With the same columns on both sides of the join these read one exchange.
    kinds = firsts.groupBy(*keys).agg(F.count("*").alias("kinds"), F.sum("times").alias("uses"), F.max("first_doc").alias("last")).where("uses > 1 and last is not null")
    return firsts.where("first_doc is not null").join(kinds.drop("uses", "last"), keys).checkpoint()


def span(start: str = "start") -> list:
    return ["doc_id", "key", F.col(start).alias("first"), (F.col(start) + F.col("n") + F.lit(WINDOW - 1)).alias("past")]


def settled(rows: DataFrame, cuts: tuple[int, ...], held: list[DataFrame]) -> list[DataFrame]:
    """Spans to remove, in parts. rows: h1, h2, doc_id, key, start, n, lead, text and kinds, the different texts under h1 and h2.

    held: gets the checkpoints that the parts read.
    """
    rows = rows.checkpoint()
    held.append(rows)
    spans = [sorted_lots(rows.where(F.col("kinds") <= LIMIT))]
    if cuts and not rows.where(F.col("kinds") > LIMIT).isEmpty():
        parts = narrower(rows.where(F.col("kinds") > LIMIT), cuts[0])
        keys = ["h1", "h2"]
        firsts = kinds_of(parts, keys)
        met = spread_join(parts, firsts.drop("times"), [*keys, "run"], firsts.select(*keys, "run", "times")).checkpoint()
        own = Window.partitionBy(*keys, "run", "key").orderBy("start")
        first = met.where("doc_id = first_doc").withColumn("least", F.min("start").over(own))
        spans += [met.where("doc_id > first_doc").select(*span()), first.where("start > least").select(*span())]
        held += [firsts, met]
        spans += settled(first.where("start = least and kinds > 1").drop("least", "first_doc", "run"), cuts[1:], held)
    return spans


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans): bytes to remove as [first, past) positions, possibly overlapping. docs: doc_id with null replaced, key, text."""
    spark = docs.sparkSession
    bits = cell_bits(docs)
    marked = spark.sparkContext.broadcast(repeated_cells(docs, bits))
    runs = passing_runs(docs, marked, bits)
    firsts = kinds_of(runs, ["anchor"])
    equal = ["anchor", "run"]
    times = firsts.select(*equal, "times")
    met = spread_join(runs, firsts.select(*equal, "first_doc"), equal, times)
    spans, held = [met.where("own or doc_id > first_doc").select(*span())], [firsts]
    several = firsts.where("kinds > 1").select(*equal, "first_doc", "kinds")
    if not several.isEmpty():

        def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for batch in batches:
                yield place_cells(batch.column("first_doc").to_pylist(), *(batch.column(c).to_numpy().view("u8") for c in equal), bits)

        open_ = spark.sparkContext.broadcast(cell_table(several.select("first_doc", *equal), cells_of, bits, 1))
        texts = passing_runs(docs, marked, bits, open_).join(several, equal).where("doc_id = first_doc")
        spans += settled(texts.select(F.col("anchor").alias("h1"), F.lit(0).cast("long").alias("h2"), "doc_id", "key", "start", "n", "lead", "text", "kinds"), CUTS, held)
    out = spans[0]
    for part in spans[1:]:
        out = out.unionByName(part)
    out = out.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "past")).alias("spans")).checkpoint()
    discard(*held)
    return out


def with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with the spans of their bytes that occur earlier, and that column's name."""
    prepare(docs.sparkSession)
    identity = free_name(docs, "xd_id"), free_name(docs, "xd_key")
    named = docs.withColumns({identity[0]: known_id(docs), identity[1]: F.xxhash64("text")})
    with setting(docs.sparkSession, _REMOVE_SHUFFLES, "true"):  # each step ends in a checkpoint, after which its shuffles go
        spans = repeated_spans(named.select(F.col(identity[0]).alias("doc_id"), F.col(identity[1]).alias("key"), "text").where("text is not null"))
    name = free_name(named, "xd_spans")
    spans = spans.select(F.col("doc_id").alias(identity[0]), F.col("key").alias(identity[1]), F.col("spans").alias(name))
    return named.join(spans, list(identity), "left").select(*docs.columns, name), name


def islands(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The spans in order, those that touch or overlap as one."""
    return merged([(s["first"], s["past"]) for s in spans or ()])


def without(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for pair in gone for x in pair), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def report(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes and maximal runs of these, and the digest of the bytes that stay."""
    found, name = with_spans(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(byte_rows(batch.column("text")), batch.column(name).to_pylist(), strict=True):
                gone = islands(spans)
                rows.append((len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(without(text, gone)).hexdigest()))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(found, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the bytes that occur earlier; a character goes if any of its bytes does, a text that is left empty goes whole."""
    found, name = with_spans(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column("text").cast(pa.binary()).to_pylist(), [True] * batch.num_rows
            for k, spans in enumerate(batch.column(name).to_pylist()):
                if spans:
                    text, gone = texts[k], []
                    for a, b in islands(spans):
                        while a and text[a] & 0xC0 == 0x80:
                            a -= 1
                        while b < len(text) and text[b] & 0xC0 == 0x80:
                            b += 1
                        gone.append((a, b))
                    texts[k] = without(text, merged(gone))
                    keep[k] = bool(texts[k])
            yield replace_text(batch, texts, keep)

    return arrow_map(found, run, quoted(found)).select(*docs.columns)
