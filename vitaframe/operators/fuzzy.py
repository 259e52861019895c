"""Best matches of names by token-sort ratio, without comparing all pairs.

The ratio of two texts with sorted words is 200 * LCS / (m + n). For given lengths a least ratio is a largest
number d of letters that stand outside the common subsequence. Only the best match is asked for, so names are
settled from high ratios down: equal texts, then each of ``STEPS``, then the least ratio; what has a match above
a step isn't asked again.

* From NEAR_FROM up, d is so small that d + 1 grams of a text fit side by side. Those are taken that fewest texts of the
  other side have (told by a sketch of counts; any choice is exact): one of them stands whole in the other text, so a word
  that a large part of all names have in common makes no candidates.
* From PIECES_FROM up, the same is done with d + 1 pieces of a text for each length of the other one; their lengths and
  places are chosen, and a piece is met only at the places that it can have been moved to.
* From SEGMENTS_FROM up, one text is cut into d + 1 segments. A letter left out breaks one segment at most, so one
  segment stands whole in the other text, moved by no more places than letters are left out before it and behind
  it: pairs meet by an equi-join on segments. Of random names of two words one pair in 600 meets at 85.
* Below that, and for texts longer than LONGEST, segments would have a letter or two and meet everywhere. What is
  left by then meets by classes of lengths that the ratio allows, in blocks; within two blocks all pairs are bounded
  by their common letters in one matrix, and subsequences are counted from the highest bound down to the best found.

Both are exact: no pair above the ratio is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ratios at which names are settled, before the least one; the lowest ratio at which segments are used, and the longest texts.
STEPS = (96.0, 92.0, 85.0, 75.0)
SEGMENTS_FROM, LONGEST = 75.0, 48
#: Lowest ratio at which pieces are chosen.
PIECES_FROM = 80.0
#: Ratios from which rare grams are used, letters of a gram, counters of the sketch.
NEAR_FROM, GRAM, COUNTERS = 92.0, 4, 1 << 18
#: Texts in a block of the one side and of the other.
LEFT_BLOCK, RIGHT_BLOCK = 64, 1000


def form_of(name: str) -> str:
    return " ".join(sorted(name.split()))


def left_out(m: int, n: int, least: float) -> int | None:
    """Most letters outside the common subsequence of texts of m and n letters with a ratio above `least`; None: no such texts."""
    total = m + n
    if not total:
        return 0
    common = max(int(least * total / 200) - 1, 0)
    while common <= min(m, n) and not 200.0 * common / total > least:
        common += 1
    return total - 2 * common if common <= min(m, n) else None  # tried one by one, so that rounding decides as in the ratio itself


def lengths(m: int, least: float) -> tuple[int, float]:
    """Shortest and longest text that one of m letters can be matched with, or a little beyond."""
    return max(int(m * least / (200 - least)), 1), m * (200 - least) / least + 1 if least else float("inf")


@lru_cache(maxsize=4096)
def plan(m: int, least: float, cut: bool) -> list[tuple[str, int, int]]:
    """The segments that sign a text of m letters, as (label, first, past)."""
    low, high = lengths(m, least)
    segments = []
    for n in range(low, int(min(high, LONGEST)) + 1) if m <= LONGEST and least >= SEGMENTS_FROM else ():
        d = left_out(m, n, least)
        if d is None:
            continue
        whole, other = (m, n) if cut else (n, m)  # lengths of the text that is cut and of the one that is searched
        longer = other - whole
        for i in range(d + 1):
            first, past = whole * i // (d + 1), whole * (i + 1) // (d + 1)
            moves = (0,) if cut else range(max(-i, longer - (d - i)), min(i, longer + d - i) + 1)
            segments += [(f"{whole},{other},{i},", first + by, past + by) for by in moves if 0 <= first + by and past + by <= m]
    return segments


def signed(words: str) -> int:
    return xxhash.xxh3_64_intdigest(words.encode("utf-8", "surrogatepass")) - (1 << 63)


def signatures(text: str, least: float, cut: bool) -> set[int]:
    """Signatures of a text. One side's texts are cut into segments, the other's are searched for them."""
    return {signed(label + text[first:past]) for label, first, past in plan(len(text), least, cut)}


@lru_cache(maxsize=4096)
def grams_of(n: int, least: float) -> tuple[int, int]:
    """Most letters outside the common subsequence of a text of n letters and any it can be matched with; length of its grams, 0 for none."""
    low, high = lengths(n, least)
    outside = [d for m in range(low, int(min(high, LONGEST)) + 1) if (d := left_out(m, n, least)) is not None] if n <= LONGEST else []
    return (max(outside), min(GRAM, n // (max(outside) + 1))) if outside else (0, 0)


def all_grams(text: str, least: float) -> list[tuple[int, int]]:
    """(signature, place) of every gram that a text matched with this one may have chosen."""
    low, high = lengths(len(text), least)
    sizes = {grams_of(n, least)[1] for n in range(low, int(min(high, LONGEST)) + 1)} - {0} if len(text) <= LONGEST else ()
    return [(signed(text[k : k + q]), k) for q in sorted(sizes) for k in range(len(text) - q + 1)]


def rare_grams(text: str, least: float, counts: np.ndarray) -> list[tuple[int, int]]:
    """(signature, place) of one gram more than letters can be left out, none overlapping, with the least sum of counts."""
    most, q = grams_of(len(text), least)
    if not q:
        return []
    grams = [signed(text[k : k + q]) for k in range(len(text) - q + 1)]
    cost = counts[np.array(grams, "i8") % COUNTERS].tolist()
    best: list[tuple[int, tuple[int, ...]]] = [(0, ())] * (len(text) + 1)  # by the letters that are used up
    for nth in range(most + 1):
        before, best = best, [(0, ())] * (len(text) + 1)
        for past in range((nth + 1) * q, len(text) + 1):
            have = before[past - q]
            best[past] = (have[0] + cost[past - q], (*have[1], past - q))
            if past > (nth + 1) * q:
                best[past] = min(best[past], best[past - 1])
    return [(grams[k], k) for k in best[-1][1]]


@lru_cache(maxsize=4096)
def piece_sizes(whole: int, other: int, least: float) -> tuple[int, tuple[int, ...]]:
    """Most letters outside the common subsequence of texts of these lengths, and lengths that pieces of the first may have, none if they can't be matched."""
    low, high = lengths(whole, least)
    d = left_out(whole, other, least) if low <= other <= min(high, LONGEST) and whole <= LONGEST else None
    if d is None:
        return 0, ()
    q = whole // (d + 1)
    return d, tuple(x for x in (q - 1, q, q + 1) if 0 < x <= whole - d * max(q - 1, 1))


def piece(whole: int, other: int, first: int, text: str) -> int:
    return signed(f"{whole},{other},{first},{text}")


@lru_cache(maxsize=4096)
def sought(m: int, whole: int, least: float) -> list[tuple[int, int, int]]:
    """(first, size, by): the pieces that texts of `whole` letters may have, and the move by which one of m letters may hold them."""
    d, sizes = piece_sizes(whole, m, least)
    return [(first, q, by) for q in sizes for first in range(whole - q + 1) for by in range(-d, d + 1) if 0 <= first + by <= m - q and by in _moves(first, q, whole, m, d, sizes[0])]


@lru_cache(maxsize=1 << 16)
def _moves(first: int, q: int, whole: int, other: int, d: int, least_size: int) -> frozenset[int]:
    """Moves of a piece, whichever of the d + 1 it may be."""
    return frozenset(by for i in range(max(0, d - (whole - first - q) // least_size), min(d, first // least_size) + 1) for by in moved(i, d, other - whole))


def moved(i: int, d: int, longer: int) -> range:
    """Moves that the i-th of d + 1 pieces may have made."""
    return range(max(-i, longer - (d - i)), min(i, longer + d - i) + 1)


def all_pieces(text: str, least: float, wholes: list[int]) -> list[tuple[int, int, int]]:
    """(signature, move, 0) of every piece that a text of these lengths may have chosen to be found in this one by."""
    m = len(text)
    return [(piece(whole, m, first, text[first + by : first + by + q]), by, 0) for whole in wholes for first, q, by in sought(m, whole, least)]


def rare_pieces(text: str, least: float, others: list[int], counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(signature, first move, last move) of one piece more than letters can be left out, for each length of others; none overlap, the sum of counts is least."""
    n, out = len(text), []
    for other in others:
        d, sizes = piece_sizes(n, other, least)
        if not sizes:
            continue
        signs = {q: [piece(n, other, k, text[k : k + q]) for k in range(n - q + 1)] for q in sizes}
        costs = {q: counts[np.array(x, "i8") % COUNTERS].tolist() for q, x in signs.items()}
        best: list[tuple[int, tuple[tuple[int, int], ...]] | None] = [(0, ())] * (n + 1)  # by the letters that are used up
        for nth in range(d + 1):
            before, best = best, [None] * (n + 1)
            for past in range((nth + 1) * sizes[0], n - (d - nth) * sizes[0] + 1):
                found = best[past - 1]
                for q in sizes:
                    have = before[past - q] if past >= q else None
                    if have is not None:
                        cost = have[0] + costs[q][past - q]
                        if found is None or cost < found[0]:
                            found = (cost, (*have[1], (past - q, q)))
                best[past] = found
        chosen = next(x for x in reversed(best) if x is not None)[1]
        for i, (first, q) in enumerate(chosen):
            by = moved(i, d, other - n)
            if len(by):
                out.append((signs[q][first], by[0], by[-1]))
    return out


def length_class(n: int) -> int:
    """Lengths up to LONGEST each, longer ones in steps of a twelfth."""
    return n if n <= LONGEST else LONGEST + 1 + int(12 * np.log2(n / LONGEST))


def classes(m: int, least: float) -> list[int]:
    """Classes that hold lengths which a text of m letters can be matched with, but not by segments."""
    low, high = lengths(m, least)
    if m <= LONGEST and least >= SEGMENTS_FROM:
        low = LONGEST + 1
    return list(range(length_class(low), length_class(int(min(high, 1 << 40))) + 1)) if low <= high else []


def common_letters(a: str, masks: dict[str, int], b: str) -> int:
    """Length of the longest common subsequence, bit-parallel; masks: places of each letter of a."""
    row = full = (1 << len(a)) - 1
    for c in b:
        both = row & masks.get(c, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def _forms(names: DataFrame, column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([form_of(x) for x in batch.column(0).to_pylist()], pa.string())], ["name", "form"])

    return names.select(F.col(column).cast("string").alias("name")).where("name is not null").distinct().mapInArrow(run, "name string, form string")


def _signed(forms: DataFrame, least: float, cut: bool) -> DataFrame:
    """(signature, form) rows of every form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, x) for x in batch.column(0).to_pylist() for s in signatures(x, least, cut)]
            for at in range(0, len(rows), 50_000):
                lot = rows[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in lot], pa.int64()), pa.array([r[1] for r in lot], pa.string())], ["signature", "form"])

    return forms.mapInArrow(run, "signature long, form string")


def _grams(frame: DataFrame, columns: list[str], of) -> DataFrame:
    """The rows of frame (texts in their first column) for each gram, with signature and place."""
    return _signs(frame, columns, ["place"], of)


def _signs(frame: DataFrame, columns: list[str], facts: list[str], of) -> DataFrame:
    """The rows of frame (texts in their first column) for each row of numbers that `of` makes of the text: a signature and facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                lot = batch.slice(at, 1000)
                found = [of(x) for x in lot.column(0).to_pylist()]
                own = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                flat = np.array([g for f in found for g in f], "i8").reshape(-1, 1 + len(facts))
                yield pa.RecordBatch.from_arrays([*(c.take(own) for c in lot.columns), *map(pa.array, flat.T.copy())], [*columns, "signature", *facts])

    return frame.mapInArrow(run, ", ".join(f"{c} string" for c in columns) + "".join(f", {c} long" for c in ("signature", *facts)))


def _near_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs of which some may be above `least`, and all that are, of texts up to LONGEST. left: left_form; right: form, right_name."""
    mine = _grams(left, ["left_form"], lambda x: all_grams(x, least))
    seen = mine.groupBy(F.pmod("signature", F.lit(COUNTERS)).alias("counter")).count().toArrow()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, "i8")
    counts[seen.column("counter").to_numpy()] = seen.column("count").to_numpy()
    held = left.sparkSession.sparkContext.broadcast(counts)
    theirs = _grams(right.select(F.col("form").alias("right_form"), "right_name"), ["right_form", "right_name"], lambda x: rare_grams(x, least, held.value)).withColumnRenamed("place", "other")
    most = max(grams_of(n, least)[0] for n in range(1, LONGEST + 1))
    # No row of mapInArrow is counted in Spark's estimates of sizes, so these joins are never to be broadcast.
    return mine.join(theirs.hint("merge"), "signature").where(F.abs(F.col("place") - F.col("other")) <= most).select("left_form", "right_form", "right_name")


def _lengths(forms: DataFrame, form: str) -> list[int]:
    """The lengths up to LONGEST that texts have."""
    size = F.length(form)
    return sorted(r[0] for r in forms.select(size).where((size > 0) & (size <= LONGEST)).distinct().collect())


def _piece_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """As _near_pairs, by pieces."""
    spark = left.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    wholes, others = _lengths(right, "form"), _lengths(left, "left_form")
    mine = _signs(left.repartition(tasks), ["left_form"], ["by", "none"], lambda x: all_pieces(x, least, wholes)).drop("none")
    seen = mine.groupBy(F.pmod("signature", F.lit(COUNTERS)).alias("counter")).count().toArrow()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, "i8")
    counts[seen.column("counter").to_numpy()] = seen.column("count").to_numpy()
    held = spark.sparkContext.broadcast(counts)
    theirs = _signs(right.select(F.col("form").alias("right_form"), "right_name").repartition(tasks), ["right_form", "right_name"], ["low", "high"], lambda x: rare_pieces(x, least, others, held.value))
    return mine.join(theirs.hint("merge"), "signature").where(F.col("by").between(F.col("low"), F.col("high"))).select("left_form", "right_form", "right_name")


def masks_of(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


_FOUND = "left_form string, right_name string, ratio double"


def _found(rows: list[tuple[str, str, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["left_form", "right_name", "ratio"])


def _best_of_pairs(pairs: DataFrame, least: float) -> DataFrame:
    """The best pairs above `least` of each run of rows with one left form. pairs: left_form, right_form, right_name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, masks, best, seen = None, {}, None, set()
        for batch in batches:
            rows = []
            for a, b, name in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if a != left:
                    if best:
                        rows.append((left, best[1], -best[0]))
                    left, masks, best, seen = a, masks_of(a), None, set()
                if b not in seen:
                    seen.add(b)
                    ratio = 200.0 * common_letters(a, masks, b) / (len(a) + len(b))
                    if ratio > least and (best is None or (-ratio, name) < best):
                        best = (-ratio, name)
            yield _found(rows)
        if best:
            yield _found([(left, best[1], -best[0])])

    runs = pairs.select("left_form", "right_form", "right_name").repartition("left_form").sortWithinPartitions("left_form")
    return runs.mapInArrow(run, _FOUND)


def _blocks(forms: DataFrame, least: float | None, size: int) -> DataFrame:
    """(class, forms, names): the texts of a task in blocks by the class of their length; least: a row for each class that they can be matched with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[str, str]]] = {}

        def out(length: int) -> pa.RecordBatch:
            block = held.pop(length)
            to = [length] if least is None else classes(length, least)
            columns = [pa.array(to, pa.int32()), *(pa.array([[x[k] for x in block]] * len(to), pa.list_(pa.string())) for k in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, ["class", "forms", "names"])

        for batch in batches:
            for form, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                length = length_class(len(form)) if least is None else len(form)
                held.setdefault(length, []).append((form, name))
                if len(held[length]) >= size:
                    yield out(length)
        for length in list(held):
            yield out(length)

    return forms.mapInArrow(run, "class int, forms array<string>, names array<string>")


def best_in_blocks(lefts: list[str], rights: list[str], names: list[str], least: float) -> list[tuple[str, str, float]]:
    """(left, name of the best right, ratio) of the lefts with a right above `least`."""
    letters = sorted({c for x in (*lefts, *rights) for c in x})
    number = {c: k for k, c in enumerate(letters)}

    def counts(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(letters)), "i4")
        for row, text in zip(out, texts, strict=True):
            for c, n in Counter(text).items():
                row[number[c]] = n
        return out

    right_counts, right_sizes = counts(rights), np.array([len(x) for x in rights])
    out = []
    for left, own in zip(lefts, counts(lefts), strict=True):
        used = np.flatnonzero(own)
        bound = 200.0 * np.minimum(right_counts[:, used], own[used]).sum(1) / (len(left) + right_sizes)
        masks, best = masks_of(left), None
        able = np.flatnonzero(bound > least)
        for k in able[np.argsort(-bound[able], kind="stable")].tolist():
            if best and bound[k] < -best[0] - 1e-9:
                break
            ratio = 200.0 * common_letters(left, masks, rights[k]) / (len(left) + len(rights[k]))
            if ratio > least and (best is None or (-ratio, names[k]) < best):
                best = (-ratio, names[k])
        if best:
            out.append((left, best[1], -best[0]))
    return out


def _best_of_blocks(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """The best pairs above `least` of texts whose lengths allow it and that have no segments at this ratio. left: left_form; right: form, right_name."""
    mine = _blocks(left.select("left_form", "left_form"), least, LEFT_BLOCK).select("class", F.col("forms").alias("lefts"))
    both = mine.join(_blocks(right.select("form", "right_name"), None, RIGHT_BLOCK).hint("merge"), "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, names in zip(*(batch.column(c).to_pylist() for c in ("lefts", "forms", "names")), strict=True):
                yield _found(best_in_blocks(a, b, names, least))

    return both.select("lefts", "forms", "names").mapInArrow(run, _FOUND)


def _kept(frame: DataFrame) -> DataFrame:
    """The rows without the plan that made them: a step's plan would hold those of all steps before it several times over."""
    named = frame.sparkSession.sparkContext.getCheckpointDir()
    return frame.checkpoint() if named else frame.localCheckpoint()


def fuzzy_matches(left: DataFrame, right: DataFrame, name: str, least: float = 85.0) -> DataFrame:
    """(left_name, right_name, ratio): for each distinct left name the best right name above `least`; ties to the smaller name.

    Null names match nothing; names without words match each other. Hot keys of the joins are split by adaptive
    execution; names repeated in other word order go through them once.
    """
    if not 0 <= least < 100:
        raise ValueError("the least ratio is 0 to below 100")
    asked = _kept(_forms(left, name))
    offered = _kept(_forms(right, name).groupBy("form").agg(F.min("name").alias("right_name")))
    open_ = asked.select(F.col("form").alias("left_form")).distinct()
    found = open_.join(offered.hint("merge"), F.col("left_form") == F.col("form")).select("left_form", "right_name", F.lit(100.0).alias("ratio")).where(F.lit(100.0) > least)
    rights = offered.where("form <> ''")
    for step in [*(s for s in STEPS if s > least), least]:
        open_ = _kept(open_.where("left_form <> ''").join(found.hint("merge"), "left_form", "left_anti"))
        if open_.isEmpty():
            break
        best = _best_of_blocks(open_, rights, step)
        if step >= NEAR_FROM:
            best = best.unionByName(_best_of_pairs(_near_pairs(open_, rights, step), step))
        elif step >= PIECES_FROM:
            best = best.unionByName(_best_of_pairs(_piece_pairs(open_, rights, step), step))
        elif step >= SEGMENTS_FROM:
            mine = _signed(open_, step, False).withColumnRenamed("form", "left_form")
            theirs = _signed(rights.select("form"), step, True).withColumnRenamed("form", "right_form")
            best = best.unionByName(_best_of_pairs(mine.join(theirs.hint("merge"), "signature").join(rights.withColumnRenamed("form", "right_form").hint("merge"), "right_form"), step))
        best = best.groupBy("left_form").agg(F.min(F.struct((-F.col("ratio")).alias("r"), F.col("right_name"))).alias("b"))
        found = _kept(found.unionByName(best.select("left_form", "b.right_name", (-F.col("b.r")).alias("ratio"))))
    return asked.withColumnRenamed("form", "left_form").join(found.hint("merge"), "left_form").select(F.col("name").alias("left_name"), "right_name", "ratio")
