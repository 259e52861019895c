"""Hierarchical Pitman-Yor language model, with Chinese-restaurant seating sampled by Gibbs.

There is one leaf restaurant for each pair of words that occurs, one parent for each word (shared by the
leaves whose nearest word it is), and one root, whose base is uniform over the V training words and one
unknown word. Contexts are the words themselves, so restaurants and dishes grow with the corpus; none
is merged or dropped.

Flow. A pass over the documents codes them in chunks (their words' 64-bit hashes and their tokens). The
hashes go to shards by range, which number all words by rank and return numbers and training counts.
Words are stored in order, with their classes by frequency; places among them by class and order compress better.
From a chunk then go its distinct (second word before, word before, word) triples, with their training
counts, to the bucket of the word before; a word with more tokens than a fraction of a bucket has as many
pieces as its tokens need, dealt to buckets in turn, its triples go to a piece by the second word before,
and its parent is a shared restaurant, as the root is. A bucket holds whole leaf restaurants and the parents
of all other words. In each of ROUNDS rounds the buckets
return their tables for the shared restaurants' dishes, packed by shard; the shards add them, seat the
dishes and send customers and tables back. In the last pass a bucket draws SAMPLES seatings, averages the
predictive probabilities, and returns one for each of a chunk's triples; a chunk then sums logarithms by
document. Chunks and dealt triples are checkpointed.

Gibbs. A dish's state is its number of tables t among c customers; which customer sits where is summed
out. A step removes a customer (its table goes with the ratio of generalised Stirling numbers
S(c-1, t-1) / S(c, t), the chance that it sat alone) and seats it again by the restaurant's weights.
Each sweep makes min(c, RESEATS) steps for each dish, dishes side by side, with the restaurant's tables
counted anew after each step; then the parents follow: customers that came or went are seated or removed
one by one, and the parents' dishes are reseated. So each sweep reseats every customer of a dish of up to RESEATS, and
its chain may start from the expected number of tables; a larger dish starts from a seating that is drawn by the
restaurant's weights, in lots of an eighth of those seated. Up to STIRLING customers the ratio is exact, beyond that
it is read at the same share of tables.
Draws are hashes of the dish and the step, so a lost task repeats itself exactly, whatever the buckets.
Discounts come from how many dishes have one and two customers, strengths from the expected auxiliary
variables of the seating before.

Defined results: null and empty texts consist of the end token alone; a null doc_id is not held out;
repeated rows are learned from and scored each; without training rows V and N are 0 and every token has
the base probability; extra columns take no part.
"""

from __future__ import annotations

import gc
import time
import zlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.llm.common import arrow_map, arrow_type, byte_rows, lower_words, mix, prepare

CHUNK_TOKENS, CHUNK_DOCS = 1_000_000, 30_000
BUCKET_TOKENS = 1_500_000
#: A word's triples are split when it precedes more than this share of a bucket's tokens.
HOT_SHARE = 0.25
#: Words that are split, at most: their list is broadcast, and with more tokens it takes more of them to be on it.
MAX_HOT = 1 << 20
#: Ranges of buckets that triples are dealt to one after another, so that a shuffle never holds more than this part of them.
DEALS = 2
#: A piece of such a word has about this share of a bucket's tokens.
PIECE_SHARE = 0.125
ROUNDS, WARM_UP, SAMPLES = 2, 2, 3
RESEATS = 256
STIRLING = 256
#: Variance from which the normal law stands for the binomial one.
NORMAL_FROM = 100.0
#: Classes of words by powers of two of their counts.
CLASSES = 64
STRENGTH = (10.0, 5.0, 2.0)  # root, parent, leaf, before the first estimate
_END, _START = (int.from_bytes(xxhash.xxh3_64_digest(x), "big") for x in (b"\nend", b"\nstart"))
TRIPLES, ROOT, SHARED, FACTS, WORDS = range(5)
_ROWS = "kind int, bucket int, part long, n int, m int, packed binary"
_NAMES = ["kind", "bucket", "part", "n", "m", "packed"]
_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def is_held_out(doc_id: int | str | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _pack(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes by significance, which compresses numbers best."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).view("u1").reshape(len(a), a.itemsize).T.tobytes() for a in arrays))


def _unpack(data: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind, n in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, "u1", n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], _NAMES)


def _steps(sorted_: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, from which cumsum gives them back."""
    return np.diff(sorted_, prepend=np.zeros(1, "u8"))


#: Within such a setting the shuffle files of a query go as soon as it has ended; all that is needed later is checkpointed.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, "false")
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*frames: DataFrame | None) -> None:
    """Deletes the files of checkpoints that no later step reads, whether the session cleans checkpoints or not."""
    for frame in frames:
        if frame is not None:
            context = frame.sparkSession.sparkContext
            file = frame._jdf.logicalPlan().rdd().getCheckpointFile()
            if file.isDefined():
                path = context._jvm.org.apache.hadoop.fs.Path(file.get())
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(docs: DataFrame) -> None:
    """Lets Spark remove the checkpoints that no plan refers to any more."""
    docs.sparkSession.range(1).checkpoint()  # what was checkpointed last is held until something else has been
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()
    time.sleep(1)  # the cleaner works beside us


# Chunks of documents


def _numbering() -> dict[bytes, int]:
    """A number for each word that is looked up, in the order of their first times."""
    known: dict = defaultdict()
    known.default_factory = known.__len__
    return known


def chunk_rows(docs: DataFrame) -> DataFrame:
    """A row for each chunk: training documents first, the distinct words' sorted hashes and classes, and the tokens as places among the words ordered by class and hash.

    start is the place, among the hashes, of what stands before a document.
    """

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray], dict[bytes, int]]]:
        """Ids, documents and the numbers that stand for words in these; no document's words are held."""
        ids, lots, held, known = [], [], 0, _numbering()
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), byte_rows(batch.column("text")), strict=True):
                words = lower_words(text)
                ids.append(i)
                lots.append(np.fromiter(map(known.__getitem__, words), "i8", len(words)))
                held += len(words) + 1
                if held >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield ids, lots, known
                    ids, lots, held, known = [], [], 0, _numbering()
        if ids:
            yield ids, lots, known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for nth, (ids, words, known) in enumerate(lots(batches)):
            order = np.argsort([is_held_out(i) for i in ids], kind="stable")
            ids, words = [ids[i] for i in order], [words[i] for i in order]
            sizes = np.array([len(w) + 1 for w in words], "i8")
            past = np.cumsum(sizes)
            tokens = np.full(past[-1], -1, "i8")
            inner = np.ones(past[-1], bool)
            inner[past - 1] = False
            tokens[inner] = np.concatenate(words)
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in known] + [_START, _END], "u8")
            tokens[~inner] = len(hashes) - 1
            hashes, place = np.unique(hashes, return_inverse=True)
            tokens = place[tokens]
            n_train = sum(not is_held_out(i) for i in ids)
            start = int(np.searchsorted(hashes, np.uint64(_START)))
            kinds = classes(np.bincount(tokens, minlength=len(hashes)))
            by_class = np.empty(len(hashes), "<u4")
            by_class[np.argsort(kinds, kind="stable")] = np.arange(len(hashes))
            row = part << 32 | nth, n_train, len(hashes), start, len(tokens), _pack(_steps(hashes), kinds, by_class[tokens]), ids, sizes.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    types = _chunk_types(kind)
    names = _CHUNK
    return arrow_map(docs, run, _chunk_schema(kind))


def classes(counts: np.ndarray) -> np.ndarray:
    """Words by powers of two of their counts, the most frequent ones first."""
    return (CLASSES - np.frexp(np.maximum(counts, 1).astype("f8"))[1]).astype("u1")


_CHUNK = ["part", "n_train", "n_words", "start", "n_tokens", "packed", "ids", "sizes"]


def _chunk_types(kind: str) -> tuple:
    return pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(arrow_type(kind)), pa.list_(pa.int64())


def _chunk_schema(kind: str) -> str:
    return f"part long, n_train int, n_words int, start int, n_tokens int, packed binary, ids array<{kind}>, sizes array<long>"


def numbered(chunks: DataFrame, shards: int) -> tuple[DataFrame, float, float, np.ndarray]:
    """The chunks with words' numbers and training counts in place of hashes; V, N and the sorted numbers of words that precede too many tokens for one bucket."""
    return numbered_and_counted(chunks, shards)[:4]


def numbered_and_counted(chunks: DataFrame, shards: int, total: int = 0) -> tuple[DataFrame, float, float, np.ndarray, np.ndarray, DataFrame]:
    """The same, how many tokens each of those words precedes, and the checkpoint of numbers that the chunks are read from. total: all tokens."""
    too_many = max(HOT_SHARE * BUCKET_TOKENS, total / MAX_HOT)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row, numbered=False)
                by_hash = np.argsort(chunk.words)
                n = chunk.words[by_hash]
                every = np.bincount(chunk.tokens, minlength=len(n))
                every[chunk.start] = len(chunk.sizes)
                trained = np.bincount(chunk.tokens[: int(chunk.sizes[: chunk.n_train].sum())], minlength=len(n))
                every, trained = every[by_hash], trained[by_hash]
                edges = np.searchsorted(((n >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32), np.arange(shards + 1))
                yield _rows([(WORDS, s, row["part"], int(edges[s + 1] - a), 0, _pack(_steps(n[a : edges[s + 1]]), every[a : edges[s + 1]], trained[a : edges[s + 1]])) for s, a in enumerate(edges[:-1].tolist()) if edges[s + 1] > a])

    def count(key, table):
        rows = table.to_pylist()
        keys, place, (every, trained), edges = _merged(rows, ["<i8", "<i8"])
        every, trained = (np.bincount(place, x, len(keys)).astype("<i8") for x in (every, trained))
        out = [(WORDS, r["bucket"], r["part"], r["n"], 0, _pack(_steps(place[a:b].astype("u8")), trained[place[a:b]])) for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True)]
        many = np.flatnonzero(every > too_many)
        facts = np.array([len(keys), (trained > 0).sum(), trained.sum()], "<i8")
        return pa.Table.from_batches([_rows([*out, (FACTS, key[0].as_py(), 0, 3, len(many), _pack(facts, many.astype("<i8"), every[many]))])])

    asked = arrow_map(chunks.drop("ids"), words, _ROWS)
    found = asked.groupBy("bucket").applyInArrow(count, _ROWS).checkpoint()
    facts = {}
    for r in _facts(found):
        facts[r["bucket"]] = _unpack(r["packed"], ("<i8", 3), ("<i8", r["m"]), ("<i8", r["m"]))  # few words are frequent
    numbers = np.zeros(shards + 1, "i8")
    for s, (sums, *_) in facts.items():
        numbers[s + 1] = sums[0]
    first = np.cumsum(numbers)
    hot = np.concatenate([np.zeros(0, "u8"), *((first[s] + many).astype("u8") for s, (_, many, _) in facts.items())])
    times = np.concatenate([np.zeros(0, "i8"), *(t for _, _, t in facts.values())])[np.argsort(hot)]
    hot = np.sort(hot)
    v, n = (float(sum(x[0][k] for x in facts.values())) for k in (1, 2))
    held = chunks.sparkSession.sparkContext.broadcast(first)

    def meet(key, left, right):
        parts = sorted(left.to_pylist(), key=lambda r: r["bucket"])
        got = [_unpack(r["packed"], ("<u8", r["n"]), ("<i8", r["n"])) for r in parts]
        numbers = np.concatenate([np.cumsum(x, dtype="u8") + np.uint64(held.value[r["bucket"]]) for (x, _), r in zip(got, parts, strict=True)])
        out = []
        for row in right.to_pylist():
            _, kinds, tokens = _unpack(row["packed"], ("<u8", row["n_words"]), ("u1", row["n_words"]), ("<u4", row["n_tokens"]))
            out.append(row | {"packed": _pack(_steps(numbers), kinds, np.concatenate([x for _, x in got]), tokens)})
        return pa.Table.from_pylist(out, pa.schema(list(zip(_CHUNK, _chunk_types(kind), strict=True))))

    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    replies = found.where(F.col("kind") == WORDS)
    return replies.groupBy("part").cogroup(chunks.groupBy("part")).applyInArrow(meet, _chunk_schema(kind)), v, n, hot, times, found


@dataclass
class Chunk:
    """A chunk's tokens, as places among its words, which are ordered by class and hash; and its distinct triples ordered by bucket."""

    words: np.ndarray  # hashes or numbers
    kinds: np.ndarray
    trained_words: np.ndarray | None
    tokens: np.ndarray
    sizes: np.ndarray
    n_train: int  # documents
    start: int

    @classmethod
    def of(cls, row: dict, numbered: bool = True) -> Chunk:
        n = row["n_words"]
        steps, kinds, *trained, tokens = _unpack(row["packed"], ("<u8", n), ("u1", n), *([("<i8", n)] if numbered else []), ("<u4", row["n_tokens"]))
        order = np.argsort(kinds, kind="stable")
        start = int(np.flatnonzero(order == row["start"])[0])
        return cls(np.cumsum(steps, dtype="u8")[order], kinds[order], trained[0][order] if trained else None, tokens.astype("i8"), np.array(row["sizes"], "i8"), row["n_train"], start)

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """The word before each token and the one before that."""
        first = np.cumsum(self.sizes) - self.sizes
        out = []
        for k in (1, 2):
            x = np.full(len(self.tokens), self.start, "i8")
            x[k:] = self.tokens[:-k]
            for shift in range(k):
                x[(first + shift)[shift < self.sizes]] = self.start
            out.append(x)
        return out[0], out[1]

    def triples(self, buckets: int, hot: np.ndarray, pieces: np.ndarray, only: range | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, near, far, word) of the distinct triples, and each token's triple. only: of these buckets, of others -1."""
        near, far = self.before()
        tokens, n, by_word = self.tokens, len(self.words), mix(self.words)
        own_bucket, is_hot = (by_word % np.uint64(buckets)).astype("i4"), np.isin(self.words, hot)
        if only is not None:
            # A split word's triples may go to any bucket; what other ranges get of them goes below.
            some = np.flatnonzero((is_hot | (own_bucket >= only.start) & (own_bucket < only.stop))[near])
            near, far, tokens = near[some], far[some], tokens[some]
        pairs = near * n + far
        if n >= 1 << 21:  # three places do not fit 64 bits
            kinds, pairs = np.unique(pairs, return_inverse=True)
            keys, own = np.unique(pairs * n + tokens, return_inverse=True)
            pairs = kinds[keys // n]
        else:
            keys, own = np.unique(pairs * n + tokens, return_inverse=True)
            pairs = keys // n
        near, far, word = pairs // n, pairs % n, keys % n
        bucket = own_bucket[near]
        split = np.flatnonzero(is_hot[near])
        at = np.searchsorted(hot, self.words[near[split]])
        piece = mix(by_word[near[split]] ^ self.words[far[split]]) % pieces[at].astype("u8")
        bucket[split] = ((np.cumsum(pieces) - pieces)[at] + piece.astype("i8")) % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        own = place[own]
        if only is not None:
            first, past = np.searchsorted(bucket[order], (only.start, only.stop))
            order = order[first:past]
            every = np.full(len(self.tokens), -1, "i8")
            every[some] = np.where((own >= first) & (own < past), own - first, -1)
            own = every
        return bucket[order], near[order], far[order], word[order], own

    def trained(self, own: np.ndarray, n: int) -> np.ndarray:
        """How many training tokens each triple has."""
        return np.bincount(own[: int(self.sizes[: self.n_train].sum())] + 1, minlength=n + 1)[1:]


def _distinct(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of numbers below n, sorted, and the place of each among them; many are marked, not sorted."""
    if len(x) < n // 4:
        return np.unique(x, return_inverse=True)
    there = np.zeros(n, bool)
    there[x] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[x]


def _afresh(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Steps of x, with x itself where new."""
    return np.where(new, x, np.diff(x, prepend=0))


def _summed(steps: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The numbers of which these are the steps."""
    total = np.cumsum(steps)
    return total - (total - steps)[np.flatnonzero(new)][np.cumsum(new) - 1]


def _ordered(near: np.ndarray, far: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted triples as steps: of near; of far while near stays; of word while both stay."""
    new = np.diff(near, prepend=-1) != 0
    other = new | (np.diff(far, prepend=-1) != 0)
    return np.diff(near, prepend=0), _afresh(far, new), _afresh(word, other)


def _restored(near: np.ndarray, far: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The triples of which these are the steps."""
    new = near != 0
    new[:1] = True
    other = new | (far != 0)
    return np.cumsum(near), _summed(far, new), _summed(word, other)


def pieces_of(times: np.ndarray, buckets: int) -> np.ndarray:
    """Into how many pieces words are split that precede so many tokens; they are dealt to buckets in turn."""
    return np.clip(np.ceil(times / (PIECE_SHARE * BUCKET_TOKENS)), 1, buckets).astype("i8")


def deal(chunks: DataFrame, buckets: int, hot: np.ndarray, pieces: np.ndarray | None = None, only: range | None = None) -> DataFrame:
    """The chunks' triples, a row for each chunk and bucket. pieces: of each word in hot, without them as many as buckets; only: of these buckets."""
    held = chunks.sparkSession.sparkContext.broadcast((hot, np.full(len(hot), buckets) if pieces is None else pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row)
                bucket, near, far, word, own = chunk.triples(buckets, *held.value, only)
                n = chunk.trained(own, len(word)).astype("<u4")
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                rows = []
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    at = slice(edges[b], edges[b + 1])
                    words, place = _distinct(np.concatenate((near[at], far[at], word[at])), len(chunk.words))
                    size = edges[b + 1] - edges[b]
                    narrow = "<u2" if len(words) < 1 << 16 else "<u4"
                    by_number = np.argsort(chunk.words[words])
                    numbers, kinds = chunk.words[words][by_number], chunk.kinds[words][by_number]
                    rows.append((TRIPLES, b, row["part"], len(words), size, _pack(_steps(numbers), kinds, *(x.astype(narrow) for x in _ordered(*place.reshape(3, size))), n[at])))
                yield _rows(rows)

    return arrow_map(chunks.drop("ids"), run, _ROWS)


# Seating


def _digamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for _ in range(6):
        shift -= 1 / x
        x = x + 1
    return shift + np.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x**4)


def auxiliary(customers: np.ndarray, tables: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Expected sums of the auxiliary variables that a Gamma(1, 1) strength is estimated from."""
    c, t = customers[customers > 0].astype("f8"), tables[customers > 0].astype("f8")
    ratio = strength / discount
    opened = ratio * (_digamma(ratio + t) - _digamma(np.full(1, ratio + 1)))
    return np.array([opened.sum(), (_digamma(strength + c) - _digamma(np.full(1, strength + 1))).sum()])


def draws(keys: np.ndarray, *step: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in [0, 1) for each key, that depend on the key and the step alone."""
    salt = 0
    for x in step:
        salt = (salt * 1_000_003 + x + 1) % 2**64
    x = keys ^ mix(np.array([salt], "u8"))[0]
    high = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # mix, in place
        np.right_shift(x, np.uint64(shift), out=high)
        np.bitwise_xor(x, high, out=x)
        if factor > 1:
            np.multiply(x, np.uint64(factor), out=x)
    halves = x.view("<u4").reshape(-1, 2)
    return halves[:, 1] * 2.0**-32, halves[:, 0] * 2.0**-32


def opened(lot: np.ndarray, p: np.ndarray, keys: np.ndarray, *step: int) -> np.ndarray:
    """How many of a lot of customers open a table, each with the chance p."""
    first, second = draws(keys, *step)
    spread = lot * p * (1 - p)
    out = np.floor(lot * p + np.sqrt(spread) * np.sqrt(-2 * np.log(first + 2.0**-33)) * np.cos(2 * np.pi * second) + 0.5)
    few = np.flatnonzero(spread < NORMAL_FROM)
    n, swap = lot[few].astype("f8"), p[few] > 0.5
    q = np.where(swap, 1 - p[few], p[few])
    term, left, k = (1 - q) ** n, first[few], np.zeros(len(few))
    some = np.flatnonzero((left >= term) & (n > 0))
    while len(some):
        left[some] -= term[some]
        term[some] *= (n[some] - k[some]) / (k[some] + 1) * (q[some] / (1 - q[some]))
        k[some] += 1
        some = some[(left[some] >= term[some]) & (k[some] < n[some])]
    out[few] = np.where(swap, n - k, k)
    return np.clip(out, 0, lot)


class Alone:
    """The chance that a customer sits alone, by customers and tables of its dish."""

    def __init__(self, discount: float, size: int = STIRLING) -> None:
        self.size = size
        t = np.arange(size + 1)
        self.table = np.zeros((size + 1, size + 1))
        with np.errstate(divide="ignore"):
            row = np.where(t == 1, 0.0, -np.inf)  # logarithms of S(1, t)
            for c in range(2, size + 1):
                before = np.concatenate(([-np.inf], row[:-1]))
                new = np.logaddexp(before, np.log(np.maximum(c - 1 - discount * t, 0)) + row)
                self.table[c] = np.exp(np.where(t <= c, before - np.where(np.isfinite(new), new, 0), -np.inf))
                row = np.where(t <= c, new, -np.inf)
        self.table[1, 1] = 1.0
        self.last, self.rise = self.table[size], np.diff(self.table[size])

    def large(self, share: np.ndarray) -> np.ndarray:
        """Of dishes beyond the table, by the tables that `size` customers would have at the same share."""
        low = np.minimum(share.astype("i8"), self.size - 1)
        return self.last[low] + (share - low) * self.rise[low]

    def scale(self, customers: np.ndarray) -> np.ndarray:
        """What turns tables beyond the first into those of `size` customers."""
        return (self.size - 1) / (customers - 1)

    def __call__(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        if not len(customers) or customers.max() <= self.size:
            return self.table[customers, tables]
        out = self.table[np.minimum(customers, self.size), np.minimum(tables, self.size)]
        large = np.flatnonzero(customers > self.size)
        out[large] = self.large(1 + (tables[large] - 1) * self.scale(customers[large]))
        return out


@dataclass
class Level:
    """The dishes of some restaurants. tables are sampled, given the restaurants' numbers of tables."""

    at: np.ndarray  # restaurant of each dish
    keys: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    in_all: np.ndarray  # tables by restaurant
    alone: dict[float, Alone] = field(default_factory=dict)

    def _open(self, some: np.ndarray, customers: np.ndarray, base: np.ndarray, d: float, theta: float, chance: np.ndarray) -> np.ndarray:
        """Whether a further customer of a dish opens a table."""
        new = (theta + d * self.in_all[self.at[some]]) * base[some]
        return chance * (new + customers - d * self.tables[some]) < new

    def _change(self, some: np.ndarray, by: np.ndarray) -> None:
        self.tables[some] += by
        moved = np.flatnonzero(by)
        np.add.at(self.in_all, self.at[some[moved]], by[moved])

    def start(self, base: np.ndarray, d: float, theta: float, *step: int) -> None:
        """A first seating: expected tables for dishes whose customers are all reseated, drawn ones for larger dishes. Lots of customers grow with those seated."""
        live = np.flatnonzero(self.customers > 1)
        t, n = np.ones(len(live)), np.ones(len(live))
        new, c, keys = (theta + d * self.in_all[self.at[live]]) * base[live], self.customers[live], self.keys[live]
        most = int(c.max(initial=0))
        seated = 1
        some = slice(None)  # dishes that have customers to seat yet
        while seated < most:
            lot = np.clip(c[some] - seated, 0, max(1, seated // 8))
            chance = new[some] / (new[some] + n[some] - d * t[some])
            more = lot * chance
            large = np.flatnonzero(c[some] > RESEATS)
            more[large] = opened(lot[large], chance[large], keys[some][large], *step, seated)
            t[some] += more
            n[some] += lot
            seated += max(1, seated // 8)
            some = np.flatnonzero(c > seated) if isinstance(some, slice) else some[c[some] > seated]
        by = np.clip(np.floor(t + 0.5).astype("i8"), 1, c) - self.tables[live]
        self._change(live, by)

    def follow(self, customers: np.ndarray, base: np.ndarray, d: float, theta: float, *step: int) -> None:
        """Seats customers that came and removes those that went, one by one."""
        alone = self.ratio(d)
        nth = 0
        live = np.flatnonzero(customers != self.customers)
        while len(live):
            first, second = draws(self.keys[live], *step, nth)
            have = self.customers[live]
            more = customers[live] > have
            goes = ~more & (first < alone(have, self.tables[live]))
            by = np.where(more, self._open(live, have, base, d, theta, second), -goes.astype("i8")).astype("i8")
            self.customers[live] += np.where(more, 1, -1)
            self._change(live, by)
            live = live[customers[live] != self.customers[live]]
            nth += 1

    def reseat(self, base: np.ndarray, d: float, theta: float, *step: int) -> None:
        """min(customers, RESEATS) steps for each dish of two customers or more."""
        alone = self.ratio(d)
        live = np.flatnonzero(self.customers > 1)
        live = live[np.argsort(-self.customers[live], kind="stable")]  # those with customers left to reseat stand first
        keys, customers, at, base, tables = self.keys[live], self.customers[live], self.at[live], base[live], self.tables[live]
        row, exact, large = np.minimum(customers, alone.size) * (alone.size + 1), alone.table.ravel(), int((customers > alone.size).sum())
        scale, left = alone.scale(customers[:large]), np.searchsorted(-customers, -np.arange(RESEATS))  # as many have over nth customers
        for nth, n in enumerate(left.tolist()):
            if not n:
                break
            first, second = draws(keys[:n], *step, nth)
            have = tables[:n]
            chance = exact.take(row[:n] + have, mode="clip")
            if large:
                chance[:large] = alone.large(1 + (have[:large] - 1) * scale[:n])
            goes = first < chance
            t = have - goes
            new = (theta + d * (self.in_all[at[:n]] - goes)) * base[:n]
            opens = second * (new + customers[:n] - 1 - d * t) < new
            moved = np.flatnonzero(opens != goes)
            by = np.where(opens[moved], 1, -1)
            tables[moved] += by
            np.add.at(self.in_all, at[moved], by)
        self.tables[live] = tables

    def ratio(self, d: float) -> Alone:
        if d not in self.alone:
            self.alone[d] = Alone(d)
        return self.alone[d]


@dataclass
class Shared:
    """What all buckets know: the root's sums, the shared parents' sums (sorted by word), discounts and strengths."""

    discounts: tuple[float, float, float]
    strengths: tuple[float, float, float]
    customers: float
    tables: float
    vocabulary: float
    hot: np.ndarray
    hot_customers: np.ndarray
    hot_tables: np.ndarray

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        d, theta = self.discounts[0], self.strengths[0]
        return (np.maximum(customers - d * tables, 0) + (theta + d * self.tables) / (self.vocabulary + 1)) / (theta + self.customers)


def sharded(keys: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Places of the keys ordered by shard, as a whole and for each shard."""
    shard = (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(shards)).astype("i8")
    order = np.argsort(shard, kind="stable")
    numbers, first = np.unique(shard[order], return_index=True)
    return order, list(zip(numbers.tolist(), np.split(order, first[1:]), strict=True)) if len(keys) else []


def pair_keys(near: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(near) ^ word)


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted numbers and the place of each among them, without sorting again."""
    new = np.diff(sorted_, prepend=-1) != 0
    return sorted_[new], np.cumsum(new) - 1


class Bucket:
    """The triples of one bucket; far, near and word are places among `words`."""

    def __init__(self, rows: list[dict], hot: np.ndarray) -> None:
        rows = sorted(rows, key=lambda r: r["part"])
        parts = []
        for r in rows:
            narrow = "<u2" if r["n"] < 1 << 16 else "<u4"
            steps, kinds, *rest = _unpack(r["packed"], ("<u8", r["n"]), ("u1", r["n"]), *[(narrow, r["m"])] * 3, ("<u4", r["m"]))
            parts.append((np.cumsum(steps, dtype="u8")[np.argsort(kinds, kind="stable")], *_restored(*(x.astype("i8") for x in rest[:3])), rest[3]))
        self.parts = [r["part"] for r in rows]
        self.edges = np.cumsum([0, *(r["m"] for r in rows)])
        self.words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sizes = np.cumsum([0, *(len(p[0]) for p in parts)])
        near, far, word = (np.concatenate([place[a + p[k]] for p, a in zip(parts, sizes[:-1], strict=True)]) for k in (1, 2, 3))
        n = len(self.words)
        contexts = near * n + far
        if n > 1 << 21:  # three places do not fit 64 bits
            kinds, contexts = np.unique(contexts, return_inverse=True)
        triples, self.triple = np.unique(contexts * n + word, return_inverse=True)
        contexts, self.context = _runs(triples // n)
        if n > 1 << 21:
            contexts = kinds[contexts]
        self.word = triples % n
        self.count = np.bincount(self.triple, np.concatenate([p[4] for p in parts]), len(triples)).astype("i8")
        near = contexts // n
        pairs, self.pair = np.unique(near[self.context] * n + self.word, return_inverse=True)
        self.nears, parent = _runs(pairs // n)
        self.pair_word = pairs % n
        self.is_hot = np.isin(self.words[self.nears], hot)[parent]  # by pair
        seen = (self.count > 0).astype("i8")
        keys = pair_keys(self.words[self.nears[parent]], self.words[self.pair_word])
        self.leaf = Level(self.context, mix(keys[self.pair] ^ mix(self.words[contexts % n])[self.context]), self.count, seen.copy(), np.bincount(self.context, seen, len(contexts)).astype("i8"))
        self.leaf_customers = np.bincount(self.context, self.count, len(contexts))
        customers = np.bincount(self.pair, seen, len(pairs)).astype("i8")
        tables = np.minimum(customers, 1)
        self.upper = Level(parent, keys, customers, tables, np.bincount(parent, tables, len(self.nears)).astype("i8"))
        # Words that need the root, and pairs that need a shared parent, in order.
        self.asked = np.unique(self.word)
        self.asked_pairs = np.flatnonzero(self.is_hot)
        self.base = np.zeros(n)

    def take(self, shared: Shared, replies: pa.Table) -> None:
        """What the shards sent back, in the order of `out`."""
        rows = sorted(replies.to_pylist(), key=lambda r: r["part"])
        root, hot = ([r for r in rows if r["kind"] == k] for k in (ROOT, SHARED))
        got = [np.concatenate(x) for x in zip(*(_unpack(r["packed"], *[("<i8", r["n"])] * 2) for r in root), strict=True)]
        at = self.asked[sharded(self.words[self.asked], root[0]["m"])[0]]
        self.base[at] = shared.root(*got)
        if hot:
            got = [np.concatenate(x) for x in zip(*(_unpack(r["packed"], *[("<i8", r["n"])] * 2) for r in hot), strict=True)]
            at = self.asked_pairs[sharded(self.upper.keys[self.asked_pairs], hot[0]["m"])[0]]
            self.upper.customers[at], self.upper.tables[at] = got
        self.prepare(shared)

    def prepare(self, shared: Shared) -> None:
        """Totals by parent, of shared ones from all buckets."""
        words = self.words[self.nears]
        self.upper.in_all = np.bincount(self.upper.at, np.where(self.is_hot, 0, self.upper.tables), len(words)).astype("i8")
        self.place = np.minimum(np.searchsorted(shared.hot, words), max(len(shared.hot) - 1, 0))
        self.shared_parent = shared.hot[self.place] == words if len(shared.hot) else np.zeros(len(words), bool)
        if len(shared.hot):
            self.upper.in_all = np.where(self.shared_parent, shared.hot_tables[self.place], self.upper.in_all)

    def upper_customers(self, shared: Shared) -> np.ndarray:
        total = np.bincount(self.upper.at, np.where(self.is_hot, 0, self.upper.customers), len(self.nears))
        return np.where(self.shared_parent, shared.hot_customers[self.place], total) if len(shared.hot) else total

    def parents(self, shared: Shared) -> np.ndarray:
        """P(word | word before) by pair."""
        d, theta, at = shared.discounts[1], shared.strengths[1], self.upper.at
        own = np.maximum(self.upper.customers - d * self.upper.tables, 0)
        return (own + (theta + d * self.upper.in_all[at]) * self.base[self.pair_word]) / (theta + self.upper_customers(shared)[at])

    def sweep(self, shared: Shared, nth: int) -> None:
        d, theta = shared.discounts, shared.strengths
        base = self.parents(shared)[self.pair]
        if nth == 0:
            self.leaf.start(base, d[2], theta[2], 2, 2_000)
        self.leaf.reseat(base, d[2], theta[2], 2, nth)
        customers = np.bincount(self.pair, self.leaf.tables, len(self.upper.at)).astype("i8")
        customers[self.is_hot] = self.upper.customers[self.is_hot]
        base = self.base[self.pair_word]
        local = Level(self.upper.at, self.upper.keys, np.where(self.is_hot, 0, self.upper.customers), self.upper.tables, self.upper.in_all, alone=self.upper.alone)
        wanted = np.where(self.is_hot, 0, customers)
        if nth == 0:
            local.customers = wanted.copy()
            local.start(base, d[1], theta[1], 1, 2_000)
        else:
            local.follow(wanted, base, d[1], theta[1], 1, nth, 1)
        local.reseat(base, d[1], theta[1], 1, nth, 0)
        self.upper.customers = customers

    def probability(self, shared: Shared) -> np.ndarray:
        """Of each triple."""
        d, theta = shared.discounts[2], shared.strengths[2]
        own = np.maximum(self.count - d * self.leaf.tables, 0)
        at = self.context
        return (own + (theta + d * self.leaf.in_all[at]) * self.parents(shared)[self.pair]) / (theta + self.leaf_customers[at])

    def out(self, bucket: int, shards: int, shared: Shared | None) -> list[tuple]:
        """Rows for the shards and the driver."""
        rows = []
        tables = np.where(self.is_hot, 0, self.upper.tables)
        upward = np.bincount(self.pair_word, tables, len(self.words)).astype("<i8")[self.asked]
        words = self.words[self.asked]
        for s, at in sharded(words, shards)[1]:
            rows.append((ROOT, bucket, s, len(at), shards, _pack(_steps(words[at]), upward[at])))
        pairs = self.asked_pairs
        partial = np.bincount(self.pair, self.leaf.tables, len(self.upper.at)).astype("<i8")
        if len(pairs):
            keys = self.upper.keys[pairs]
            near, word = (self.words[x].astype("i8") for x in (self.nears[self.upper.at[pairs]], self.pair_word[pairs]))
            customers, base = partial[pairs], rounded(self.base[self.pair_word[pairs]])
            for s, at in sharded(keys, shards)[1]:
                steps = np.diff(near[at], prepend=-1)
                rows.append((SHARED, bucket, s, len(at), shards, _pack(steps, _afresh(word[at], steps != 0), customers[at], base[at])))
        own = [np.bincount(np.minimum(x[x > 0], 3), minlength=4)[1:3] for x in (np.where(self.is_hot, 0, self.upper.customers), self.count)]
        sums = np.zeros(4)
        if shared is not None:
            local = ~self.shared_parent
            sums = np.concatenate((auxiliary(self.upper_customers(shared)[local], self.upper.in_all[local], shared.discounts[1], shared.strengths[1]), auxiliary(self.leaf_customers, self.leaf.in_all, shared.discounts[2], shared.strengths[2])))
        in_hot = np.bincount(self.upper.at[self.is_hot], partial[self.is_hot], len(self.nears))
        some = np.flatnonzero(in_hot)
        rows.append((FACTS, bucket, 0, 8, len(some), _pack(np.concatenate((*own, sums)).astype("<f8"), self.words[self.nears[some]].astype("<u8"), in_hot[some].astype("<f8"))))
        return rows


# Rounds


def bucket_of(table: pa.Table, hot: np.ndarray) -> tuple[int, Bucket]:
    rows = table.to_pylist()
    return rows[0]["bucket"], Bucket(rows, hot)


@dataclass
class Dealt:
    """The dealt triples: a frame, partitioned by bucket, for each range of buckets."""

    frames: list[DataFrame]
    ranges: list[range]

    @classmethod
    def of(cls, cold: Dealt | DataFrame) -> Dealt:
        """All buckets in one frame are one range."""
        return cold if isinstance(cold, Dealt) else cls([cold], [range(1 << 31)])

    def each(self, run, replies: DataFrame | None, together) -> DataFrame:
        """The rows that `run` makes of every bucket, or `together` of every bucket and its replies."""
        out = None
        for frame, own in zip(self.frames, self.ranges, strict=True):
            groups = frame.groupBy("bucket")
            if replies is None:
                part = groups.applyInArrow(run, _ROWS)
            else:
                part = groups.cogroup(replies.where(F.col("bucket").between(own.start, own.stop - 1)).groupBy("bucket")).applyInArrow(together, _ROWS)
            out = part if out is None else out.unionAll(part)
        return out


def emitted(cold: Dealt, replies: DataFrame | None, shards: int, hot: np.ndarray, shared: Shared | None) -> DataFrame:
    """The buckets' rows for the shards, after sweeps where the root is known."""
    held = cold.frames[0].sparkSession.sparkContext.broadcast((hot, shared))

    def begin(key, table):
        number, bucket = bucket_of(table, held.value[0])
        return pa.Table.from_batches([_rows(bucket.out(number, shards, None))])

    def go_on(key, table, replies):
        hot, shared = held.value
        number, bucket = bucket_of(table, hot)
        bucket.take(shared, replies)
        for nth in range(WARM_UP):
            bucket.sweep(shared, nth)
        return pa.Table.from_batches([_rows(bucket.out(number, shards, shared))])

    return cold.each(begin, replies, go_on)


def _merged(rows: list[dict], kinds: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys of the rows, each row's places among them one after another, the columns, and where rows start."""
    parts = [_unpack(r["packed"], ("<u8", r["n"]), *[(k, r["n"]) for k in kinds]) for r in rows]
    keys, place = np.unique(np.concatenate([np.cumsum(p[0], dtype="u8") for p in parts]), return_inverse=True)
    return keys, place, [np.concatenate([p[k + 1] for p in parts]) for k in range(len(kinds))], np.cumsum([0, *(r["n"] for r in rows)])


def seat_pairs(emitted_: DataFrame, shards: int, shared: Shared | None, nth: int) -> DataFrame:
    """Seats the dishes of the shared parents: replies to the buckets, their tables for the root, and sums by parent."""
    held = emitted_.sparkSession.sparkContext.broadcast(shared)

    def run(key, table):
        shared, rows, out = held.value, table.to_pylist(), []
        parts = [_unpack(r["packed"], *[("<i8", r["n"])] * 3, ("<f4", r["n"])) for r in rows]
        near = np.concatenate([np.cumsum(p[0]) - 1 for p in parts]).astype("u8")
        word = np.concatenate([_summed(p[1], p[0] != 0) for p in parts]).astype("u8")
        customers, base = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
        edges = np.cumsum([0, *(r["n"] for r in rows)])
        keys, first, place = np.unique(pair_keys(near, word), return_index=True, return_inverse=True)
        total = np.bincount(place, customers, len(keys)).astype("i8")
        near, word, base = near[first], word[first], base[first].astype("f8")
        tables = np.minimum(total, 1)
        if shared is not None:
            at = np.searchsorted(shared.hot, near)
            level = Level(at, keys, total, tables, shared.hot_tables.astype("i8"))
            level.start(base, shared.discounts[1], shared.strengths[1], 1, 2_000 + nth)
            level.reseat(base, shared.discounts[1], shared.strengths[1], 1, 1_000 + nth)
        for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True):
            out.append((SHARED, r["bucket"], r["part"], r["n"], shards, _pack(total[place[a:b]], tables[place[a:b]])))
        words, at = np.unique(word, return_inverse=True)
        up = np.bincount(at, tables, len(words)).astype("<i8")
        for s, some in sharded(words, shards)[1]:
            out.append((ROOT, -1, s, len(some), shards, _pack(_steps(words[some]), up[some])))
        parents, at = np.unique(near, return_inverse=True)
        facts = [np.bincount(at, x, len(parents)) for x in (tables, total == 1, total == 2)]
        out.append((FACTS, -1, key[0].as_py(), 0, len(parents), _pack(parents, *facts)))
        return pa.Table.from_batches([_rows(out)])

    return emitted_.where(F.col("kind") == SHARED).groupBy("part").applyInArrow(run, _ROWS)


def seat_root(rows: DataFrame, shards: int, shared: Shared | None, nth: int) -> DataFrame:
    """Seats the root's dishes: replies to the buckets, and sums."""
    held = rows.sparkSession.sparkContext.broadcast(shared)

    def run(key, table):
        shared, rows, out = held.value, table.to_pylist(), []
        keys, place, (customers,), edges = _merged(rows, ["<i8"])
        total = np.bincount(place, customers, len(keys)).astype("<i8")
        tables = np.minimum(total, 1)
        if shared is not None:
            level = Level(np.zeros(len(keys), "i8"), mix(keys), total, tables, np.array([int(shared.tables)]))
            base = np.full(len(keys), 1 / (shared.vocabulary + 1))
            level.start(base, shared.discounts[0], shared.strengths[0], 0, 2_000 + nth)
            level.reseat(base, shared.discounts[0], shared.strengths[0], 0, nth)
        for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True):
            if r["bucket"] >= 0:
                out.append((ROOT, r["bucket"], r["part"], r["n"], shards, _pack(total[place[a:b]], tables[place[a:b]])))
        facts = [total.sum(), tables.sum(), (total == 1).sum(), (total == 2).sum()]
        out.append((FACTS, -1, key[0].as_py(), 4, 0, _pack(np.array(facts, "<f8"))))
        return pa.Table.from_batches([_rows(out)])

    return rows.where(F.col("kind") == ROOT).groupBy("part").applyInArrow(run, _ROWS)


def _facts(rows: DataFrame) -> Iterator[dict]:
    """The driver's rows: a few numbers for each bucket or shard, and for each shared parent in it."""
    for r in rows.where(F.col("kind") == FACTS).coalesce(4).toLocalIterator():
        yield r.asDict() | {"packed": bytes(r.packed)}


def _discount(one: float, two: float) -> float:
    return float(np.clip((one + 0.5) / (one + 2 * two + 1), 0.05, 0.95))


def learn(cold: Dealt | DataFrame, buckets: int, hot: np.ndarray, vocabulary: float) -> tuple[Shared, DataFrame]:
    """The sums, and what the buckets need to know of the shared restaurants."""
    cold = Dealt.of(cold)
    shards = _shards(cold.frames[0], buckets)
    shared, replies, sources = None, None, ()
    for nth in range(ROUNDS):
        rows = emitted(cold, replies, shards, hot, shared).checkpoint()
        discard(*sources)
        own, customers = np.zeros(8), np.zeros(len(hot))
        for r in _facts(rows):
            sums, words, n = _unpack(r["packed"], ("<f8", 8), ("<u8", r["m"]), ("<f8", r["m"]))
            own += sums
            np.add.at(customers, np.searchsorted(hot, words), n)
        tables, ones = np.zeros(len(hot)), np.zeros(2)
        upward = rows.where(F.col("kind") == ROOT)
        pairs = None
        if len(hot):
            pairs = seat_pairs(rows, shards, shared, nth).checkpoint()
            for r in _facts(pairs):
                words, t, one, two = _unpack(r["packed"], ("<u8", r["m"]), *[("<f8", r["m"])] * 3)
                np.add.at(tables, np.searchsorted(hot, words), t)
                ones += one.sum(), two.sum()
            upward = upward.unionByName(pairs.where(F.col("kind") == ROOT))
        seated = seat_root(upward, shards, shared, nth).checkpoint()
        root = sum((_unpack(r["packed"], ("<f8", 4))[0] for r in _facts(seated)), np.zeros(4))
        if shared is None:
            discounts = _discount(root[2], root[3]), _discount(own[0] + ones[0], own[1] + ones[1]), _discount(own[2], own[3])
            strengths = STRENGTH
        else:
            discounts, before = shared.discounts, shared.strengths
            sums = own[4:].reshape(2, 2)
            sums[0] += auxiliary(customers, tables, discounts[1], before[1])
            top = auxiliary(root[:1], root[1:2], discounts[0], before[0])
            strengths = tuple(float((1 + a) / (1 + b)) for a, b in (top, *sums))
        shared = Shared(discounts, strengths, root[0], root[1], vocabulary, hot, customers, tables)
        replies = seated.where(F.col("kind") == ROOT)
        if pairs is not None:
            replies = replies.unionByName(pairs.where((F.col("kind") == SHARED) & (F.col("bucket") >= 0)))
        discard(rows)
        sources = seated, pairs
        del rows, upward, pairs, seated
        release(cold.frames[0])
    return shared, replies


def _shards(frame: DataFrame, buckets: int) -> int:
    return max(1, min(buckets, frame.sparkSession.sparkContext.defaultParallelism), buckets // 8)


def rounded(p: np.ndarray) -> np.ndarray:
    """To 16 significant bits: a base-10 logarithm changes by 7e-6 at most, to either side."""
    return ((p.astype("<f4").view("<u4") + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view("<f4")


def probabilities(cold: Dealt | DataFrame, replies: DataFrame, hot: np.ndarray, shared: Shared) -> DataFrame:
    """For each chunk and bucket, its triples' probabilities."""
    cold = Dealt.of(cold)
    held = cold.frames[0].sparkSession.sparkContext.broadcast((hot, shared))

    def run(key, table, replies):
        hot, shared = held.value
        number, bucket = bucket_of(table, hot)
        bucket.take(shared, replies)
        p = np.zeros(len(bucket.word))
        for nth in range(WARM_UP + SAMPLES):
            bucket.sweep(shared, nth)
            if nth >= WARM_UP:
                p += bucket.probability(shared) / SAMPLES
        p = rounded(p)[bucket.triple]
        return pa.Table.from_batches([_rows([(TRIPLES, number, part, int(b - a), 0, _pack(p[a:b])) for part, a, b in zip(bucket.parts, bucket.edges[:-1], bucket.edges[1:], strict=True)])])

    return cold.each(None, replies, run)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text")
    with setting(spark, _REMOVE_SHUFFLES, "true"):
        coded = chunk_rows(docs).checkpoint()
        total = coded.agg(F.sum("n_tokens")).first()[0] or 0
        buckets = max(1, -(-total // BUCKET_TOKENS), min(spark.sparkContext.defaultParallelism, -(-total // 1000)))
        chunks, vocabulary, tokens, hot, times, numbers = numbered_and_counted(coded, _shards(docs, buckets), total)
        pieces = pieces_of(times, buckets)
        chunks = chunks.checkpoint()
        discard(coded, numbers)
        del coded, numbers
        release(docs)
        edges = [buckets * k // min(DEALS, buckets) for k in range(min(DEALS, buckets) + 1)]
        cold = Dealt([], [range(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        for own in cold.ranges:
            with setting(spark, "spark.sql.adaptive.enabled", "false"):  # a fixed plan's checkpoint keeps its partitioning
                cold.frames.append(deal(chunks, buckets, hot, pieces, own).repartition(min(len(own), 20_000), "bucket").checkpoint())
            release(docs)
        shared, replies = learn(cold, buckets, hot, vocabulary)
        found = probabilities(cold, replies, hot, shared).checkpoint()
        discard(*cold.frames)
        del cold, replies
        release(docs)
    known = spark.sparkContext.broadcast((hot, pieces))

    def meet(key, left, right):
        out: list[list] = [[] for _ in range(6)]
        for row in right.to_pylist():
            chunk = Chunk.of(row)
            bucket, _, _, word, own = chunk.triples(buckets, *known.value)
            p = np.zeros(len(word))
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for part in left.to_pylist():
                p[edges[part["bucket"]] : edges[part["bucket"] + 1]] = _unpack(part["packed"], ("<f4", part["n"]))[0]
            doc, n = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes), chunk.trained_words[chunk.tokens]
            s, b, k = (np.bincount(doc, x, len(chunk.sizes)) for x in (np.log10(p)[own], np.log10(n + 1.0), n > 0))
            base = b - chunk.sizes * np.log10(tokens + vocabulary + 1)
            for column, x in zip(out, (np.array(row["ids"], object), np.arange(len(base)) >= chunk.n_train, chunk.sizes, k.astype("i8"), base, s), strict=True):
                column += x.tolist()
        out.insert(4, [int(tokens)] * len(out[0]))
        types = id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = arrow_type(kind)
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return found.groupBy("part").cogroup(chunks.groupBy("part")).applyInArrow(meet, schema)
