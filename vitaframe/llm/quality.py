"""Quality by ordinal cumulative-link regression on hashed text.

Grades 0 < 1 < ... < K share one weight vector; ordered thresholds t_1 < t_2 < ... < t_K give
P(grade >= k) = sigmoid(w.x - t_k), from which the expected grade and the tail probability for
selection follow. x holds, for the whole text, the share of words in each hashed bucket: of the word
itself, of its shape (letter case, digits, the punctuation around it) and of whether it repeats the word
before it.

Grades may be any numbers, whole or not, up to MAX_GRADES of them (more raise an error). Fitting takes at most `sample` rows per
grade, those with the smallest digests, and `bound` rows in all: with more grades than bound / sample, each
gives as many rows as that leaves it (one at least). These few rows, each as its buckets and their counts, are fitted in
one task, so that the driver gets the weights alone. Defined results: empty and null texts have x = 0, so they get the
thresholds' own probabilities; grades that are null, NaN or infinite and documents with disagreeing grades take no part
in fitting; a labelled id with several texts is fitted with the smallest of them; grades of one kind only, or none, give the constant grade (0
for none) and keep everything; extra columns pass through `select_quality`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.llm.common import arrow_map, byte_rows, plain_words, prepare, quoted

BUCKETS = 1 << 16
SHAPES = 1 << 10
SCALE = 20.0
SAMPLE = 4000
#: Rows to fit on, over all grades.
BOUND = 64_000
MAX_GRADES = 1000
STEPS = 120
PENALTY = 1e-4
#: Documents with less than this probability of a grade from the middle threshold up are rejected.
KEEP = 0.5
_CLASSES = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


class Coder:
    """Buckets of words, remembered for the words seen last."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, int]] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        """Bucket numbers, three for each word of the text."""
        words = plain_words(text)
        known, out = self.known, []
        for w in words:
            code = known.get(w)
            if code is None:
                shape = _RUNS.sub(rb"\1", w.translate(_CLASSES))
                code = zlib.crc32(w.lower()) % BUCKETS, BUCKETS + zlib.crc32(shape) % SHAPES
                if len(known) > 500_000:
                    known.clear()
                known[w] = code
            out.append(code)
        if not out:
            return np.zeros(0, "i4")
        pairs = np.array(out, "i4")
        same = np.zeros(len(words), "i4")
        same[1:] = (pairs[1:, 0] == pairs[:-1, 0]) & (pairs[1:, 1] == pairs[:-1, 1])
        return np.concatenate((pairs.ravel(), BUCKETS + SHAPES + same))


@dataclass
class Ordinal:
    """Weights by bucket and the ordered thresholds of grades 1 .. K (values in `grades`)."""

    weights: np.ndarray
    limits: np.ndarray
    grades: list[float]

    def tails(self, codes: list[np.ndarray]) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1 .. K, shape (n, K)."""
        z = np.array([SCALE * self.weights[c].sum(dtype="f8") / (len(c) / 3) if len(c) else 0.0 for c in codes])
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.limits, -30, 30)))


def fit_ordinal(codes: list[np.ndarray], grades: np.ndarray, steps: int = STEPS) -> Ordinal:
    """The model of texts' buckets and grades."""
    return fit_counted([np.unique(c, return_counts=True) for c in codes], grades, steps)


def fit_counted(counted: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, steps: int = STEPS) -> Ordinal:
    """Full-batch Adam on the cumulative-link likelihood, each grade weighing the same. counted: each text's distinct buckets and their counts."""
    values = sorted(set(grades.tolist()))
    size = BUCKETS + SHAPES + 2
    if len(values) < 2:
        return Ordinal(np.zeros(size), np.zeros(0), values or [0])
    rank = np.searchsorted(values, grades)
    k = len(values) - 1
    weight = 1.0 / np.bincount(rank)[rank] / (k + 1)
    flat = np.concatenate([d[0] for d in counted])
    own = np.repeat(np.arange(len(counted)), [len(d[0]) for d in counted])
    share = np.concatenate([SCALE * d[1] / max(d[1].sum() / 3, 1) for d in counted])
    w, gaps, first = np.zeros(size), np.zeros(k - 1), 0.0
    moments = [np.zeros((2, size)), np.zeros((2, k - 1)), np.zeros((2, 1))]
    for tick in range(1, steps + 1):
        limits = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        z = np.bincount(own, w[flat] * share, len(counted))
        q = 1 / (1 + np.exp(-np.clip(z[:, None] - np.concatenate(([-1e9], limits, [1e9])), -30, 30)))
        q[:, 0], q[:, -1] = 1.0, 0.0
        rows = np.arange(len(counted))
        high, low = q[rows, rank], q[rows, rank + 1]
        p = np.maximum(high - low, 1e-9)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        dz = -weight * (slope_high - slope_low) / p
        dlimit = np.zeros(k + 2)
        np.add.at(dlimit, rank, weight * slope_high / p)
        np.add.at(dlimit, rank + 1, -weight * slope_low / p)
        dlimit = dlimit[1:-1]
        gradients = [np.bincount(flat, dz[own] * share, size) + PENALTY * w, np.cumsum(dlimit[::-1])[::-1][1:] * np.exp(gaps), np.array([dlimit.sum()])]
        for value, gradient, m, rate in ((w, gradients[0], moments[0], 0.05), (gaps, gradients[1], moments[1], 0.05)):
            m[0] += 0.1 * (gradient - m[0])
            m[1] += 0.01 * (gradient * gradient - m[1])
            value -= rate * (m[0] / (1 - 0.9**tick)) / (np.sqrt(m[1] / (1 - 0.99**tick)) + 1e-8)
        m = moments[2]
        m[0] += 0.1 * (gradients[2] - m[0])
        m[1] += 0.01 * (gradients[2] ** 2 - m[1])
        first -= 0.05 * float((m[0] / (1 - 0.9**tick) / (np.sqrt(m[1] / (1 - 0.99**tick)) + 1e-8))[0])
    limits = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    return Ordinal(w, limits, values)


def fit(docs: DataFrame, labels: DataFrame, grade: str = "quality", sample: int = SAMPLE, bound: int = BOUND) -> Ordinal:
    prepare(docs.sparkSession)
    value = F.col(grade).cast("double")
    known = labels.select("doc_id", value.alias("grade")).where("doc_id is not null and not isnan(grade) and abs(grade) < double('inf')")
    known = known.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.max("grade").alias("most")).where("grade = most").select("doc_id", "grade")
    known = known.checkpoint()
    kinds = known.select("grade").distinct().count()
    if kinds > MAX_GRADES:
        raise ValueError(f"{kinds} grades; an ordinal scale may have {MAX_GRADES}")
    each = min(sample, max(1, bound // max(kinds, 1)))
    nearest = Window.partitionBy("grade").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id")
    chosen = known.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= each).drop("nth")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # one an id, at most `bound` rows

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            counted = [np.concatenate(np.unique(coder(t), return_counts=True)).astype("<i4").tobytes() for t in byte_rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(counted, pa.binary())], ["grade", "counted"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(x for batch in batches for x in zip(batch.column("grade").to_pylist(), batch.column("counted").to_pylist(), strict=True))
        if got:
            model = fit_counted([tuple(np.frombuffer(c, "<i4").reshape(2, -1)) for _, c in got], np.array([g for g, _ in got], "f8"))
            many = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f8").tobytes()], pa.binary()), pa.array([model.limits], many), pa.array([model.grades], many)], ["weights", "limits", "grades"])

    # At most `bound` rows go to the one task.
    fitted = arrow_map(arrow_map(rows, encode, "grade double, counted binary").repartition(1), learn, "weights binary, limits array<double>, grades array<double>").collect()
    return Ordinal(np.frombuffer(fitted[0].weights, "<f8"), np.array(fitted[0].limits, "f8"), fitted[0].grades) if fitted else fit_counted([], np.zeros(0))


def _scores(model: Ordinal, coder: Coder, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and tail probability of the middle threshold."""
    if not len(model.limits):
        return np.full(len(texts), float(model.grades[0])), np.ones(len(texts))
    tails = model.tails([coder(t) for t in texts])
    return model.grades[0] + tails @ np.diff(model.grades), tails[:, len(model.limits) // 2]


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail_probability and keep."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            grade, tail = _scores(held.value, coder, byte_rows(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(grade), pa.array(tail), pa.array(tail >= KEEP)], ["doc_id", "expected_grade", "tail_probability", "keep"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_probability double, keep boolean")


def select_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, as they are."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            _, tail = _scores(held.value, coder, [t or b"" for t in texts])
            yield batch.filter(pa.array(tail >= KEEP))

    return arrow_map(docs, run, quoted(docs))
