"""Similarity of texts by the vectors of their tokens, with every distinct token embedded once."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Maps a batch of tokens to their vectors, as rows of a matrix.
Embedder = Callable[[list[str]], np.ndarray]
#: Tokens handed to the model at once, and rows of a matrix that are matched at once.
BATCH_TOKENS, BLOCK = 1024, 512


def hashed_vectors(tokens: list[str], size: int = 64) -> np.ndarray:
    """Offline stand-in for a model: letter trigrams by hash. It says nothing about a model's quality."""
    out = np.zeros((len(tokens), size))
    for row, token in zip(out, tokens, strict=True):
        padded = f"#{token}#"
        for k in range(len(padded) - 2):
            row[zlib.crc32(padded[k : k + 3].encode()) % size] += 1.0
    return out


def greedy_f1(a: np.ndarray, b: np.ndarray, a_times: np.ndarray, b_times: np.ndarray) -> float:
    """F1 of the mean best cosine of each side's tokens. a, b: unit vectors of distinct tokens; times: how often each stands there.

    The matrix of cosines is made block by block, so that long texts don't need it whole.
    """
    best_a, best_b = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            like = a[i : i + BLOCK] @ b[j : j + BLOCK].T
            best_a[i : i + BLOCK] = np.maximum(best_a[i : i + BLOCK], like.max(1))
            best_b[j : j + BLOCK] = np.maximum(best_b[j : j + BLOCK], like.max(0))
    precision, recall = np.average(best_a, weights=a_times), np.average(best_b, weights=b_times)
    return float(2 * precision * recall / (precision + recall)) if precision + recall > 0 else 0.0


def token_vectors(tokens: DataFrame, embedder: Callable[[], Embedder]) -> DataFrame:
    """(token, vector) with unit vectors, for tokens that are distinct; the model is built once a task. A zero vector stays zero."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = embedder()
        for frame in frames:
            for at in range(0, len(frame), BATCH_TOKENS):
                lot = frame["token"].iloc[at : at + BATCH_TOKENS].tolist()
                found = np.asarray(embed(lot), float)
                found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"token": lot, "vector": list(found)})

    return tokens.select("token").mapInPandas(run, "token string, vector array<double>")


def semantic_scores(frame: DataFrame, pred: str, truth: str, embedder: Callable[[], Embedder], name: str = "score") -> DataFrame:
    """The frame with the greedy-match cosine F1 of two text columns; null where a text is null or has no tokens.

    Tokens are parted by white space, in lower case. Distinct tokens are embedded, distinct texts get their vectors by a
    join on tokens, distinct pairs are scored; a token, text or pair that comes up often costs as much as a rare one.
    """
    pairs = frame.select(F.col(pred).alias("p"), F.col(truth).alias("t")).where("p is not null and t is not null").distinct()
    texts = pairs.select(F.col("p").alias("text")).union(pairs.select("t")).distinct()
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    tokens = texts.select("text", F.explode(words).alias("token")).groupBy("text", "token").agg(F.count("*").alias("times"))
    vectors = token_vectors(tokens.select("token").distinct(), embedder).persist()  # the model is asked once
    matrix = tokens.join(vectors, "token").groupBy("text").agg(F.sort_array(F.collect_list(F.struct("token", "times", "vector"))).alias("m"))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def sides(rows) -> tuple[np.ndarray, np.ndarray]:
            return np.array([r["vector"] for r in rows]), np.array([r["times"] for r in rows], float)

        for frame_ in frames:
            out = []
            for a, b in zip(frame_["a"], frame_["b"], strict=True):
                (va, na), (vb, nb) = sides(a), sides(b)
                out.append(greedy_f1(va, vb, na, nb))
            yield frame_[["p", "t"]].assign(score=out)

    both = pairs.join(matrix.select(F.col("text").alias("p"), F.col("m").alias("a")), "p").join(matrix.select(F.col("text").alias("t"), F.col("m").alias("b")), "t")
    scored = both.select("p", "t", "a", "b").mapInPandas(score, "p string, t string, score double")
    scored = scored.select(F.col("p").alias("_p"), F.col("t").alias("_t"), F.col("score").alias(name))
    return frame.join(scored, (F.col(pred) == F.col("_p")) & (F.col(truth) == F.col("_t")), "left").drop("_p", "_t")
