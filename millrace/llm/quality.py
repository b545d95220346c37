"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader (operator 4)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import kept, list_array, slices, texts
from millrace.llm.labelled import in_fold, sample

BITS = 18
SCALE = 10.0
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
MARKS = bytes(32 if b <= 32 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else b for b in range(256))
SAME, MARK, PAIR, CAPITALS = (np.uint32(zlib.crc32(x)) for x in (b"same", b"mark", b"pair", b"capitals"))
MANY = np.uint32(2654435761)


class Hashes(dict):
    """crc32 of words; at most `most` are kept."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


def ngrams(text: str, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and their counts for each word of the text, times SCALE.

    The n-grams are words, pairs of words, runs of marks between them, pairs of such runs, and, whatever the
    words, "this word repeats one of the four before it" and "this word is in capitals".
    """
    raw = text.encode("utf-8", "surrogatepass")
    words, marks = raw.translate(WORDS).split(), raw.translate(MARKS).split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint32, len(words))
    m = np.fromiter(map(hashes.__getitem__, marks), np.uint32, len(marks)) ^ MARK
    mixed = [w, w[:-1] * MANY + w[1:] ^ PAIR, m, m[:-1] * MANY + m[1:]]
    for lag in range(1, 5):
        mixed.append(np.full(int((w[lag:] == w[:-lag]).sum()), SAME + np.uint32(lag), np.uint32))
    mixed.append(np.full(sum(map(bytes.isupper, raw.split())), CAPITALS, np.uint32))
    h = np.concatenate(mixed)
    index, count = np.unique((h * MANY) >> np.uint32(32 - BITS), return_counts=True)
    return index.astype(np.int32), (count * (SCALE / max(len(words), 1))).astype(np.float32)


def fit(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1) -> np.ndarray:
    """Weights (the last is the intercept's) by the FTRL-proximal rule, one row at a time."""
    rows = list(rows)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for index, value, label in rows:
            i, x = np.append(index, 1 << BITS), np.append(value, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange((1 << BITS) + 1)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 4, fold: int = 2, most: int = 6000) -> np.ndarray:
    """Weights fitted on at most `most` labelled documents outside the fold: n-grams are counted where the
    documents are, and one task, which reads `most` sparse rows, fits. Without labelled rows all weights are 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept("hashes", Hashes)
        for b in slices(batches):
            got = [ngrams(t, hashes) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("place"), b.column("label"), list_array([i for i, _ in got], pa.int32()), list_array([v for _, v in got], pa.float32())], ["place", "label", "i", "v"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["i"].values.to_numpy(), r["v"].values.to_numpy(), y) for b in batches for y, r in zip(b.column("label").to_pylist(), ({c: b.column(c)[k] for c in "iv"} for k in range(b.num_rows)), strict=True)]
        yield pa.record_batch([pa.array([fit(rows).tobytes()], pa.binary())], ["weights"])

    rows = sample(docs, labels, column, folds, fold, most).mapInArrow(count, "place long, label int, i array<int>, v array<float>")
    fitted = rows.repartition(1).sortWithinPartitions("place", "label", "i").mapInArrow(one, "weights binary")
    got = fitted.first()
    return np.frombuffer(got.weights, np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score (0 to 1) of every row: the logistic function of a sparse dot product."""
    packed = weights.tobytes()  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, w = kept("hashes", Hashes), np.frombuffer(packed, np.float32)
        for b in slices(batches):
            dots = [float(w[i] @ v + w[-1]) for i, v in (ngrams(t, hashes) for t in b.column("text").to_pylist())]
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(np.array(dots, np.float64), -35, 35))))], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 4, fold: int = 2, least: float = 0.7, most: int = 6000) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `least` on) of every document.

    A null text is scored as the empty one, whose score is the intercept's; rows with a null or repeated doc_id
    are scored like any others; an empty table gives no rows; without labels every score is 0.5. Other columns
    (lang, source, labels joined by the caller) are never read.
    """
    out = score(docs, train(docs, labels, column, folds, fold, most))
    return out.select("doc_id", in_fold(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
