"""What the two classifiers share: bounded training samples and word features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, words_of

WORD_BUCKETS, GRAM_BUCKETS, GRAM = 1 << 16, 1 << 16, 4
#: Characters of all texts of a training sample together, the last one taken whole; no text is left out for its own length.
SAMPLE_CHARS = 12_000_000


def fold(doc_id: str, mod: int = 3):
    """crc32 of the id as text, modulo ``mod``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod, F.lit(0))


def labelled_ids(labels: DataFrame, label: str, each: int) -> DataFrame:
    """``(doc_id, y)``: the ``each`` rows of either label that come first by a hash of the id,
    out of those that may be learnt from. A document with several labels counts as the largest."""
    rows = labels.where((fold("doc_id") != 1) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    by = F.xxhash64("doc_id", F.lit(1))
    return rows.where("y = 1").orderBy(by).limit(each).unionByName(rows.where("y = 0").orderBy(by).limit(each))


def gather(docs: DataFrame, ids: DataFrame, columns: list[str]) -> list:
    """The sampled documents, whole, sorted by id; of several rows of one id the least.

    ``ids`` has a bounded number of rows, so it may be broadcast. They are
    taken in the order of a hash of the id until their texts have
    ``SAMPLE_CHARS`` characters together, which bounds what comes to the
    driver, whatever the length of any one text (but for the last).
    """
    found = docs.select("doc_id", F.struct(*columns).alias("row")).join(F.broadcast(ids), "doc_id")
    found = settle(found.groupBy("doc_id", "y").agg(F.min("row").alias("row")))
    sizes = found.select("doc_id", F.coalesce(F.length("row.text"), F.lit(0)).alias("n"), F.xxhash64("doc_id", F.lit(3)).alias("by")).collect()
    taken, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["by"], r["doc_id"])):
        if total >= SAMPLE_CHARS:
            break
        taken.append(r["doc_id"])
        total += r["n"]
    if len(taken) < len(sizes):
        found = found.where(F.col("doc_id").isin(taken))
    return sorted(found.select("doc_id", "y", "row.*").collect(), key=lambda r: r["doc_id"])


class Words:
    """Numbers for distinct words from 1 up (0 is padding), with hashed word and character features."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def tokens(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        for w in dict.fromkeys(words):
            if w not in number:
                number[w] = len(number) + 1
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets; buckets of all character 4-grams; where each word's 4-grams start."""
        words = list(self.number)
        buckets = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORD_BUCKETS
        if not words:
            return buckets, np.empty(0, np.int64), np.empty(0, np.int64)
        data = np.frombuffer(b"".join(b"<" + w + b">>" for w in words) + b"\0\0\0", np.uint8).astype(np.uint32)
        n = np.fromiter(map(len, words), np.int64, len(words))
        code = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
        grams = (code * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64) % GRAM_BUCKETS
        ends = np.cumsum(n + 3)
        inside = np.ones(len(grams), bool)
        for back in (1, 2, 3):  # windows that reach into the next word
            inside[ends - back] = False
        return buckets, grams[inside], np.concatenate([[0], np.cumsum(n)[:-1]])


def chunks(texts, size: int) -> Iterator[tuple[int, int, list[bytes], np.ndarray]]:
    """Runs of texts of about ``size`` words: (from, to, their words, words of each)."""
    start, held, counts = 0, [], []
    for k, text in enumerate(texts):
        w = words_of(text)
        held += w
        counts.append(len(w))
        if len(held) >= size:
            yield start, k + 1, held, np.array(counts, np.int64)
            start, held, counts = k + 1, [], []
    if counts:
        yield start, start + len(counts), held, np.array(counts, np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """a and b of ``sigmoid(a x + b)``, by damped Newton steps on softened labels."""
    scale = max(float(np.std(x)), 1e-9)
    w1, w0 = max((weight * y).sum(), 1e-9), max((weight * (1 - y)).sum(), 1e-9)
    t = np.where(y == 1, (w1 + 1) / (w1 + 2), 1 / (w0 + 2))
    design = np.stack([x / scale, np.ones_like(x)], 1)
    start = np.array([1.0, 0.0])

    def loss(beta: np.ndarray) -> float:
        u = design @ beta
        return float((weight * (np.logaddexp(0, u) - t * u)).sum() + ridge / 2 * ((beta - start) ** 2).sum())

    beta = start.copy()
    for _ in range(100):
        p = sigmoid(design @ beta)
        grad = design.T @ (weight * (p - t)) + ridge * (beta - start)
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        while loss(beta - step) > loss(beta) and np.abs(step).max() > 1e-9:
            step /= 2
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]) / scale, 1e-6), float(beta[1])
