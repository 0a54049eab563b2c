"""Language of texts by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and brought to their letters, with one space for
whatever stands between words and around them. All n-grams of 1 to 4
characters of all labelled texts are counted, by language and hash bucket, in
running totals of each task that are summed up in one shuffle. The matrix of
log probabilities has a bounded number of cells and is broadcast; a batch of
texts is scored by gathering its n-grams' columns and summing them by text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the longest n-gram; all lengths from 1 up are used.
LONGEST = 4
#: Hash buckets at most; languages at most, the commonest first; languages times buckets at most.
BUCKETS, LANGUAGES, CELLS = 1 << 16, 1024, 1 << 23
#: What is added to every count.
SMOOTHING = 0.5
#: Characters that are turned into n-grams at a time.
PIECE = 1 << 20
UNDETERMINED = "und"


def letters(text: Column) -> Column:
    """Words of letters and their marks in lower case, a space between them; null where there is no letter."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))
    return F.when(text.rlike(r"\p{L}"), words)


def held_out(doc_id: str = "doc_id", mod: int = 4, rest: int = 2) -> Column:
    """crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of characters of about ``PIECE``, long texts in several: the characters, and of each stretch the text it
    belongs to, its length, and how many of its characters start n-grams; the others only end those of this stretch."""
    held, of, starts, size = [], [], [], 0
    for k, text in enumerate(texts):
        text = f" {text} "
        for a in range(0, len(text), PIECE):
            held.append(text[a : a + PIECE + LONGEST - 1])
            of.append(k)
            starts.append(min(PIECE, len(text) - a))
            size += starts[-1]
            if size >= PIECE:
                yield _stretches(held, of, starts)
                held, of, starts, size = [], [], [], 0
    if held:
        yield _stretches(held, of, starts)


def _stretches(held: list[str], of: list[int], starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.array(of, np.int64), np.fromiter(map(len, held), np.int64, len(held)), np.array(starts, np.int64)


def grams(codes: np.ndarray, lengths: np.ndarray, starts: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-gram the buckets of all of them, and how many each stretch has."""
    ends = np.cumsum(lengths)
    stretch = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(codes))
    may_start = at < (ends - lengths + starts)[stretch]
    room = ends[stretch] - at
    h = np.zeros(len(codes), np.uint32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for n in range(1, LONGEST + 1):
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
        inside = may_start[: len(h)] & (room[: len(h)] >= n)
        yield (h[inside] ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> shift, np.bincount(stretch[: len(h)][inside], minlength=len(lengths))


def _count(numbers: dict[str, int], buckets: int):
    """Totals of a task, by language and bucket, in one running array."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(len(numbers) * buckets, np.int64)
        for pdf in parts:
            language = pdf["lang"].map(numbers).to_numpy(np.int64)
            for codes, of, lengths, starts in pieces(pdf["letters"].to_list()):
                row = language[of] * buckets
                for found, sizes in grams(codes, lengths, starts, buckets):
                    cells, n = np.unique(np.repeat(row, sizes) + found, return_counts=True)
                    totals[cells] += n
        at = np.flatnonzero(totals)
        for a in range(0, len(at), 1 << 16):
            yield pd.DataFrame({"cell": at[a : a + (1 << 16)], "n": totals[at[a : a + (1 << 16)]]})

    return count


class Model:
    """Languages in order, the logarithm of each one's share of texts, and a row of log probabilities for each."""

    def __init__(self, names: list[str], prior: np.ndarray, weights: np.ndarray):
        self.names, self.prior, self.weights = names, prior, weights

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each text's language, and its probability; n-grams that overlap count together once."""
        scores = np.zeros((len(self.names), len(texts)))
        for codes, of, lengths, starts in pieces(texts):
            for found, sizes in grams(codes, lengths, starts, self.weights.shape[1]):
                some = np.flatnonzero(sizes)
                first = np.cumsum(sizes)[some] - sizes[some]
                for k, row in enumerate(self.weights):
                    if len(some):
                        np.add.at(scores[k], of[some], np.add.reduceat(row[found].astype(np.float64), first))
        scores = scores / LONGEST + self.prior[:, None]
        best = scores.argmax(0)
        return best, 1 / np.exp(scores - scores.max(0)).sum(0)


def train(docs: DataFrame) -> Model | None:
    """The model of all ``(letters, lang)`` whose text has letters; None where there are none.

    The languages that are learnt are the ``LANGUAGES`` commonest, so the
    matrix is bounded; with more than ``CELLS / BUCKETS`` of them each has
    fewer buckets. Every text of these languages is counted.
    """
    rows = docs.where(F.col("letters").isNotNull() & F.col("lang").isNotNull())
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not known:
        return None
    known = sorted((r["lang"], r["n"]) for r in known)
    numbers = {name: k for k, (name, _) in enumerate(known)}
    buckets = min(BUCKETS, 1 << (CELLS // len(known)).bit_length() - 1)
    cells = rows.where(F.col("lang").isin(list(numbers))).select("letters", "lang").mapInPandas(_count(numbers, buckets), "cell long, n long")
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(known) * buckets)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    counts = counts.reshape(len(known), buckets) + SMOOTHING
    weights = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
    total = sum(n for _, n in known)
    return Model(list(numbers), np.array([math.log(n / total) for _, n in known]), weights)


def _predict(model: Broadcast):
    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            name, score = np.full(len(pdf), UNDETERMINED, object), np.zeros(len(pdf))
            at = np.flatnonzero(pdf["letters"].notna())
            if len(at):
                best, score[at] = model.value.predict(pdf["letters"].iloc[at].to_list())
                name[at] = np.array(model.value.names, object)[best]
            yield pdf[["doc_id", "held_out"]].assign(lang_pred=name, score=score)

    return predict


def predict_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each of ``(doc_id, text, lang)``, over whole texts.

    Learnt from the texts and languages of rows that aren't held out; rows of
    a null language are not learnt from. A null text, or one without letters,
    is ``und`` with a score of 0, and so is every text where no language was
    learnt. Null ids are learnt from and predicted; repeated rows count each;
    an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out().alias("held_out"), letters(F.col("text")).alias("letters"), "lang")
    model = train(rows.where("not held_out").select("letters", "lang"))
    rows = rows.select("doc_id", "held_out", "letters")
    if model is None:
        return rows.select(F.col("doc_id").cast("long"), "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = rows.mapInPandas(_predict(shared), "doc_id string, held_out boolean, lang_pred string, score double")
    return found.select(F.col("doc_id").cast("long"), "held_out", "lang_pred", "score")
