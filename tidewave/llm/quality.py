"""Quality by co-training of two views of a page.

One classifier sees the text: hashed words, character 4-grams and the layout's
proportions. The other sees what the page's record says beside the text, and
nothing of the text: source, language and the stated number of characters. Over
some rounds each is trained on its own labelled set and labels the unlabelled
documents that it is surest of, by its calibrated confidence, for the other. At the end both are calibrated
on labelled documents that neither learnt from, and their calibrated log odds
are combined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import GRAM_BUCKETS, WORD_BUCKETS, Words, chunks, fold, gather, labelled_ids, platt, sigmoid

#: Labelled rows of either label, and unlabelled rows, that are learnt from, at most.
SAMPLE_EACH, SAMPLE_UNLABELLED = 1000, 1000
ROUNDS, GIVEN, SURE = 3, 100, 0.95
#: Documents below this are rejected.
THRESHOLD = 0.3
SOURCE_BUCKETS, LANG_BUCKETS = 256, 64
CHUNK = 200_000
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
PLAIN = bytes({*range(65, 91), *range(97, 123), *range(128, 256), *b" \t\n\r\x0b\x0c0123456789"})


def layout(text: str | None, words: int, distinct: int) -> list[float]:
    """Numbers on the shape of a page, none on what it says."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(b))
    share = lambda chars: (len(b) - len(b.translate(None, chars))) / n
    lines = b.split(b"\n")
    return [
        np.log1p(len(b)), np.log1p(words), np.log1p(len(lines)), words / len(lines) / 50, share(UPPER), share(DIGITS), 1 - share(PLAIN),
        distinct / max(1, words), len(set(lines)) / len(lines), n / max(1, words) / 10,
    ]


#: Numbers of the layout, behind the words and grams of the text view; numbers and classes of the stated length.
SHAPE, SIZES, SIZE_CLASSES = 10, 1, 32
LAYOUT = WORD_BUCKETS + GRAM_BUCKETS
META = SIZES + SIZE_CLASSES + SOURCE_BUCKETS + LANG_BUCKETS
COLUMNS = ["text", "source", "lang", "n_chars"]


def content(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, tuple, np.ndarray]:
    """Token numbers, features and distinct words of each text."""
    book = Words()
    tokens = book.tokens(words)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    distinct = np.array([len(np.unique(tokens[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)
    return tokens, book.features(), distinct


def shapes(texts, counts: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    return np.array([layout(t, int(w), int(d)) for t, w, d in zip(texts, counts, distinct, strict=True)], np.float64).reshape(-1, SHAPE)


def metadata(sources, langs, sizes) -> tuple[np.ndarray, np.ndarray]:
    """The stated length (none counts as 0), and columns of its class, the source and the language."""
    n = np.array([0 if pd.isna(x) else max(0, int(x)) for x in sizes], np.int64)
    bucket = lambda v, m: np.fromiter((zlib.crc32(repr(x).encode("utf-8", "surrogatepass")) % m for x in v), np.int64, len(n))
    kind = np.fromiter((min(int(x).bit_length(), SIZE_CLASSES - 1) for x in n), np.int64, len(n))
    at = SIZES + SIZE_CLASSES
    return np.log1p(n)[:, None], np.stack([SIZES + kind, at + bucket(sources, SOURCE_BUCKETS), at + SOURCE_BUCKETS + bucket(langs, LANG_BUCKETS)], 1)


class Linear:
    """A logistic model of sparse rows ``(row, column, value)``, by Adam over the whole sample."""

    def __init__(self, size: int, ridge: float):
        self.w, self.b, self.ridge = np.zeros(size), 0.0, ridge

    def fit(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.3) -> Linear:
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        self.w[:], self.b = 0, 0.0
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for t in range(1, steps + 1):
            p = sigmoid(np.bincount(row, val * self.w[col], len(y)) + self.b)
            d = weight * (p - y)
            g = np.append(np.bincount(col, val * d[row], len(self.w)) + self.ridge * self.w, d.sum())
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w -= step[:-1]
            self.b -= step[-1]
        return self


class Model:
    """Both views and how their log odds combine."""

    def __init__(self):
        self.text = Linear(LAYOUT + SHAPE, 1e-3)
        self.meta = Linear(META, 1e-4)
        self.mean, self.scale = np.zeros(SHAPE), np.ones(SHAPE)
        self.size = (0.0, 1.0)
        self.calibration = ((1.0, 0.0), (1.0, 0.0))
        self.final = (1.0, 0.0)

    def text_logits(self, tokens: np.ndarray, features: tuple, counts: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """The mean over a text's words of what each word says, and what its layout says."""
        buckets, grams, starts = features
        of_word = np.zeros(len(buckets))
        if len(buckets):
            n = np.diff(np.append(starts, len(grams)))
            of_word = self.text.w[buckets] + np.add.reduceat(self.text.w[WORD_BUCKETS + grams], starts) / n
        total = np.concatenate([[0.0], np.cumsum(of_word[tokens - 1])])
        ends = np.cumsum(counts)
        said = SCALE * (total[ends] - total[ends - counts]) / np.maximum(counts, 1)
        return said + ((shape - self.mean) / self.scale) @ self.text.w[LAYOUT:] + self.text.b

    def meta_logits(self, meta: tuple) -> np.ndarray:
        size, columns = meta
        return ((size - self.size[0]) / self.size[1]) @ self.meta.w[:SIZES] + self.meta.w[columns].sum(1) + self.meta.b

    def combine(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        (a, b), (c, d) = self.calibration
        return sigmoid(self.final[0] * (a * text + b + c * meta + d) + self.final[1])

    def views(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        text, meta = [], []
        for i, j, words, counts in chunks(pdf["text"], CHUNK):
            rows = pdf.iloc[i:j]
            tokens, features, distinct = content(words, counts)
            text.append(self.text_logits(tokens, features, counts, shapes(rows["text"], counts, distinct)))
            meta.append(self.meta_logits(metadata(rows["source"], rows["lang"], rows["n_chars"])))
        return (np.concatenate(text), np.concatenate(meta)) if text else (np.empty(0), np.empty(0))


#: Mean frequencies are small; this brings their weights to the size of the step.
SCALE = 20.0


def _sparse(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The content view's rows: frequencies of words and, within words, of 4-grams."""
    counts = np.array([len(w) for w in words], np.int64)
    tokens, (buckets, grams, starts), _ = content([x for w in words for x in w], counts)
    n = np.diff(np.append(starts, len(grams)))
    rows, cols, vals = [], [], []
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        own, times = np.unique(tokens[a:b] - 1, return_counts=True)
        share = SCALE * times / max(1, b - a)
        at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(n[own])[:-1]]), n[own]) + np.arange(n[own].sum()) if len(own) else np.empty(0, np.int64)
        # half-width numbers: the sample's entries are the driver's largest arrays
        cols.append(np.concatenate([buckets[own], WORD_BUCKETS + grams[at]]).astype(np.int32))
        vals.append(np.concatenate([share, np.repeat(share / np.maximum(n[own], 1), n[own])]).astype(np.float32))
        rows.append(np.full(len(cols[-1]), i, np.int32))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def fit(pdf: pd.DataFrame, y: np.ndarray, negatives_weight: float = 1.0) -> Model:
    """Co-train on rows of (text, source, lang, n_chars); ``y`` is 1, 0, or -1 where unknown.

    A third of the labelled rows calibrates. ``negatives_weight``: rows of
    label 1 that each sampled one stands for, over that of label 0.
    """
    model = Model()
    y = np.asarray(y, np.int64)
    known = np.flatnonzero(y >= 0)
    if not len(known) or y[known].min() == y[known].max():
        model.final = (0.0, 4.0 if not len(known) or y[known[0]] else -4.0)
        return model
    words = [w for _, _, w, _ in chunks(pdf["text"], 1)] if len(pdf) else []
    counts = np.array([len(w) for w in words], np.int64)
    row, col, val = _sparse(words)
    vocabulary = np.array([len(set(w)) for w in words])
    shape = shapes(pdf["text"], counts, vocabulary)
    del words
    model.mean, model.scale = shape.mean(0), shape.std(0) + 1e-6
    each = np.arange(len(y), dtype=np.int32)
    row = np.concatenate([row, np.repeat(each, SHAPE)])
    col = np.concatenate([col, np.tile(np.arange(LAYOUT, LAYOUT + SHAPE, dtype=np.int32), len(y))])
    val = np.concatenate([val, ((shape - model.mean) / model.scale).ravel().astype(np.float32)])
    size, columns = metadata(pdf["source"], pdf["lang"], pdf["n_chars"])
    model.size = (float(size.mean()), float(size.std()) + 1e-6)
    m_row = np.concatenate([each, np.repeat(each, columns.shape[1])])
    m_col = np.concatenate([np.zeros(len(y), np.int64), columns.ravel()])
    m_val = np.concatenate([((size - model.size[0]) / model.size[1]).ravel(), np.ones(columns.size)])
    views = ((model.text, row, col, val), (model.meta, m_row, m_col, m_val))
    calibrating = np.zeros(len(y), bool)
    for label in (0, 1):
        calibrating[np.flatnonzero(y == label)[::3]] = True
    held = np.flatnonzero(calibrating)
    labels = [np.where(calibrating, -1, y) for _ in views]
    for round_ in range(ROUNDS + 1):
        said = []
        for (linear, r, c, v), own in zip(views, labels, strict=True):
            used = own >= 0
            number = (np.cumsum(used) - 1).astype(np.int32)
            at = used[r]
            linear.fit(number[r[at]], c[at], v[at], own[used].astype(float))
            del at
            said.append(np.bincount(r, v * linear.w[c], len(y)) + linear.b)
        if round_ == ROUNDS:
            break
        for own, other in ((0, 1), (1, 0)):
            free = (y < 0) & (labels[other] < 0)
            a, b = platt(said[own][held], y[held], np.ones(len(held)))  # a view that knows little is sure of little
            p = sigmoid(a * said[own] + b)
            for label, sure in ((1, p), (0, 1 - p)):
                at = np.flatnonzero(free & (sure >= SURE))
                labels[other][at[np.argsort(-sure[at], kind="stable")[:GIVEN]]] = label
    weight = np.where(y[held] == 1, negatives_weight, 1.0)
    model.calibration = tuple(platt(s[held], y[held], weight) for s in said)
    (a, b), (c, d) = model.calibration
    model.final = platt(a * said[0][held] + b + c * said[1][held] + d, y[held], weight)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn ``labels.quality`` from rows whose crc32 of the id, modulo 3, is not 1, and from unlabelled ones."""
    labels = labels.select("doc_id", "quality")
    ids = labelled_ids(labels, "quality", SAMPLE_EACH)
    by = F.xxhash64("doc_id", F.lit(2))
    free = docs.select("doc_id").where((fold("doc_id") != 1) & F.col("doc_id").isNotNull()).join(labels.select("doc_id"), "doc_id", "left_anti")
    ids = ids.unionByName(free.orderBy(by).limit(SAMPLE_UNLABELLED).select("doc_id", F.lit(-1).alias("y")))
    rows = gather(docs, ids, COLUMNS)
    n = dict(labels.where(fold("doc_id") != 1).groupBy("quality").count().collect())
    seen = max(1, sum(r["y"] == 1 for r in rows)) / max(1, sum(r["y"] == 0 for r in rows))
    pdf = pd.DataFrame([tuple(r[c] for c in COLUMNS) for r in rows], columns=COLUMNS)
    return fit(pdf, np.array([r["y"] for r in rows]), max(1.0, n.get(1, 0) / max(1, n.get(0, 0)) / seen))


def _score(model: Model):
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            text, meta = model.views(pdf)
            (a, b), (c, d) = model.calibration
            s = model.combine(text, meta)
            yield pdf[["doc_id", "held_out"]].assign(text_score=sigmoid(a * text + b), meta_score=sigmoid(c * meta + d), score=s, kept=s >= THRESHOLD)

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, text_score, meta_score, score, kept)`` for each of ``docs``, over whole texts.

    Null texts count as empty, null sources and languages are values of their
    own, a null length is 0. Null ids are scored and never learnt from; repeated rows are scored
    each; with no labels, or one, every score is that label's; an empty table
    gives no rows. Further columns are not read.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("string"), (fold("doc_id") == 1).alias("held_out"), *COLUMNS)
    scored = rows.mapInPandas(_score(model), "doc_id string, held_out boolean, text_score double, meta_score double, score double, kept boolean")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those scored below ``THRESHOLD``, in one pass over the texts.

    Rows are kept or go by their own score, whatever repeats them, null ids
    too; nulls are scored as by :func:`score_documents`. With no labels all
    stay; an empty table gives an empty one; all columns are passed on.
    """
    return docs.mapInArrow(_filter(train(docs, labels)), docs.schema)


def _filter(model: Model):
    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield batch.filter(pa.array(model.combine(*model.views(batch.select(COLUMNS).to_pandas())) >= THRESHOLD))

    return keep
