"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as a hashed word embedding and the mean of its hashed character
4-gram embeddings, beside the evidence that either had in the training texts.
Two gated recurrent layers read a window in either direction, attention pools
them, and a document's score is the calibrated maximum over all of its
overlapping windows. Everything is numpy; the network is trained on a bounded
sample and has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import GRAM_BUCKETS, WORD_BUCKETS, Words, chunks, fold, gather, labelled_ids, platt, sigmoid

#: Labelled rows of either label that are learnt from, at most.
SAMPLE_EACH = 1500
WINDOW, STRIDE = 24, 16
HIDDEN, EMBED, ATTEND = 8, 4, 8
INPUT = 3 + 2 * EMBED
STEPS, BATCH, RATE = 500, 256, 0.01
THRESHOLD = 0.7
#: Words and windows that a task holds at a time.
CHUNK, WINDOWS = 200_000, 4096


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ``counts`` words: start and end of each window, and each text's first window."""
    per = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    k = np.arange(per.sum()) - np.repeat(first, per)
    return np.repeat(begin, per) + STRIDE * k, np.repeat(begin + counts, per), first


def window_tokens(tokens: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < end[:, None], np.append(tokens, 0)[np.minimum(at, len(tokens))], 0)


class Prior:
    """Evidence of hashed features: z-scores of the log odds of their document frequencies."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray):
        self.word, self.gram = (self._z([d[k] for d in docs], y, size) for k, size in ((0, WORD_BUCKETS), (1, GRAM_BUCKETS)))

    @staticmethod
    def _z(sets: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
        n = [np.bincount(np.concatenate([s for s, v in zip(sets, y, strict=True) if v == k] or [np.empty(0, np.int64)]), minlength=size) for k in (0, 1)]
        total = [max(1, int((y == k).sum())) for k in (0, 1)]
        odds = np.log((n[1] + 0.5) / (total[1] + 1)) - np.log((n[0] + 0.5) / (total[0] + 1))
        z = odds / np.sqrt(1 / (n[0] + 0.5) + 1 / (n[1] + 0.5))
        return np.where(n[0] + n[1] > 0, np.clip(z, -4, 8) / 4, 0).astype(np.float32)


def inputs(features: tuple, prior: Prior, p: dict[str, np.ndarray]) -> np.ndarray:
    """A row for each word, below a row of zeros for the padding."""
    buckets, grams, starts = features
    x = np.zeros((len(buckets) + 1, INPUT), np.float32)
    if len(buckets):
        n = np.diff(np.append(starts, len(grams)))[:, None]
        z = prior.gram[grams]
        x[1:, 0] = prior.word[buckets]
        x[1:, 1] = np.add.reduceat(z, starts) / n[:, 0]
        x[1:, 2] = np.maximum.reduceat(z, starts)
        x[1:, 3 : 3 + EMBED] = p["word"][buckets]
        x[1:, 3 + EMBED :] = np.add.reduceat(p["gram"][grams], starts, axis=0) / n
    return x


def _unroll(px: np.ndarray, u: np.ndarray, tokens: np.ndarray, keep: list | None) -> np.ndarray:
    """States (time, window, hidden) of one direction; ``px`` is what the inputs add to the gates."""
    h = np.zeros((len(tokens), HIDDEN), np.float32)
    out = np.empty((WINDOW, len(tokens), HIDDEN), np.float32)
    for t in range(WINDOW):
        a, b, m = px[tokens[:, t]], h @ u, (tokens[:, t] > 0)[:, None]
        zr = 1 / (1 + np.exp(-(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])))
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
        new = np.where(m, n + z * (h - n), h)
        if keep is not None:
            keep.append((h, z, r, n, b[:, 2 * HIDDEN :], m))
        out[t] = h = new
    return out


def _back(px: np.ndarray, u: np.ndarray, tokens: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``px`` and ``u`` from those of the states."""
    d_px, d_u, d_h = np.zeros_like(px), np.zeros_like(u), np.zeros((len(tokens), HIDDEN), np.float32)
    for t in range(WINDOW - 1, -1, -1):
        h, z, r, n, bn, m = kept[t]
        d = d_h + d_out[t]
        d_new = d * m
        d_n = d_new * (1 - z) * (1 - n * n)
        d_z = d_new * (h - n) * z * (1 - z)
        d_r = d_n * bn * r * (1 - r)
        d_a = np.concatenate([d_z, d_r, d_n], 1)
        d_b = np.concatenate([d_z, d_r, d_n * r], 1)
        np.add.at(d_px, tokens[:, t], d_a)
        d_u += h.T @ d_b
        d_h = d * ~m + d_new * z + d_b @ u.T
    return d_px, d_u


def forward(p: dict[str, np.ndarray], x: np.ndarray, tokens: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows of word numbers into ``x``."""
    back = tokens[:, ::-1]
    px = [x @ p[f"w{k}"] + p[f"b{k}"] for k in (0, 1)]
    held = [[] if keep is not None else None for _ in (0, 1)]
    h = np.concatenate([_unroll(px[0], p["u0"], tokens, held[0]), _unroll(px[1], p["u1"], back, held[1])[::-1]], 2)
    g = np.tanh(h @ p["wa"])
    e = np.where(tokens.T > 0, g @ p["va"], -30)
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = (a[:, :, None] * h).sum(0)
    if keep is not None:
        keep |= {"px": px, "held": held, "h": h, "g": g, "a": a, "pooled": pooled, "back": back}
    return pooled @ p["out"] + p["bias"][0]


def gradients(p: dict[str, np.ndarray], x: np.ndarray, tokens: np.ndarray, d_logit: np.ndarray, k: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of the parameters between inputs and logit, and of the inputs."""
    d_pool = d_logit[:, None] * p["out"]
    a, h, g = k["a"], k["h"], k["g"]
    d_a = (h * d_pool).sum(2)
    d_e = a * (d_a - (a * d_a).sum(0)) * (tokens.T > 0)
    d_g = d_e[:, :, None] * p["va"] * (1 - g * g)
    d_h = a[:, :, None] * d_pool + d_g @ p["wa"].T
    flat = h.reshape(-1, 2 * HIDDEN)
    out = {"out": k["pooled"].T @ d_logit, "bias": np.array([d_logit.sum()]), "va": (g * d_e[:, :, None]).sum((0, 1)), "wa": flat.T @ d_g.reshape(-1, ATTEND)}
    d_x = np.zeros_like(x)
    for j, t, d in ((0, tokens, d_h[:, :, :HIDDEN]), (1, k["back"], d_h[::-1, :, HIDDEN:])):
        d_px, out[f"u{j}"] = _back(k["px"][j], p[f"u{j}"], t, k["held"][j], d)
        out[f"w{j}"], out[f"b{j}"] = x.T @ d_px, d_px.sum(0)
        d_x += d_px @ p[f"w{j}"].T
    d_x[0] = 0
    return out, d_x


def new_parameters(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    r = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"word": np.zeros((WORD_BUCKETS, EMBED), np.float32), "gram": np.zeros((GRAM_BUCKETS, EMBED), np.float32)}
    for j in (0, 1):
        p |= {f"w{j}": r(INPUT, 3 * HIDDEN), f"u{j}": r(HIDDEN, 3 * HIDDEN), f"b{j}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"wa": r(2 * HIDDEN, ATTEND), "va": r(ATTEND), "out": r(2 * HIDDEN), "bias": np.zeros(1, np.float32)}


class Model:
    def __init__(self, prior: Prior, p: dict[str, np.ndarray], a: float, b: float):
        self.prior, self.p, self.a, self.b = prior, p, a, b

    def logits(self, words: list[bytes], counts: np.ndarray, prior: Prior | None = None) -> np.ndarray:
        """The largest logit over the windows of each text."""
        book = Words()
        tokens = book.tokens(words)
        x = inputs(book.features(), prior or self.prior, self.p)
        start, end, first = windows(counts)
        out = np.concatenate([forward(self.p, x, window_tokens(tokens, start[k : k + WINDOWS], end[k : k + WINDOWS])) for k in range(0, len(start), WINDOWS)])
        return np.maximum.reduceat(out, first)

    def scores(self, texts) -> np.ndarray:
        parts = [self.logits(words, counts) for _, _, words, counts in chunks(texts, CHUNK)]
        return sigmoid(self.a * np.concatenate(parts).astype(np.float64) + self.b) if parts else np.empty(0)


def fit(texts: list[str | None], y: np.ndarray, negatives: float = 1.0, seed: int = 7) -> Model:
    """Train on labelled texts; ``negatives``: documents that each sampled one of label 0 stands for.

    The evidence that a text's words bring is counted on the other half of the
    sample, so that no text is its own evidence. Of a text of label 1 the
    window of most evidence is learnt as such, and again by the network's own
    choice half-way; texts of label 0 give all windows, in turn.
    """
    y = np.asarray(y, np.int64)
    if not len(y) or y.min() == y.max():  # one label only: its frequency is all there is to learn
        p = new_parameters(seed)
        p["out"][:] = 0
        return Model(Prior([], np.empty(0, np.int64)), p, 1e-3, 4.0 if len(y) and y[0] else -4.0)
    rng, book = np.random.default_rng(seed), Words()
    words = [w for _, _, w, _ in chunks(texts, 1)]
    tokens = [book.tokens(w) for w in words]
    features = buckets, grams, starts = book.features()
    ends = np.append(starts, len(grams))
    sets = []
    for t in tokens:
        own = np.unique(t) - 1
        sets.append((np.unique(buckets[own]), np.unique(np.concatenate([grams[ends[w] : ends[w + 1]] for w in own] or [np.empty(0, np.int64)]))))
    half = np.zeros(len(y), np.int64)
    for label in (0, 1):
        at = rng.permutation(np.flatnonzero(y == label))
        half[at[: len(at) // 2]] = 1
    other = [Prior([sets[i] for i in np.flatnonzero(half != k)], y[half != k]) for k in (0, 1)]
    p = new_parameters(seed)
    rows = []
    for i, t in enumerate(tokens):
        start, end, _ = windows(np.array([len(t)]))
        rows.append(window_tokens(t, start, end))
    of = np.repeat(np.arange(len(y)), [len(r) for r in rows])
    windows_, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
    evidence = np.empty(len(windows_))
    for k in (0, 1):
        z = inputs(features, other[k], p)[:, :3].sum(1)
        evidence[half[of] == k] = z[windows_[half[of] == k]].max(1)
    best = lambda s: np.array([f + np.argmax(s[f : f + len(r)]) for f, r in zip(first, rows, strict=True)])
    positive = best(evidence)[y == 1]
    negative = np.flatnonzero(y[of] == 0)
    hard = best(evidence)[y == 0]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    fixed = [inputs(features, other[k], p)[:, :3] for k in (0, 1)]
    spans = np.diff(ends)
    for step in range(1, STEPS + 1):
        if step == STEPS // 2:
            s = np.empty(len(windows_))
            for k in (0, 1):
                at = np.flatnonzero(half[of] == k)
                x = inputs(features, other[k], p)
                s[at] = np.concatenate([forward(p, x, windows_[at[c : c + WINDOWS]]) for c in range(0, len(at), WINDOWS)])
            positive, hard = best(s)[y == 1], best(s)[y == 0]
        k = step % 2
        pick = lambda c, n: rng.choice(c[half[of[c]] == k], n)
        at = np.concatenate([pick(positive, BATCH // 2), pick(negative, BATCH // 4), pick(hard, BATCH // 4)])
        used, small = np.unique(windows_[at], return_inverse=True)
        keep: dict = {}
        t = small.reshape(len(at), WINDOW)
        if used[0] != 0:  # zero stands for the padding, which every batch is given
            used, t = np.append(0, used), t + 1
        own = used[1:] - 1
        n = spans[own]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        near = grams[np.repeat(starts[own] - begin, n) + np.arange(n.sum())]
        x = np.zeros((len(used), INPUT), np.float32)
        x[:, :3] = fixed[k][used]
        x[1:, 3 : 3 + EMBED] = p["word"][buckets[own]]
        x[1:, 3 + EMBED :] = np.add.reduceat(p["gram"][near], begin, axis=0) / n[:, None]
        d = ((sigmoid(forward(p, x, t, keep)) - y[of[at]]) / len(at)).astype(np.float32)
        grad, d_x = gradients(p, x, t, d, keep)
        wide = lambda at, d, size: np.stack([np.bincount(at, c, size) for c in d.T], 1)
        grad["word"] = wide(buckets[own], d_x[1:, 3 : 3 + EMBED], WORD_BUCKETS)
        grad["gram"] = wide(near, np.repeat(d_x[1:, 3 + EMBED :] / n[:, None], n, axis=0), GRAM_BUCKETS)
        rate = RATE * min(1.0, 2 - 2 * step / STEPS)
        for name, g in grad.items():
            m, v = moments[name]
            g = g.astype(np.float32) + 1e-5 * p[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    model = Model(Prior(sets, y), p, 1.0, 0.0)
    x = np.empty(len(y))
    for k in (0, 1):
        at = np.flatnonzero(half == k)
        x[at] = model.logits([w for i in at for w in words[i]], np.array([len(words[i]) for i in at]), other[k])
    model.a, model.b = platt(x, y, np.where(y == 1, 1.0, negatives))
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn ``labels.toxic`` from rows whose crc32 of the id, modulo 3, is not 1."""
    ids = labelled_ids(labels.select("doc_id", "toxic"), "toxic", SAMPLE_EACH)
    rows = gather(docs, ids, ["text"])
    n = dict(labels.where(fold("doc_id") != 1).groupBy("toxic").count().collect())
    seen = max(1, sum(r["y"] == 0 for r in rows)) / max(1, sum(r["y"] == 1 for r in rows))
    return fit([r["text"] for r in rows], np.array([r["y"] for r in rows]), max(1.0, n.get(0, 0) / max(1, n.get(1, 0)) / seen))


def _score(model: Model):
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            s = model.scores(pdf["text"])
            yield pdf.drop(columns="text").assign(score=s, predicted=(s >= THRESHOLD).astype("int32"))

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each of ``docs``, over whole texts.

    A null or empty text has one empty window and the score of that. Null ids
    are scored, and never learnt from; repeated rows are scored each; with no
    labels, or one, every score is that label's; an empty table gives no
    rows. Further columns are not read.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("string"), (fold("doc_id") == 1).alias("held_out"), "text")
    scored = rows.mapInPandas(_score(model), "doc_id string, held_out boolean, score double, predicted int")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic, in one pass: the text is scored where it lies.

    Rows are kept or go by their own score, whatever repeats them, null ids
    too; a null text is scored as the empty one. With no labels all stay; an
    empty table gives an empty one; all columns are passed on.
    """
    model = train(docs, labels)
    return docs.mapInArrow(_filter(model, docs.columns.index("text")), docs.schema)


def _filter(model: Model, at: int):
    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) < THRESHOLD))

    return keep
