"""Sequential envelopes as a distributed two-pass block scan.

Each recurrence is a function of the state it is given, and such functions
compose: a block is summarised by a few numbers, the summaries of a run of
blocks by as few, and the runs of a series are folded in order into the state
that every run starts with. Then each run is walked once, block by block, and
its values are filled in. The run is the unit of work, never a series; a series
of one run needs no summaries. Several envelopes, of any kinds and rates, are
made in the same pass.

    peak hold   e = max(|x|, d e)              (M, D):    max(M, D e)
    slow RMS    y = y + a (x^2 - y)            (A, B):    A y + B
    follower    e = max(r, (1 - c) e + c r)    (P, Q, R): max(P, Q e + R)

Inside a block all samples are computed at once, as running sums and maxima of
values that are scaled by the decay, in pieces in which the scale stays finite.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import check_centres
from ..functions.levels import dbfs
from . import halo, walk

KEYS = ["track_id", "channel_index"]


def release_samples(band_hz: float, rate: float, wavelengths: float = 1.0, fallback_ms: float = 10.0) -> float:
    """Release of a band's follower in samples: its wavelengths, or a fixed time for the full spectrum."""
    return max(1.0, wavelengths * rate / band_hz if band_hz > 0 else fallback_ms / 1000 * rate)


def peak_hold(rows: DataFrame, decay: float, keys=KEYS, block: int = 4096) -> DataFrame:
    """``e = max(|x|, exp(-decay) e)`` in the log domain, with built-ins only: a running maximum of ``ln|x| + decay i``,
    in each block and over the blocks before it, so a window has a block's rows or a row a block."""
    own = F.expr(f"sample_idx div {block}")
    rows = rows.select(*keys, "sample_idx", own.alias("_block"), (F.ln(F.abs("value")) + decay * F.col("sample_idx")).alias("_x"))
    along = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    highest = rows.groupBy(*keys, "_block").agg(F.max("_x").alias("_x"))
    before = highest.select(*keys, "_block", F.max("_x").over(along).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("_x", F.max("_x").over(inside)).join(before, [*keys, "_block"])
    e = F.exp(F.greatest("_x", "_before") - decay * F.col("sample_idx"))
    return held.select(*keys, "sample_idx", F.coalesce(e, F.lit(0.0)).alias("envelope"))


#: Envelopes: kind and rate of each.
Specs = Sequence[tuple[str, float]]
#: A block's samples as one signal for each envelope.
Spread = Callable[[np.ndarray], Sequence[np.ndarray]]
#: Blocks of a run, and how far a piece's scale may grow, as a power of e.
RUN, GROWTH = 4096, 300.0
#: Numbers of envelopes that a task holds before it hands them on, about.
STRETCH = 1 << 18


def _pieces(n: int, keep: float) -> Iterator[tuple[int, int]]:
    """Pieces of n samples over which a decay by ``keep`` a sample stays far from the smallest double."""
    size = n if keep >= 1 else max(1, int(GROWTH / -math.log(max(keep, 1e-300))))
    for a in range(0, n, size):
        yield a, min(n, a + size)


def _hold(x: np.ndarray, keep: float, e: float) -> np.ndarray:
    """``e = max(x, keep e)`` as a running maximum of ``x / keep^i``."""
    out = np.empty(len(x))
    for a, b in _pieces(len(x), keep):
        scale = keep ** np.arange(1, b - a + 1)
        out[a:b] = np.maximum(np.maximum.accumulate(x[a:b] / scale), e) * scale
        e = out[b - 1]
    return out


def _smooth(v: np.ndarray, keep: float, y: float) -> np.ndarray:
    """``y = keep y + (1 - keep) v`` as a running sum of ``v / keep^i``, along the last axis."""
    out = np.empty(v.shape)
    for a, b in _pieces(v.shape[-1], keep):
        scale = keep ** np.arange(1, b - a + 1)
        out[..., a:b] = (np.asarray(y)[..., None] + (1 - keep) * np.cumsum(v[..., a:b] / scale, axis=-1)) * scale
        y = out[..., b - 1]
    return out


def _follow(x: np.ndarray, keep: float, e: float) -> np.ndarray:
    """``e = max(x, keep e + (1 - keep) x)``: of all samples so far the one that, smoothed from there on, is highest. Along the last axis."""
    out = np.empty(x.shape)
    for a, b in _pieces(x.shape[-1], keep):
        scale = keep ** np.arange(1, b - a + 1)
        s = _smooth(x[..., a:b], keep, 0.0)
        out[..., a:b] = s + np.maximum(np.maximum.accumulate((x[..., a:b] - s) / scale, axis=-1), np.asarray(e)[..., None]) * scale
        e = out[..., b - 1]
    return out


def summary(kind: str, rate: float, x: np.ndarray, first: bool) -> tuple[float, float, float]:
    """(p, q, r) of a block: state in, e; state out, max(p, q e + r)."""
    n = len(x)
    if kind == "hold":
        return float(_hold(np.abs(x), rate, 0.0)[-1]), rate**n, 0.0
    keep = 1 - rate
    if kind == "slow":
        y = x * x
        if first:  # the first sample is the seed
            return -math.inf, 0.0, float(_smooth(y, keep, y[0])[-1])
        return -math.inf, keep**n, float(_smooth(y, keep, 0.0)[-1])
    a = np.abs(x)
    return float(_follow(a, keep, -math.inf)[-1]) if n else -math.inf, keep**n, float(_smooth(a, keep, 0.0)[-1])


def values(kind: str, rate: float, x: np.ndarray, first: bool, e: float) -> tuple[np.ndarray, float]:
    """The envelope of a block from the state it starts with, and the state it ends with."""
    if not len(x):
        return np.empty(0), e
    if kind == "slow":
        y = x * x
        y = _smooth(y, 1 - rate, y[0] if first else e)
        return np.sqrt(np.maximum(y, 0.0)), float(y[-1])
    out = _hold(np.abs(x), rate, e) if kind == "hold" else _follow(np.abs(x), 1 - rate, e)
    return out, float(out[-1])


def pieces(parts: Iterator[pd.DataFrame], signals: int) -> Iterator[pd.DataFrame]:
    """Batches of blocks cut to some ``STRETCH`` numbers of all signals, so that no more envelopes are held at a time."""
    for pdf in parts:
        step = max(1, STRETCH // (signals * max([1, *map(len, pdf["samples"])])))
        for a in range(0, len(pdf), step):
            yield pdf.iloc[a : a + step].reset_index(drop=True)


def states(blocks: DataFrame, specs: Specs, spread: Spread) -> DataFrame:
    """``(keys, run, e0, e1, ...)``: the state that each run but the first starts with, of each envelope, in time
    linear in the blocks. Series of one run are not read."""
    k = range(len(specs))
    names = [f"{c}{i}" for i in k for c in "pqr"]
    doubles = ", ".join(f"{c} double" for c in names)

    def summarise(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(parts, len(specs)):
            found = [[v for (kind, rate), x in zip(specs, spread(np.asarray(x, np.float64)), strict=True) for v in summary(kind, rate, x, n == 0)] for n, x in zip(pdf["block_idx"], pdf["samples"], strict=True)]
            rows = pd.DataFrame(found, columns=names, dtype=np.float64)
            yield pd.concat([pdf[[*KEYS, "block_idx"]].assign(run=pdf["block_idx"] // RUN).reset_index(drop=True), rows], axis=1)

    def compose(_, rows: walk.Columns) -> walk.Columns:
        out = {}
        for i in k:
            p, q, r = -math.inf, 1.0, 0.0
            for a, b, c in zip(*(rows[f"{n}{i}"].tolist() for n in "pqr"), strict=True):
                p, q, r = max(a, b * p + c) if b else max(a, c), b * q, b * r + c
            out |= {f"p{i}": [p], f"q{i}": [q], f"r{i}": [r]}
        return out

    def fold(_, rows: walk.Columns) -> walk.Columns:
        out: walk.Columns = {"run": rows["run"][1:]}
        for i in k:
            e, before = 0.0, []
            for p, q, r in zip(*(rows[f"{n}{i}"].tolist() for n in "pqr"), strict=True):
                before.append(e)
                e = max(p, q * e + r)
            out[f"e{i}"] = before[1:]
        return out

    long = blocks.groupBy(*KEYS).agg(F.max("block_idx").alias("_last")).where(F.col("_last") >= RUN).select(*KEYS)
    rows = blocks.select(*KEYS, "block_idx", "samples").join(long, KEYS, "left_semi")
    rows = rows.mapInPandas(summarise, f"{walk.types_of(blocks, KEYS)}, block_idx long, run long, {doubles}")
    runs = walk.by_group(rows, [*KEYS, "run"], ["block_idx"], compose, doubles)
    return walk.by_group(runs, KEYS, ["run"], fold, "run long, " + ", ".join(f"e{i} double" for i in k))


def scan(blocks: DataFrame, specs: Specs, emit: Callable, columns: str, spread: Spread | None = None) -> DataFrame:
    """``(keys, columns)`` from one walk over the blocks of each run.

    ``emit(block_idx, start_sample, envelopes)`` gives the columns of a block;
    ``specs`` are pairs of kind and rate. ``spread`` makes of a block's samples
    one signal for each envelope; without it all are of the samples themselves.
    """
    specs, k = list(specs), range(len(specs))
    spread = spread or (lambda x: [x] * len(specs))
    for kind, _ in specs:
        if kind not in ("hold", "slow", "follow"):
            raise ValueError(f"unknown envelope {kind!r}")
    names = [c.split()[0] for c in columns.split(", ")]

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, e = None, [0.0] * len(specs)
        for pdf in pieces(parts, len(specs)):
            found, sizes = [], []
            starts = np.stack([pdf[f"e{i}"].fillna(0.0).to_numpy(np.float64) for i in k], 1).tolist()
            keys = zip(pdf[KEYS[0]], pdf[KEYS[1]], pdf["run"], strict=True)
            for key, n, start, x, begun in zip(keys, pdf["block_idx"].tolist(), pdf["start_sample"].tolist(), pdf["samples"], starts, strict=True):
                if key != at:
                    at, e = key, begun
                made = [values(kind, rate, own, n == 0, e[i]) for i, ((kind, rate), own) in enumerate(zip(specs, spread(np.asarray(x, np.float64)), strict=True))]
                e = [state for _, state in made]
                found.append(emit(n, start, [v for v, _ in made]))
                sizes.append(len(found[-1][names[0]]))
            if found:
                own = {c: np.repeat(pdf[c].to_numpy(), sizes) for c in KEYS}
                yield pd.DataFrame(own | {c: walk.stacked([f[c] for f in found]) for c in names})

    held = blocks.select(*KEYS, F.expr(f"block_idx div {RUN}").alias("run"), "block_idx", "start_sample", "samples")
    by = [*KEYS, "run"]
    held = held.join(states(blocks, specs, spread), by, "left")
    return held.repartition(*by).sortWithinPartitions(*by, "block_idx").mapInPandas(fill, f"{walk.types_of(blocks, KEYS)}, {columns}")


def envelope(blocks: DataFrame, kind: str, rate: float) -> DataFrame:
    """Blocks of an envelope: ``hold`` (rate = the factor a sample), ``slow`` or ``follow`` (rate = the share of the new value)."""

    def emit(n: int, start: int, made: list[np.ndarray]) -> walk.Columns:
        return {"block_idx": [n], "start_sample": [start], "samples": made}

    return scan(blocks, [(kind, rate)], emit, "block_idx long, start_sample long, samples array<double>")


def sampled(blocks: DataFrame, specs: Specs, steps: Sequence[int]) -> DataFrame:
    """``(keys, step, sample_idx, e0, e1, ...)``: all envelopes at the ends of the steps of every length, from one walk."""
    names = [f"e{i}" for i in range(len(specs))]

    def emit(_: int, start: int, made: list[np.ndarray]) -> walk.Columns:
        at = [np.arange(step - 1 - start % step, len(made[0]), step) for step in steps]
        every = np.concatenate(at)
        return {"step": np.repeat(np.array(steps, np.int64), [len(a) for a in at]), "sample_idx": start + every} | {n: v[every] for n, v in zip(names, made, strict=True)}

    return scan(blocks, specs, emit, "step long, sample_idx long, " + ", ".join(f"{n} double" for n in names))


def band_envelopes(blocks: DataFrame, centres: Sequence[float], rate: float, wavelengths: float = 1.0, fallback_ms: float = 10.0, digits: int | None = None) -> DataFrame:
    """``(keys, band_hz, start_sample, levels, whole)``: blocks of each band's peak follower in dBFS, the full spectrum as band 0.

    A block's transform gives the bands, and each band is followed at once,
    with a release of its own wavelengths, from the state that the block
    before has left; the bank is never rows. ``digits`` rounds the levels, so
    that nearly equal ones are plateaus. Blocks that are the ``whole`` of their
    series need no walk: many are followed at once, where they are.
    """
    from .spectral import bank, blocks_of_a_length

    hz = [0.0, *check_centres(centres).tolist()]
    specs = [("follow", 1 - math.exp(-1 / release_samples(f, rate, wavelengths, fallback_ms))) for f in hz]

    def decibels(v: np.ndarray) -> np.ndarray:
        db = 20 * np.log10(np.maximum(v, 1e-10) + 1e-10)
        return db if digits is None else np.round(db, digits)

    def emit(_: int, start: int, made: list[np.ndarray]) -> walk.Columns:
        return {"band_hz": np.array(hz), "start_sample": np.full(len(hz), start, np.int64), "levels": [decibels(v) for v in made]}

    def follow(parts: Iterator[pd.DataFrame]) -> Iterator[walk.Columns]:
        for rows, x in blocks_of_a_length(parts, len(hz)):
            b = np.abs(bank(x, centres, rate))
            levels = np.stack([decibels(_follow(b[:, k], 1 - share, 0.0)) for k, (_, share) in enumerate(specs)], 1)
            own = {k: np.repeat(rows[k].to_numpy(), len(hz)) for k in (*KEYS, "start_sample")}
            yield own | {"band_hz": np.tile(hz, len(rows)), "levels": walk.Lists.of_rows(levels.reshape(-1, x.shape[1])), "whole": np.ones(len(rows) * len(hz), bool)}

    columns = "band_hz double, start_sample long, levels array<double>"
    there = F.coalesce(F.size("samples") > 0, F.lit(False))
    one = blocks.groupBy(*KEYS).agg(F.count("*").alias("_n")).where("_n = 1").select(*KEYS)
    lone = blocks.where(there).join(one, KEYS, "left_semi").select(*KEYS, "start_sample", "samples")
    several = blocks.where(~there).unionByName(blocks.where(there).join(one, KEYS, "left_anti").select(*blocks.columns))
    walked = scan(several, specs, emit, columns, lambda x: bank(x, centres, rate)).withColumn("whole", F.lit(False))
    return walk.map_frames(lone, follow, f"{walk.types_of(blocks, KEYS)}, {columns}, whole boolean").select(*walked.columns).unionByName(walked)


def moving_rms(rows: DataFrame, window: int, keys=KEYS, block: int = halo.BLOCK) -> DataFrame:
    """Centred moving RMS with zeros beyond the ends; a window as long as the series gives its RMS throughout."""
    ahead = (window - 1) // 2

    def work(idx: np.ndarray, x: np.ndarray, start: int, end: int) -> walk.Columns:
        # blocks are no shorter than the window, so a series within a window is one block
        if start == 0 and idx[0] == 0 and len(idx) <= window:
            return {"sample_idx": idx[:end], "envelope": np.full(end, np.sqrt(np.mean(x * x)))}
        sums = np.concatenate([[0.0], np.cumsum(x * x)])
        at = np.arange(start, end)
        total = sums[np.minimum(at + ahead + 1, len(x))] - sums[np.maximum(at + ahead + 1 - window, 0)]
        return {"sample_idx": idx[start:end], "envelope": np.sqrt(np.maximum(total, 0.0) / window)}

    return halo.exchange(rows, window - 1 - ahead, ahead, work, "sample_idx long, envelope double", keys, max(block, window))


def slow_crest(rows: DataFrame, step: int, rate: float = 1.0, rms_tau: float = 1.0, peak_tau: float = 1.0, peak: Column | float = 1.0, block: int = 4096) -> DataFrame:
    """Crest factor of the peak-hold envelope over the slow RMS envelope, sampled at the ends of steps."""
    from ..sources.series import to_blocks

    hold, share = math.exp(-1 / (peak_tau * rate)), 1 - math.exp(-1 / (rms_tau * rate))
    at = sampled(to_blocks(rows, block), [("hold", hold), ("slow", share)], [step]).withColumnsRenamed({"e0": "peak", "e1": "rms"})
    c = F.when(F.col("rms") > 0, F.greatest(F.col("peak") / F.col("rms"), F.lit(1.0)))
    return at.select(
        *KEYS, F.expr(f"(sample_idx + 1) div {step} - 1").alias("window_idx"), ((F.col("sample_idx") + 1) / rate).alias("time_seconds"), c.alias("crest_factor"),
        (20 * F.log10(c)).alias("crest_factor_db"), dbfs(F.col("peak"), peak).alias("peak_level_dbfs"), dbfs(F.col("rms"), peak).alias("rms_level_dbfs"),
    )
