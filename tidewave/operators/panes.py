"""Windows over ordered samples by panes: partial sums first, then a window over few rows."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import crest, crest_db, dbfs, dbfs_epsilon, is_valid
from . import halo, walk
from .quantiles import percentiles

KEYS = ("track_id", "channel_index")
FLOOR_DB = -80.0


def panes(rows: DataFrame, size: int, keys=KEYS) -> DataFrame:
    """Peak, sum of squares and length of each run of ``size`` samples: a partial aggregate, so
    the shuffle carries panes and no samples."""
    x = F.col("value")
    return rows.groupBy(*keys, F.expr(f"sample_idx div {size}").alias("pane")).agg(
        F.max(F.abs(x)).alias("peak"), F.sum(x * x).alias("squares"), F.count("*").alias("n")
    )


def crest_columns(rate: float, peak: Column | float, floor: float, epsilon: bool = False) -> list[Column]:
    """The columns of a window from its ``peak`` and ``rms``."""
    db = dbfs_epsilon if epsilon else dbfs
    level = db(F.col("rms"), peak)
    valid = is_valid(F.col("rms"), level, floor)
    return [
        F.when(valid, crest(F.col("peak"), F.col("rms"))).alias("crest_factor"),
        F.when(valid, crest_db(F.col("peak"), F.col("rms"))).alias("crest_factor_db"),
        F.col("peak").alias("peak_level"),
        F.col("rms").alias("rms_level"),
        db(F.col("peak"), peak).alias("peak_level_dbfs"),
        level.alias("rms_level_dbfs"),
        valid.alias("is_valid_crest_factor"),
    ]


def window_levels(rows: DataFrame, window: int, step: int, keys=KEYS) -> DataFrame:
    """``(keys, window_idx, end_sample, peak, rms)`` of every full window of ``window`` samples each ``step``."""
    g = gcd(window, step)
    return levels_of_panes(panes(rows, g, keys), g, window, step, keys)


def levels_of_panes(p: DataFrame, g: int, window: int, step: int, keys=KEYS) -> DataFrame:
    """:func:`window_levels` from panes ``(keys, pane, peak, squares, n)`` of ``g`` samples, of whatever they come from."""
    n = window // g
    frame = Window.partitionBy(*keys).orderBy("pane").rowsBetween(1 - n, 0)
    p = p.select(
        *keys, "pane", F.max("peak").over(frame).alias("peak"), F.sqrt(F.sum("squares").over(frame) / window).alias("rms"), F.sum("n").over(frame).alias("n")
    )
    first = F.col("pane") - (n - 1)
    full = p.where((F.col("n") == window) & (first >= 0) & (first % (step // g) == 0))
    return full.select(*keys, F.expr(f"(pane - {n - 1}) div {step // g}").alias("window_idx"), ((F.col("pane") + 1) * g).alias("end_sample"), "peak", "rms")


def fixed_window(rows: DataFrame, window: int, step: int, rate: float = 1.0, peak: Column | float = 1.0, floor: float = FLOOR_DB, keys=KEYS, epsilon: bool = False) -> DataFrame:
    """Overlapping windows; a window's time is its end, and trailing incomplete windows go."""
    w = window_levels(rows, window, step, keys)
    return w.select(*keys, "window_idx", (F.col("end_sample") / rate).alias("time_seconds"), *crest_columns(rate, peak, floor, epsilon))


def fixed_chunk(rows: DataFrame, size: int, rate: float = 1.0, peak: Column | float = 1.0, keys=KEYS) -> DataFrame:
    """Tumbling chunks; a silent chunk has a crest factor of 1, which is 0 dB. A chunk's time is its end."""
    p = panes(rows, size, keys).where(F.col("n") == size).withColumn("rms", F.sqrt(F.col("squares") / size))
    c = F.coalesce(crest(F.col("peak"), F.col("rms")), F.lit(1.0))
    return p.select(
        *keys, F.col("pane").alias("chunk_idx"), ((F.col("pane") + 1) * size / rate).alias("time_seconds"), c.alias("crest_factor"), (20 * F.log10(c)).alias("crest_factor_db"),
        F.col("peak").alias("peak_level"), F.col("rms").alias("rms_level"), dbfs(F.col("peak"), peak).alias("peak_level_dbfs"), dbfs(F.col("rms"), peak).alias("rms_level_dbfs"),
    )


def time_domain(rows: DataFrame, mode: str = "fixed_window", *, window: int, step: int, rate: float = 1.0, **options) -> DataFrame:
    """The operator of a mode; an unknown mode is ``fixed_window``."""
    if mode == "fixed_chunk":
        return fixed_chunk(rows, window, rate, **options)
    if mode == "slow":
        from .scan import slow_crest

        return slow_crest(rows, step, rate, **options)
    return fixed_window(rows, window, step, rate, **options)


def sliding_max(rows: DataFrame, window: int, step: int, keys=KEYS) -> DataFrame:
    """max |x| of every full window each ``step`` samples; the last window may be short of nothing."""
    return window_levels(rows, window, step, keys).select(*keys, "window_idx", F.col("peak").alias("max_abs"))


def global_max(rows: DataFrame, keys=KEYS) -> DataFrame:
    """The maximum over all sliding windows: every sample is in some window, so it is max |x|."""
    return rows.groupBy(*keys).agg(F.max(F.abs("value")).alias("max_abs"))


def differences(rows: DataFrame, threshold: float, keys=KEYS, block: int = halo.BLOCK) -> DataFrame:
    """How often the value jumps by more than ``threshold``, and the largest jump; null for a single sample."""

    def work(_: np.ndarray, x: np.ndarray, start: int, end: int) -> walk.Columns:
        jump = np.abs(np.diff(x[max(start - 1, 0) : end]))
        return {"jumps": [int((jump > threshold).sum())], "largest": [float(jump.max()) if len(jump) else None]}

    found = halo.exchange(rows, 1, 0, work, "jumps long, largest double", keys, block)
    return found.groupBy(*keys).agg(F.sum("jumps").alias("jumps"), F.max("largest").alias("largest"))


def extreme_chunks(chunks: DataFrame, keys=KEYS, skip_silent: bool = False) -> DataFrame:
    """The chunks of least and largest crest factor of each channel, the first on ties."""
    if skip_silent:
        chunks = chunks.where("rms_level > 0")
    others = [c for c in chunks.columns if c not in (*keys, "crest_factor_db", "chunk_idx")]
    least = F.min(F.struct("crest_factor_db", "chunk_idx", *others)).alias("_lo")
    most = F.max(F.struct("crest_factor_db", (-F.col("chunk_idx")).alias("_first"), "chunk_idx", *others)).alias("_hi")
    ends = chunks.groupBy(*keys).agg(least, most)
    kind = lambda name, at: F.struct(F.lit(name).alias("chunk_type"), *(F.col(f"{at}.{c}").alias(c) for c in ("chunk_idx", "crest_factor_db", *others)))
    both = F.explode(F.array(kind("min_chunk", "_lo"), kind("max_chunk", "_hi"))).alias("_e")
    return ends.select(*keys, both).select(*(c if c in keys else f"_e.{c}" for c in chunks.columns), "_e.chunk_type")


def chunks_of_lengths(rows: DataFrame, lengths: Sequence[int], keys=KEYS) -> DataFrame:
    """``(keys, window, chunk_idx, peak, rms)`` of the whole chunks of several lengths.

    The chunks are put together from panes of the length that all are multiples
    of, so it is panes, not samples, that go into every length.
    """
    g = gcd(*lengths)
    every = panes(rows, g, keys).withColumn("window", F.explode(F.array(*map(F.lit, lengths))))
    c = every.groupBy(*keys, "window", F.expr(f"pane div (window div {g})").alias("chunk_idx")).agg(F.max("peak").alias("peak"), F.sum("squares").alias("squares"), F.sum("n").alias("n"))
    return c.where("n = window").select(*keys, "window", "chunk_idx", "peak", F.sqrt(F.col("squares") / F.col("n")).alias("rms"))


def block_reference(rows: DataFrame, lengths: Sequence[int], keys=KEYS) -> DataFrame:
    """The distribution of chunk crest factors for several chunk lengths."""
    c = chunks_of_lengths(rows, lengths, keys).where("rms > 0").select(*keys, "window", crest_db(F.col("peak"), F.col("rms")).alias("cf"))
    q = percentiles(c, [*keys, "window"], {"_q": F.col("cf")}, [0.5, 0.95])
    s = c.groupBy(*keys, "window").agg(F.count("*").alias("num_windows"), F.min("cf").alias("min_cf_db"), F.avg("cf").alias("mean_cf_db"), F.max("cf").alias("max_cf_db"), F.stddev_pop("cf").alias("std_cf_db"))
    at = F.col("_q")
    return s.join(q, [*keys, "window"]).select(*keys, "window", "num_windows", "min_cf_db", "mean_cf_db", at[0].alias("median_cf_db"), at[1].alias("p95_cf_db"), "max_cf_db", "std_cf_db")


