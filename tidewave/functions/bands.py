"""Octave bands: centres, power-complementary weights, labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The default centres; 4 and 8 Hz are the residual at the lower end, 32 kHz at the upper.
CENTRES = (8.0, 16.0, 31.25, 62.5, 125.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0, 16000.0)
LOW_RESIDUAL, HIGH_RESIDUAL = 4.0, 32000.0


def band_centres(centres: Sequence[float] = CENTRES, low: float | None = LOW_RESIDUAL, high: float | None = HIGH_RESIDUAL) -> tuple[float, ...]:
    """Unique, positive, ascending centres with residual ends."""
    found = {float(c) for c in centres if c > 0}
    inner = sorted(found)
    if inner and low is not None and low < inner[0]:
        found.add(float(low))
    if inner and high is not None and high > inner[-1]:
        found.add(float(high))
    return tuple(sorted(found))


def check_centres(centres: Sequence[float]) -> np.ndarray:
    c = np.asarray(centres, np.float64)
    if not len(c) or (c <= 0).any():
        raise ValueError("band centres must be positive")
    if (np.diff(c) <= 0).any():
        raise ValueError("band centres must be strictly ascending")
    return c


def weights(freqs: np.ndarray, centres: Sequence[float]) -> np.ndarray:
    """Weights (band, frequency) whose squares sum to 1: a raised cosine over the log frequency
    between neighbouring centres, and all of what lies outside in the end bands."""
    c = check_centres(centres)
    x = np.interp(np.log(np.maximum(freqs, 1e-300)), np.log(c), np.arange(len(c)))
    return np.cos(np.pi / 2 * np.minimum(np.abs(x - np.arange(len(c))[:, None]), 1))


def bands_frame(spark: SparkSession, centres: Sequence[float]) -> DataFrame:
    """``(band_idx, band_hz, lower_hz, upper_hz)``: a few rows; the neighbours are null at the ends."""
    c = [float(x) for x in check_centres(centres)]
    rows = [(i, x, c[i - 1] if i else None, c[i + 1] if i + 1 < len(c) else None) for i, x in enumerate(c)]
    return spark.createDataFrame(rows, "band_idx int, band_hz double, lower_hz double, upper_hz double")


def weight(freq: Column, centre: Column, lower: Column, upper: Column) -> Column:
    """One weight as a column expression, with null neighbours at the ends."""
    rise = F.sin(F.lit(np.pi / 2) * (F.ln(freq) - F.ln(lower)) / (F.ln(centre) - F.ln(lower)))
    fall = F.cos(F.lit(np.pi / 2) * (F.ln(freq) - F.ln(centre)) / (F.ln(upper) - F.ln(centre)))
    below = F.when(lower.isNull(), 1.0).when(freq > lower, rise).otherwise(0.0)
    above = F.when(upper.isNull(), 1.0).when(freq < upper, fall).otherwise(0.0)
    return F.when(freq < centre, below).when(freq == centre, 1.0).otherwise(above)


def band_label(hz: Column) -> Column:
    return F.when(hz == 0, "Full Spectrum").otherwise(F.format_string("%.3f", hz))


def parse_label(label: Column) -> Column:
    return F.when(label == "Full Spectrum", 0.0).otherwise(label.try_cast("double"))


def display_label(hz: Column) -> Column:
    """``1k Hz``, ``62.5 Hz``: thousands with k, one decimal where it is no whole number."""
    plain = lambda x: F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(F.format_string("%.1f", F.bround(x, 1)))
    return F.when(hz >= 1000, F.concat(plain(hz / 1000), F.lit("k Hz"))).otherwise(F.concat(plain(hz), F.lit(" Hz")))
