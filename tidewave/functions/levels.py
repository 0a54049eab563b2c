"""Levels: decibels, crest factors and validity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENCE_DB = -120.0
EPSILON = 1e-10


def dbfs(level: Column, peak: Column | float = 1.0, floor: float | None = SILENCE_DB) -> Column:
    """20 log10 of a level times its reference; silence gives ``floor``, or null where that is None."""
    db = 20 * F.log10(level * peak)
    return db if floor is None else F.coalesce(db, F.lit(floor))


def dbfs_epsilon(level: Column, peak: Column | float = 1.0) -> Column:
    """The form that adds 1e-10 before the logarithm."""
    return 20 * F.log10(level * peak + EPSILON)


def linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def spl(db: Column, is_lfe: Column) -> Column:
    """Calibrated sound pressure: 105 dB at full scale, 115 for LFE channels."""
    return db + F.when(is_lfe, 115.0).otherwise(105.0)


def crest(peak: Column, rms: Column) -> Column:
    """max(peak / rms, 1); null where there is no signal."""
    return F.when(rms > 0, F.greatest(peak / rms, F.lit(1.0)))


def crest_db(peak: Column, rms: Column) -> Column:
    return 20 * F.log10(crest(peak, rms))


def is_valid(rms: Column, rms_dbfs: Column, floor: float) -> Column:
    """There is a signal, and its level reaches the floor."""
    return F.coalesce((rms > 0) & (rms_dbfs >= floor), F.lit(False))


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def compact_axis(times: Column) -> Column:
    """``(start, step, values)``: a uniform axis as start and step, any other by its values."""
    steps = F.transform(F.sequence(F.lit(1), F.size(times) - 1), lambda i: F.element_at(times, i + 1) - F.element_at(times, i))
    step = F.when(F.size(times) > 1, F.element_at(steps, 1))
    uniform = F.coalesce(F.forall(steps, lambda d: F.abs(d - F.element_at(steps, 1)) <= 1e-9), F.lit(False)) & (F.size(times) > 1)
    return F.struct(F.get(times, F.lit(0)).alias("start"), F.when(uniform, step).alias("step"), F.when(~uniform, times).alias("values"))


def expand_axis(start: Column, step: Column, n: Column, values: Column) -> Column:
    """The times that :func:`compact_axis` has stored."""
    return F.coalesce(values, F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i * step))
