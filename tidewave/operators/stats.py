"""Whole-interval statistics, histograms and indicators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import SILENCE_DB, crest, crest_db, dbfs, dbfs_epsilon, is_valid
from .quantiles import percentiles

KEYS = ("track_id", "channel_index")
PERCENTILES = (10, 25, 50, 75, 90, 95, 99)
# Half-open dBFS ranges of the peak distribution.
RANGES = (("clipping", -0.1, 0.0), ("hot", -1.0, -0.1), ("loud", -3.0, -1.0), ("moderate", -6.0, -3.0), ("quiet", -12.0, -6.0), ("very_quiet", -60.0, -12.0))


def whole_interval(rows: DataFrame, keys=KEYS, peak: Column | float = 1.0, floor: float = -80.0) -> DataFrame:
    """Peak, RMS, crest factor and levels of whole series, in one partial and final aggregate; null where silent."""
    x = F.col("value")
    s = rows.groupBy(*keys).agg(F.max(F.abs(x)).alias("peak"), F.sqrt(F.avg(x * x)).alias("rms"), F.count("value").alias("samples"))
    level = dbfs(F.col("rms"), peak, None)
    return s.select(
        *keys, "samples", "peak", "rms", crest(F.col("peak"), F.col("rms")).alias("crest_factor"), crest_db(F.col("peak"), F.col("rms")).alias("crest_factor_db"),
        dbfs(F.col("peak"), peak, None).alias("peak_dbfs"), level.alias("rms_dbfs"), is_valid(F.col("rms"), level, floor).alias("is_valid_crest_factor"),
    )


def band_statistics(rows: DataFrame, keys=KEYS, peak: Column | float = 1.0, approximate: bool = False) -> DataFrame:
    """Everything that is said of one band: levels, range, moments and percentiles of |x|.

    Percentiles are exact, by selection; ``approximate`` gives them by mergeable
    sketches instead, which reads the rows once.
    """
    x = F.col("value")
    moments = [F.max(F.abs(x)).alias("max_amplitude"), F.sqrt(F.avg(x * x)).alias("rms"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")]
    if approximate:
        s = rows.groupBy(*keys).agg(*moments, F.percentile_approx(F.abs(x), F.array(*(F.lit(p / 100) for p in PERCENTILES)), F.lit(10_000)).alias("_q"))
    else:
        q = percentiles(rows, keys, {"_q": F.abs(x)}, [p / 100 for p in PERCENTILES])
        s = rows.groupBy(*keys).agg(*moments).join(q, list(keys), "left")
    return described(s, keys, peak)


def moments(x: np.ndarray) -> dict[str, np.ndarray]:
    """``max_amplitude``, ``rms``, ``mean``, ``std`` and the percentiles ``_q`` of |x| along the last axis, as :func:`band_statistics` has them; NaN is left out."""
    n = np.count_nonzero(~np.isnan(x), axis=-1)
    ordered = np.sort(np.abs(x), axis=-1)  # NaN comes last
    none, some = n == 0, np.maximum(n, 1)
    mean = np.nansum(x, axis=-1) / some
    place = (n[..., None] - 1).clip(0) * (np.array(PERCENTILES) / 100)
    lower, upper = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
    low, high = np.take_along_axis(ordered, lower, -1), np.take_along_axis(ordered, upper, -1)
    found = {
        "max_amplitude": np.take_along_axis(ordered, some[..., None] - 1, -1)[..., 0], "rms": np.sqrt(np.nansum(x * x, axis=-1) / some),
        "mean": mean, "std": np.sqrt(np.nansum((x - mean[..., None]) ** 2, axis=-1) / some), "_q": np.where(lower == upper, low, (upper - place) * low + (place - lower) * high),
    }
    return {k: np.where(none if v.ndim == none.ndim else none[..., None], np.nan, v) for k, v in found.items()}


def described(s: DataFrame, keys=KEYS, peak: Column | float = 1.0) -> DataFrame:
    """The columns of :func:`band_statistics` from ``max_amplitude``, ``rms``, ``mean``, ``std`` and the percentiles ``_q``."""
    ratio = F.try_divide("rms", "max_amplitude")
    return s.select(
        *keys, "max_amplitude", dbfs(F.col("max_amplitude"), peak, None).alias("max_amplitude_db"), "rms", dbfs(F.col("rms"), peak, None).alias("rms_db"),
        ratio.alias("dynamic_range"), (20 * F.log10(ratio)).alias("dynamic_range_db"), crest(F.col("max_amplitude"), F.col("rms")).alias("crest_factor"),
        crest_db(F.col("max_amplitude"), F.col("rms")).alias("crest_factor_db"), "mean", "std", *(F.col("_q")[i].alias(f"p{p}") for i, p in enumerate(PERCENTILES)),
    )


def time_domain_summary(windows: DataFrame, keys=KEYS) -> DataFrame:
    """Valid and invalid windows, and moments of the crest factor and the levels."""
    c = F.col("crest_factor_db")
    return windows.groupBy(*keys).agg(
        F.count("*").alias("total_windows"), F.count_if("is_valid_crest_factor").alias("valid_windows"), F.count_if(~F.col("is_valid_crest_factor")).alias("invalid_windows"),
        F.avg(c).alias("crest_factor_mean_db"), F.stddev_pop(c).alias("crest_factor_std_db"), F.min(c).alias("crest_factor_min_db"), F.max(c).alias("crest_factor_max_db"),
        F.avg("peak_level_dbfs").alias("peak_level_mean_dbfs"), F.stddev_pop("peak_level_dbfs").alias("peak_level_std_dbfs"),
        F.avg("rms_level_dbfs").alias("rms_level_mean_dbfs"), F.stddev_pop("rms_level_dbfs").alias("rms_level_std_dbfs"),
    )


def window_medians(windows: DataFrame, keys=KEYS) -> DataFrame:
    names = {"median_peak_dbfs": "peak_level_dbfs", "median_rms_dbfs": "rms_level_dbfs", "median_crest_factor_db": "crest_factor_db"}
    q = percentiles(windows, keys, {name: F.col(c) for name, c in names.items()}, [0.5])
    counts = windows.groupBy(*keys).agg(F.count_if("is_valid_crest_factor").alias("valid_windows"))
    return counts.join(q, list(keys), "left").select(*keys, *(F.col(n)[0].alias(n) for n in names), "valid_windows")


def window_averages(windows: DataFrame, keys=KEYS) -> DataFrame:
    """Two averages of a series' crest factor: of the windows' decibels, and of the highest peak over the mean RMS."""
    return windows.groupBy(*keys).agg(F.avg("crest_factor_db").alias("mean_crest_db"), (20 * F.log10(F.max("peak_level") / F.nullif(F.avg("rms_level"), F.lit(0.0)))).alias("peak_over_mean_rms_db"))


def saturation(rows: DataFrame, rate: float, keys=KEYS, peak: Column | float = 1.0, clip: float = -0.1, hot: float = -3.0) -> DataFrame:
    """Clipped samples a second, the share of hot samples and the largest level."""
    db = dbfs_epsilon(F.abs("value"), peak)
    s = rows.select(*keys, db.alias("db")).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("db") > clip).alias("clips"), F.count_if(F.col("db") > hot).alias("hot"), F.max("db").alias("max_true_peak_dbfs"))
    return s.select(
        *keys, (F.col("clips") * rate / F.col("n")).alias("clip_events_rate_per_sec"), (F.col("hot") / F.col("n") * 100).alias("peak_saturation_percent"),
        (F.col("hot") / F.col("n")).alias("peak_density_above_minus3db"), "max_true_peak_dbfs",
    )


def peak_distribution(rows: DataFrame, keys=KEYS, peak: Column | float = 1.0) -> DataFrame:
    """Percent of the samples in each half-open range of levels."""
    d = rows.select(*keys, dbfs_epsilon(F.abs("value"), peak).alias("db"))
    share = lambda lo, hi: F.count_if((F.col("db") >= lo) & (F.col("db") < hi)) / F.count("*") * 100
    return d.groupBy(*keys).agg(*(share(lo, hi).alias(f"peak_distribution_{name}_percent") for name, lo, hi in RANGES))


def peak_rates(peaks: DataFrame, durations: DataFrame, keys=KEYS, limits=(-3.0, -1.0, -0.1)) -> DataFrame:
    """Peak events above each limit, and a second, for every series of ``durations (keys, seconds)``."""
    name = lambda t: f"peaks_above_minus{abs(t):g}db".replace(".", "_")
    counts = peaks.groupBy(*keys).agg(*(F.count_if(F.col("peak_db") > t).alias(f"{name(t)}_count") for t in limits))
    all_ = durations.join(counts, list(keys), "left").na.fill(0, [f"{name(t)}_count" for t in limits])
    return all_.select(*keys, *(c for t in limits for c in (F.col(f"{name(t)}_count"), (F.col(f"{name(t)}_count") / F.col("seconds")).alias(f"{name(t)}_per_sec"))))


def _binned(rows: DataFrame, x: Column, lo: float, hi: float, bins: int, keys, keep: Column) -> DataFrame:
    inside = rows.where(keep).select(*keys, F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = inside.groupBy(*keys, "bin").agg(F.count("*").alias("bin_count"))
    every = rows.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    total = F.sum("bin_count").over(Window.partitionBy(*keys))
    return _bins(every.join(counts, [*keys, "bin"], "left").na.fill(0, ["bin_count"]), total, lo, hi, bins, keys)


def _bins(c: DataFrame, total: Column, lo: float, hi: float, bins: int, keys) -> DataFrame:
    width = (hi - lo) / bins
    return c.select(
        *keys, "bin", (lo + F.col("bin") * width).alias("bin_left"), (lo + (F.col("bin") + 1) * width).alias("bin_right"),
        "bin_count", F.coalesce(F.try_divide(F.col("bin_count"), total * width), F.lit(0.0)).alias("bin_density"),
    )


def counted(x: np.ndarray, lo: float, hi: float, bins: int) -> np.ndarray:
    """How many of each row's values are in each bin, the last one closed; NaN is in none."""
    row, at = np.nonzero((x >= lo) & (x <= hi))
    own = np.minimum(np.floor((x[row, at] - lo) / (hi - lo) * bins), bins - 1).astype(np.int64)
    return np.bincount(row * bins + own, minlength=len(x) * bins).reshape(len(x), bins)


def decibels(x: np.ndarray) -> np.ndarray:
    """Levels as :func:`log_histogram` counts them: silence is at the floor."""
    a = np.abs(x)
    return np.maximum(20 * np.log10(a, where=a > 0, out=np.full(a.shape, SILENCE_DB / 20)), SILENCE_DB)


def log_bins(lo: float = -60.0, hi: float = 0.0, width: float = 3.0) -> int:
    return int((hi - lo) / width) - 1


def histogram_of_counts(counts: DataFrame, column: str, lo: float, hi: float, bins: int, keys=KEYS) -> DataFrame:
    """A histogram from arrays of counts of parts of each series."""
    c = counts.groupBy(*keys).agg(F.array(*(F.sum(F.col(column)[k]) for k in range(bins))).alias("_c"))
    total = F.aggregate("_c", F.lit(0).cast("long"), lambda s, v: s + v).alias("_total")
    c = c.select(*keys, "_c", total)  # a step of its own, or every bin would add up all of them
    return _bins(c.select(*keys, "_total", F.posexplode("_c").alias("bin", "bin_count")), F.nullif("_total", F.lit(0)), lo, hi, bins, keys)


def linear_histogram(rows: DataFrame, lo: float = -1.0, hi: float = 1.0, bins: int = 50, keys=KEYS) -> DataFrame:
    """Equal bins, the last one closed; finite values inside of the range only; empty bins are kept."""
    x = F.col("value")
    return _binned(rows, x, lo, hi, bins, keys, x.between(lo, hi) & ~F.isnan(x))


def log_histogram(rows: DataFrame, lo: float = -60.0, hi: float = 0.0, width: float = 3.0, keys=KEYS, peak: Column | float = 1.0) -> DataFrame:
    """Levels in bins of at least ``width`` dB: as many edges as widths fit, so one bin less. Silence counts at the floor."""
    db = F.greatest(dbfs(F.abs("value"), peak, SILENCE_DB), F.lit(SILENCE_DB))
    rows = rows.withColumn("_db", db)
    return _binned(rows, F.col("_db"), lo, hi, log_bins(lo, hi, width), keys, F.col("_db").between(lo, hi))


def sample_histogram(rows: DataFrame, bins: int = 51, keys=KEYS) -> DataFrame:
    """The linear histogram of what is no silence, with real counts."""
    return linear_histogram(rows.where(F.abs("value") > 1e-10), -1.0, 1.0, bins, keys)


def frequency_dynamics(bands: DataFrame, keys=KEYS, low: int = 3, high: int = 3) -> DataFrame:
    """How the crest factor varies over the bands, and the bass against the treble by position in the band list."""
    by = Window.partitionBy(*keys)
    b = bands.where("band_hz > 0").select(*keys, "band_hz", F.coalesce("crest_factor_db", F.lit(0.0)).alias("c"), F.coalesce("rms_db", F.lit(-60.0)).alias("r"))
    b = b.withColumn("n", F.row_number().over(by.orderBy("band_hz"))).withColumn("m", F.row_number().over(by.orderBy(F.desc("band_hz"))))
    c = F.col("c")
    return b.groupBy(*keys).agg(
        F.var_pop(c).alias("frequency_crest_factor_variance"), (F.max(c) - F.min(c)).alias("frequency_crest_factor_range"),
        (F.avg(F.when(F.col("n") <= low, c)) / F.greatest(F.avg(F.when(F.col("m") <= high, c)), F.lit(0.1))).alias("bass_vs_treble_dynamics_ratio"),
        F.stddev_pop("r").alias("frequency_balance_std"),
        F.max_by("band_hz", F.struct("c", -F.col("band_hz"))).alias("most_dynamic_frequency_hz"), F.min_by("band_hz", F.struct("c", "band_hz")).alias("least_dynamic_frequency_hz"),
    )


def mastering_indicators(bands: DataFrame, keys=KEYS) -> DataFrame:
    """Peak to RMS of the full spectrum, the spectral centroid and energy ratios by position in the band list."""
    by = Window.partitionBy(*keys)
    e = F.when(F.col("band_hz") > 0, F.col("rms") * F.col("rms"))
    b = bands.select("*", e.alias("e"), F.sum(F.when(F.col("band_hz") > 0, 1)).over(by.orderBy("band_hz")).alias("n"), F.count_if(F.col("band_hz") > 0).over(by).alias("all"))
    part = lambda cond: F.coalesce(F.try_divide(F.sum(F.when(cond, F.col("e"))), F.greatest(F.sum("e"), F.lit(1e-10))), F.lit(0.0))
    return b.groupBy(*keys).agg(
        F.max(F.when(F.col("band_hz") == 0, F.col("max_amplitude_db") - F.col("rms_db"))).alias("true_peak_to_rms_ratio_db"),
        F.coalesce(F.try_divide(F.sum(F.col("band_hz") * F.col("e")), F.sum("e")), F.lit(0.0)).alias("spectral_centroid_hz"),
        part(F.col("n") <= 3).alias("bass_energy_ratio"), part(F.col("n").between(4, 7)).alias("mid_energy_ratio"), part(F.col("n") > F.col("all") - 3).alias("treble_energy_ratio"),
    )


def temporal_dynamics(windows: DataFrame, seconds: float | Column, keys=KEYS, jump_db: float = 3.0) -> DataFrame:
    """Stability of levels and crest factors over the windows, and jumps of the RMS level a second."""
    jump = F.abs(F.col("rms_level_dbfs") - F.lag("rms_level_dbfs").over(Window.partitionBy(*keys).orderBy("window_idx")))
    w = windows.withColumn("_jump", jump)
    c = F.col("crest_factor_db")
    return w.groupBy(*keys).agg(
        F.stddev_pop(c).alias("dynamic_consistency_std"), (F.count_if(F.col("_jump") > jump_db) / F.max(F.lit(seconds))).alias("transient_density_per_sec"),
        F.stddev_pop("rms_level_dbfs").alias("loudness_stability_std"), F.var_pop("peak_level_dbfs").alias("peak_level_variance"), (F.max(c) - F.min(c)).alias("temporal_crest_factor_range"),
    )


def parameters(wide: DataFrame, keys=KEYS) -> DataFrame:
    """A wide row of statistics as rows of (parameter, value)."""
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(list(keys), names, "parameter", "value")


def from_parameters(flat: DataFrame, names: list[str], keys=KEYS) -> DataFrame:
    """The wide row again. The names are given, so no extra pass looks for them."""
    return flat.groupBy(*keys).pivot("parameter", names).agg(F.first("value"))
