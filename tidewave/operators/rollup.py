"""Rollups of channels into groups, and the tables behind reports."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import SILENCE_DB
from .quantiles import percentiles

KEYS = ("track_id", "channel_index")
#: Search window of the recovery times; a time this near to it never recovered.
CAP_MS = 5000.0
# Fixed value: the order in which a channel's worst score is looked for.
SCORE_KEYS = ("t6_ms_p95", "t9_ms_p95", "t3_ms_p95", "t12_ms_p95", "hold_ms_p95")


def group_crest_table(windows: DataFrame, by: Sequence[str] = ("track_id", "channel_group")) -> DataFrame:
    """Crest factors of all windows of a group's channels, pooled."""
    c = F.col("crest_factor_db")
    valid = windows.where(c.isNotNull())
    q = percentiles(valid, by, {"_q": c}, [0.95, 0.9, 0.5])
    s = valid.groupBy(*by).agg(F.min(c).alias("min_db"), F.avg(c).alias("mean_db"), F.max(c).alias("max_db"), F.stddev_pop(c).alias("std_db"), F.count("*").alias("windows")).join(q, list(by))
    at = {n: F.col("_q")[k].alias(n) for k, n in enumerate(("p95_db", "p90_db", "median_db"))}
    return s.select(*by, "min_db", at["p95_db"], at["p90_db"], "mean_db", at["median_db"], "max_db", "std_db", "windows")


def mean_of_numbers(channels: DataFrame, by: Sequence[str] = ("track_id", "channel_group"), skip: Sequence[str] = KEYS) -> DataFrame:
    """The mean of every numeric column over a group's channels; nulls are skipped."""
    numeric = [c for c, t in channels.dtypes if t in ("double", "float", "int", "bigint") and c not in (*by, *skip)]
    return channels.groupBy(*by).agg(*(F.avg(c).alias(c) for c in numeric))


def occurrence_level(rate: Column) -> Column:
    return F.when(rate > 1, "high").when(rate > 0.1, "medium").otherwise("low")


def peak_occurrence(means: DataFrame) -> DataFrame:
    """How conspicuous a group's clipping, hot and loud peaks are; more than 10 a second above -3 dBFS is a finding of its own."""
    return means.select(
        "track_id", "channel_group", "peaks_above_minus3db_per_sec", "peaks_above_minus1db_per_sec", "peaks_above_minus0_1db_per_sec",
        occurrence_level(F.col("peaks_above_minus0_1db_per_sec")).alias("clipping"), occurrence_level(F.col("peaks_above_minus1db_per_sec")).alias("hot"), (F.col("peaks_above_minus3db_per_sec") > 10).alias("dense"),
    )


def decay_aggregate(channels: DataFrame, by: Sequence[str] = ("track_id", "channel_group"), thresholds: Sequence[int] = (3, 6, 9, 12)) -> DataFrame:
    """Per group and threshold the worst p95 recovery time, or the worst p90 where that hits the cap. Zeros are ignored."""
    stacked = channels.select(*by, F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}_ms_p95").alias("p95"), F.col(f"t{t}_ms_p90").alias("p90")) for t in thresholds))).alias("x")).select(*by, "x.*")
    positive = lambda c: F.max(F.when(F.col(c) > 0, F.col(c)))
    s = stacked.groupBy(*by, "threshold").agg(positive("p95").alias("a"), positive("p90").alias("b"))
    time = F.when(F.col("a") >= CAP_MS * 0.99, F.coalesce("b", "a")).otherwise(F.coalesce("a", F.lit(0.0)))
    return s.select(*by, "threshold", time.alias("time_ms"), (-F.col("threshold")).cast("double").alias("level_db"))


def decay_curve(times: DataFrame, by: Sequence[str] = ("track_id", "channel_group"), points: int = 400) -> DataFrame:
    """tau and amplitude of ``-A ln(1 + t / tau)`` through the middle time, the axis' extent, and the curve."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("time_ms") > 0, F.struct((-F.col("level_db")).alias("drop"), "time_ms"))))
    g = times.groupBy(*by).agg(ordered.alias("t"), F.max("time_ms").alias("most")).where(F.size("t") > 0)
    middle = F.col("t")[F.expr("size(t) div 2").cast("int")]
    fits = F.size("t") >= 2
    tau = F.when(fits, F.greatest(middle["time_ms"], F.lit(1.0))).otherwise(50.0)
    amplitude = F.when(fits, F.greatest(middle["drop"] / 0.693, F.lit(1.0))).otherwise(12.0)
    extent = F.greatest(F.lit(200), F.floor(F.col("most") * 1.2)).cast("int")
    g = g.select(*by, tau.alias("tau_ms"), amplitude.alias("amplitude_db"), extent.alias("x_max"))
    step = F.col("x_max") / (points - 1)
    curve = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct((i * step).alias("t_ms"), (-F.col("amplitude_db") * F.log1p(i * step / F.col("tau_ms"))).alias("level_db")))
    return g.withColumn("curve", curve)


def fit_decay(times: DataFrame, by: Sequence[str] = ("track_id", "channel_group")) -> DataFrame:
    """Bounded least squares of the same model; a group has one row a threshold, so a group is a few numbers."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[pdf["time_ms"] > 0]
        t, y = p["time_ms"].to_numpy(), -p["level_db"].to_numpy()
        tau, a = 50.0, 12.0
        if len(t) >= 2:
            grid = np.exp(np.linspace(np.log(1.0), np.log(5000.0), 400))
            for _ in range(4):  # for a given tau the amplitude is linear
                basis = np.log1p(t[None, :] / grid[:, None])
                best = np.clip((basis * y).sum(1) / (basis**2).sum(1), 1.0, 100.0)
                k = int(((best[:, None] * basis - y) ** 2).sum(1).argmin())
                tau, a = float(grid[k]), float(best[k])
                grid = np.exp(np.linspace(np.log(grid[max(0, k - 1)]), np.log(grid[min(len(grid) - 1, k + 1)]), 400))
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in by} | {"tau_ms": [tau], "amplitude_db": [a]})

    types = dict(times.dtypes)
    return times.groupBy(*by).applyInPandas(fit, ", ".join(f"{c} {types[c]}" for c in by) + ", tau_ms double, amplitude_db double")


def worst_scores(channels: DataFrame, sustained: DataFrame, advanced: DataFrame, keys=KEYS) -> DataFrame:
    """A channel's score: the first recovery statistic it has, else saturation, else clipping, else 0."""
    j = channels.join(sustained, list(keys), "left").join(advanced, list(keys), "left")
    found = [(c, f"sustained:{c}") for c in SCORE_KEYS] + [(c, f"advanced:{c}") for c in ("peak_saturation_percent", "clip_events_rate_per_sec")]
    metric = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(name)) for c, name in found), F.lit("none"))
    return j.select(*channels.columns, F.coalesce(*(F.col(c).cast("double") for c, _ in found), F.lit(0.0)).alias("score"), metric.alias("metric_used"))


def worst_channels(scored: DataFrame, by: Sequence[str] = ("track_id", "channel_group")) -> DataFrame:
    """The channel of the largest score of each group, the first on ties."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "channel_index")
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def nearest_bands(metrics: DataFrame, wanted: Sequence[float], tolerance: float = 0.2, keys=KEYS) -> DataFrame:
    """Rows of the stored band nearest to each wanted one, if it is within the tolerance. The wanted list is fixed and small.

    The metrics are read once; rows of bands that are near no wanted one go first.
    """
    wanted = [float(x) for x in dict.fromkeys(wanted)]
    away = lambda x: F.abs(F.col("band_hz") - x)
    if not wanted:
        return metrics.where("false").withColumn("wanted_hz", F.lit(None).cast("double"))
    near = metrics.where(functools.reduce(Column.__or__, (away(x) <= tolerance for x in wanted)))
    pairs = F.array(*(F.struct(F.lit(x).alias("wanted_hz"), away(x).alias("d")) for x in wanted))
    near = near.select("*", F.explode(F.filter(pairs, lambda p: p["d"] <= tolerance)).alias("_p"))
    place = F.struct("_p.d", "band_hz")
    near = near.withColumn("_least", F.min(place).over(Window.partitionBy(*keys, "_p.wanted_hz")))
    return near.where(place == F.col("_least")).select(*metrics.columns, "_p.wanted_hz")


def deep_dive(octave_time: DataFrame, bands: Sequence[float], keys=KEYS) -> DataFrame:
    """Per band over time: crest factors from 0, levels from -120 dBFS."""
    near = nearest_bands(octave_time, bands, keys=keys)
    floor = lambda c: F.greatest(F.coalesce(c, F.lit(SILENCE_DB)), F.lit(SILENCE_DB)).alias(c)
    return near.select(*keys, "wanted_hz", "time_seconds", F.greatest("crest_factor_db", F.lit(0.0)).alias("crest_factor_db"), floor("peak_level_dbfs"), floor("rms_level_dbfs"))


def crest_limits(windows: DataFrame, by: Sequence[str] = ("track_id", "channel_group")) -> DataFrame:
    """Limits of a group's crest axis: whole steps of 5 dB around the data, 20 dB at least."""
    c = F.col("crest_factor_db")
    return windows.groupBy(*by).agg(F.min(c).alias("lowest"), F.max(c).alias("highest")).select(*by, "lowest", "highest", F.greatest(F.ceil(F.col("highest") / 5) * 5, F.lit(20)).cast("double").alias("y_max"))


def best_candidates(errors: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The candidate of the least mean absolute error, then of the least RMSE, then the first."""
    order = Window.partitionBy(*by).orderBy("mean_abs_error_db", "rmse_db", value)
    return errors.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def compare_to_reference(candidate: DataFrame, reference: DataFrame, by: Sequence[str], warm_up: int = 0) -> DataFrame:
    """Errors of a candidate's windows against the reference's, over the windows both have, after a warm-up."""
    j = candidate.alias("c").join(reference.select(*(k for k in by if k in reference.columns), "window_idx", F.col("crest_factor_db").alias("_ref")), [*(k for k in by if k in reference.columns), "window_idx"])
    e = F.abs(F.col("crest_factor_db") - F.col("_ref"))
    kept = j.where((F.col("window_idx") >= warm_up) & e.isNotNull()).withColumn("_e", e)
    return kept.groupBy(*by).agg(F.avg("_e").alias("mean_abs_error_db"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse_db"), F.percentile("_e", F.lit(0.95)).alias("p95_abs_error_db"), F.max("_e").alias("max_abs_error_db"))


def gain_shifts(metrics: DataFrame, reference_gain: float = 1.0, by: Sequence[str] = KEYS) -> DataFrame:
    """Each gain's levels less the gain itself against those of the reference gain, and the crest factor's change."""
    ref = metrics.where(F.col("gain") == reference_gain).select(*by, F.col("peak_dbfs").alias("_p"), F.col("rms_dbfs").alias("_r"), F.col("crest_factor_db").alias("_c"))
    shift = 20 * F.log10(F.col("gain") / reference_gain)
    return metrics.join(ref, list(by)).select(
        *by, "gain", (F.col("peak_dbfs") - F.col("_p") - shift).alias("peak_error_db"), (F.col("rms_dbfs") - F.col("_r") - shift).alias("rms_error_db"), (F.col("crest_factor_db") - F.col("_c")).alias("crest_error_db")
    )


def wide_series(metrics: DataFrame, bands: Sequence[float], keys=KEYS) -> DataFrame:
    """A column of crest factors for each band, over time. The bands are given, so no pass looks for them."""
    name = lambda b: f"cf_{b:g}_hz".replace(".", "_")
    return metrics.groupBy(*keys, "window_idx").agg(*(F.max(F.when(F.col("band_hz") == b, F.col("crest_factor_db"))).alias(name(b)) for b in bands))


def summary_matrix(flat: DataFrame, by: Sequence[str]) -> DataFrame:
    """``t6_ms_p95`` and the like as a matrix of metric by statistic."""
    statistics = ["mean", "median", "p90", "p95", "max"]
    parts = flat.select(*by, F.regexp_extract("parameter", r"^(.*)_([a-z0-9]+)$", 1).alias("metric"), F.regexp_extract("parameter", r"^(.*)_([a-z0-9]+)$", 2).alias("statistic"), "value")
    return parts.groupBy(*by, "metric").pivot("statistic", statistics).agg(F.first("value"))


def shorten(messages: Column, most: int) -> Column:
    """The first messages, and how many more there are."""
    extra = F.size(messages) - most
    return F.concat_ws("; ", F.slice(messages, 1, most), F.when(extra > 0, F.format_string("... and %d more", extra)))
