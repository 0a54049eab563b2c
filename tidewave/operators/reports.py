"""Operators over whole analyses: the tables that reports, exports and drivers are made of."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import check_centres
from ..functions.channels import classify, group_label
from ..functions.levels import crest_db, dbfs, finite
from . import panes, patterns, peaks, rollup, scan, spectral, stats, walk

KEYS = ("track_id", "channel_index")


def report_cell(value: Column, digits: int = 1) -> Column:
    """A number as a report prints it: zero plainly, no value as such, others with ``digits`` decimals."""
    near = F.bround(value, digits)
    sign = F.when((value < 0) & (near == 0), "-").otherwise("")  # a small loss stays one, as in C and in Python; bround drops the sign
    return F.when(value.isNull(), "N/A").when(value == 0, "0.0").otherwise(F.concat(sign, F.format_string(f"%.{digits}f", near)))


def track_metadata(rows: DataFrame, rate: float, centres: Sequence[float], design: str = "power_complementary_fft", mode: str = "block", block_seconds: float = 30.0, keys=KEYS) -> DataFrame:
    """A row a channel: length, original peak and level, and how the octave bands were made."""
    x = F.col("value")
    m = rows.groupBy(*keys).agg(F.count("*").alias("samples"), F.max(F.abs(x)).alias("original_peak"), F.sqrt(F.avg(x * x)).alias("rms"))
    listed = "|".join(f"{c:g}" for c in check_centres(centres))
    return m.select(
        "*", (F.col("samples") / rate).alias("duration_seconds"), F.lit(rate).alias("sample_rate"), dbfs(F.col("original_peak")).alias("original_peak_dbfs"),
        F.lit(design).alias("octave_design"), F.lit(mode).alias("octave_mode"), F.lit(block_seconds).alias("octave_block_seconds"), F.lit(listed).alias("octave_centres"),
    )


def batch_summary(jobs: DataFrame, top: int = 3, by: Sequence[str] = ("status",)) -> DataFrame:
    """``(by, jobs, place, job, seconds)``: how many of ``(by, job, seconds)`` ended in each state, and the slowest of each, unknown times last."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("seconds"), "job"))
    slowest = jobs.select(*by, "job", "seconds", place.alias("place")).where(F.col("place") <= top)
    return slowest.join(jobs.groupBy(*by).agg(F.count("*").alias("jobs")), list(by)).select(*by, "jobs", "place", "job", "seconds")


def filter_channels(channels: DataFrame, filters: DataFrame) -> DataFrame:
    """``(filter, id)`` of the channels ``(id, tokens)`` that each of ``(filter, tokens)`` matches; a filter that matches none has a null id."""
    flat = channels.select("id", F.explode("tokens").alias("token"))
    asked = filters.select("filter", F.explode("tokens").alias("token"))
    hit = flat.join(asked, "token").select("filter", "id").distinct()
    none = filters.select("filter").distinct().join(hit, "filter", "left_anti")
    return hit.unionByName(none.select("filter", F.lit(None).cast(dict(channels.dtypes)["id"]).alias("id")))


def report_groups(channels: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds ``report_group`` to ``(track_id, folder, channel_name, total_channels)``.

    The group of the folder in the manifest ``(track_id, folder, group)``, else
    that of the name's tokens, else Mono for a single channel.
    """
    known = manifest.groupBy("track_id", "folder").agg(F.min("group").alias("_known"))
    name = classify(F.col("channel_name"))
    group = F.coalesce("_known", F.when(name.isNotNull(), group_label(name)), F.when(F.col("total_channels") == 1, "Mono"), F.lit("All Channels"))
    return channels.join(known, ["track_id", "folder"], "left").select(*channels.columns, group.alias("report_group"))


def in_report_order(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``place``: the row's place in its panel, by the order columns, unknown values last."""
    at = Window.partitionBy(*by).orderBy(*(F.asc_nulls_last(c) for c in order))
    return rows.withColumn("place", F.row_number().over(at))


def histogram_panels(histograms: DataFrame, keys=KEYS) -> DataFrame:
    """Histograms ``(keys, band_hz, bin_left, ...)`` in the order of a report: by band, unknown bands last, then by bin."""
    return in_report_order(histograms, keys, ["band_hz", "bin_left"])


def extreme_overlay(extremes: DataFrame, keys=KEYS, kinds: Sequence[str] = ("min_chunk", "max_chunk")) -> DataFrame:
    """The marks of extreme chunks over a time axis, in the order of time."""
    marks = extremes.where(F.col("chunk_type").isin(*kinds) & F.col("crest_factor_db").isNotNull())
    return in_report_order(marks.select(*keys, "chunk_type", "chunk_idx", "crest_factor_db"), keys, ["chunk_idx", "chunk_type"])


def octave_time(blocks: DataFrame, centres: Sequence[float], rate: float, window: int, step: int, peak: Column | float = 1.0, floor: float = panes.FLOOR_DB) -> DataFrame:
    """Crest factors and levels of every band over time, from the bands' panes: no row a sample.

    Blocks start at multiples of the pane, which is the largest length that window and step are made of.
    """
    keys = (*KEYS, "band_hz")
    g = gcd(window, step)
    levels = panes.levels_of_panes(spectral.band_panes(blocks, centres, rate, g), g, window, step, keys)
    return levels.select(*keys, "window_idx", (F.col("end_sample") / rate).alias("time_seconds"), *panes.crest_columns(rate, peak, floor, True))


def extreme_band_statistics(blocks: DataFrame, centres: Sequence[float], rate: float, chunk: int) -> DataFrame:
    """Of the chunks of least and largest crest factor of each channel: the statistics of every band.

    Blocks are whole multiples of the chunk, so a chosen chunk's statistics
    are made where its block is transformed, and its samples are never rows.
    Only blocks that hold a chosen chunk are transformed.
    """
    centres = tuple(check_centres(centres).tolist())
    hz, types = np.array([0.0, *centres]), ", ".join(f"{k} {dict(blocks.dtypes)[k]}" for k in KEYS)

    def levels(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, x in spectral.blocks_of_a_length(parts):
            first = np.arange(0, x.shape[1], chunk)
            n = np.broadcast_to(np.minimum(chunk, x.shape[1] - first), (len(rows), len(first)))
            own = {k: np.repeat(rows[k].to_numpy(), len(first)) for k in (*KEYS, "start_sample")}
            yield pd.DataFrame(own | {"chunk_idx": (rows["start_sample"].to_numpy()[:, None] + first).ravel() // chunk, "peak": np.maximum.reduceat(np.abs(x), first, axis=1).ravel(), "rms": np.sqrt(np.add.reduceat(x * x, first, axis=1) / n).ravel()})

    def describe(parts: Iterator[pd.DataFrame]) -> Iterator[walk.Columns]:
        for rows, x in spectral.blocks_of_a_length(parts, len(hz)):
            b = spectral.bank(x, centres, rate)
            first = (rows["chunk_idx"].to_numpy() * chunk - rows["start_sample"].to_numpy())[:, None, None]
            at = np.minimum(first + np.arange(chunk), b.shape[2])  # a series may end within a chunk
            b = np.concatenate([b, np.full((*b.shape[:2], 1), np.nan)], axis=2)
            found = stats.moments(np.take_along_axis(b, np.broadcast_to(at, (*b.shape[:2], chunk)), 2))
            own = {k: np.repeat(rows[k].to_numpy(), len(hz)) for k in (*KEYS, "chunk_type", "chunk_idx", "chunk_crest_factor_db")}
            yield own | {"band_hz": np.tile(hz, len(rows))} | {k: v.ravel() if v.ndim == 2 else walk.Lists.of_rows(v.reshape(-1, v.shape[2])) for k, v in found.items()}

    held = blocks.select(*KEYS, "start_sample", "samples")
    found = held.mapInPandas(levels, f"{types}, start_sample long, chunk_idx long, peak double, rms double")
    c = F.round(crest_db(F.col("peak"), F.col("rms")), 9)
    chosen = panes.extreme_chunks(found.select(*KEYS, "start_sample", "chunk_idx", c.alias("crest_factor_db")))
    inside = held.join(chosen.withColumnRenamed("crest_factor_db", "chunk_crest_factor_db"), [*KEYS, "start_sample"])
    columns = "chunk_type string, chunk_idx long, chunk_crest_factor_db double, band_hz double, max_amplitude double, rms double, mean double, std double, _q array<double>"
    return stats.described(walk.map_frames(inside, describe, f"{types}, {columns}"), (*KEYS, "chunk_type", "chunk_idx", "chunk_crest_factor_db", "band_hz"))


def tau_study(rows: DataFrame, taus: Sequence[float], lengths: Sequence[int], rms_tau: float, block: int = 4096, warm_up: int = 1) -> DataFrame:
    """``(length, tau, mean_abs_error_db, rmse_db)``: which decay of the peak hold comes nearest to the
    chunks' own crest factors, over all channels, for each length of chunk. Times are in samples."""
    from ..sources.series import to_blocks

    specs = [("slow", 1 - math.exp(-1 / rms_tau)), *(("hold", math.exp(-1 / tau)) for tau in taus)]
    at = scan.sampled(to_blocks(rows, block), specs, lengths).where("e0 > 0").withColumnRenamed("step", "length")
    made = F.explode(F.array(*(F.struct(F.lit(tau).alias("tau"), F.col(f"e{k}").alias("peak")) for k, tau in enumerate(taus, 1)))).alias("x")
    cand = at.select(*KEYS, F.col("length").cast("int").alias("length"), F.expr("(sample_idx + 1) div length - 1").alias("window_idx"), F.col("e0").alias("rms"), made)
    cand = cand.select(*KEYS, "x.tau", "length", "window_idx", crest_db(F.col("x.peak"), F.col("rms")).alias("crest_factor_db"))
    level = F.coalesce(crest_db(F.col("peak"), F.col("rms")), F.lit(0.0)).alias("crest_factor_db")
    ref = panes.chunks_of_lengths(rows, lengths).select(*KEYS, F.col("window").alias("length"), F.col("chunk_idx").alias("window_idx"), level)
    errors = rollup.compare_to_reference(cand, ref, [*KEYS, "length", "tau"], warm_up=warm_up)
    pooled = errors.groupBy("length", "tau").agg(F.avg("mean_abs_error_db").alias("mean_abs_error_db"), F.avg("rmse_db").alias("rmse_db"))
    return rollup.best_candidates(pooled, ["length"], "tau")


def json_windows(windows: DataFrame, values: Sequence[str], keys=KEYS, order: str = "window_idx", run: int = 4096) -> DataFrame:
    """``(keys, part, doc)``: windows as JSON documents, in order; numbers that are not finite become null.

    A document holds the windows of one run of ``run`` numbers, so no row grows with its series.
    """
    safe = F.struct(order, *(finite(F.col(c)).alias(c) for c in values))
    doc = F.to_json(F.array_sort(F.collect_list(safe)), {"ignoreNullFields": "false"})
    return windows.groupBy(*keys, F.expr(f"{order} div {run}").alias("part")).agg(doc.alias("doc"))


def pattern_peaks(*sets: DataFrame, keys=KEYS) -> DataFrame:
    """The union of the peaks of several sets of patterns."""
    out = sets[0].select(*keys, "peak_idx")
    for s in sets[1:]:
        out = out.unionByName(s.select(*keys, "peak_idx"))
    return out.distinct()


def kept(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """``df`` written to a folder and read again, where there is one."""
    if folder is None:
        return df
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def envelope_analysis(levels: DataFrame, rate: float, height: float, distance: int, window: int | dict[float, int], keys=KEYS, similarity: float = 0.9, least: int = 3, most: int = 10, top: int = 5, least_db: float = -3.0, seconds: float = 5.0, sort_by: str = "peak_value", folder: str | None = None) -> dict[str, DataFrame]:
    """All that is said of envelope levels, rows or blocks: for bands, with the band among the keys.

    ``peaks``, ``patterns``, ``pattern_statistics``, ``worst_cases`` (none of
    the patterns' peaks, with their windows), ``sustained`` and
    ``sustained_summary``. With a ``folder``, levels, peaks and patterns, each
    of which is read often, are written there and read again; it is the
    caller's to delete. Without one nothing is kept, and each table makes what
    it reads anew.
    """
    levels = kept(levels, folder, "levels")
    found = kept(peaks.find_peaks(levels, height, distance, keys), folder, "peaks")
    members = kept(patterns.repeating_patterns(peaks.windows_around(found, levels, window, keys), similarity, least, most, keys), folder, "patterns")
    events = peaks.sustained_events(found, levels, rate, least_db, seconds=seconds, keys=keys)
    return {
        "levels": levels, "peaks": found, "patterns": members, "pattern_statistics": patterns.pattern_statistics(members, rate, keys),
        "worst_cases": peaks.worst_case(found, levels, rate, top, pattern_peaks(members, keys=keys), sort_by, keys=keys, window=window), "sustained": events,
        "sustained_summary": peaks.sustained_summary(events, levels, keys=keys),
    }


def band_envelope_analysis(blocks: DataFrame, centres: Sequence[float], rate: float, height: float, distance: int, wavelengths: float = 1.0, window_wavelengths: float = 50.0, fallback_ms: float = 10.0, digits: int | None = None, **options) -> dict[str, DataFrame]:
    """:func:`envelope_analysis` of every octave band of blocks of samples, and of the full spectrum as band 0.

    Each band's follower releases over ``wavelengths`` of its centre, and its
    windows are ``window_wavelengths`` long, up to half a second; the full
    spectrum has times of its own.
    """
    levels = scan.band_envelopes(blocks, centres, rate, wavelengths, fallback_ms, digits)
    length = lambda hz: max(2, int(peaks.window_ms(hz, window_wavelengths, fallback_ms) * rate / 1000))
    windows = {hz: length(hz) for hz in (0.0, *check_centres(centres).tolist())}
    return envelope_analysis(levels, rate, height, distance, windows, (*KEYS, "band_hz"), **options)


def band_summaries(blocks: DataFrame, centres: Sequence[float], rate: float, bins: int = 50, folder: str | None = None) -> dict[str, DataFrame]:
    """``bands``, ``linear`` and ``log``: statistics and histograms of every band, with no row a sample where a series is one block.

    A block is transformed once, and gives the counts of its bins and, if it
    is its whole series, moments and percentiles. The percentiles of series
    of several blocks are made from their rows.
    """
    centres = tuple(check_centres(centres).tolist())
    by, hz, logs = (*KEYS, "band_hz"), np.array([0.0, *centres]), stats.log_bins()
    types = ", ".join(f"{k} {dict(blocks.dtypes)[k]}" for k in KEYS)

    def describe(parts: Iterator[pd.DataFrame]) -> Iterator[walk.Columns]:
        for rows, x in spectral.blocks_of_a_length(parts, len(hz)):
            b = spectral.bank(x, centres, rate).reshape(-1, x.shape[1])
            found = stats.moments(b) | {"linear": stats.counted(b, -1.0, 1.0, bins), "log": stats.counted(stats.decibels(b), -60.0, 0.0, logs)}
            own = {k: np.repeat(rows[k].to_numpy(), len(hz)) for k in KEYS}
            yield own | {"band_hz": np.tile(hz, len(rows))} | {k: v if v.ndim == 1 else walk.Lists.of_rows(v) for k, v in found.items()}

    columns = "band_hz double, max_amplitude double, rms double, mean double, std double, _q array<double>, linear array<bigint>, log array<bigint>"
    held = blocks.select(*KEYS, "start_sample", "samples")
    made = kept(walk.map_frames(held, describe, f"{types}, {columns}"), folder, "summaries")
    several = blocks.groupBy(*KEYS).agg(F.count("*").alias("_n")).where("_n > 1").select(*KEYS)
    whole = stats.described(made.join(several, list(KEYS), "left_anti"), by)
    cut = stats.band_statistics(spectral.band_rows(held.join(several, list(KEYS), "left_semi"), centres, rate), by)
    counts = made.select(*by, "linear", "log")
    return {"bands": whole.unionByName(cut), "linear": stats.histogram_of_counts(counts, "linear", -1.0, 1.0, bins, by), "log": stats.histogram_of_counts(counts, "log", -60.0, 0.0, logs, by)}


def full_analysis(blocks: DataFrame, centres: Sequence[float], rate: float, window: int, step: int, chunk: int, height: float = -60.0, distance: int = 1, bins: int = 50, folder: str | None = None, **envelope) -> dict[str, DataFrame]:
    """The tables of a full export, by name, from blocks of samples between -1 and 1.

    ``window`` and ``step`` are those of the levels over time, ``chunk`` the
    length among which the extremes are looked for, ``height`` and
    ``distance`` those of peaks; further options are those of
    :func:`band_envelope_analysis`; so is ``folder``. Blocks are whole multiples of chunks and of
    the panes that windows are made of.
    """
    from ..sources.series import to_rows

    rows = to_rows(blocks)
    summaries = band_summaries(blocks, centres, rate, bins, folder)
    bands = kept(summaries["bands"], folder, "bands")
    windows = kept(panes.fixed_window(rows, window, step, rate), folder, "windows")
    found = band_envelope_analysis(blocks, centres, rate, height, distance, folder=folder, **envelope)
    events = kept(found["sustained"], folder, "sustained")
    seconds = rows.groupBy(*KEYS).agg((F.count("*") / rate).alias("seconds"))
    peak_rates = stats.peak_rates(found["peaks"].where("band_hz = 0").drop("band_hz"), seconds)
    wide = stats.saturation(rows, rate)
    for more in (peak_rates, stats.peak_distribution(rows), stats.frequency_dynamics(bands), stats.mastering_indicators(bands), stats.temporal_dynamics(windows.join(seconds, list(KEYS)), F.col("seconds"))):
        wide = wide.join(more.drop("seconds"), list(KEYS), "left")
    return {
        "track_metadata": track_metadata(rows, rate, centres), "octave_band_analysis": bands, "time_domain_summary": stats.time_domain_summary(windows), "time_domain_analysis": windows,
        "advanced_statistics": stats.parameters(wide), "extreme_chunks_octave_analysis": extreme_band_statistics(blocks, centres, rate, chunk),
        "histogram_linear": summaries["linear"], "histogram_log_db": summaries["log"], "octave_time_metrics": octave_time(blocks, centres, rate, window, step),
        "envelope_statistics": found["worst_cases"], "envelope_pattern_analysis": found["pattern_statistics"], "sustained_peaks_summary": peaks.sustained_summary(events, found["levels"], keys=(*KEYS, "band_hz"), stored=folder is not None), "sustained_peaks_events": events,
    }
