"""Levels, whole-interval statistics, histograms and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels
from ..operators import panes, reports, rollup, stats
from ..sources import series
from .views import EVENTS, USERS, events, rounded, sql, table, users
from .windows import FULL, WINDOWS

Q, O = {}, {}
KEYS = ["track_id", "channel_index"]
UNIT = ", un AS (SELECT track_id, channel_index, sample_idx, value / max(abs(value)) OVER (PARTITION BY channel_index) AS value FROM ev)"


def unit(s, d):
    return series.normalise(events(s, d)).drop("original_peak")


Q["s6_series_blocks"] = lambda s, d: series.to_blocks(series.from_table(series.ranked(table(s, d, "events"), "event_type", "c"), F.lit("events"), F.col("c"), ["ts", "event_id"], F.round("value", 6)), 64).select(
    *KEYS, "block_idx", "start_sample", F.size("samples").alias("n"), F.round(F.element_at("samples", 1), 6).alias("first_value"), F.round(F.element_at("samples", -1), 6).alias("last_value")
)
O["s6_series_blocks"] = """WITH e AS (SELECT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS channel_index, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, round(value, 6) AS value FROM events)
SELECT 'events' AS track_id, channel_index, i // 64 AS block_idx, min(i) AS start_sample, CAST(count(*) AS INTEGER) AS n, arg_min(value, i) AS first_value, arg_max(value, i) AS last_value FROM e GROUP BY channel_index, i // 64"""

Q["s4_section_trim"] = lambda s, d: rounded(series.to_rows(series.trim(series.to_blocks(events(s, d), 64), 100, 150)))
O["s4_section_trim"] = sql(EVENTS, "SELECT track_id, channel_index, sample_idx, value FROM ev WHERE sample_idx >= 100 AND sample_idx < 250", "value")


def _frames(s, d):
    e = table(s, d, "embeddings").select(F.lit("frames").alias("track_id"), F.col("vec_id").alias("sample_idx"), F.col("embedding").alias("frame"))
    return series.split_frames(e)


Q["s5_split_channels"] = lambda s, d: rounded(_frames(s, d))
O["s5_split_channels"] = sql("x AS (SELECT vec_id, embedding FROM embeddings)", "SELECT 'frames' AS track_id, CAST(i AS INTEGER) AS channel_index, vec_id AS sample_idx, embedding[i + 1]::DOUBLE AS value FROM x, range(64) r(i)", "value")
Q["p2_downmix"] = lambda s, d: rounded(series.downmix(_frames(s, d)))
O["p2_downmix"] = sql("x AS (SELECT vec_id, embedding FROM embeddings)", "SELECT 'frames' AS track_id, vec_id AS sample_idx, list_avg(embedding::DOUBLE[]) AS value FROM x", "value")
Q["p1_normalise"] = lambda s, d: rounded(series.normalise(events(s, d)))
O["p1_normalise"] = sql(EVENTS, "SELECT track_id, channel_index, sample_idx, value / max(abs(value)) OVER (PARTITION BY channel_index) AS value, max(abs(value)) OVER (PARTITION BY channel_index) AS original_peak FROM ev", "value original_peak")


def _levels(s, d):
    """All decibel forms of the samples of a channel, and back."""
    x = F.abs("value")
    is_lfe = F.col("channel_index") == 3
    return unit(s, d).select(
        *KEYS, "sample_idx", levels.dbfs(x).alias("dbfs_floor"), levels.dbfs(x, 1.0, None).alias("dbfs_null"), levels.dbfs_epsilon(x).alias("dbfs_eps"),
        levels.linear(levels.dbfs_epsilon(x)).alias("linear"), levels.spl(levels.dbfs(x), is_lfe).alias("spl"), levels.finite(F.when(F.col("sample_idx") % 7 == 0, float("nan")).otherwise(x)).alias("finite"),
    )


Q["p3_p7_p18_levels"] = lambda s, d: rounded(_levels(s, d))
O["p3_p7_p18_levels"] = sql(
    EVENTS + UNIT,
    """SELECT track_id, channel_index, sample_idx, coalesce(20 * log10(nullif(abs(value), 0)), -120) AS dbfs_floor, 20 * log10(nullif(abs(value), 0)) AS dbfs_null, 20 * log10(abs(value) + 1e-10) AS dbfs_eps,
  abs(value) + 1e-10 AS linear, coalesce(20 * log10(nullif(abs(value), 0)), -120) + CASE WHEN channel_index = 3 THEN 115 ELSE 105 END AS spl, CASE WHEN sample_idx % 7 = 0 THEN NULL ELSE abs(value) END AS finite FROM un""",
    "dbfs_floor dbfs_null dbfs_eps linear spl finite",
)


def _axes(s, d):
    """The time axes of the users' series, uniform and not, stored compactly and expanded again."""
    t = F.when(F.col("channel_index") % 2 == 0, F.col("sample_idx") * 0.5).otherwise(F.round(F.sqrt(F.col("sample_idx")), 6))
    a = users(s, d).withColumn("t", t).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: x).alias("times"))
    a = a.withColumn("axis", levels.compact_axis(F.col("times")))
    back = levels.expand_axis(F.col("axis.start"), F.col("axis.step"), F.size("times"), F.col("axis.values"))
    return a.select(*KEYS, F.col("axis.start").alias("start"), F.col("axis.step").alias("step"), F.size(back).cast("long").alias("n"), F.aggregate(back, F.lit(0.0), lambda x, y: x + y).alias("total"))


Q["p19_time_axis"] = lambda s, d: rounded(_axes(s, d), 4)
O["p19_time_axis"] = sql(
    USERS + ", t AS (SELECT track_id, channel_index, CASE WHEN channel_index % 2 = 0 THEN sample_idx * 0.5 ELSE round(sqrt(sample_idx), 6) END AS t FROM us)",
    "SELECT track_id, channel_index, 0.0 AS start, CASE WHEN channel_index % 2 = 0 THEN 0.5 END AS step, count(*) AS n, sum(t::DOUBLE) AS total FROM t GROUP BY ALL",
    "start step total",
    4,
)

Q["a1_whole_interval"] = lambda s, d: rounded(stats.whole_interval(users(s, d)))
O["a1_whole_interval"] = sql(
    USERS + ", a AS (SELECT track_id, channel_index, count(*) AS samples, max(abs(value)) AS peak, sqrt(avg(value * value)) AS rms FROM us GROUP BY ALL)",
    "SELECT *, greatest(peak / rms, 1) AS crest_factor, 20 * log10(greatest(peak / rms, 1)) AS crest_factor_db, 20 * log10(peak) AS peak_dbfs, 20 * log10(rms) AS rms_dbfs, rms > 0 AND 20 * log10(rms) >= -80 AS is_valid_crest_factor FROM a",
    "peak rms crest_factor crest_factor_db peak_dbfs rms_dbfs",
)
Q["a2_a3_band_statistics"] = lambda s, d: rounded(stats.band_statistics(users(s, d)))
O["a2_a3_band_statistics"] = sql(
    USERS + f""", a AS (SELECT track_id, channel_index, max(abs(value)) AS max_amplitude, sqrt(avg(value * value)) AS rms, avg(value) AS mean, stddev_pop(value) AS std,
  {', '.join(f'quantile_cont(abs(value), {p / 100}) AS p{p}' for p in stats.PERCENTILES)} FROM us GROUP BY ALL)""",
    """SELECT *, 20 * log10(max_amplitude) AS max_amplitude_db, 20 * log10(rms) AS rms_db, rms / max_amplitude AS dynamic_range, 20 * log10(rms / max_amplitude) AS dynamic_range_db,
  greatest(max_amplitude / rms, 1) AS crest_factor, 20 * log10(greatest(max_amplitude / rms, 1)) AS crest_factor_db FROM a""",
    "max_amplitude rms mean std max_amplitude_db rms_db dynamic_range dynamic_range_db crest_factor crest_factor_db " + " ".join(f"p{p}" for p in stats.PERCENTILES),
)
WIN = EVENTS + ", " + WINDOWS.format("ev") + f", full_ AS ({FULL})"
Q["a4_time_domain_summary"] = lambda s, d: rounded(stats.time_domain_summary(panes.fixed_window(events(s, d), 4, 2)))
O["a4_time_domain_summary"] = sql(
    WIN,
    """SELECT track_id, channel_index, count(*) AS total_windows, count(*) FILTER (is_valid_crest_factor) AS valid_windows, count(*) FILTER (NOT is_valid_crest_factor) AS invalid_windows,
  avg(crest_factor_db) AS crest_factor_mean_db, stddev_pop(crest_factor_db) AS crest_factor_std_db, min(crest_factor_db) AS crest_factor_min_db, max(crest_factor_db) AS crest_factor_max_db,
  avg(peak_level_dbfs) AS peak_level_mean_dbfs, stddev_pop(peak_level_dbfs) AS peak_level_std_dbfs, avg(rms_level_dbfs) AS rms_level_mean_dbfs, stddev_pop(rms_level_dbfs) AS rms_level_std_dbfs FROM full_ GROUP BY ALL""",
    "crest_factor_mean_db crest_factor_std_db crest_factor_min_db crest_factor_max_db peak_level_mean_dbfs peak_level_std_dbfs rms_level_mean_dbfs rms_level_std_dbfs",
)
Q["a24_window_medians"] = lambda s, d: rounded(stats.window_medians(panes.fixed_window(events(s, d), 4, 2)))
O["a24_window_medians"] = sql(
    WIN,
    "SELECT track_id, channel_index, median(peak_level_dbfs) AS median_peak_dbfs, median(rms_level_dbfs) AS median_rms_dbfs, median(crest_factor_db) AS median_crest_factor_db, count(*) FILTER (is_valid_crest_factor) AS valid_windows FROM full_ GROUP BY ALL",
    "median_peak_dbfs median_rms_dbfs median_crest_factor_db",
)
Q["a20_window_averages"] = lambda s, d: rounded(stats.window_averages(panes.fixed_window(events(s, d), 4, 2)))
O["a20_window_averages"] = sql(WIN, "SELECT track_id, channel_index, avg(crest_factor_db) AS mean_crest_db, 20 * log10(max(peak_level) / avg(rms_level)) AS peak_over_mean_rms_db FROM full_ GROUP BY ALL", "mean_crest_db peak_over_mean_rms_db")
Q["a8_temporal_dynamics"] = lambda s, d: rounded(stats.temporal_dynamics(panes.fixed_window(events(s, d), 4, 2), 100.0))
O["a8_temporal_dynamics"] = sql(
    WIN + ", j AS (SELECT *, abs(rms_level_dbfs - lag(rms_level_dbfs) OVER (PARTITION BY channel_index ORDER BY window_idx)) AS jump FROM full_)",
    """SELECT track_id, channel_index, stddev_pop(crest_factor_db) AS dynamic_consistency_std, count(*) FILTER (jump > 3) / 100.0 AS transient_density_per_sec, stddev_pop(rms_level_dbfs) AS loudness_stability_std,
  var_pop(peak_level_dbfs) AS peak_level_variance, max(crest_factor_db) - min(crest_factor_db) AS temporal_crest_factor_range FROM j GROUP BY ALL""",
    "dynamic_consistency_std transient_density_per_sec loudness_stability_std peak_level_variance temporal_crest_factor_range",
)
DB = EVENTS + UNIT + ", db AS (SELECT track_id, channel_index, 20 * log10(abs(value) + 1e-10) AS db FROM un)"
Q["a6_saturation"] = lambda s, d: rounded(stats.saturation(unit(s, d), 10.0))
O["a6_saturation"] = sql(
    DB,
    "SELECT track_id, channel_index, count(*) FILTER (db > -0.1) * 10.0 / count(*) AS clip_events_rate_per_sec, count(*) FILTER (db > -3) * 100.0 / count(*) AS peak_saturation_percent, count(*) FILTER (db > -3) * 1.0 / count(*) AS peak_density_above_minus3db, max(db) AS max_true_peak_dbfs FROM db GROUP BY ALL",
    "clip_events_rate_per_sec peak_saturation_percent peak_density_above_minus3db max_true_peak_dbfs",
)
Q["a10_peak_distribution"] = lambda s, d: rounded(stats.peak_distribution(unit(s, d)))
O["a10_peak_distribution"] = sql(
    DB,
    "SELECT track_id, channel_index, " + ", ".join(f"count(*) FILTER (db >= {lo} AND db < {hi}) * 100.0 / count(*) AS peak_distribution_{n}_percent" for n, lo, hi in stats.RANGES) + " FROM db GROUP BY ALL",
    " ".join(f"peak_distribution_{n}_percent" for n, _, _ in stats.RANGES),
)


def _histogram_sql(source: str, x: str, lo: float, hi: float, bins: int, keep: str) -> str:
    width = (hi - lo) / bins
    return sql(
        EVENTS + UNIT + f""", c AS (SELECT track_id, channel_index, CAST(least(floor(({x} - ({lo})) / {hi - lo} * {bins}), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM {source} WHERE {keep} GROUP BY ALL),
k AS (SELECT DISTINCT track_id, channel_index FROM un), b AS (SELECT track_id, channel_index, CAST(range AS INTEGER) AS bin FROM k, range({bins}))""",
        f"""SELECT track_id, channel_index, bin, {lo} + bin * {width}::DOUBLE AS bin_left, {lo} + (bin + 1) * {width}::DOUBLE AS bin_right, coalesce(n, 0) AS bin_count,
  coalesce(coalesce(n, 0) / (sum(n) OVER (PARTITION BY channel_index) * {width}::DOUBLE), 0) AS bin_density FROM b LEFT JOIN c USING (track_id, channel_index, bin)""",
        "bin_left bin_right bin_density",
    )


Q["a11_linear_histogram"] = lambda s, d: rounded(stats.linear_histogram(unit(s, d)))
O["a11_linear_histogram"] = _histogram_sql("un", "value", -1.0, 1.0, 50, "value BETWEEN -1 AND 1")
Q["a12_f1_log_histogram"] = lambda s, d: rounded(stats.log_histogram(unit(s, d)))
LOG = "greatest(coalesce(20 * log10(nullif(abs(value), 0)), -120), -120)"
O["a12_f1_log_histogram"] = _histogram_sql("un", LOG, -60.0, 0.0, 19, f"{LOG} BETWEEN -60 AND 0")
Q["a13_sample_histogram"] = lambda s, d: rounded(stats.sample_histogram(unit(s, d)))
O["a13_sample_histogram"] = _histogram_sql("un", "value", -1.0, 1.0, 51, "abs(value) > 1e-10 AND value BETWEEN -1 AND 1")


Q["p22_p24_metadata"] = lambda s, d: rounded(reports.track_metadata(users(s, d), 64.0, (1.0, 2.0, 4.0)))
O["p22_p24_metadata"] = sql(
    USERS,
    """SELECT track_id, channel_index, count(*) AS samples, max(abs(value)) AS original_peak, sqrt(avg(value * value)) AS rms, count(*) / 64.0 AS duration_seconds, 20 * log10(max(abs(value))) AS original_peak_dbfs,
  64.0 AS sample_rate, 'power_complementary_fft' AS octave_design, 'block' AS octave_mode, 30.0 AS octave_block_seconds, '1|2|4' AS octave_centres FROM us GROUP BY ALL""",
    "sample_rate octave_block_seconds original_peak rms duration_seconds original_peak_dbfs",
)

WIDE = "a AS (SELECT CAST(user_id AS INTEGER) AS channel_index, avg(value) AS mean, max(value) AS highest, count(*)::DOUBLE AS n FROM events GROUP BY ALL)"


def _wide(s, d):
    return table(s, d, "events").groupBy(F.lit("users").alias("track_id"), F.col("user_id").cast("int").alias("channel_index")).agg(F.avg("value").alias("mean"), F.max("value").alias("highest"), F.count("*").cast("double").alias("n"))


Q["a23_unpivot"] = lambda s, d: rounded(stats.parameters(_wide(s, d)))
O["a23_unpivot"] = sql(WIDE, "SELECT 'users' AS track_id, channel_index, parameter, value FROM (UNPIVOT a ON mean, highest, n INTO NAME parameter VALUE value)", "value")
Q["a23_pivot"] = lambda s, d: rounded(stats.from_parameters(stats.parameters(_wide(s, d)), ["mean", "highest", "n"]))
O["a23_pivot"] = sql(WIDE, "SELECT 'users' AS track_id, * FROM a", "mean highest n")


def _batch(s, d):
    """Orders as a batch of jobs: how many ended in each state, the slowest first with unknown times last."""
    o = table(s, d, "orders").select(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice").cast("double")).alias("seconds"), F.col("o_orderkey").alias("job"))
    return reports.batch_summary(o)


Q["a22_batch_summary"] = lambda s, d: rounded(_batch(s, d), 2)
O["a22_batch_summary"] = sql(
    "o AS (SELECT o_orderstatus AS status, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice::DOUBLE END AS seconds, o_orderkey AS job FROM orders)",
    "SELECT status, count(*) OVER (PARTITION BY status) AS jobs, CAST(row_number() OVER (PARTITION BY status ORDER BY seconds DESC NULLS LAST, job) AS INTEGER) AS place, job, seconds FROM o QUALIFY place <= 3",
    "seconds",
    2,
)


def _gains(s, d):
    """One series at three gains: levels shift by the gain, crest factors stay."""
    u = users(s, d).select("track_id", "channel_index", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0))).alias("gain"), "value").withColumn("value", F.col("value") * F.col("gain"))
    return rollup.gain_shifts(stats.whole_interval(u, ("track_id", "channel_index", "gain")))


Q["j10_gain_shifts"] = lambda s, d: rounded(_gains(s, d))
O["j10_gain_shifts"] = sql(
    USERS + ", a AS (SELECT track_id, channel_index, g AS gain, 20 * log10(max(abs(value * g))) AS p, 20 * log10(sqrt(avg(value * g * value * g))) AS r FROM us, (VALUES (0.25::DOUBLE), (0.5), (1.0)) t(g) GROUP BY ALL)",
    "SELECT x.track_id, x.channel_index, x.gain, x.p - y.p - 20 * log10(x.gain) AS peak_error_db, x.r - y.r - 20 * log10(x.gain) AS rms_error_db, (x.p - x.r) - (y.p - y.r) AS crest_error_db FROM a x JOIN a y ON x.channel_index = y.channel_index AND y.gain = 1",
    "gain peak_error_db rms_error_db crest_error_db",
)


def _panels(s, d):
    """Histograms of all channels as panels of one report; channel 0 stands for an unknown band."""
    h = stats.linear_histogram(unit(s, d)).withColumn("band_hz", F.when(F.col("channel_index") > 0, F.col("channel_index").cast("double")))
    return reports.histogram_panels(h, ("track_id",)).select("track_id", "channel_index", "bin_left", "bin_count", "place")


Q["g12_histogram_panels"] = lambda s, d: rounded(_panels(s, d))
O["g12_histogram_panels"] = sql(
    f"h AS ({O['a11_linear_histogram']})",
    "SELECT track_id, channel_index, bin_left, bin_count, CAST(row_number() OVER (ORDER BY nullif(channel_index, 0) NULLS LAST, bin_left) AS INTEGER) AS place FROM h",
    "bin_left",
)
