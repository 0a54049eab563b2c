"""Windows, envelopes and ordered scans."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import panes, reports, rollup, scan, spectral
from ..sources import series
from .views import BANK, CENTRES, EVENTS, RATE, USERS, event_values, events, rounded, sql, users, vectors

Q, O = {}, {}
CREST = """CASE WHEN rms > 0 AND coalesce(20 * log10(nullif(rms, 0)), -120) >= -80 THEN greatest(peak / rms, 1) END"""
WINDOWS = """p AS (SELECT track_id, channel_index, sample_idx // 2 AS pane, max(abs(value)) AS m, sum(value * value) AS s, count(*) AS n FROM {0} GROUP BY ALL),
w AS (SELECT track_id, channel_index, pane, max(m) OVER f AS peak, sqrt(sum(s) OVER f / 4) AS rms, sum(n) OVER f AS n FROM p WINDOW f AS (PARTITION BY track_id, channel_index ORDER BY pane ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
win AS (SELECT track_id, channel_index, pane - 1 AS window_idx, (pane + 1) * 2.0 AS time_seconds, peak, rms, """ + CREST + """ AS crest_factor FROM w WHERE n = 4 AND pane >= 1)"""
FULL = """SELECT track_id, channel_index, window_idx, time_seconds, crest_factor, 20 * log10(crest_factor) AS crest_factor_db, peak AS peak_level, rms AS rms_level,
  coalesce(20 * log10(nullif(peak, 0)), -120) AS peak_level_dbfs, coalesce(20 * log10(nullif(rms, 0)), -120) AS rms_level_dbfs, crest_factor IS NOT NULL AS is_valid_crest_factor FROM win"""
FULL_DOUBLES = "time_seconds crest_factor crest_factor_db peak_level rms_level peak_level_dbfs rms_level_dbfs"

Q["w1_fixed_window_crest"] = lambda s, d: rounded(panes.fixed_window(events(s, d), 4, 2))
O["w1_fixed_window_crest"] = sql(EVENTS + ", " + WINDOWS.format("ev"), FULL, FULL_DOUBLES)

Q["w2_fixed_chunk_crest"] = lambda s, d: rounded(panes.fixed_chunk(events(s, d), 8))
O["w2_fixed_chunk_crest"] = sql(
    EVENTS + """, p AS (SELECT track_id, channel_index, sample_idx // 8 AS chunk_idx, max(abs(value)) AS peak, sqrt(avg(value * value)) AS rms, count(*) AS n FROM ev GROUP BY ALL),
c AS (SELECT *, CASE WHEN rms > 0 THEN greatest(peak / rms, 1) ELSE 1 END AS cf FROM p WHERE n = 8)""",
    """SELECT track_id, channel_index, chunk_idx, (chunk_idx + 1) * 8.0 AS time_seconds, cf AS crest_factor, 20 * log10(cf) AS crest_factor_db, peak AS peak_level, rms AS rms_level,
  coalesce(20 * log10(nullif(peak, 0)), -120) AS peak_level_dbfs, coalesce(20 * log10(nullif(rms, 0)), -120) AS rms_level_dbfs FROM c""",
    FULL_DOUBLES,
)

DECAY, SLOW, FOLLOW = math.exp(-0.125), 0.125, 0.25


def _scanned(kind: str, rate: float):
    return lambda s, d: rounded(series.to_rows(scan.envelope(series.to_blocks(users(s, d), 16), kind, rate)).withColumnRenamed("value", "envelope"), 4)


HOLD_SQL = """e AS (SELECT track_id, channel_index, sample_idx, exp(max(ln(greatest(abs(value), 1e-300)) + 0.125 * sample_idx) OVER (PARTITION BY channel_index ORDER BY sample_idx) - 0.125 * sample_idx) AS envelope FROM us)"""
SLOW_SQL = """RECURSIVE {0}, e AS (SELECT track_id, channel_index, sample_idx, value * value AS y FROM us WHERE sample_idx = 0
  UNION ALL SELECT u.track_id, u.channel_index, u.sample_idx, e.y + 0.125 * (u.value * u.value - e.y) FROM e JOIN us u ON u.channel_index = e.channel_index AND u.sample_idx = e.sample_idx + 1)"""
FOLLOW_SQL = """RECURSIVE {0}, e AS (SELECT track_id, channel_index, sample_idx, abs(value) AS envelope FROM us WHERE sample_idx = 0
  UNION ALL SELECT u.track_id, u.channel_index, u.sample_idx, greatest(abs(u.value), 0.75 * e.envelope + 0.25 * abs(u.value)) FROM e JOIN us u ON u.channel_index = e.channel_index AND u.sample_idx = e.sample_idx + 1)"""

Q["w6_peak_hold_blocks"] = _scanned("hold", DECAY)
Q["w6_peak_hold_window"] = lambda s, d: rounded(scan.peak_hold(users(s, d), 0.125), 4)
O["w6_peak_hold_blocks"] = O["w6_peak_hold_window"] = sql(f"{USERS}, {HOLD_SQL}", "SELECT * FROM e", "envelope", 4)
Q["w7_slow_rms"] = _scanned("slow", SLOW)
O["w7_slow_rms"] = sql(SLOW_SQL.format(USERS), "SELECT track_id, channel_index, sample_idx, sqrt(y) AS envelope FROM e", "envelope", 4)
Q["w8_peak_follower"] = _scanned("follow", FOLLOW)
O["w8_peak_follower"] = sql(FOLLOW_SQL.format(USERS), "SELECT * FROM e", "envelope", 4)
Q["w10_simple_follower"] = lambda s, d: rounded(scan.peak_hold(users(s, d), -math.log(1 - 1 / 7)), 4)
O["w10_simple_follower"] = sql(
    FOLLOW_SQL.format(USERS).replace("0.75 * e.envelope + 0.25 * abs(u.value)", "e.envelope * (1 - 1.0 / 7)"), "SELECT * FROM e", "envelope", 4
)

Q["w3_slow_crest"] = lambda s, d: rounded(scan.slow_crest(users(s, d), 4, rms_tau=8, peak_tau=8, block=16))
O["w3_slow_crest"] = sql(
    SLOW_SQL.format(USERS).replace("0.125 * (u.value", "(1 - exp(-0.125)) * (u.value").replace(", e AS", f", {HOLD_SQL.replace('e AS', 'h AS', 1)}, e AS", 1)
    + ", j AS (SELECT e.track_id, e.channel_index, e.sample_idx, h.envelope AS peak, sqrt(e.y) AS rms FROM e JOIN h ON e.channel_index = h.channel_index AND e.sample_idx = h.sample_idx WHERE (e.sample_idx + 1) % 4 = 0)",
    """SELECT track_id, channel_index, (sample_idx + 1) // 4 - 1 AS window_idx, sample_idx + 1.0 AS time_seconds, greatest(peak / rms, 1) AS crest_factor, 20 * log10(greatest(peak / rms, 1)) AS crest_factor_db,
  20 * log10(peak) AS peak_level_dbfs, 20 * log10(rms) AS rms_level_dbfs FROM j WHERE rms > 0""",
    "time_seconds crest_factor crest_factor_db peak_level_dbfs rms_level_dbfs",
)

Q["w4_mode_dispatch"] = lambda s, d: rounded(panes.time_domain(events(s, d), "no such mode", window=4, step=2))
O["w4_mode_dispatch"] = O["w1_fixed_window_crest"]
Q["w4_mode_chunk"] = lambda s, d: rounded(panes.time_domain(events(s, d), "fixed_chunk", window=8, step=8))
O["w4_mode_chunk"] = O["w2_fixed_chunk_crest"]
Q["w4_mode_slow"] = lambda s, d: rounded(panes.time_domain(users(s, d), "slow", window=4, step=4, rms_tau=8, peak_tau=8, block=16))
O["w4_mode_slow"] = O["w3_slow_crest"]

Q["w9_moving_rms"] = lambda s, d: rounded(scan.moving_rms(users(s, d), 6))
O["w9_moving_rms"] = sql(
    USERS,
    "SELECT track_id, channel_index, sample_idx, CASE WHEN count(*) OVER (PARTITION BY channel_index) <= 6 THEN sqrt(avg(value * value) OVER (PARTITION BY channel_index)) "
    "ELSE sqrt(sum(value * value) OVER (PARTITION BY channel_index ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6) END AS envelope FROM us",
    "envelope",
)
Q["w11_sliding_max"] = lambda s, d: rounded(panes.sliding_max(events(s, d), 6, 4))
O["w11_sliding_max"] = sql(
    EVENTS + ", m AS (SELECT track_id, channel_index, sample_idx, max(abs(value)) OVER f AS max_abs, count(*) OVER f AS n FROM ev WINDOW f AS (PARTITION BY channel_index ORDER BY sample_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))",
    "SELECT track_id, channel_index, (sample_idx - 5) // 4 AS window_idx, max_abs FROM m WHERE n = 6 AND (sample_idx - 5) % 4 = 0 AND sample_idx % 2 = 1",
    "max_abs",
)
Q["w12_global_max"] = lambda s, d: rounded(panes.global_max(events(s, d)))
O["w12_global_max"] = sql(EVENTS, "SELECT track_id, channel_index, max(abs(value)) AS max_abs FROM ev GROUP BY ALL", "max_abs")
#: Jumps of the values as they are: the mean falls out of a difference, but its last digits, which depend on
#: the order of its sum, would decide whether jumps of 50.00 are above 50.
Q["w13_jumps"] = lambda s, d: rounded(panes.differences(event_values(s, d), 50.0))
O["w13_jumps"] = sql(
    EVENTS + ", j AS (SELECT track_id, channel_index, abs(value - lag(value) OVER (PARTITION BY channel_index ORDER BY sample_idx)) AS jump FROM ev)",
    "SELECT track_id, channel_index, count(*) FILTER (jump > 50) AS jumps, max(jump) AS largest FROM j GROUP BY ALL",
    "largest",
)

CHUNKS = """p AS (SELECT track_id, channel_index, sample_idx // 8 AS chunk_idx, max(abs(value)) AS peak, sqrt(avg(value * value)) AS rms, count(*) AS n FROM ev GROUP BY ALL),
c AS (SELECT track_id, channel_index, chunk_idx, round(20 * log10(CASE WHEN rms > 0 THEN greatest(peak / rms, 1) ELSE 1 END), 9) AS crest_factor_db FROM p WHERE n = 8)"""


def _extremes(s, d):
    chunks = panes.fixed_chunk(events(s, d), 8).withColumn("crest_factor_db", F.round("crest_factor_db", 9))
    return rounded(panes.extreme_chunks(chunks).select("track_id", "channel_index", "chunk_type", "chunk_idx", "crest_factor_db"))


Q["w17_extreme_chunks"] = _extremes
O["w17_extreme_chunks"] = sql(
    f"{EVENTS}, {CHUNKS}",
    """SELECT track_id, channel_index, 'min_chunk' AS chunk_type, chunk_idx, crest_factor_db FROM c QUALIFY row_number() OVER (PARTITION BY channel_index ORDER BY crest_factor_db, chunk_idx) = 1
UNION ALL SELECT track_id, channel_index, 'max_chunk', chunk_idx, crest_factor_db FROM c QUALIFY row_number() OVER (PARTITION BY channel_index ORDER BY crest_factor_db DESC, chunk_idx) = 1""",
    "crest_factor_db",
)


def _extreme_bands(s, d):
    """Statistics of the bands in the most and the least peaky chunk of each vector."""
    x = reports.extreme_band_statistics(vectors(s, d), CENTRES, RATE, 16)
    return rounded(x.select("track_id", "channel_index", "chunk_type", "band_hz", F.col("chunk_idx").alias("pane"), F.col("chunk_crest_factor_db").alias("crest_factor_db"), "max_amplitude", "rms", "mean", "std", "p10", "p50", "p95"), 5)


Q["j6_extreme_chunk_bands"] = _extreme_bands
O["j6_extreme_chunk_bands"] = sql(
    BANK + """, bp AS (SELECT track_id, channel_index, band_hz, sample_idx // 16 AS pane, max(abs(value)) AS max_amplitude, sqrt(avg(value * value)) AS rms, avg(value) AS mean, stddev_pop(value) AS std,
  quantile_cont(abs(value), 0.1) AS p10, quantile_cont(abs(value), 0.5) AS p50, quantile_cont(abs(value), 0.95) AS p95 FROM bank GROUP BY ALL),
c AS (SELECT track_id, channel_index, pane, round(20 * log10(greatest(max_amplitude / rms, 1)), 9) AS cf FROM bp WHERE band_hz = 0),
x AS (SELECT *, 'min_chunk' AS chunk_type FROM c QUALIFY row_number() OVER (PARTITION BY channel_index ORDER BY cf, pane) = 1
  UNION ALL SELECT *, 'max_chunk' FROM c QUALIFY row_number() OVER (PARTITION BY channel_index ORDER BY cf DESC, pane) = 1)""",
    "SELECT b.track_id, b.channel_index, x.chunk_type, b.band_hz, b.pane, b.max_amplitude, b.rms, b.mean, b.std, b.p10, b.p50, b.p95, x.cf AS crest_factor_db FROM bp b JOIN x USING (channel_index, pane)",
    "max_amplitude rms mean std p10 p50 p95 crest_factor_db",
    5,
)

Q["w18_block_reference"] = lambda s, d: rounded(panes.block_reference(events(s, d), [4, 8, 16]))
O["w18_block_reference"] = sql(
    EVENTS + """, p AS (SELECT track_id, channel_index, w, sample_idx // w AS pane, max(abs(value)) AS peak, sqrt(avg(value * value)) AS rms, count(*) AS n FROM ev, (VALUES (4), (8), (16)) t(w) GROUP BY ALL),
c AS (SELECT *, 20 * log10(greatest(peak / rms, 1)) AS cf FROM p WHERE n = w AND rms > 0)""",
    """SELECT track_id, channel_index, w AS "window", count(*) AS num_windows, min(cf) AS min_cf_db, avg(cf) AS mean_cf_db, quantile_cont(cf, 0.5) AS median_cf_db, quantile_cont(cf, 0.95) AS p95_cf_db,
  max(cf) AS max_cf_db, stddev_pop(cf) AS std_cf_db FROM c GROUP BY ALL""",
    "min_cf_db mean_cf_db median_cf_db p95_cf_db max_cf_db std_cf_db",
)

Q["w5_octave_time_metrics"] = lambda s, d: rounded(
    reports.octave_time(vectors(s, d), CENTRES, RATE, 16, 8)
    .select("track_id", "channel_index", "band_hz", "window_idx", "time_seconds", "crest_factor_db", "peak_level_dbfs", "rms_level_dbfs", "is_valid_crest_factor"), 4
)
O["w5_octave_time_metrics"] = sql(
    BANK + """, p AS (SELECT track_id, channel_index, band_hz, sample_idx // 8 AS pane, max(abs(value)) AS m, sum(value * value) AS s FROM bank GROUP BY ALL),
w AS (SELECT track_id, channel_index, band_hz, pane, max(m) OVER f AS peak, sqrt(sum(s) OVER f / 16) AS rms FROM p WINDOW f AS (PARTITION BY channel_index, band_hz ORDER BY pane ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
v AS (SELECT *, rms > 0 AND 20 * log10(rms + 1e-10) >= -80 AS ok FROM w WHERE pane >= 1)""",
    """SELECT track_id, channel_index, band_hz, pane - 1 AS window_idx, (pane + 1) * 8 / 64.0 AS time_seconds, CASE WHEN ok THEN 20 * log10(greatest(peak / rms, 1)) END AS crest_factor_db,
  20 * log10(peak + 1e-10) AS peak_level_dbfs, 20 * log10(rms + 1e-10) AS rms_level_dbfs, ok AS is_valid_crest_factor FROM v""",
    "time_seconds crest_factor_db peak_level_dbfs rms_level_dbfs",
    4,
)


def _tau_study(s, d):
    return rounded(reports.tau_study(users(s, d), (4, 8, 16), (4, 8), -1 / math.log(1 - SLOW), 16), 5)


Q["g13_tau_study"] = _tau_study
O["g13_tau_study"] = sql(
    SLOW_SQL.format(USERS) + """, h AS (SELECT channel_index, sample_idx, tau, exp(max(ln(greatest(abs(value), 1e-300)) + sample_idx / tau::DOUBLE) OVER (PARTITION BY channel_index, tau ORDER BY sample_idx) - sample_idx / tau::DOUBLE) AS peak
  FROM us, (VALUES (4), (8), (16)) t(tau)),
c AS (SELECT h.channel_index, tau, length, (h.sample_idx + 1) // length - 1 AS window_idx, 20 * log10(greatest(peak / sqrt(y), 1)) AS cf FROM h JOIN e USING (channel_index, sample_idx), (VALUES (4), (8)) l(length) WHERE (h.sample_idx + 1) % length = 0 AND y > 0),
r AS (SELECT channel_index, length, sample_idx // length AS window_idx, 20 * log10(CASE WHEN sqrt(avg(value * value)) > 0 THEN greatest(max(abs(value)) / sqrt(avg(value * value)), 1) ELSE 1 END) AS ref FROM us, (VALUES (4), (8)) l(length) GROUP BY ALL HAVING count(*) = length),
x AS (SELECT channel_index, length, tau, avg(abs(cf - ref)) AS mae, sqrt(avg((cf - ref) * (cf - ref))) AS rmse FROM c JOIN r USING (channel_index, length, window_idx) WHERE window_idx >= 1 GROUP BY ALL),
m AS (SELECT length, tau, avg(mae) AS mean_abs_error_db, avg(rmse) AS rmse_db FROM x GROUP BY ALL)""",
    "SELECT length, tau, mean_abs_error_db, rmse_db FROM m QUALIFY row_number() OVER (PARTITION BY length ORDER BY mean_abs_error_db, rmse_db, tau) = 1",
    "mean_abs_error_db rmse_db",
    5,
)

Q["g5_deep_dive"] = lambda s, d: rounded(rollup.deep_dive(reports.octave_time(vectors(s, d), CENTRES, RATE, 16, 8), [2.1, 8.0, 31.9, 500.0]), 4)
O["g5_deep_dive"] = sql(
    f"o AS ({O['w5_octave_time_metrics']})",
    """SELECT track_id, channel_index, CASE band_hz WHEN 2 THEN 2.1 WHEN 8 THEN 8.0 ELSE 31.9 END::DOUBLE AS wanted_hz, time_seconds, greatest(coalesce(crest_factor_db, 0), 0) AS crest_factor_db,
  greatest(peak_level_dbfs, -120) AS peak_level_dbfs, greatest(rms_level_dbfs, -120) AS rms_level_dbfs FROM o WHERE band_hz IN (2, 8, 32)""",
    "wanted_hz time_seconds crest_factor_db peak_level_dbfs rms_level_dbfs",
    4,
)
Q["g11_extreme_overlay"] = lambda s, d: rounded(reports.extreme_overlay(_extremes(s, d)))
O["g11_extreme_overlay"] = sql(
    f"x AS ({O['w17_extreme_chunks']})",
    "SELECT *, CAST(row_number() OVER (PARTITION BY channel_index ORDER BY chunk_idx, chunk_type) AS INTEGER) AS place FROM x",
    "crest_factor_db",
)
