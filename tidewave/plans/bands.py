"""Octave bands: weights, powers, closure, comparison, and indicators over bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as fb
from ..operators import rollup, spectral, stats
from ..sources import series
from .views import BANDS, BANK, CENTRES, RATE, SPECTRUM, WEIGHT, rounded, sql, table, vectors

Q, O = {}, {}
KEYS = ["track_id", "channel_index"]


def power(s, d):
    return spectral.band_power(vectors(s, d), CENTRES, RATE)


def band_level_frame(s, d):
    return spectral.band_levels(spectral.band_panes(vectors(s, d), CENTRES, RATE, 16))


LEVELS = BANK + """, bl AS (SELECT track_id, channel_index, band_hz, max(abs(value)) AS peak, sqrt(avg(value * value)) AS rms FROM bank GROUP BY ALL),
lv AS (SELECT *, 20 * log10(nullif(peak, 0)) AS max_amplitude_db, 20 * log10(nullif(rms, 0)) AS rms_db, 20 * log10(greatest(peak / nullif(rms, 0), 1)) AS crest_factor_db FROM bl)"""

#: A list of bands is no longer than this, or it is not one.
MOST_BANDS = 1000


def _sizes(s, d):
    """The distinct sizes of parts, some fifty, as band centres."""
    found = table(s, d, "part").select("p_size").distinct().where("p_size > 0").limit(MOST_BANDS + 1).collect()
    if len(found) > MOST_BANDS:
        raise ValueError("too many sizes for a list of bands")
    return sorted(float(r["p_size"]) for r in found)


def _centres(s, d):
    """The distinct sizes of parts, some fifty, as band centres with residual ends."""
    return fb.bands_frame(s, fb.band_centres(_sizes(s, d), 0.5, 4000.0))


Q["p20_band_list"] = _centres
O["p20_band_list"] = """WITH c AS (SELECT DISTINCT p_size::DOUBLE AS band_hz FROM part WHERE p_size > 0 UNION SELECT 0.5 UNION SELECT 4000)
SELECT CAST(row_number() OVER (ORDER BY band_hz) - 1 AS INTEGER) AS band_idx, band_hz, lag(band_hz) OVER (ORDER BY band_hz) AS lower_hz, lead(band_hz) OVER (ORDER BY band_hz) AS upper_hz FROM c"""


def _weights(s, d):
    f = table(s, d, "part").select((F.col("p_partkey") / 16.0).alias("f")).distinct()
    b = fb.bands_frame(s, CENTRES)
    return f.crossJoin(F.broadcast(b)).select("f", "band_hz", fb.weight(F.col("f"), F.col("band_hz"), F.col("lower_hz"), F.col("upper_hz")).alias("w"))


Q["p21_weights"] = lambda s, d: rounded(_weights(s, d))
O["p21_weights"] = sql(f"{BANDS}, fs AS (SELECT DISTINCT p_partkey / 16.0 AS f FROM part)", f"SELECT f::DOUBLE AS f, hz::DOUBLE AS band_hz, {WEIGHT} AS w FROM fs, bands", "f w")
Q["x9_band_edges"] = lambda s, d: rounded(spectral.band_edges(table(s, d, "part").select((F.col("p_partkey") / 3.0 + 0.1).alias("freq")).distinct(), CENTRES))
O["x9_band_edges"] = sql(
    f"{BANDS}, fs AS (SELECT DISTINCT p_partkey / 3.0::DOUBLE + 0.1 AS f FROM part), w AS (SELECT f, hz, pow({WEIGHT}, 2) AS p FROM fs, bands), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY p DESC, hz) AS n FROM w)",
    """SELECT f AS freq, max(hz::DOUBLE) FILTER (n = 1) AS primary_band, max(p) FILTER (n = 1) AS primary_power, max(hz::DOUBLE) FILTER (n = 2) AS secondary_band, max(p) FILTER (n = 2) AS secondary_power, sum(p) AS power_sum FROM r GROUP BY f""",
    "freq primary_power secondary_power power_sum",
)


SIZES = "sz AS (SELECT DISTINCT p_size::DOUBLE AS hz FROM part WHERE p_size > 0), bands AS (SELECT hz, lag(hz) OVER (ORDER BY hz) AS lo, lead(hz) OVER (ORDER BY hz) AS hi FROM sz)"
Q["x9_band_acceptance"] = lambda s, d: rounded(spectral.band_acceptance(s, _sizes(s, d), 80.0))
O["x9_band_acceptance"] = sql(
    SIZES + f""", ts AS (SELECT 'center' AS test_type, hz AS f, hz AS a, hz AS b FROM bands UNION ALL SELECT 'crossover', sqrt(hz * hi), hz, hi FROM bands WHERE hi IS NOT NULL),
w AS (SELECT test_type, f, a, b, hz, pow({WEIGHT}, 2) AS p FROM ts, bands WHERE f < 40), r AS (SELECT *, row_number() OVER (PARTITION BY test_type, f ORDER BY p DESC) AS n FROM w),
x AS (SELECT test_type, f AS freq, a, b, min(hz) FILTER (n <= k) AS lower_band, max(hz) FILTER (n <= k) AS upper_band, max(p) AS p1, sum(p) FILTER (n <= k) AS top, sum(p) AS total
  FROM (SELECT *, CASE test_type WHEN 'center' THEN 1 ELSE 2 END AS k FROM r) GROUP BY ALL)""",
    """SELECT test_type, freq, lower_band, upper_band, 100 * p1 AS primary_power_percent, 100 * top AS top_power_percent, 100 * total AS power_sum_percent,
  lower_band = a AND upper_band = b AND CASE test_type WHEN 'center' THEN p1 >= 0.999999 ELSE abs(p1 - 0.5) <= 5e-6 AND abs(top - 1) <= 1e-5 END AS passed FROM x""",
    "freq lower_band upper_band primary_power_percent top_power_percent power_sum_percent",
)
Q["x9_phase_acceptance"] = lambda s, d: rounded(spectral.phase_acceptance(table(s, d, "orders").select((F.col("o_orderkey") % 997 / 16.0 + 0.25).alias("freq")).distinct(), CENTRES))
O["x9_phase_acceptance"] = sql(
    f"{BANDS}, fs AS (SELECT DISTINCT o_orderkey % 997 / 16.0::DOUBLE + 0.25 AS f FROM orders), w AS (SELECT hz::DOUBLE AS band_hz, {WEIGHT} AS w FROM fs, bands)",
    """SELECT band_hz, count(*) FILTER (abs(w) > 1e-12) AS active_bins, min(w) FILTER (abs(w) > 1e-12) AS min_active_weight, max(w) FILTER (abs(w) > 1e-12) AS max_active_weight,
  count(*) FILTER (w < 0) AS negative_weights, max(CASE WHEN w < 0 THEN 180.0 ELSE 0.0 END) AS max_phase_shift_degrees, count(*) FILTER (w < 0) = 0 AS passed FROM w GROUP BY band_hz""",
    "min_active_weight max_active_weight max_phase_shift_degrees",
)
Q["x1_block_bank"] = lambda s, d: rounded(spectral.band_rows(vectors(s, d), CENTRES, RATE))
Q["x2_full_bank"] = lambda s, d: rounded(spectral.full_band_rows(series.to_rows(vectors(s, d)), CENTRES, RATE))
#: The same transforms, each spread over several tasks.
Q["x2_distributed_bank"] = lambda s, d: rounded(spectral.full_band_rows(series.to_rows(vectors(s, d)), CENTRES, RATE, whole=32, tile=16))
O["x1_block_bank"] = O["x2_full_bank"] = O["x2_distributed_bank"] = sql(BANK, "SELECT track_id, channel_index, band_hz, sample_idx, value FROM bank", "value")
Q["x1_band_levels"] = lambda s, d: rounded(band_level_frame(s, d).drop("mean"))
O["x1_band_levels"] = sql(LEVELS, "SELECT * FROM lv", "peak rms max_amplitude_db rms_db crest_factor_db")
Q["x3_band_power"] = lambda s, d: rounded(power(s, d).select(*KEYS, "band_hz", "power"), 9)
O["x3_band_power"] = sql(SPECTRUM, "SELECT * FROM power", "power", 9)
Q["x4_energy_closure"] = lambda s, d: rounded(spectral.energy_closure(power(s, d)))
O["x4_energy_closure"] = sql(
    SPECTRUM,
    """SELECT track_id, channel_index, sqrt(sum(power) FILTER (band_hz = 0)) AS full_rms, sqrt(sum(power) FILTER (band_hz > 0)) AS band_power_sum_rms,
  10 * log10(sum(power) FILTER (band_hz > 0) / sum(power) FILTER (band_hz = 0)) AS closure_error_db, 100 * sum(power) FILTER (band_hz > 0) / sum(power) FILTER (band_hz = 0) AS captured_power_percent,
  arg_max(band_hz, power) FILTER (band_hz > 0) AS loudest_band_hz FROM power GROUP BY ALL""",
    "full_rms band_power_sum_rms closure_error_db captured_power_percent",
)


def _modes(s, d):
    """Blocks of 32 samples against whole series of 64."""
    v = vectors(s, d)
    halves = series.to_blocks(series.to_rows(v), 32)
    full = spectral.band_levels(spectral.band_panes(v, CENTRES, RATE, 32))
    return spectral.compare_modes(full, spectral.band_levels(spectral.band_panes(halves, CENTRES, RATE, 32)))


HALVES = """hx AS (SELECT channel_index, n // 32 AS b, n % 32 AS n, x FROM vx), hk AS (SELECT range AS k FROM range(17)),
hw AS (SELECT k, hz, """ + WEIGHT + """ AS w FROM (SELECT k, k * 2.0::DOUBLE AS f, hz, lo, hi FROM hk, bands)),
hd AS (SELECT channel_index, b, k, pow(sum(x * cos(2 * pi() * k * n / 32)), 2) + pow(sum(x * sin(2 * pi() * k * n / 32)), 2) AS p FROM hx, hk GROUP BY ALL),
hp AS (SELECT channel_index, hz::DOUBLE AS band_hz, sqrt(sum(p * w * w * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END) / 1024 / 2) AS rms FROM hd JOIN hw USING (k) GROUP BY ALL)"""
Q["x5_compare_modes"] = lambda s, d: rounded(_modes(s, d), 5)
O["x5_compare_modes"] = sql(
    f"{SPECTRUM}, {HALVES}",
    """SELECT a.track_id, a.channel_index, max(abs(20 * log10(hp.rms / sqrt(a.power)))) AS max_band_rms_delta_db, avg(abs(20 * log10(hp.rms / sqrt(a.power)))) AS mean_abs_band_rms_delta_db
  FROM power a JOIN hp USING (channel_index, band_hz) JOIN power f ON f.channel_index = a.channel_index AND f.band_hz = 0 WHERE sqrt(a.power) > sqrt(f.power) * 1e-6 GROUP BY ALL""",
    "max_band_rms_delta_db mean_abs_band_rms_delta_db",
    5,
)
Q["x6_x7_f8_against_source"] = lambda s, d: rounded(spectral.against_source(spectral.active_bands(band_level_frame(s, d)).drop("full_rms")), 5)
O["x6_x7_f8_against_source"] = sql(
    LEVELS,
    """SELECT b.track_id, b.channel_index, b.band_hz, 20 * log10(b.peak / f.peak) AS band_peak_minus_source_peak_db, pow(b.rms / f.rms, 2) AS band_power_fraction, b.crest_factor_db - f.crest_factor_db AS crest_factor_expansion_db,
  b.peak > f.peak AS exceeds_source_peak, 20 * log10(b.rms / f.rms) AS band_rms_db_relative_to_source FROM lv b JOIN lv f ON f.channel_index = b.channel_index AND f.band_hz = 0 WHERE b.band_hz > 0 AND b.rms > f.rms * 1e-6""",
    "band_peak_minus_source_peak_db band_power_fraction crest_factor_expansion_db band_rms_db_relative_to_source",
    5,
)


def _synthesis(s, d):
    e = spectral.synthesis_error(vectors(s, d), CENTRES, RATE)
    return e.select(*KEYS, (F.col("weighted_error_db") < -200).alias("exact"), "direct_error_db")


#: What adding the bands up as they are changes: by the sum of the weights of every bin.
DIRECT = SPECTRUM + """, ws AS (SELECT k, sum(w) AS w FROM wt GROUP BY k), de AS (SELECT track_id, channel_index, 10 * log10(sum(p * (w - 1) * (w - 1)) / sum(p)) AS direct_error_db FROM pw JOIN ws USING (k) GROUP BY ALL)"""
Q["x8_synthesis"] = lambda s, d: rounded(_synthesis(s, d))
O["x8_synthesis"] = sql(DIRECT, "SELECT track_id, channel_index, TRUE AS exact, direct_error_db FROM de", "direct_error_db")
Q["x4_waveform_sum"] = lambda s, d: rounded(spectral.closure_with_waveform(vectors(s, d), CENTRES, RATE).select(*KEYS, "captured_power_percent", "loudest_band_hz", "waveform_sum_error_db"))
O["x4_waveform_sum"] = sql(
    DIRECT + """, cp AS (SELECT track_id, channel_index, 100 * sum(power) FILTER (band_hz > 0) / sum(power) FILTER (band_hz = 0) AS captured_power_percent, arg_max(band_hz, power) FILTER (band_hz > 0) AS loudest_band_hz FROM power GROUP BY ALL)""",
    "SELECT cp.*, de.direct_error_db AS waveform_sum_error_db FROM cp JOIN de USING (track_id, channel_index)",
    "captured_power_percent waveform_sum_error_db",
)
Q["x10_target_power"] = lambda s, d: rounded(spectral.target_power(power(s, d), [4.0, 8.0]))
O["x10_target_power"] = sql(
    SPECTRUM,
    "SELECT track_id, channel_index, arg_max(band_hz, power) FILTER (band_hz IN (4, 8)) AS loudest_target_hz, 100 * sum(power) FILTER (band_hz IN (4, 8)) / sum(power) AS target_power_percent FROM power WHERE band_hz > 0 GROUP BY ALL",
    "target_power_percent",
)
Q["x11_series_validity"] = lambda s, d: rounded(spectral.series_validity(spectral.band_panes(vectors(s, d), CENTRES, RATE, 16)), 4)
O["x11_series_validity"] = sql(
    BANK + ", wn AS (SELECT track_id, channel_index, band_hz, sample_idx // 16 AS pane, count(*) AS n, bool_and(isfinite(value)) AS fine, 20 * log10(greatest(max(abs(value)) / sqrt(avg(value * value)), 1)) AS cf FROM bank GROUP BY ALL), "
    "ln AS (SELECT track_id, channel_index, band_hz, sum(n) AS samples, count(*) FILTER (n = 16) AS windows, bool_and(fine) AS fine, min(cf) FILTER (n = 16) AS lo, max(cf) FILTER (n = 16) AS hi FROM wn GROUP BY ALL)",
    """SELECT track_id, channel_index, max(samples)::BIGINT AS num_samples, count(*) - 1 AS num_bands, min(samples) = max(samples) AS same_length, bool_and(fine) AS all_finite, max(windows) AS crest_factor_windows,
  min(lo) FILTER (band_hz > 0) AS min_band_crest_factor_db, max(hi) FILTER (band_hz > 0) AS max_band_crest_factor_db FROM ln GROUP BY ALL""",
    "min_band_crest_factor_db max_band_crest_factor_db",
    4,
)
Q["a21_low_frequency_rank"] = lambda s, d: rounded(spectral.rank_low_frequency(power(s, d).withColumn("power", F.round("power", 12)), F.col("band_hz") <= 4))
O["a21_low_frequency_rank"] = sql(
    SPECTRUM + ", r AS (SELECT track_id, channel_index, sum(round(power, 12)) FILTER (band_hz <= 4) / sum(round(power, 12)) AS low_ratio FROM power WHERE band_hz > 0 GROUP BY ALL)",
    "SELECT *, CAST(row_number() OVER (ORDER BY low_ratio DESC, channel_index) AS INTEGER) AS rank FROM r",
    "low_ratio",
)
Q["a7_frequency_dynamics"] = lambda s, d: rounded(stats.frequency_dynamics(band_level_frame(s, d).withColumn("crest_factor_db", F.round("crest_factor_db", 9))), 5)
O["a7_frequency_dynamics"] = sql(
    LEVELS + ", b AS (SELECT track_id, channel_index, band_hz, round(crest_factor_db, 9) AS c, rms_db AS r FROM lv WHERE band_hz > 0)",
    """SELECT track_id, channel_index, var_pop(c) AS frequency_crest_factor_variance, max(c) - min(c) AS frequency_crest_factor_range, avg(c) FILTER (band_hz <= 4) / greatest(avg(c) FILTER (band_hz >= 8), 0.1) AS bass_vs_treble_dynamics_ratio,
  stddev_pop(r) AS frequency_balance_std, arg_max(band_hz, c) AS most_dynamic_frequency_hz, arg_min(band_hz, c) AS least_dynamic_frequency_hz FROM b GROUP BY ALL""",
    "frequency_crest_factor_variance frequency_crest_factor_range bass_vs_treble_dynamics_ratio frequency_balance_std",
    5,
)
Q["a9_mastering_indicators"] = lambda s, d: rounded(stats.mastering_indicators(band_level_frame(s, d)), 5)
O["a9_mastering_indicators"] = sql(
    LEVELS,
    """SELECT track_id, channel_index, max(max_amplitude_db - rms_db) FILTER (band_hz = 0) AS true_peak_to_rms_ratio_db, sum(band_hz * rms * rms) FILTER (band_hz > 0) / sum(rms * rms) FILTER (band_hz > 0) AS spectral_centroid_hz,
  sum(rms * rms) FILTER (band_hz IN (1, 2, 4)) / sum(rms * rms) FILTER (band_hz > 0) AS bass_energy_ratio, sum(rms * rms) FILTER (band_hz IN (8, 16, 32)) / sum(rms * rms) FILTER (band_hz > 0) AS mid_energy_ratio,
  sum(rms * rms) FILTER (band_hz IN (8, 16, 32)) / sum(rms * rms) FILTER (band_hz > 0) AS treble_energy_ratio FROM lv GROUP BY ALL""",
    "true_peak_to_rms_ratio_db spectral_centroid_hz bass_energy_ratio mid_energy_ratio treble_energy_ratio",
    5,
)
Q["g5_g4_f5_f6_deep_dive"] = lambda s, d: rounded(
    rollup.nearest_bands(band_level_frame(s, d).where("band_hz > 0"), [4.1, 8.05, 100.0]).select(*KEYS, "wanted_hz", "band_hz", "rms_db", F.greatest("crest_factor_db", F.lit(0.0)).alias("crest_factor_db"))
)
O["g5_g4_f5_f6_deep_dive"] = sql(LEVELS, "SELECT track_id, channel_index, CASE band_hz WHEN 4 THEN 4.1 ELSE 8.05 END::DOUBLE AS wanted_hz, band_hz, rms_db, greatest(crest_factor_db, 0) AS crest_factor_db FROM lv WHERE band_hz IN (4, 8)", "rms_db crest_factor_db")


def _labels(s, d):
    hz = F.when(F.col("p_size") % 5 == 0, 0.0).otherwise(F.col("p_size") * 31.25)
    p = table(s, d, "part").select("p_partkey", hz.alias("hz"))
    return p.select("p_partkey", fb.band_label(F.col("hz")).alias("label"), fb.parse_label(fb.band_label(F.col("hz"))).alias("parsed"), fb.display_label(F.col("hz")).alias("display"))


Q["p17_labels"] = lambda s, d: _labels(s, d)
O["p17_labels"] = """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size * 31.25::DOUBLE END AS hz FROM part)
SELECT p_partkey, CASE WHEN hz = 0 THEN 'Full Spectrum' ELSE printf('%.3f', hz) END AS label, hz AS parsed,
  CASE WHEN hz >= 1000 THEN CASE WHEN hz % 1000 = 0 THEN printf('%.0f', hz / 1000) ELSE printf('%.1f', round_even(hz / 1000, 1)) END || 'k Hz'
       ELSE CASE WHEN hz = floor(hz) THEN printf('%.0f', hz) ELSE printf('%.1f', round_even(hz, 1)) END || ' Hz' END AS display FROM p"""
