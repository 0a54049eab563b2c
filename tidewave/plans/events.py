"""Peaks, their times, and repeating patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns, peaks, reports, stats
from ..sources import tables
from .views import BANK, CENTRES, USER_LEVELS, rounded, scratch, sql, table, user_levels, vectors
from .views import RATE as BAND_RATE

Q, O = {}, {}
KEYS = ["track_id", "channel_index"]
HEIGHT, DISTANCE, RATE = -20.0, 4, 10.0


def found(s, d, distance=DISTANCE):
    return peaks.find_peaks(user_levels(s, d), HEIGHT, distance)


MAXIMA = USER_LEVELS + f""", r1 AS (SELECT *, CASE WHEN lag(db) OVER o IS DISTINCT FROM db THEN 1 ELSE 0 END AS new FROM lv WINDOW o AS (PARTITION BY channel_index ORDER BY sample_idx)),
r2 AS (SELECT *, sum(new) OVER (PARTITION BY channel_index ORDER BY sample_idx) AS run FROM r1),
r3 AS (SELECT track_id, channel_index, run, min(sample_idx) AS a, max(sample_idx) AS b, min(db) AS db FROM r2 GROUP BY ALL),
r4 AS (SELECT *, lag(db) OVER o AS before, lead(db) OVER o AS after FROM r3 WINDOW o AS (PARTITION BY channel_index ORDER BY run)),
mx AS (SELECT track_id, channel_index, (a + b) // 2 AS peak_idx, db AS peak_db FROM r4 WHERE before < db AND after < db AND db >= {HEIGHT})"""
#: Greedy suppression one peak at a time, the highest first, the later of equal ones first.
PEAKS = "RECURSIVE " + MAXIMA + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY channel_index ORDER BY peak_db DESC, peak_idx DESC) AS n FROM mx),
gr AS (SELECT channel_index, n, [peak_idx] AS kept FROM rk WHERE n = 1
  UNION ALL SELECT rk.channel_index, rk.n, CASE WHEN len(list_filter(gr.kept, lambda k: abs(k - rk.peak_idx) < {DISTANCE})) = 0 THEN list_append(gr.kept, rk.peak_idx) ELSE gr.kept END
  FROM gr JOIN rk ON rk.channel_index = gr.channel_index AND rk.n = gr.n + 1),
pk AS (SELECT mx.* FROM mx JOIN (SELECT channel_index, unnest(arg_max(kept, n)) AS peak_idx FROM gr GROUP BY channel_index) USING (channel_index, peak_idx)),
ln AS (SELECT channel_index, max(sample_idx) + 1 AS n FROM lv GROUP BY ALL)"""

Q["e1_local_maxima"] = lambda s, d: rounded(peaks.local_maxima(user_levels(s, d), height=HEIGHT), 3)
O["e1_local_maxima"] = sql(MAXIMA, "SELECT * FROM mx", "peak_db", 3)
Q["e1_f3_find_peaks"] = lambda s, d: rounded(found(s, d), 3)
O["e1_f3_find_peaks"] = sql(PEAKS, "SELECT * FROM pk", "peak_db", 3)


def _rates(s, d):
    length = user_levels(s, d).groupBy(*KEYS).agg((F.count("*") / RATE).alias("seconds"))
    return stats.peak_rates(found(s, d), length)


Q["a5_peak_rates"] = lambda s, d: rounded(_rates(s, d))
O["a5_peak_rates"] = sql(
    PEAKS,
    f"""SELECT 'users' AS track_id, l.channel_index, """
    + ", ".join(f"count(*) FILTER (peak_db > {t}) AS {n}_count, count(*) FILTER (peak_db > {t}) / (min(l.n) / {RATE}) AS {n}_per_sec" for t, n in ((-3, "peaks_above_minus3db"), (-1, "peaks_above_minus1db"), (-0.1, "peaks_above_minus0_1db")))
    + " FROM ln l LEFT JOIN pk USING (channel_index) GROUP BY ALL",
    "peaks_above_minus3db_per_sec peaks_above_minus1db_per_sec peaks_above_minus0_1db_per_sec",
)
Q["e2_j3_attack_times"] = lambda s, d: rounded(peaks.attack_times(found(s, d), user_levels(s, d), RATE, 20.0, 1.0), 3)
O["e2_j3_attack_times"] = sql(
    PEAKS,
    f"""SELECT p.track_id, p.channel_index, p.peak_idx, p.peak_db, greatest((p.peak_idx - coalesce(max(v.sample_idx) FILTER (v.db < p.peak_db - 20) + 1, greatest(p.peak_idx - 10, 0))) / {RATE} * 1000, 0) AS attack_time_ms
  FROM pk p JOIN lv v ON v.channel_index = p.channel_index AND v.sample_idx BETWEEN p.peak_idx - 10 AND p.peak_idx GROUP BY p.track_id, p.channel_index, p.peak_idx, p.peak_db""",
    "peak_db attack_time_ms",
    3,
)
Q["e3_hold_times"] = lambda s, d: rounded(peaks.hold_times(found(s, d), user_levels(s, d), RATE, 6.0, 1.0), 3)
O["e3_hold_times"] = sql(
    PEAKS,
    f"""SELECT p.track_id, p.channel_index, p.peak_idx, (max(v.sample_idx) - min(v.sample_idx)) / {RATE} * 1000 AS peak_hold_time_ms
  FROM pk p JOIN lv v ON v.channel_index = p.channel_index AND v.sample_idx BETWEEN p.peak_idx - 10 AND p.peak_idx + 9 WHERE v.db >= p.peak_db - 6 GROUP BY ALL""",
    "peak_hold_time_ms",
    3,
)


def _first(limit: str) -> str:
    return f"(coalesce(min(v.sample_idx) FILTER (v.db <= {limit}), least(min(l.n), p.peak_idx + 20)) - p.peak_idx) / {RATE} * 1000"


AHEAD = "FROM pk p JOIN ln l ON l.channel_index = p.channel_index JOIN lv v ON v.channel_index = p.channel_index AND v.sample_idx BETWEEN p.peak_idx AND p.peak_idx + 19"
TS = (3, 6, 9, 12)
Q["e4_decay_times"] = lambda s, d: rounded(peaks.decay_times(found(s, d), user_levels(s, d), RATE, seconds=2.0), 3)
O["e4_decay_times"] = sql(
    PEAKS,
    "SELECT p.track_id, p.channel_index, p.peak_idx, p.peak_db, "
    + ", ".join(f"{_first(f'p.peak_db - {t}')} AS decay_{t}db_ms, count(*) FILTER (v.db <= p.peak_db - {t}) > 0 AS decay_{t}db_reached" for t in TS)
    + f" {AHEAD} GROUP BY p.track_id, p.channel_index, p.peak_idx, p.peak_db",
    "peak_db " + " ".join(f"decay_{t}db_ms" for t in TS),
    3,
)


def _events(s, d, relative=True):
    return peaks.sustained_events(found(s, d), user_levels(s, d), RATE, -3.0, seconds=2.0, relative=relative)


def _events_sql(limit: str) -> str:
    return (
        PEAKS + ", sv AS (SELECT p.track_id, p.channel_index, p.peak_idx, p.peak_db, p.peak_idx / 10.0 AS peak_time_seconds, "
        + f"(coalesce(min(v.sample_idx) FILTER (v.db < p.peak_db - 1), least(min(l.n), p.peak_idx + 20)) - p.peak_idx) / {RATE} * 1000 AS hold_ms, "
        + ", ".join(f"{_first(limit.format(t))} AS t{t}_ms" for t in TS) + f" {AHEAD} WHERE p.peak_db >= -3 GROUP BY p.track_id, p.channel_index, p.peak_idx, p.peak_db)"
    )


Q["e5_f4_sustained_events"] = lambda s, d: rounded(_events(s, d), 3)
O["e5_f4_sustained_events"] = sql(_events_sql("p.peak_db - {}"), "SELECT * FROM sv", "peak_db peak_time_seconds hold_ms t3_ms t6_ms t9_ms t12_ms", 3)
Q["e5_sustained_absolute"] = lambda s, d: rounded(_events(s, d, False), 3)
O["e5_sustained_absolute"] = sql(_events_sql("-{}.0"), "SELECT * FROM sv", "peak_db peak_time_seconds hold_ms t3_ms t6_ms t9_ms t12_ms", 3)
NAMES = ("hold_ms", "t3_ms", "t6_ms", "t9_ms", "t12_ms")
Q["a14_sustained_summary"] = lambda s, d: rounded(peaks.sustained_summary(_events(s, d), user_levels(s, d)), 3)
O["a14_sustained_summary"] = sql(
    _events_sql("p.peak_db - {}"),
    "SELECT 'users' AS track_id, l.channel_index, count(sv.peak_idx) AS n_peaks, "
    + ", ".join(f"coalesce({f}, 0) AS {c}_{n}" for c in NAMES for n, f in (("mean", f"avg({c})"), ("median", f"median({c})"), ("p90", f"quantile_cont({c}, 0.9)"), ("p95", f"quantile_cont({c}, 0.95)"), ("max", f"max({c})")))
    + " FROM ln l LEFT JOIN sv USING (channel_index) GROUP BY ALL",
    " ".join(f"{c}_{n}" for c in NAMES for n in ("mean", "median", "p90", "p95", "max")),
    3,
)


def _worst(s, d, sort_by="peak_value"):
    """Peaks at even places are taken to be pattern peaks, and are left out."""
    p = found(s, d)
    return peaks.worst_case(p, user_levels(s, d), RATE, 3, p.where("peak_idx % 2 = 0"), sort_by).select(*KEYS, "rank", "peak_idx", "peak_db", "attack_time_ms", "peak_hold_time_ms", *(f"decay_{t}db_ms" for t in TS))


WORST = PEAKS + f""", od AS (SELECT * FROM pk WHERE peak_idx % 2 <> 0),
dc AS (SELECT p.channel_index, p.peak_idx, (coalesce(min(v.sample_idx) FILTER (v.db <= p.peak_db - 12), least(min(l.n), p.peak_idx + 300)) - p.peak_idx) / {RATE} * 1000 AS decay_12db_ms
  FROM od p JOIN ln l ON l.channel_index = p.channel_index JOIN lv v ON v.channel_index = p.channel_index AND v.sample_idx BETWEEN p.peak_idx AND p.peak_idx + 299 GROUP BY p.channel_index, p.peak_idx, p.peak_db),
wt AS (SELECT od.*, dc.decay_12db_ms, CAST(row_number() OVER (PARTITION BY channel_index ORDER BY {{0}}) AS INTEGER) AS rank FROM od JOIN dc USING (channel_index, peak_idx)),
wc AS (SELECT * FROM wt WHERE rank <= 3)"""
WORST_SELECT = f"""SELECT p.track_id, p.channel_index, p.rank, p.peak_idx, p.peak_db, greatest((p.peak_idx - coalesce(max(v.sample_idx) FILTER (v.sample_idx <= p.peak_idx AND v.db < p.peak_db - 20) + 1, greatest(p.peak_idx - 100, 0))) / {RATE} * 1000, 0) AS attack_time_ms,
  (max(v.sample_idx) FILTER (v.db >= p.peak_db - 1 AND abs(v.sample_idx - p.peak_idx + 0.5) < 50) - min(v.sample_idx) FILTER (v.db >= p.peak_db - 1 AND v.sample_idx BETWEEN p.peak_idx - 50 AND p.peak_idx + 49)) / {RATE} * 1000 AS peak_hold_time_ms, p.decay_12db_ms, {", ".join(f"(coalesce(min(v.sample_idx) FILTER (v.sample_idx >= p.peak_idx AND v.db <= p.peak_db - {t}), least(min(l.n), p.peak_idx + 300)) - p.peak_idx) / {RATE} * 1000 AS decay_{t}db_ms" for t in TS[:3])}
  FROM wc p JOIN lv v ON v.channel_index = p.channel_index AND v.sample_idx BETWEEN p.peak_idx - 100 AND p.peak_idx + 299 JOIN ln l ON l.channel_index = p.channel_index GROUP BY p.track_id, p.channel_index, p.rank, p.peak_idx, p.peak_db, p.decay_12db_ms"""
Q["e6_j4_k1_w16_worst_case"] = lambda s, d: rounded(_worst(s, d), 3)
O["e6_j4_k1_w16_worst_case"] = sql(WORST.format("peak_db DESC, peak_idx"), WORST_SELECT, "peak_db attack_time_ms peak_hold_time_ms decay_3db_ms decay_6db_ms decay_9db_ms decay_12db_ms", 3)
Q["k2_worst_by_decay"] = lambda s, d: rounded(_worst(s, d, "decay_time"), 3)
O["k2_worst_by_decay"] = sql(WORST.format("decay_12db_ms DESC, peak_db DESC, peak_idx"), WORST_SELECT, "peak_db attack_time_ms peak_hold_time_ms decay_3db_ms decay_6db_ms decay_9db_ms decay_12db_ms", 3)


def windows(s, d, size=8):
    return peaks.windows_around(found(s, d), user_levels(s, d), size)


CUT = PEAKS + """, cw AS (SELECT p.track_id, p.channel_index, p.peak_idx, p.peak_db, min(v.sample_idx) AS start_idx, list(v.db ORDER BY v.sample_idx) AS w
  FROM pk p JOIN lv v ON v.channel_index = p.channel_index AND v.sample_idx BETWEEN p.peak_idx - 4 AND p.peak_idx + 3 GROUP BY ALL HAVING count(*) >= 4)"""
Q["w15_windows"] = lambda s, d: windows(s, d).select(*KEYS, "peak_idx", "start_idx", F.size("window").alias("n"), F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))
O["w15_windows"] = sql(CUT, "SELECT track_id, channel_index, peak_idx, start_idx, CAST(len(w) AS INTEGER) AS n, list_sum(w) AS total FROM cw", "total", 3)

Q["e12_top_windows"] = lambda s, d: rounded(patterns.top_windows(windows(s, d), 3).select(*KEYS, "peak_idx", "peak_db", "position"), 3)
O["e12_top_windows"] = sql(
    CUT + ", tp AS (SELECT * FROM cw QUALIFY row_number() OVER (PARTITION BY channel_index ORDER BY list_max(w) DESC, peak_idx) <= 3)",
    "SELECT track_id, channel_index, peak_idx, peak_db, CAST(row_number() OVER (PARTITION BY channel_index ORDER BY peak_idx) AS INTEGER) AS position FROM tp",
    "peak_db",
    3,
)
Q["e13_display_windows"] = lambda s, d: rounded(patterns.display_windows(windows(s, d), found(s, d).where("peak_idx % 3 = 0"), 2).select(*KEYS, "peak_idx", "peak_db", "position"), 3)
O["e13_display_windows"] = sql(
    CUT + ", tp AS (SELECT * FROM cw WHERE peak_idx % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY channel_index ORDER BY list_max(w) DESC, peak_idx) <= 2)",
    "SELECT track_id, channel_index, peak_idx, peak_db, CAST(row_number() OVER (PARTITION BY channel_index ORDER BY peak_idx) AS INTEGER) AS position FROM tp",
    "peak_db",
    3,
)


def _similar(s, d):
    w = windows(s, d).withColumn("n", F.row_number().over(patterns.Window.partitionBy(*KEYS).orderBy("peak_idx")) - 1)
    return patterns.similar_pairs(w, 0.8).where("same").drop("same")


SIMILAR = CUT + """, nw AS (SELECT *, row_number() OVER (PARTITION BY channel_index ORDER BY peak_idx) - 1 AS n FROM cw),
pr AS (SELECT a.track_id, a.channel_index, CAST(a.n AS INTEGER) AS i, CAST(b.n AS INTEGER) AS j, (SELECT corr(x, y) FROM (SELECT unnest(a.w) AS x, unnest(b.w) AS y)) AS r
  FROM nw a JOIN nw b ON a.channel_index = b.channel_index AND a.n < b.n AND len(a.w) = len(b.w))"""
Q["e7_j5_similar_pairs"] = lambda s, d: rounded(_similar(s, d), 5)
O["e7_j5_similar_pairs"] = sql(SIMILAR, "SELECT * FROM pr WHERE r >= 0.8", "r", 5)


def _shapes(s, d):
    """The first 40 components of each vector against its last 24: between two of them wherever they are resampled."""
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", patterns.similarity(F.slice("e", 1, 40), F.slice("e", 41, 24)).alias("similarity"))


Q["e7_resampled_similarity"] = lambda s, d: rounded(_shapes(s, d))
O["e7_resampled_similarity"] = sql(
    "x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
    "SELECT vec_id, (SELECT corr(a, b) FROM (SELECT unnest([e[i * 39 // 23 + 1] + (e[least(i * 39 // 23 + 2, 40)] - e[i * 39 // 23 + 1]) * (i * 39 / 23.0::DOUBLE - i * 39 // 23) FOR i IN range(24)]) AS a, unnest(e[41:64]) AS b)) AS similarity FROM x",
    "similarity",
)


def _members(s, d):
    return patterns.repeating_patterns(windows(s, d), 0.8, 2, 4)


#: Alike windows of one length, and of others by interpolation; then the greedy grouping, a window a step: first with windows of its length, then with others.
GROUPED = CUT + """, nw AS MATERIALIZED (SELECT track_id, channel_index, peak_idx, peak_db, w, len(w) AS k, list_max(w) - list_min(w) < 1e-10 AS flat, row_number() OVER (PARTITION BY channel_index ORDER BY peak_idx) - 1 AS n FROM cw),
bt AS (SELECT a.channel_index, a.n AS an, b.n AS bn, a.k = b.k AS same, a.w AS x, (a.flat OR b.flat) AS flat, abs(list_max(a.w) - list_max(b.w)) < 1e-10 AS level,
    CASE WHEN a.k = b.k THEN b.w ELSE [b.w[i * (b.k - 1) // (a.k - 1) + 1] + (b.w[least(i * (b.k - 1) // (a.k - 1) + 2, b.k)] - b.w[i * (b.k - 1) // (a.k - 1) + 1]) * (i * (b.k - 1) / (a.k - 1)::DOUBLE - i * (b.k - 1) // (a.k - 1)) FOR i IN range(a.k)] END AS y
  FROM nw a JOIN nw b ON a.channel_index = b.channel_index AND (a.k < b.k OR a.k = b.k AND a.n < b.n)),
al AS (SELECT channel_index, least(an, bn) AS i, greatest(an, bn) AS j, same, CASE WHEN flat THEN CASE WHEN level AND NOT same THEN 1 ELSE 0 END ELSE (SELECT corr(p, q) FROM (SELECT unnest(x) AS p, unnest(y) AS q)) END AS r FROM bt),
ne AS (SELECT channel_index, i, same, list(j ORDER BY j) AS js FROM al WHERE r >= 0.8 GROUP BY ALL),
so AS (SELECT channel_index, n, TRUE AS same, row_number() OVER (PARTITION BY channel_index ORDER BY f, n) AS step FROM (SELECT channel_index, n, min(n) OVER (PARTITION BY channel_index, k) AS f FROM nw)
  UNION ALL SELECT channel_index, n, FALSE, count(*) OVER (PARTITION BY channel_index) + row_number() OVER (PARTITION BY channel_index ORDER BY n) FROM nw),
sj AS MATERIALIZED (SELECT so.channel_index, so.n, so.step, coalesce(ne.js, []) AS js FROM so LEFT JOIN ne ON ne.channel_index = so.channel_index AND ne.i = so.n AND ne.same = so.same),
gg AS (SELECT DISTINCT channel_index, 0::BIGINT AS step, []::BIGINT[] AS used, []::BIGINT[][] AS groups FROM nw
  UNION ALL SELECT channel_index, step, CASE WHEN skip OR len(mem) = 0 THEN used ELSE list_concat(list_append(used, n), mem) END, CASE WHEN skip OR len(mem) = 0 THEN groups ELSE list_append(groups, list_prepend(n, mem)) END
  FROM (SELECT gg.channel_index, sj.step, sj.n, gg.used, gg.groups, list_contains(gg.used, sj.n) AS skip, list_filter(sj.js, lambda j: NOT list_contains(gg.used, j)) AS mem FROM gg JOIN sj ON sj.channel_index = gg.channel_index AND sj.step = gg.step + 1)),
gs AS (SELECT channel_index, unnest(groups) AS g, generate_subscripts(groups, 1) AS o FROM (SELECT channel_index, arg_max(groups, step) AS groups FROM gg GROUP BY channel_index)),
gn AS (SELECT channel_index, g, CAST(row_number() OVER (PARTITION BY channel_index ORDER BY len(g) DESC, o) AS INTEGER) AS pattern_num FROM gs),
mb AS (SELECT nw.track_id, nw.channel_index, m.pattern_num, nw.peak_idx, nw.peak_db FROM (SELECT channel_index, pattern_num, unnest(g) AS n FROM gn WHERE pattern_num <= 4) m JOIN nw USING (channel_index, n))"""
Q["e8_k3_repeating_patterns"] = lambda s, d: rounded(_members(s, d), 3)
O["e8_k3_repeating_patterns"] = sql(GROUPED, "SELECT * FROM mb", "peak_db", 3)
Q["e9_w14_pattern_statistics"] = lambda s, d: rounded(patterns.pattern_statistics(_members(s, d), RATE), 5)


def _fixed_members(s, d):
    """Each user's peaks in two groups, by their parity: intervals and regularity in plain SQL."""
    return patterns.pattern_statistics(found(s, d).withColumn("pattern_num", (F.col("peak_idx") % 2).cast("int")), RATE).where("num_repetitions > 2")


def _intervals_sql(members: str, more: int) -> str:
    """Statistics of the intervals between the peaks of ``gm``, for patterns of more than so many."""
    return sql(
        members + f""", gp AS (SELECT track_id, channel_index, pattern_num, (peak_idx - lag(peak_idx) OVER (PARTITION BY channel_index, pattern_num ORDER BY peak_idx)) / 10.0 AS gap FROM gm),
st AS (SELECT track_id, channel_index, pattern_num, count(*) AS num_repetitions, avg(gap) AS mean_interval_seconds, stddev_pop(gap) AS std_interval_seconds, median(gap::DOUBLE) AS median_interval_seconds, min(gap)::DOUBLE AS min_interval_seconds, max(gap)::DOUBLE AS max_interval_seconds
  FROM gp GROUP BY ALL HAVING count(*) > {more})""",
        """SELECT *, 1 / (1 + std_interval_seconds / mean_interval_seconds) AS pattern_regularity_score, CASE WHEN std_interval_seconds / mean_interval_seconds < 0.1 THEN 'high' WHEN std_interval_seconds / mean_interval_seconds < 0.3 THEN 'medium' ELSE 'low' END AS pattern_confidence,
  60 / mean_interval_seconds AS beats_per_minute FROM st""",
        "mean_interval_seconds std_interval_seconds median_interval_seconds min_interval_seconds max_interval_seconds pattern_regularity_score beats_per_minute",
        5,
    )


Q["e9_interval_statistics"] = lambda s, d: rounded(_fixed_members(s, d), 5)
O["e9_interval_statistics"] = _intervals_sql(PEAKS + ", gm AS (SELECT track_id, channel_index, CAST(peak_idx % 2 AS INTEGER) AS pattern_num, peak_idx FROM pk)", 2)
O["e9_w14_pattern_statistics"] = _intervals_sql(GROUPED.replace("mb AS (", "gm AS ("), 0)
Q["e10_window_length"] = lambda s, d: rounded(table(s, d, "part").select("p_partkey", peaks.window_length_ms(F.when(F.col("p_size") % 5 == 0, 0.0).otherwise(F.col("p_size") * 1.3), 4.0, 50.0).alias("window_ms")))
O["e10_window_length"] = sql("p AS (SELECT p_partkey, p_size FROM part)", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 100 ELSE least(4 / (p_size * 1.3::DOUBLE) * 1000, 500) END AS window_ms FROM p", "window_ms")


def _analysis(s, d):
    return reports.envelope_analysis(user_levels(s, d), RATE, HEIGHT, DISTANCE, 8, similarity=0.8, least=2, most=4, top=3, seconds=2.0, folder=scratch(s))


def _counts(found, names):
    n = lambda df, name: df.groupBy(*KEYS).agg(F.count("*").alias(name))
    out = n(found["levels"], "samples")
    for table_, name in names:
        out = out.join(n(found[table_], name), KEYS, "left")
    return out.na.fill(0)


#: How many of each there are, in all.
Q["e11_u5_envelope_driver"] = lambda s, d: _counts(_analysis(s, d), (("peaks", "peaks"), ("patterns", "pattern_peaks"), ("worst_cases", "worst_cases"), ("sustained", "sustained")))
O["e11_u5_envelope_driver"] = f"""WITH {GROUPED} SELECT 'users' AS track_id, l.channel_index, l.n AS samples, coalesce(p.c, 0) AS peaks, coalesce(m.c, 0) AS pattern_peaks,
  coalesce(least(3, p.c - coalesce(m.c, 0)), 0) AS worst_cases, coalesce(p.s, 0) AS sustained
  FROM ln l LEFT JOIN (SELECT channel_index, count(*) AS c, count(*) FILTER (peak_db >= -3) AS s FROM pk GROUP BY ALL) p USING (channel_index) LEFT JOIN (SELECT channel_index, count(*) AS c FROM mb GROUP BY ALL) m USING (channel_index)"""
Q["e11_envelope_counts"] = lambda s, d: _counts(_analysis(s, d), (("peaks", "peaks"), ("sustained", "sustained")))
O["e11_envelope_counts"] = PEAKS.replace("RECURSIVE", "WITH RECURSIVE", 1) + """ SELECT 'users' AS track_id, l.channel_index, min(l.n) AS samples, count(pk.peak_idx) AS peaks, count(pk.peak_idx) FILTER (peak_db >= -3) AS sustained
  FROM ln l LEFT JOIN pk USING (channel_index) GROUP BY l.channel_index"""


BAND_KEYS = [*KEYS, "band_hz"]
BAND_HEIGHT, BAND_DISTANCE, BAND_DIGITS, BAND_LEAST = -30.0, 3, 4, -18.0


def _bands(s, d, folder=None):
    """Every band of every vector: its own release, windows and peaks."""
    return reports.band_envelope_analysis(
        vectors(s, d), CENTRES, BAND_RATE, BAND_HEIGHT, BAND_DISTANCE, window_wavelengths=4.0, fallback_ms=100.0, digits=BAND_DIGITS, similarity=0.8, least=2, most=4, top=2, least_db=BAND_LEAST, seconds=0.25, folder=folder
    )


def _band_release() -> str:
    from ..operators.scan import release_samples

    return "CASE band_hz " + " ".join(f"WHEN {hz} THEN {release_samples(hz, BAND_RATE, 1.0, 100.0)!r}" for hz in (0.0, *CENTRES)) + " END"


#: The follower of every band by recursion, its levels, and all that the plain series' peaks are made of, with the band among the keys.
BAND_LEVELS = f"""RECURSIVE {BANK}, bs AS MATERIALIZED (SELECT *, CAST(channel_index * 1000 + dense_rank() OVER (ORDER BY band_hz) AS INTEGER) AS own, 1 - exp(-1 / ({_band_release()})::DOUBLE) AS c FROM bank),
fo AS (SELECT own, sample_idx, abs(value) AS e FROM bs WHERE sample_idx = 0
  UNION ALL SELECT b.own, b.sample_idx, greatest(abs(b.value), fo.e * (1 - b.c) + abs(b.value) * b.c) FROM fo JOIN bs b ON b.own = fo.own AND b.sample_idx = fo.sample_idx + 1),
nm AS (SELECT DISTINCT own, channel_index AS channel, band_hz FROM bs),
lv AS MATERIALIZED (SELECT 'vectors' AS track_id, own AS channel_index, sample_idx, round(20 * log10(greatest(e, 1e-10) + 1e-10), {BAND_DIGITS}) AS db FROM fo)"""
BAND_PEAKS = BAND_LEVELS + PEAKS[PEAKS.index(", r1 AS") :].replace(f"db >= {HEIGHT}", f"db >= {BAND_HEIGHT}").replace(f"< {DISTANCE})", f"< {BAND_DISTANCE})")
NAMED = "JOIN nm ON nm.own = x.channel_index"
Q["e11_band_peaks"] = lambda s, d: rounded(_bands(s, d)["peaks"], BAND_DIGITS)
O["e11_band_peaks"] = sql(BAND_PEAKS, f"SELECT x.track_id, nm.channel AS channel_index, nm.band_hz, x.peak_idx, x.peak_db FROM pk x {NAMED}", "peak_db", BAND_DIGITS)
Q["e11_band_sustained"] = lambda s, d: rounded(_bands(s, d)["sustained"], BAND_DIGITS)
_BAND_EVENTS = _events_sql("p.peak_db - {}")[len(PEAKS) :].replace("p.peak_db >= -3 ", f"p.peak_db >= {BAND_LEAST} ").replace("p.peak_idx + 20", "p.peak_idx + 16").replace("p.peak_idx + 19", "p.peak_idx + 15").replace(f"/ {RATE} *", f"/ {BAND_RATE} *").replace("/ 10.0 AS", f"/ {BAND_RATE} AS")
O["e11_band_sustained"] = sql(BAND_PEAKS + _BAND_EVENTS, f"SELECT x.* EXCLUDE (channel_index), nm.channel AS channel_index, nm.band_hz FROM sv x {NAMED}", "peak_db peak_time_seconds hold_ms t3_ms t6_ms t9_ms t12_ms", BAND_DIGITS)


def _band_worst(s, d):
    """The highest three of each band that belong to no pattern, with their windows; patterns are those that repeat."""
    w = _bands(s, d, scratch(s))["worst_cases"]
    return w.select(*BAND_KEYS, "rank", "peak_idx", "peak_db", "attack_time_ms", "decay_6db_ms", "start_idx", F.size("window").alias("n"))


def _band_sizes() -> str:
    return "CASE band_hz " + " ".join(f"WHEN {hz} THEN {max(2, int(peaks.window_ms(hz, 4.0, 100.0) * BAND_RATE / 1000))}" for hz in (0.0, *CENTRES)) + " END"


BAND_GROUPED = (
    BAND_PEAKS + f""", hw AS (SELECT own AS channel_index, {_band_sizes()} AS size FROM nm),
cw AS (SELECT p.track_id, p.channel_index, p.peak_idx, p.peak_db, min(v.sample_idx) AS start_idx, list(v.db ORDER BY v.sample_idx) AS w FROM pk p JOIN hw ON hw.channel_index = p.channel_index
  JOIN lv v ON v.channel_index = p.channel_index AND v.sample_idx BETWEEN p.peak_idx - size // 2 AND p.peak_idx + size // 2 - 1 GROUP BY p.track_id, p.channel_index, p.peak_idx, p.peak_db, size HAVING count(*) >= greatest(1, size // 2))"""
    + GROUPED[len(CUT) :]
)
Q["e11_e6_band_worst_cases"] = lambda s, d: rounded(_band_worst(s, d), BAND_DIGITS)
O["e11_e6_band_worst_cases"] = sql(
    BAND_GROUPED + """, wc AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel_index ORDER BY peak_db DESC, peak_idx) AS INTEGER) AS rank FROM pk ANTI JOIN mb USING (channel_index, peak_idx) QUALIFY rank <= 3),
tm AS (SELECT p.track_id, p.channel_index, p.rank, p.peak_idx, p.peak_db, max(v.sample_idx) FILTER (v.sample_idx <= p.peak_idx AND v.db < p.peak_db - 20) + 1 AS low, min(v.sample_idx) FILTER (v.sample_idx >= p.peak_idx AND v.db <= p.peak_db - 6) AS hit
  FROM wc p JOIN lv v ON v.channel_index = p.channel_index GROUP BY ALL)""",
    f"""SELECT x.track_id, nm.channel AS channel_index, nm.band_hz, x.rank, x.peak_idx, x.peak_db, greatest((x.peak_idx - coalesce(low, 0)) / {BAND_RATE} * 1000, 0) AS attack_time_ms, (coalesce(hit, ln.n) - x.peak_idx) / {BAND_RATE} * 1000 AS decay_6db_ms,
  cw.start_idx, CAST(len(cw.w) AS INTEGER) AS n FROM tm x {NAMED} JOIN ln ON ln.channel_index = x.channel_index LEFT JOIN cw ON cw.channel_index = x.channel_index AND cw.peak_idx = x.peak_idx""",
    "peak_db attack_time_ms decay_6db_ms",
    BAND_DIGITS,
)

#: Columns whose sums stand for the sections of a full export; None counts rows only.
SUMMED = {
    "track_metadata": "original_peak", "octave_band_analysis": "p50", "time_domain_summary": "total_windows", "time_domain_analysis": "peak_level", "advanced_statistics": None, "extreme_chunks_octave_analysis": "max_amplitude",
    "histogram_linear": "bin_count", "histogram_log_db": "bin_count", "octave_time_metrics": "peak_level", "sustained_peaks_summary": "n_peaks", "sustained_peaks_events": "hold_ms",
}


def _full_export(s, d):
    """All sections of an analysis of the vectors, written as CSV and read back; what rests on patterns is written, and not summed."""
    folder = scratch(s)
    made = reports.full_analysis(
        vectors(s, d), CENTRES, BAND_RATE, 32, 16, 16, BAND_HEIGHT, BAND_DISTANCE, folder=f"{folder}/kept", window_wavelengths=4.0, fallback_ms=100.0, digits=BAND_DIGITS, similarity=0.8, least=2, most=4, top=2, least_db=BAND_LEAST, seconds=0.25
    )
    names, out = tables.write_sections(made, folder), None
    for name in (n for n in names if n in SUMMED):
        df = s.read.csv(f"{folder}/{name}", header=True)
        if name == "advanced_statistics":
            df = df.where("parameter = 'spectral_centroid_hz'").withColumn("total", F.col("value"))
        one = df.agg(F.count("*").alias("n"), F.sum(F.col(SUMMED[name] or "total").cast("double")).alias("total")).select(F.lit(name).alias("section"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


def _export_sql() -> str:
    windows_ = "SELECT channel_index, band_hz, w, max(abs(value)) AS peak FROM bank, unnest(range(3)) u(w) WHERE sample_idx // 16 BETWEEN w AND w + 1 GROUP BY ALL"
    chunks = """bp AS (SELECT channel_index, band_hz, sample_idx // 16 AS pane, max(abs(value)) AS m, sqrt(avg(value * value)) AS rms FROM bank GROUP BY ALL),
cc AS (SELECT channel_index, pane, round(20 * log10(greatest(m / rms, 1)), 9) AS cf FROM bp WHERE band_hz = 0),
xc AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY channel_index ORDER BY cf, pane) = 1 UNION ALL SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY channel_index ORDER BY cf DESC, pane) = 1)"""
    levels = "coalesce(20 * log10(nullif(abs(value), 0)), -120)"
    select = """SELECT 'track_metadata' AS section, count(*) AS n, sum(m)::DOUBLE AS total FROM (SELECT max(abs(value)) AS m FROM bank WHERE band_hz = 0 GROUP BY channel_index)
UNION ALL SELECT 'octave_band_analysis', count(*), sum(q) FROM (SELECT quantile_cont(abs(value), 0.5) AS q FROM bank GROUP BY channel_index, band_hz)
UNION ALL SELECT 'time_domain_summary', count(DISTINCT channel_index), count(*) FROM ww WHERE band_hz = 0
UNION ALL SELECT 'time_domain_analysis', count(*), sum(peak) FROM ww WHERE band_hz = 0
UNION ALL SELECT 'advanced_statistics', count(*), sum(c) FROM (SELECT sum(band_hz * e) / sum(e) AS c FROM (SELECT channel_index, band_hz, avg(value * value) AS e FROM bank WHERE band_hz > 0 GROUP BY ALL) GROUP BY channel_index)
UNION ALL SELECT 'extreme_chunks_octave_analysis', count(*), sum(m) FROM bp JOIN xc USING (channel_index, pane)
UNION ALL SELECT 'histogram_linear', 50 * (SELECT count(*) FROM nm), count(*) FILTER (value BETWEEN -1 AND 1) FROM bank
UNION ALL SELECT 'histogram_log_db', 19 * (SELECT count(*) FROM nm), count(*) FILTER (LEVELS BETWEEN -60 AND 0) FROM bank
UNION ALL SELECT 'octave_time_metrics', count(*), sum(peak) FROM ww
UNION ALL SELECT 'sustained_peaks_summary', (SELECT count(*) FROM nm), count(*) FROM sv
UNION ALL SELECT 'sustained_peaks_events', count(*), sum(hold_ms) FROM sv""".replace("LEVELS", levels)
    return sql(f"{BAND_PEAKS}{_BAND_EVENTS}, ww AS ({windows_}), {chunks}", select, "total", 3)


Q["s14_composed_export"] = lambda s, d: rounded(_full_export(s, d), 3)
O["s14_composed_export"] = _export_sql()
