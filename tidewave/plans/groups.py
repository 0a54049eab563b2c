"""Channels, groups, manifests and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import channels as ch
from ..operators import panes, reports, rollup, stats
from ..sources import media, series, tables
from .views import EVENTS, USERS, events, rounded, scratch, sql, table, users
from .windows import FULL, WINDOWS

Q, O = {}, {}
LAYOUTS = list(ch.LAYOUTS)
VALUES = "ly(layout, names) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ch.LAYOUTS.items()) + "), cn(total, names) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in ch.COUNTS.items()) + ")"
LIST = "[" + ", ".join(f"'{x}'" for x in LAYOUTS) + "]"


def channel_rows(s, d) -> DataFrame:
    """Suppliers as channels: a count, an index below it, and a layout, known or not."""
    k = F.col("s_suppkey")
    layout = F.element_at(F.array(*map(F.lit, LAYOUTS)), (k % len(LAYOUTS) + 1).cast("int"))
    total = (k % 14 + 1).cast("int")
    return table(s, d, "supplier").select(k.alias("id"), total.alias("total_channels"), (k * 7 % total).cast("int").alias("channel_index"), F.when(k % 4 == 0, F.concat(F.lit(" "), F.upper(layout))).when(k % 4 < 3, layout).alias("layout"))


CHANNELS = f"""{VALUES}, c0 AS (SELECT s_suppkey AS id, CAST(s_suppkey % 14 + 1 AS INTEGER) AS total_channels, {LIST}[s_suppkey % {len(LAYOUTS)} + 1] AS l FROM supplier),
c1 AS (SELECT id, total_channels, CAST(id * 7 % total_channels AS INTEGER) AS channel_index, CASE WHEN id % 4 = 0 THEN ' ' || upper(l) WHEN id % 4 < 3 THEN l END AS layout FROM c0),
c2 AS (SELECT c1.*, CASE WHEN c1.total_channels = 2 THEN ['Channel 1 Left', 'Channel 2 Right'][channel_index + 1] ELSE coalesce(string_split(ly.names, ',')[channel_index + 1], string_split(cn.names, ',')[channel_index + 1], 'Channel ' || (channel_index + 1)) END AS channel_name
  FROM c1 LEFT JOIN ly ON ly.layout = lower(trim(c1.layout)) LEFT JOIN cn ON cn.total = c1.total_channels),
c3 AS (SELECT *, list_transform(list_filter(regexp_split_to_array(trim(translate(trim(replace(upper(channel_name), 'CHANNEL', ' ')), '_/', '  ')), '\\s+'), lambda t: t <> ''), lambda t: trim(t, '()[],:;-')) AS tokens FROM c2),
c4 AS (SELECT *, CASE WHEN list_has_any(tokens, {list(ch.SCREEN)}) THEN 'screen' WHEN len(list_filter(tokens, lambda t: starts_with(t, 'LFE'))) > 0 THEN 'lfe'
  WHEN list_has_any(tokens, {list(ch.SURROUND)}) OR left(channel_name, 9) IN ('Channel 5', 'Channel 6', 'Channel 7', 'Channel 8') THEN 'surround' END AS kind FROM c3)"""


def _names(s, d):
    c = ch.with_channel_name(channel_rows(s, d))
    return c.select("*", ch.folder_name(F.col("channel_name"), F.col("channel_index"), F.col("total_channels")).alias("folder"))


Q["p9_p10_j1_channel_names"] = _names
O["p9_p10_j1_channel_names"] = f"WITH {CHANNELS} SELECT id, total_channels, channel_index, layout, channel_name, CASE WHEN total_channels = 2 THEN channel_name ELSE 'Channel ' || (channel_index + 1) || ' ' || channel_name END AS folder FROM c2"


def _kinds(s, d):
    c = _names(s, d)
    group = ch.group_of(F.col("channel_name"), F.col("channel_index"))
    return c.select("id", ch.classify(F.col("channel_name")).alias("kind"), group.alias("channel_group"), ch.group_label(group).alias("label"), ch.legacy_group(F.col("folder")).alias("legacy"))


Q["p12_p14_g1_u3_groups"] = _kinds
O["p12_p14_g1_u3_groups"] = f"""WITH {CHANNELS}, c5 AS (SELECT *, coalesce(kind, CASE WHEN channel_index <= 2 THEN 'screen' WHEN channel_index = 3 THEN 'lfe' ELSE 'surround' END) AS g,
  CASE WHEN total_channels = 2 THEN channel_name ELSE 'Channel ' || (channel_index + 1) || ' ' || channel_name END AS folder FROM c4)
SELECT id, kind, g AS channel_group, CASE g WHEN 'screen' THEN 'Screen' WHEN 'lfe' THEN 'LFE' ELSE 'Surround+Height' END AS label,
  CASE WHEN folder IN ('Channel 1 FL', 'Channel 2 FR', 'Channel 3 FC') THEN 'Screen' WHEN folder IN ('Channel 4 LFE', 'Channel 5 LFE', 'Channel 6 LFE') THEN 'LFE' WHEN regexp_matches(folder, '^Channel (5|6|7|8|9|10|11|12)') THEN 'Surround+Height' ELSE 'All Channels' END AS legacy FROM c5"""

CONFIGS = ["2F", "3F", "3F2M2R/LFE", "1F", "5F4M/LFE", "2f4r/lfe", "", "junk", "3F2M"]


def _configs(s, d):
    c = F.element_at(F.array(*map(F.lit, CONFIGS)), (F.col("p_partkey") % len(CONFIGS) + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", c.alias("config")).select("p_partkey", "config", F.array_join(ch.parse_config(F.col("config")), ",").alias("names"))


def _config_sql(letter: str, names: dict) -> str:
    return f"CASE regexp_extract(m, '(\\d+){letter}', 1) " + " ".join(f"WHEN '{k}' THEN '{v},'" for k, v in names.items()) + " ELSE '' END"


Q["p11_channel_config"] = _configs
O["p11_channel_config"] = (
    f"WITH p AS (SELECT p_partkey, {CONFIGS}[p_partkey % {len(CONFIGS)} + 1] AS config FROM part), q AS (SELECT *, string_split(upper(config), '/')[1] AS m, coalesce(string_split(upper(config), '/')[2], '') AS l FROM p) "
    f"SELECT p_partkey, config, nullif(rtrim({_config_sql('F', ch.FRONT)} || {_config_sql('M', ch.MIDDLE)} || {_config_sql('R', ch.REAR)} || CASE WHEN contains(l, 'LFE') THEN 'LFE' ELSE '' END, ','), '') AS names FROM q"
)


def _filters(s, d):
    """Which channel filters match a channel's tokens, and which match nothing."""
    c = _names(s, d).select("id", ch.filter_tokens(F.col("channel_name"), F.col("folder")).alias("tokens"))
    wanted = table(s, d, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.concat(F.lit(" ch-annel "), F.col("n_nationkey").cast("string"), F.lit(" FL "))).alias("filter"))
    return reports.filter_channels(c, wanted.select("filter", ch.filter_tokens(F.col("filter")).alias("tokens"))).select("filter", F.col("id").cast("long").alias("id"))


Q["p15_j11_u4_channel_filters"] = _filters
O["p15_j11_u4_channel_filters"] = f"""WITH {CHANNELS}, nm AS (SELECT id, unnest([channel_name, CASE WHEN total_channels = 2 THEN channel_name ELSE 'Channel ' || (channel_index + 1) || ' ' || channel_name END]) AS v FROM c2),
tk AS (SELECT DISTINCT id, unnest([lower(trim(v)), regexp_replace(lower(trim(v)), '[^\\p{{L}}\\p{{N}}]', '', 'g')]) AS token FROM nm),
fl AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE ' ch-annel ' || n_nationkey || ' FL ' END AS filter FROM nation),
ft AS (SELECT DISTINCT filter, unnest([lower(trim(filter)), regexp_replace(lower(trim(filter)), '[^\\p{{L}}\\p{{N}}]', '', 'g')]) AS token FROM fl),
hit AS (SELECT DISTINCT filter, id FROM ft JOIN tk USING (token))
SELECT filter, CAST(id AS BIGINT) AS id FROM hit UNION ALL SELECT DISTINCT filter, NULL FROM fl WHERE filter NOT IN (SELECT filter FROM hit)"""

PATH = "concat('/media/', CASE n_nationkey % 4 WHEN 0 THEN 'Music' WHEN 1 THEN 'Film' WHEN 2 THEN 'Test Signals' ELSE n_name END, '/', n_name, '.wav')"
Q["p16_content_type"] = lambda s, d: table(s, d, "nation").select("n_nationkey", F.expr(PATH).alias("path")).select("n_nationkey", ch.content_type(F.col("path")).alias("content_type"))
O["p16_content_type"] = "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Music' WHEN 1 THEN 'Film' WHEN 2 THEN 'Test Signal' ELSE 'Unknown' END AS content_type FROM nation"


def _streams(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(
        F.concat(F.lit("t"), (k % 500).cast("string")).alias("track_id"), k.alias("stream_index"),
        F.element_at(F.array(F.lit("aac"), F.lit("TrueHD"), F.lit("ac3"), F.lit("flac"), F.lit("eac3")), (k % 5 + 1).cast("int")).alias("codec"), F.when(k % 3 == 0, "Dolby Atmos").alias("profile"),
    )


Q["s3_choose_stream"] = lambda s, d: series.choose_stream(_streams(s, d))
O["s3_choose_stream"] = """WITH st AS (SELECT 't' || (o_orderkey % 500) AS track_id, o_orderkey AS stream_index, ['aac', 'TrueHD', 'ac3', 'flac', 'eac3'][o_orderkey % 5 + 1] AS codec, CASE WHEN o_orderkey % 3 = 0 THEN 'Dolby Atmos' END AS profile FROM orders)
SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY CASE WHEN lower(codec) = 'truehd' AND NOT contains(lower(coalesce(profile, '')), 'atmos') THEN 0 ELSE 1 END, stream_index) = 1"""


def _paths(s, d):
    return media.unique_paths(table(s, d, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("path"))).select("path")


Q["u2_unique_paths"] = _paths
O["u2_unique_paths"] = "SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS path FROM pages"


def _media(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey"), F.concat(F.lit("/m/"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_custkey") % 5).alias("mtime"))
    done = o.where("o_orderkey % 2 = 0").select("path", F.when(F.col("o_orderkey") % 3 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime")).withColumn("config_hash", media.parameter_hash(step=1, window=2))
    return media.unprocessed(o.select("path", "mtime"), done, media.parameter_hash(window=2, step=1)).select("path", "mtime")


Q["s18_unprocessed"] = _media
O["s18_unprocessed"] = "SELECT '/m/' || o_orderkey AS path, o_custkey % 5 AS mtime FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0)"
Q["s19_track_folders"] = lambda s, d: media.track_folders(table(s, d, "orders").select(F.concat(F.lit("/r/t"), (F.col("o_custkey") % 99).cast("string"), F.lit("/ch1/"), F.when(F.col("o_orderkey") % 2 == 0, "analysis_results.csv").otherwise("x.png")).alias("path")))
O["s19_track_folders"] = "SELECT DISTINCT '/r/t' || (o_custkey % 99) AS track_folder FROM orders WHERE o_orderkey % 2 = 0"


def _manifest(s, d):
    c = lambda n: table(s, d, "customer").where(f"c_custkey % {n} = 0").select(F.lit("t").alias("track_id"), F.col("c_custkey").cast("int").alias("channel_index"), F.lit(n).alias("version"))
    return tables.upsert_manifest(c(2), c(3))


Q["s8_upsert_manifest"] = _manifest
O["s8_upsert_manifest"] = "SELECT 't' AS track_id, CAST(c_custkey AS INTEGER) AS channel_index, CAST(CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 2 END AS INTEGER) AS version FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"


def _versions(s, d):
    """Two versions of a store: every third user anew, of whom the odd ones have nothing in the table any more."""
    folder = scratch(s)
    u = users(s, d).groupBy("track_id", "channel_index").agg(F.count("*").alias("samples"), F.max(F.abs("value")).alias("peak"))
    tables.commit({"levels": u}, u, folder)
    again = u.where("channel_index % 3 = 0")
    tables.commit({"levels": again.where("channel_index % 2 = 0").withColumn("samples", F.col("samples") + 1000)}, again, folder)
    return tables.read_version(s, folder, "levels", u.schema)


Q["s7_s8_versions"] = lambda s, d: rounded(_versions(s, d))
O["s7_s8_versions"] = sql(
    USERS + ", a AS (SELECT track_id, channel_index, count(*) AS samples, max(abs(value)) AS peak FROM us GROUP BY ALL)",
    "SELECT track_id, channel_index, samples + CASE WHEN channel_index % 3 = 0 THEN 1000 ELSE 0 END AS samples, peak FROM a WHERE channel_index % 3 <> 0 OR channel_index % 2 = 0",
    "peak",
)
KINDS = ["click", "purchase", "refund", "view"]


def _artifacts(s, d):
    return tables.missing_artifacts(table(s, d, "events").select(F.lit("u").alias("track_id"), F.col("user_id").cast("int").alias("channel_index"), F.col("event_type").alias("artifact")).where("event_type > 'c' and channel_index % 3 = 0 or event_type > 'n'"), KINDS)


Q["s9_missing_artifacts"] = lambda s, d: _artifacts(s, d).select("track_id", "channel_index", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"))
O["s9_missing_artifacts"] = f"""WITH f AS (SELECT DISTINCT CAST(user_id AS INTEGER) AS channel_index, event_type AS artifact FROM events WHERE event_type > 'c' AND user_id % 3 = 0 OR event_type > 'n'),
e AS (SELECT channel_index, unnest({KINDS}) AS artifact FROM (SELECT DISTINCT channel_index FROM f))
SELECT 'u' AS track_id, channel_index, coalesce(string_agg(artifact, ',' ORDER BY artifact) FILTER (f.artifact IS NOT NULL), '') AS present, coalesce(string_agg(e.artifact, ',' ORDER BY e.artifact) FILTER (f.artifact IS NULL), '') AS missing
FROM e LEFT JOIN f USING (channel_index, artifact) GROUP BY channel_index""".replace("string_agg(artifact, ',' ORDER BY artifact)", "string_agg(e.artifact, ',' ORDER BY e.artifact)")


def _messages(s, d):
    m = table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("m"), F.count("*").alias("n"))
    return m.select("n_regionkey", rollup.shorten(F.col("m"), 4).alias("messages"), "n")


Q["s10_k7_messages"] = _messages
O["s10_k7_messages"] = "WITH m AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS m, count(*) AS n FROM nation GROUP BY ALL) SELECT n_regionkey, array_to_string(m[:4], '; ') || CASE WHEN n > 4 THEN '; ... and ' || (n - 4) || ' more' ELSE '' END AS messages, n FROM m"


def _json(s, d):
    """All windows of each channel as JSON documents, read again; some of their levels are not finite."""
    k = F.col("window_idx") % 5
    level = F.when(k == 1, float("inf")).when(k == 3, float("nan")).otherwise(F.round("peak_level", 6))
    docs = reports.json_windows(panes.fixed_window(events(s, d), 64, 64).withColumn("level", level), ["level"], run=16)
    back = docs.select("channel_index", "part", F.explode(F.from_json("doc", "array<struct<window_idx:long,level:double>>")).alias("x"))
    return back.select("channel_index", "part", "x.window_idx", "x.level")


Q["s17_s12_json_windows"] = lambda s, d: rounded(_json(s, d))
O["s17_s12_json_windows"] = sql(
    EVENTS + ", w AS (SELECT channel_index, sample_idx // 64 AS window_idx, max(abs(value)) AS m FROM ev GROUP BY ALL HAVING count(*) = 64)",
    "SELECT channel_index, window_idx // 16 AS part, window_idx, CASE WHEN window_idx % 5 NOT IN (1, 3) THEN m END AS level FROM w", "level",
)
WIN = EVENTS + ", " + WINDOWS.format("ev") + f", fw AS ({FULL}), gw AS (SELECT *, CASE WHEN channel_index <= 2 THEN 'screen' WHEN channel_index = 3 THEN 'lfe' ELSE 'surround' END AS channel_group FROM fw)"


def grouped(s, d):
    w = panes.fixed_window(events(s, d), 4, 2)
    return w.withColumn("channel_group", ch.group_of(F.lit("x"), F.col("channel_index")))


Q["a15_u1_g3_group_crest"] = lambda s, d: rounded(rollup.group_crest_table(grouped(s, d)))
O["a15_u1_g3_group_crest"] = sql(
    WIN,
    """SELECT track_id, channel_group, min(crest_factor_db) AS min_db, quantile_cont(crest_factor_db, 0.95) AS p95_db, quantile_cont(crest_factor_db, 0.9) AS p90_db, avg(crest_factor_db) AS mean_db, median(crest_factor_db) AS median_db,
  max(crest_factor_db) AS max_db, stddev_pop(crest_factor_db) AS std_db, count(crest_factor_db) AS windows FROM gw GROUP BY ALL""",
    "min_db p95_db p90_db mean_db median_db max_db std_db",
)
Q["g3_crest_limits"] = lambda s, d: rounded(rollup.crest_limits(grouped(s, d)))
O["g3_crest_limits"] = sql(WIN, "SELECT track_id, channel_group, min(crest_factor_db) AS lowest, max(crest_factor_db) AS highest, greatest(ceil(max(crest_factor_db) / 5) * 5, 20) AS y_max FROM gw GROUP BY ALL", "lowest highest y_max")
Q["s16_wide_series"] = lambda s, d: rounded(rollup.wide_series(panes.fixed_window(events(s, d), 4, 2).select("track_id", F.lit(0).alias("channel_index"), F.col("channel_index").cast("double").alias("band_hz"), "window_idx", "crest_factor_db"), [0.0, 1.0, 2.0, 3.0, 4.0]))
O["s16_wide_series"] = sql(WIN, "SELECT track_id, CAST(0 AS INTEGER) AS channel_index, window_idx, " + ", ".join(f"max(crest_factor_db) FILTER (channel_index = {i}) AS cf_{i}_hz" for i in range(5)) + " FROM gw GROUP BY ALL", "cf_0_hz cf_1_hz cf_2_hz cf_3_hz cf_4_hz")

# Recovery statistics of channels, from line items: suppliers as channels of region-like groups.
STAT = {f"t{t}_ms_{n}": f"(sum(l_quantity) * {m} + {t * 10}) % 5200" for t, m in ((3, 7), (6, 13), (9, 29), (12, 31)) for n, m in (("p95", m), ("p90", m + 2))}
STAT |= {"hold_ms_p95": "sum(l_quantity) % 97"}


def recovery(s, d):
    cols = [F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in STAT.items()]
    g = table(s, d, "lineitem").groupBy(F.lit("t").alias("track_id"), F.col("l_suppkey").cast("int").alias("channel_index")).agg(*cols)
    return g.withColumn("channel_group", F.concat(F.lit("g"), (F.col("channel_index") % 6).cast("string")))


RECOVERY = "rc AS (SELECT 't' AS track_id, CAST(l_suppkey AS INTEGER) AS channel_index, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in STAT.items()) + ", 'g' || (l_suppkey % 6) AS channel_group FROM lineitem GROUP BY l_suppkey)"
Q["a18_decay_aggregate"] = lambda s, d: rounded(rollup.decay_aggregate(recovery(s, d)), 4)
DEC = RECOVERY + ", st AS (" + " UNION ALL ".join(f"SELECT track_id, channel_group, CAST({t} AS INTEGER) AS threshold, t{t}_ms_p95 AS p95, t{t}_ms_p90 AS p90 FROM rc" for t in (3, 6, 9, 12)) + """),
da AS (SELECT track_id, channel_group, threshold, max(p95) FILTER (p95 > 0) AS a, max(p90) FILTER (p90 > 0) AS b FROM st GROUP BY ALL),
dt AS (SELECT track_id, channel_group, threshold, CASE WHEN a >= 4950 THEN coalesce(b, a) ELSE coalesce(a, 0) END AS time_ms, -threshold::DOUBLE AS level_db FROM da)"""
O["a18_decay_aggregate"] = sql(DEC, "SELECT * FROM dt", "time_ms level_db", 4)
Q["g7_a19_decay_curve"] = lambda s, d: rounded(rollup.decay_curve(rollup.decay_aggregate(recovery(s, d))).select("track_id", "channel_group", "tau_ms", "amplitude_db", "x_max", F.col("curve")[399]["level_db"].alias("end_db"), F.size("curve").cast("long").alias("points"), F.aggregate("curve", F.lit(0.0), lambda a, x: a + x["level_db"]).alias("total_db"), F.aggregate("curve", F.lit(0.0), lambda a, x: a + x["t_ms"]).alias("total_ms")), 4)
O["g7_a19_decay_curve"] = sql(
    DEC + ", cv AS (SELECT track_id, channel_group, greatest(max(time_ms) FILTER (threshold = 9), 1) AS tau_ms, 9 / 0.693::DOUBLE AS amplitude_db, CAST(greatest(200, floor(max(time_ms) * 1.2)) AS INTEGER) AS x_max FROM dt GROUP BY ALL)",
    "SELECT cv.*, -amplitude_db * ln(1 + x_max / tau_ms) AS end_db, count(*) AS points, sum(-amplitude_db * ln(1 + i * x_max / 399.0::DOUBLE / tau_ms)) AS total_db, sum(i * x_max / 399.0::DOUBLE) AS total_ms FROM cv, range(400) r(i) GROUP BY ALL",
    "tau_ms amplitude_db end_db total_db total_ms",
    4,
)
#: A bounded fit is no SQL; it is tested against known curves.
Q["g8_fit_decay"] = lambda s, d: rounded(rollup.fit_decay(rollup.decay_aggregate(recovery(s, d)).select("track_id", "channel_group", "time_ms", "level_db")), 3)


def _scores(s, d):
    r = recovery(s, d)
    lacking = r.where("channel_index % 3 <> 0").select("track_id", "channel_index", F.when(F.col("channel_index") % 3 == 1, F.col("t6_ms_p95")).alias("t6_ms_p95"), F.lit(None).cast("double").alias("t9_ms_p95"), F.lit(None).cast("double").alias("t3_ms_p95"), F.lit(None).cast("double").alias("t12_ms_p95"), "hold_ms_p95")
    advanced = r.where("channel_index % 2 = 0").select("track_id", "channel_index", (F.col("hold_ms_p95") / 2).alias("peak_saturation_percent"), F.lit(1.0).alias("clip_events_rate_per_sec"))
    return rollup.worst_channels(rollup.worst_scores(r.select("track_id", "channel_index", "channel_group"), lacking, advanced))


Q["g6_j7_k5_worst_channels"] = lambda s, d: rounded(_scores(s, d), 4)
O["g6_j7_k5_worst_channels"] = sql(
    RECOVERY + """, sc AS (SELECT track_id, channel_index, channel_group, CASE channel_index % 3 WHEN 1 THEN t6_ms_p95 WHEN 2 THEN hold_ms_p95 ELSE CASE WHEN channel_index % 2 = 0 THEN hold_ms_p95 / 2 ELSE 0 END END AS score,
  CASE channel_index % 3 WHEN 1 THEN 'sustained:t6_ms_p95' WHEN 2 THEN 'sustained:hold_ms_p95' ELSE CASE WHEN channel_index % 2 = 0 THEN 'advanced:peak_saturation_percent' ELSE 'none' END END AS metric_used FROM rc)""",
    "SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY channel_group ORDER BY score DESC, channel_index) = 1",
    "score",
    4,
)
Q["a16_g9_group_means"] = lambda s, d: rounded(rollup.mean_of_numbers(recovery(s, d)), 4)
O["a16_g9_group_means"] = sql(RECOVERY, "SELECT track_id, channel_group, " + ", ".join(f"avg({n}) AS {n}" for n in STAT) + " FROM rc GROUP BY ALL", " ".join(STAT), 4)


def _occurrence(s, d):
    r = recovery(s, d).select("track_id", "channel_index", "channel_group", *((F.col(c) / n).alias(f"peaks_above_{k}_per_sec") for c, n, k in (("t3_ms_p95", 250.0, "minus3db"), ("t6_ms_p95", 5e3, "minus1db"), ("hold_ms_p95", 530.0, "minus0_1db"))))
    return rollup.peak_occurrence(rollup.mean_of_numbers(r))


Q["a17_peak_occurrence"] = lambda s, d: rounded(_occurrence(s, d), 4)
O["a17_peak_occurrence"] = sql(
    RECOVERY + ", oc AS (SELECT track_id, channel_group, avg(t3_ms_p95 / 250) AS a, avg(t6_ms_p95 / 5e3) AS b, avg(hold_ms_p95 / 530.0) AS c FROM rc GROUP BY ALL)",
    """SELECT track_id, channel_group, a AS peaks_above_minus3db_per_sec, b AS peaks_above_minus1db_per_sec, c AS peaks_above_minus0_1db_per_sec, CASE WHEN c > 1 THEN 'high' WHEN c > 0.1 THEN 'medium' ELSE 'low' END AS clipping,
  CASE WHEN b > 1 THEN 'high' WHEN b > 0.1 THEN 'medium' ELSE 'low' END AS hot, a > 10 AS dense FROM oc""",
    "peaks_above_minus3db_per_sec peaks_above_minus1db_per_sec peaks_above_minus0_1db_per_sec",
    4,
)


def _matrix(s, d):
    m = rollup.mean_of_numbers(recovery(s, d))
    flat = m.unpivot(["track_id", "channel_group"], list(STAT), "parameter", "value")
    return rollup.summary_matrix(flat, ["track_id", "channel_group"]).select("track_id", "channel_group", "metric", "p90", "p95")


Q["g10_summary_matrix"] = lambda s, d: rounded(_matrix(s, d), 4)
O["g10_summary_matrix"] = sql(
    RECOVERY,
    " UNION ALL ".join(f"SELECT track_id, channel_group, 't{t}_ms' AS metric, avg(t{t}_ms_p90) AS p90, avg(t{t}_ms_p95) AS p95 FROM rc GROUP BY ALL" for t in (3, 6, 9, 12)) + " UNION ALL SELECT track_id, channel_group, 'hold_ms', NULL, avg(hold_ms_p95) FROM rc GROUP BY ALL",
    "p90 p95",
    4,
)


def _report_groups(s, d):
    """Every fifth channel's folder stands in a manifest; the others go by their names."""
    c = _names(s, d).select("id", F.lit("t").alias("track_id"), "folder", "channel_name", "total_channels", "layout")
    manifest = c.where("id % 5 = 0").select("track_id", "folder", F.concat(F.lit("G"), F.length("folder").cast("string")).alias("group"))
    return reports.report_groups(c, manifest).select("id", "folder", "report_group")


Q["g2_report_groups"] = _report_groups
O["g2_report_groups"] = f"""WITH {CHANNELS}, f AS (SELECT *, CASE WHEN total_channels = 2 THEN channel_name ELSE 'Channel ' || (channel_index + 1) || ' ' || channel_name END AS folder FROM c4),
m AS (SELECT DISTINCT folder, 'G' || length(folder) AS g FROM f WHERE id % 5 = 0)
SELECT id, folder, coalesce(g, CASE kind WHEN 'screen' THEN 'Screen' WHEN 'lfe' THEN 'LFE' WHEN 'surround' THEN 'Surround+Height' END, CASE WHEN total_channels = 1 THEN 'Mono' ELSE 'All Channels' END) AS report_group FROM f LEFT JOIN m USING (folder)"""


def _best(s, d):
    e = table(s, d, "lineitem").groupBy((F.col("l_linenumber") % 3).alias("length"), (F.col("l_suppkey") % 5).alias("tau")).agg(F.round(F.avg("l_tax"), 6).alias("mean_abs_error_db"), F.round(F.avg("l_discount"), 6).alias("rmse_db"))
    return rollup.best_candidates(e, ["length"], "tau")


Q["k6_best_candidate"] = _best
O["k6_best_candidate"] = "WITH e AS (SELECT l_linenumber % 3 AS length, l_suppkey % 5 AS tau, round(avg(l_tax), 6) AS mean_abs_error_db, round(avg(l_discount), 6) AS rmse_db FROM lineitem GROUP BY ALL) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY length ORDER BY mean_abs_error_db, rmse_db, tau) = 1"


def _sections(s, d):
    """A sectioned file a customer: their orders, rows of another width among them, between two other sections."""
    cells = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 7 == 0, "ragged"))
    held = table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", cells.alias("line")))).alias("rows"), F.count("*").alias("n"))
    count = F.col("n").cast("string")
    text = F.flatten(F.array(F.array(F.lit("[SUMMARY]"), F.lit("orders,kind"), F.concat(count, F.lit(",all")), F.lit(""), F.lit("[ORDERS]"), F.lit("key,priority")), F.col("rows.line"), F.array(F.lit("[END]"), F.lit("key,priority"), F.lit("0,none"))))
    lines = held.select(F.col("o_custkey").cast("string").alias("path"), F.posexplode(text).alias("line", "value"))
    return tables.parse_sections(lines, "ORDERS", ["key", "priority"]).select("path", "key", "priority")


Q["s15_sections"] = _sections
O["s15_sections"] = "SELECT o_custkey::VARCHAR AS path, o_orderkey::VARCHAR AS key, o_orderpriority AS priority FROM orders WHERE o_orderkey % 7 <> 0"
Q["p23_report_cells"] = lambda s, d: table(s, d, "supplier").select("s_suppkey", reports.report_cell(F.when((F.col("s_suppkey") % 7 != 0) | (F.col("s_acctbal") == 0), F.col("s_acctbal").cast("double"))).alias("cell"))
O["p23_report_cells"] = "SELECT s_suppkey, CASE WHEN s_acctbal = 0 THEN '0.0' WHEN s_suppkey % 7 <> 0 THEN printf('%.1f', round_even(s_acctbal::DOUBLE, 1)) ELSE 'N/A' END AS cell FROM supplier"


def _ordered(s, d):
    """Rows in report order: by band, unknown bands last, then by bin."""
    o = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 9 != 0, F.col("p_size")).alias("band"))
    return reports.in_report_order(o.withColumn("panel", F.col("p_partkey") % 10), ["panel"], ["band", "p_partkey"]).select("p_partkey", "place")


Q["g11_g12_k4_report_order"] = _ordered
O["g11_g12_k4_report_order"] = "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY CASE WHEN p_size % 9 <> 0 THEN p_size END NULLS LAST, p_partkey) AS INTEGER) AS place FROM part"


def _stored(s, d):
    """Levels of all users written as a partitioned table, the even ones again at half the level, and read back."""
    folder, levels = scratch(s), stats.whole_interval(users(s, d)).select("track_id", (F.col("channel_index") % 16).alias("channel_index"), F.col("channel_index").alias("user"), "samples", "peak")
    tables.write_table(levels, folder, "levels")
    tables.write_table(levels.where("channel_index % 2 = 0").withColumn("peak", F.col("peak") / 2), folder, "levels")
    return tables.read_table(s, folder, "levels", levels.schema, "users")


Q["s7_s12_result_tables"] = lambda s, d: rounded(_stored(s, d))
O["s7_s12_result_tables"] = sql(
    USERS + ', a AS (SELECT track_id, channel_index AS "user", count(*) AS samples, max(abs(value)) AS peak FROM us GROUP BY ALL)',
    'SELECT track_id, CAST("user" % 16 AS INTEGER) AS channel_index, "user", samples, peak / CASE WHEN "user" % 2 = 0 THEN 2 ELSE 1 END AS peak FROM a',
    "peak",
)


def _exported(s, d):
    """A full export's sections written as CSV and read back: rows of each, and a sum over one of its columns."""
    folder, w = scratch(s), panes.fixed_window(events(s, d), 4, 2)
    frames = {"time_domain_analysis": w, "time_domain_summary": stats.time_domain_summary(w), "histogram_linear": stats.linear_histogram(series.normalise(events(s, d)))}
    sums = {"time_domain_analysis": "peak_level", "time_domain_summary": "total_windows", "histogram_linear": "bin_count"}
    out = None
    for name in tables.write_sections(frames, folder):
        df = s.read.csv(f"{folder}/{name}", header=True)
        one = df.agg(F.count("*").alias("n"), F.sum(F.col(sums[name]).cast("double")).alias("total")).select(F.lit(name).alias("section"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


Q["s13_s14_full_export"] = lambda s, d: rounded(_exported(s, d), 4)
O["s13_s14_full_export"] = sql(
    WIN,
    """SELECT 'time_domain_analysis' AS section, count(*) AS n, sum(peak_level) AS total FROM fw UNION ALL SELECT 'time_domain_summary', count(DISTINCT channel_index), count(*) FROM fw
  UNION ALL SELECT 'histogram_linear', 50 * count(DISTINCT channel_index), count(*) FROM ev""",
    "total",
    4,
)


def _found(s, d):
    """The tables that lie in a folder of results."""
    folder, rows = scratch(s), table(s, d, "nation").select(F.lit("t").alias("track_id"), (F.col("n_regionkey")).cast("int").alias("channel_index"), "n_name")
    for name in ("a", "b"):
        tables.write_table(rows.repartition("channel_index"), folder, name)
    return tables.find_tables(s, folder).select("table", "files")


Q["s11_find_tables"] = _found
O["s11_find_tables"] = "SELECT t AS \"table\", count(DISTINCT n_regionkey) AS files FROM nation, (VALUES ('a'), ('b')) v(t) GROUP BY t"
