"""The given tables as signals, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import series

#: Digits that floating results are rounded to, so that two engines agree.
DIGITS = 6
#: Bins of a 64-sample block are 1 Hz apart at this rate; the centres fit it.
RATE = 64.0
SCALE = 2.6457513110645907
CENTRES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder of results: in the shared folder that the session names, or, where it names none, on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{shared.rstrip('/')}/results-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="results-")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, and never minus zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql(with_: str, select: str, doubles: str = "", digits: int = DIGITS) -> str:
    """A query over common table expressions with the named columns rounded."""
    replace = ", ".join(f"round({c}::DOUBLE, {digits}) + 0.0 AS {c}" for c in doubles.split())
    return f"WITH {with_} SELECT * {f'REPLACE ({replace})' if replace else ''} FROM ({select})"


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type is a channel, in order of time."""
    e = series.ranked(table(spark, sf_dir, "events"), "event_type", "channel")
    return series.from_table(e, F.lit("events"), F.col("channel"), ["ts", "event_id"], F.col("value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event types' values less their mean."""
    return series.centred(event_values(spark, sf_dir))


EVENTS = """ev AS (SELECT 'events' AS track_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS channel_index,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS sample_idx, value - avg(value) OVER (PARTITION BY event_type) AS value FROM events)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a channel: many short series. The divisor has no short form, or rounding would meet ties."""
    e = table(spark, sf_dir, "events")
    return series.centred(series.from_table(e, F.lit("users"), F.col("user_id"), ["ts", "event_id"], F.col("value"))).withColumn("value", F.col("value") / SCALE)


USERS = """us AS (SELECT 'users' AS track_id, CAST(user_id AS INTEGER) AS channel_index, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx,
  (value - avg(value) OVER (PARTITION BY user_id)) / 2.6457513110645907::DOUBLE AS value FROM events)"""


def user_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' series as levels in dB under their largest value, to 3 digits so that plateaus are real."""
    u = series.normalise(users(spark, sf_dir))
    return u.select("track_id", "channel_index", "sample_idx", F.round(20 * F.log10(F.abs("value") + 1e-10), 3).alias("db"))


USER_LEVELS = (
    USERS
    + """, lv AS (SELECT track_id, channel_index, sample_idx, round(20 * log10(abs(value / max(abs(value)) OVER (PARTITION BY channel_index)) + 1e-10), 3) AS db FROM us)"""
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding is a channel with one block of 64 samples."""
    e = table(spark, sf_dir, "embeddings")
    samples = F.transform("embedding", lambda x: x.cast("double"))
    zero = F.lit(0).cast("long")
    return e.select(F.lit("vectors").alias("track_id"), F.col("vec_id").cast("int").alias("channel_index"), zero.alias("block_idx"), zero.alias("start_sample"), samples.alias("samples"))


BANDS = "bands(hz, lo, hi) AS (VALUES " + ", ".join(
    f"({c}, {CENTRES[i - 1] if i else 'NULL'}, {CENTRES[i + 1] if i + 1 < len(CENTRES) else 'NULL'})" for i, c in enumerate(CENTRES)
) + ")"
WEIGHT = """CASE WHEN f < hz THEN CASE WHEN lo IS NULL THEN 1 WHEN f > lo THEN sin(pi() / 2 * (ln(greatest(f, 1e-9)) - ln(lo)) / (ln(hz) - ln(lo))) ELSE 0 END
  WHEN f = hz THEN 1 ELSE CASE WHEN hi IS NULL THEN 1 WHEN f < hi THEN cos(pi() / 2 * (ln(greatest(f, 1e-9)) - ln(hz)) / (ln(hi) - ln(hz))) ELSE 0 END END"""
#: Plain discrete Fourier transform of every vector, the weights of the bins, and band powers.
SPECTRUM = f"""vx AS (SELECT 'vectors' AS track_id, CAST(vec_id AS INTEGER) AS channel_index, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings),
ks AS (SELECT range AS k FROM range(33)), {BANDS},
wt AS (SELECT k, hz, {WEIGHT} AS w FROM (SELECT k, k::DOUBLE AS f, hz, lo, hi FROM ks, bands)),
dft AS (SELECT track_id, channel_index, k, sum(x * cos(2 * pi() * k * n / 64)) AS re, -sum(x * sin(2 * pi() * k * n / 64)) AS im FROM vx, ks GROUP BY ALL),
pw AS (SELECT track_id, channel_index, k, (re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 4096.0 AS p FROM dft),
power AS (SELECT track_id, channel_index, hz::DOUBLE AS band_hz, sum(p * w * w) AS power FROM pw JOIN wt USING (k) GROUP BY ALL
  UNION ALL SELECT track_id, channel_index, 0.0, sum(p) FROM pw GROUP BY ALL)"""
#: The bank as rows, by the inverse transform.
BANK = (
    SPECTRUM
    + """, ns AS (SELECT range AS n FROM range(64)),
bank AS (SELECT track_id, channel_index, hz::DOUBLE AS band_hz, n AS sample_idx, sum(w * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * n / 64) - im * sin(2 * pi() * k * n / 64))) / 64 AS value
  FROM dft JOIN wt USING (k), ns GROUP BY ALL UNION ALL SELECT track_id, channel_index, 0.0, n, x FROM vx)"""
)
