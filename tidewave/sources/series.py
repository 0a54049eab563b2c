"""Ordered series: rows ``(track_id, channel_index, sample_idx, value)`` and blocks of samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["track_id", "channel_index"]


#: Rows of a slice in which samples are numbered by one task, about; rows that are looked at for each slice's end.
SLICE_ROWS, LOOKED_AT = 1 << 20, 32


def _slices(rows: DataFrame, lead: Column, order: Sequence[str], count: int) -> Column:
    """The slice of each row: slices of about equal numbers of rows, ended by quantiles of a hashed sample of bounded size."""
    every = max(1, rows.count() // (count * LOOKED_AT))
    seen = rows.where(F.pmod(F.xxhash64(*KEYS, *order), F.lit(every)) == 0).select(lead.alias("x")).where("x is not null").toPandas()["x"].sort_values().to_numpy()
    ends = np.unique(seen[np.arange(1, count) * len(seen) // count]) if len(seen) else seen

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        at = np.full(len(x), -1, np.int64)  # nulls come first
        there = x.notna().to_numpy() if x.dtype == object else np.ones(len(x), bool)
        at[there] = np.searchsorted(ends, x.to_numpy()[there], side="right")
        return pd.Series(at)

    return F.when(lead.isNull(), F.lit(-1)).otherwise(place(lead))


def from_table(df: DataFrame, track: Column, channel: Column, order: Sequence[str], value: Column, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Any table as series: samples are numbered by ``order`` inside their track and channel.

    NaN and null values are dropped first, so that numbers have no holes. A
    table of more than ``slice_rows`` rows is cut along the first order column
    where a sample's quantiles say, so slices have like numbers of rows however
    the rows are spread over time; samples are numbered inside a slice, and the
    counts of the slices before are added. No task sorts a whole channel; rows
    that are equal in the first column are one slice.
    """
    rows = df.select(track.alias("track_id"), channel.cast("int").alias("channel_index"), value.cast("double").alias("value"), *order)
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    slices, part = -(-df.count() // slice_rows), F.lit(0)
    if slices > 1:
        kind, lead = dict(rows.dtypes)[order[0]], F.col(order[0])
        if kind in ("timestamp", "timestamp_ntz", "date"):
            lead = F.unix_micros(lead.cast("timestamp")).cast("double")
        elif kind != "string":
            lead = lead.cast("double")
        part = _slices(rows, lead, order, slices)
    rows = rows.withColumn("_slice", part)
    number = F.row_number().over(Window.partitionBy(*KEYS, "_slice").orderBy(*order)) - 1
    numbered = rows.select(*KEYS, "_slice", number.cast("long").alias("sample_idx"), "value")
    if slices > 1:
        along = Window.partitionBy(*KEYS).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
        counts = rows.groupBy(*KEYS, "_slice").agg(F.count("*").alias("_n"))
        before = counts.select(*KEYS, "_slice", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
        numbered = numbered.join(before, [*KEYS, "_slice"]).withColumn("sample_idx", F.col("sample_idx") + F.col("_before"))
    return numbered.select(*KEYS, "sample_idx", "value")


def ranked(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the dense rank, from 0, of a column of few distinct values, which alone are ordered."""
    few = df.select(column).distinct()
    few = few.select(F.col(column).alias("_v"), (F.row_number().over(Window.orderBy(column)) - 1).alias(name))
    return df.join(few, df[column].eqNullSafe(F.col("_v")), "left").drop("_v")


def centred(rows: DataFrame) -> DataFrame:
    """The series minus their means."""
    mean = rows.groupBy(*KEYS).agg(F.avg("value").alias("_mean"))
    return rows.join(mean, KEYS).select(*KEYS, "sample_idx", (F.col("value") - F.col("_mean")).alias("value"))


def to_blocks(rows: DataFrame, size: int) -> DataFrame:
    """``(keys, block_idx, start_sample, samples)``: the unit of parallel work."""
    block = F.expr(f"sample_idx div {size}").alias("block_idx")
    samples = F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))), lambda x: x["value"])
    return rows.groupBy(*KEYS, block).agg(F.min("sample_idx").alias("start_sample"), samples.alias("samples"))


def to_rows(blocks: DataFrame) -> DataFrame:
    flat = blocks.select(*KEYS, "start_sample", F.posexplode("samples").alias("_i", "value"))
    return flat.select(*KEYS, (F.col("start_sample") + F.col("_i")).alias("sample_idx"), "value")


def trim(blocks: DataFrame, start: int, length: int | None = None) -> DataFrame:
    """Samples from ``start`` on, clamped to the series. Whole blocks outside are filtered
    by their numbers, which reaches a Parquet scan; the ends are sliced."""
    start = max(0, start)
    n = F.size("samples")
    rows = blocks.where(F.col("start_sample") + n > start)
    if length is not None:
        rows = rows.where(F.col("start_sample") < start + length)
    skip = F.greatest(F.lit(start) - F.col("start_sample"), F.lit(0)).cast("int")
    end = n if length is None else F.least(n.cast("long"), F.lit(start + length) - F.col("start_sample")).cast("int")
    cut = F.slice("samples", skip + 1, F.greatest(end - skip, F.lit(0)))
    return rows.select(*KEYS, "block_idx", (F.col("start_sample") + skip).alias("start_sample"), cut.alias("samples"))


def split_frames(frames: DataFrame) -> DataFrame:
    """Interleaved frames ``(track_id, sample_idx, frame array)`` as a row a channel."""
    flat = frames.select("track_id", "sample_idx", F.posexplode("frame").alias("channel_index", "value"))
    return flat.select(*KEYS, "sample_idx", F.col("value").cast("double"))


def normalise(rows: DataFrame) -> DataFrame:
    """Peak 1 in every channel, the peak kept as ``original_peak``; silent series stay."""
    peak = rows.groupBy(*KEYS).agg(F.max(F.abs("value")).alias("original_peak"))
    value = F.when(F.col("original_peak") > 0, F.col("value") / F.col("original_peak")).otherwise(F.col("value"))
    return rows.join(peak, KEYS).select(*KEYS, "sample_idx", value.alias("value"), "original_peak")


def downmix(rows: DataFrame) -> DataFrame:
    """The mean over the channels of a track."""
    return rows.groupBy("track_id", "sample_idx").agg(F.avg("value").alias("value"))


def choose_stream(streams: DataFrame) -> DataFrame:
    """One stream a track: a TrueHD stream that is not Atmos if there is one, else the first."""
    preferred = (F.lower("codec") == "truehd") & ~F.lower(F.coalesce("profile", F.lit(""))).contains("atmos")
    order = Window.partitionBy("track_id").orderBy(F.when(preferred, 0).otherwise(1), "stream_index")
    return streams.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
