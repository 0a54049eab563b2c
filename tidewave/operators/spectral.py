"""Octave bands of blocks: a NumPy FFT for each block inside Arrow batches, the rest as aggregates.

The bank itself, a column for every band and sample, is never stored; a block
gives its summaries.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bands import bands_frame, check_centres, weight, weights
from ..functions.levels import crest_db, dbfs
from . import walk

KEYS = ["track_id", "channel_index"]
#: Samples of a series that is transformed by one task; of one row or column of a longer series' transform, at most; of a tile.
WHOLE, LONGEST, TILE = 1 << 20, 1 << 24, 1 << 20
#: Numbers that a kernel holds of a batch at a time, about.
STRETCH = 1 << 18


@functools.lru_cache(maxsize=8)
def _short_weights(n: int, centres: tuple[float, ...], rate: float) -> np.ndarray:
    return weights(np.fft.rfftfreq(n, 1 / rate), centres)


def bank(x: np.ndarray, centres: Sequence[float], rate: float) -> np.ndarray:
    """The full spectrum and every band of a block, (1 + bands, samples); of several blocks of one length with these before."""
    x = np.asarray(x, np.float64)
    n = x.shape[-1]
    w = _short_weights(n, tuple(map(float, centres)), float(rate)) if n <= STRETCH else weights(np.fft.rfftfreq(n, 1 / rate), centres)
    return np.concatenate([x[..., None, :], np.fft.irfft(np.fft.rfft(x)[..., None, :] * w, n)], axis=-2)


def blocks_of_a_length(parts: Iterator[pd.DataFrame], signals: int = 1) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of blocks and their samples as a matrix: blocks of one length together, as far as ``signals`` of each
    take some ``STRETCH`` numbers in all. So memory is that of a stretch or a block, however many blocks a batch has."""
    for pdf in parts:
        lengths = np.array([0 if x is None else len(x) for x in pdf["samples"]], np.int64)
        for n in np.unique(lengths[lengths > 0]).tolist():
            at, step = np.flatnonzero(lengths == n), max(1, STRETCH // (n * signals))
            for a in range(0, len(at), step):
                rows = pdf.iloc[at[a : a + step]]
                yield rows, np.stack([np.asarray(x, np.float64) for x in rows["samples"]])


def _types(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in names)


def _panes(centres: Sequence[float], rate: float, size: int):
    hz = np.array([0.0, *centres])

    def summarise(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, x in blocks_of_a_length(parts, len(hz)):
            b = bank(x, centres, rate)
            first = np.arange(0, b.shape[2], size)
            shape = (len(rows), len(hz), len(first))
            n = np.minimum(size, b.shape[2] - first)
            pane = (rows["start_sample"].to_numpy()[:, None, None] + first) // size
            yield pd.DataFrame(
                {k: np.repeat(rows[k].to_numpy(), shape[1] * shape[2]) for k in KEYS}
                | {
                    "band_hz": np.broadcast_to(hz[:, None], shape).ravel(), "pane": np.broadcast_to(pane, shape).ravel(), "peak": np.maximum.reduceat(np.abs(b), first, axis=2).ravel(),
                    "squares": np.add.reduceat(b * b, first, axis=2).ravel(), "sum": np.add.reduceat(b, first, axis=2).ravel(), "n": np.broadcast_to(n, shape).ravel(),
                }
            )

    return summarise


def band_panes(blocks: DataFrame, centres: Sequence[float], rate: float, pane: int) -> DataFrame:
    """Block mode: peak, sum, sum of squares and length of each pane of each band. Blocks start at multiples of ``pane``."""
    check_centres(centres)
    schema = f"{_types(blocks, KEYS)}, band_hz double, pane long, peak double, squares double, sum double, n long"
    return blocks.select(*KEYS, "start_sample", "samples").mapInPandas(_panes(tuple(centres), rate, pane), schema)


def band_rows(blocks: DataFrame, centres: Sequence[float], rate: float) -> DataFrame:
    """The bank as rows, a row for each band and sample: for short series and percentiles only."""
    hz = np.array([0.0, *centres])

    def expand(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, x in blocks_of_a_length(parts, len(hz)):
            b = bank(x, centres, rate)
            at = rows["start_sample"].to_numpy()[:, None, None] + np.arange(b.shape[2])
            yield pd.DataFrame(
                {k: np.repeat(rows[k].to_numpy(), b.shape[1] * b.shape[2]) for k in KEYS}
                | {"band_hz": np.broadcast_to(hz[:, None], b.shape).ravel(), "sample_idx": np.broadcast_to(at, b.shape).ravel(), "value": b.ravel()}
            )

    return blocks.select(*KEYS, "start_sample", "samples").mapInPandas(expand, f"{_types(blocks, KEYS)}, band_hz double, sample_idx long, value double")


def full_band_rows(rows: DataFrame, centres: Sequence[float], rate: float, whole: int = WHOLE, tile: int = TILE) -> DataFrame:
    """Full-file mode: one transform over each whole series, of any length.

    A series of more than ``whole`` samples is transformed by many tasks, see
    :func:`distributed_band_rows`; shorter ones by a task each.
    """
    hz = np.array([0.0, *check_centres(centres)])

    def expand(_, held: walk.Columns) -> walk.Columns:
        b, n = bank(held["value"], centres, rate), len(held["value"])
        return {"band_hz": np.repeat(hz, n), "sample_idx": np.tile(held["sample_idx"], len(hz)), "value": b.ravel()}

    sizes = rows.groupBy(*KEYS).agg(F.count("*").alias("n"))
    rows = rows.select(*KEYS, "sample_idx", "value")
    short = rows.join(sizes.where(F.col("n") <= whole), KEYS, "left_semi")
    long = sizes.where(F.col("n") > whole)
    return walk.by_group(short, KEYS, ["sample_idx"], expand, "band_hz double, sample_idx long, value double").unionByName(distributed_band_rows(rows, long, centres, rate, tile))


def row_length(n: int) -> int:
    """The length of a row when ``n`` samples are laid out in a matrix as near to a square as its divisors let it be."""
    columns = int(n**0.5)
    while n % columns:
        columns -= 1
    if n // columns > LONGEST:
        raise ValueError(f"{n} samples have a prime factor too large for one task; leave out the last few, or use block mode")
    return n // columns


def distributed_band_rows(rows: DataFrame, sizes: DataFrame, centres: Sequence[float], rate: float, tile: int = TILE) -> DataFrame:
    """The bands of series ``(keys, n)`` whose transform is spread over many tasks, in four steps.

    Samples are a matrix, row after row. The columns are transformed, some to
    a task, and turned by their places' angles; tiles of the result are
    shuffled, so that rows are whole, and transformed. A row then has every
    so-many-th frequency: each band's weights are applied there, and the same
    steps backwards, with another shuffle of tiles, give the band's samples.
    """
    centres = check_centres(centres)
    across = F.pandas_udf(lambda n: n.map(row_length), "long")
    shape = sizes.select(*KEYS, "n", across("n").alias("row"))
    held = rows.join(shape, KEYS).withColumn("part", F.expr(f"(sample_idx % row) div greatest(1, {tile} div (n div row))"))

    def per(length: int) -> int:
        """Rows or columns of that length in a tile."""
        return max(1, tile // length)

    def tiles(m: np.ndarray, first: int, shape: tuple[int, int], by_row: bool, step: int) -> walk.Columns:
        """A matrix cut along its other side into tiles for the tasks that go on with them."""
        cut = range(0, m.shape[0 if by_row else 1], step)
        parts = [(m[a : a + step] if by_row else m[:, a : a + step]).ravel() for a in cut]
        n = len(parts)
        return {"to": [a // step for a in cut], "first": [first] * n, "n": [shape[0]] * n, "row": [shape[1]] * n, "re": [p.real.copy() for p in parts], "im": [p.imag.copy() for p in parts]}

    def columns(key: tuple, x: walk.Columns) -> walk.Columns:
        n, row = int(x["n"][0]), int(x["row"][0])
        first = int(key[-1]) * per(n // row)
        m = x["value"].reshape(n // row, -1)  # samples in order are whole stretches of rows
        k, j = np.arange(n // row)[:, None], first + np.arange(m.shape[1])
        return tiles(np.fft.fft(m, axis=0) * np.exp(-2j * np.pi * (k * j % n) / n), first, (n, row), True, per(row))

    def bands(key: tuple, x: walk.Columns) -> walk.Columns:
        n, row = int(x["n"][0]), int(x["row"][0])
        own = min(per(row), n // row - int(key[-1]) * per(row))
        k = int(key[-1]) * per(row) + np.arange(own)
        m = np.concatenate([(a + 1j * b).reshape(own, -1) for a, b in zip(x["re"], x["im"], strict=True)], axis=1)
        at = k[:, None] + n // row * np.arange(row)
        w = weights((np.minimum(at, n - at) * (rate / n)).ravel(), centres).reshape(len(centres), own, row)
        m, turn = np.fft.fft(m, axis=1), np.exp(2j * np.pi * (k[:, None] * np.arange(row) % n) / n)
        out: list[walk.Columns] = []
        for hz, own_weights in zip(centres, w, strict=True):
            made = tiles(np.fft.ifft(m * own_weights, axis=1) * turn, int(k[0]), (n, row), False, per(n // row))
            out.append(made | {"band_hz": [float(hz)] * len(made["to"])})
        return {c: [v for o in out for v in o[c]] for c in out[0]}

    def samples(key: tuple, x: walk.Columns) -> walk.Columns:
        n, row = int(x["n"][0]), int(x["row"][0])
        wide = min(per(n // row), row - int(key[-1]) * per(n // row))
        m = np.concatenate([(a + 1j * b).reshape(-1, wide) for a, b in zip(x["re"], x["im"], strict=True)], axis=0)
        at = np.arange(n // row)[:, None] * row + int(key[-1]) * per(n // row) + np.arange(wide)
        return {"sample_idx": at.ravel(), "value": np.fft.ifft(m, axis=0).real.ravel()}

    tile_columns = "to long, first long, n long, row long, re array<double>, im array<double>"
    step = walk.by_group(held, [*KEYS, "part"], ["sample_idx"], columns, tile_columns, KEYS)
    turned = walk.by_group(step.withColumnRenamed("to", "part"), [*KEYS, "part"], ["first"], bands, tile_columns + ", band_hz double", KEYS)
    made = walk.by_group(turned.withColumnRenamed("to", "part"), [*KEYS, "band_hz", "part"], ["first"], samples, "sample_idx long, value double", [*KEYS, "band_hz"])
    source = rows.join(sizes.select(*KEYS), KEYS, "left_semi").withColumn("band_hz", F.lit(0.0))
    return made.unionByName(source.select(*made.columns))


def band_power(blocks: DataFrame, centres: Sequence[float], rate: float) -> DataFrame:
    """Band RMS without an inverse transform: ``(keys, block_idx, band_hz, power)`` by Parseval's theorem."""
    hz = np.array([0.0, *check_centres(centres)])

    def power(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                x = np.asarray(row.samples, np.float64)
                n = len(x)
                s = np.abs(np.fft.rfft(x)) ** 2
                s[1 : (n + 1) // 2] *= 2  # bins that stand for two
                w = np.vstack([np.ones(len(s)), weights(np.fft.rfftfreq(n, 1 / rate), centres) ** 2])
                yield pd.DataFrame({k: getattr(row, k) for k in KEYS} | {"block_idx": row.block_idx, "band_hz": hz, "power": w @ s / n**2, "n": n})

    return blocks.select(*KEYS, "block_idx", "samples").mapInPandas(power, f"{_types(blocks, KEYS)}, block_idx long, band_hz double, power double, n long")


def band_levels(panes: DataFrame, keys=(*KEYS, "band_hz")) -> DataFrame:
    """Peak, RMS and crest factor of each band over all of its panes."""
    s = panes.groupBy(*keys).agg(F.max("peak").alias("peak"), F.sqrt(F.sum("squares") / F.sum("n")).alias("rms"), (F.sum("sum") / F.sum("n")).alias("mean"))
    return s.select("*", dbfs(F.col("peak"), 1.0, None).alias("max_amplitude_db"), dbfs(F.col("rms"), 1.0, None).alias("rms_db"), crest_db(F.col("peak"), F.col("rms")).alias("crest_factor_db"))


def active_bands(levels: DataFrame, share: float = 1e-6, keys=KEYS) -> DataFrame:
    """Bands whose RMS is above a share of that of the full spectrum."""
    full = F.max(F.when(F.col("band_hz") == 0, F.col("rms"))).over(Window.partitionBy(*keys))
    return levels.withColumn("full_rms", full).where("rms > full_rms * " + repr(share))


def energy_closure(power: DataFrame, keys=KEYS) -> DataFrame:
    """The bands' summed power against that of the source, and the loudest band."""
    p = F.col("power")
    s = power.groupBy(*keys).agg(
        F.sum(F.when(F.col("band_hz") == 0, p)).alias("full_power"), F.sum(F.when(F.col("band_hz") > 0, p)).alias("band_power"),
        F.max_by(F.when(F.col("band_hz") > 0, F.col("band_hz")), F.when(F.col("band_hz") > 0, F.struct("power", -F.col("band_hz")))).alias("loudest_band_hz"),
    )
    ratio = F.try_divide("band_power", "full_power")
    return s.select(*keys, F.sqrt("full_power").alias("full_rms"), F.sqrt("band_power").alias("band_power_sum_rms"), (10 * F.log10(ratio)).alias("closure_error_db"), (100 * ratio).alias("captured_power_percent"), "loudest_band_hz")


def closure_with_waveform(blocks: DataFrame, centres: Sequence[float], rate: float) -> DataFrame:
    """:func:`energy_closure`, with the error that the plain sum of the bands' waveforms has against the source."""
    closure = energy_closure(band_power(blocks, centres, rate))
    direct = synthesis_error(blocks, centres, rate).select(*KEYS, F.col("direct_error_db").alias("waveform_sum_error_db"))
    return closure.join(direct, KEYS)


def compare_modes(one: DataFrame, other: DataFrame, keys=KEYS) -> DataFrame:
    """Largest and mean difference in dB between two frames of (keys, band_hz, rms) on active bands."""
    a = active_bands(one).where("band_hz > 0").select(*keys, "band_hz", F.col("rms").alias("a"))
    b = other.select(*keys, "band_hz", F.col("rms").alias("b"))
    d = F.abs(20 * F.log10(F.col("b") / F.col("a")))
    return a.join(b, [*keys, "band_hz"]).groupBy(*keys).agg(F.max(d).alias("max_band_rms_delta_db"), F.avg(d).alias("mean_abs_band_rms_delta_db"))


def against_source(levels: DataFrame, keys=KEYS) -> DataFrame:
    """Peak and crest factor of each band relative to the source, its share of the power, and whether it peaks above."""
    by = Window.partitionBy(*keys)
    source = lambda c: F.max(F.when(F.col("band_hz") == 0, F.col(c))).over(by)
    s = levels.select(*keys, "band_hz", "peak", "rms", "crest_factor_db", source("peak").alias("sp"), source("rms").alias("sr"), source("crest_factor_db").alias("sc"))
    return s.where("band_hz > 0").select(
        *keys, "band_hz", (20 * F.log10(F.col("peak") / F.col("sp"))).alias("band_peak_minus_source_peak_db"), F.pow(F.try_divide("rms", "sr"), 2).alias("band_power_fraction"),
        (F.col("crest_factor_db") - F.col("sc")).alias("crest_factor_expansion_db"), (F.col("peak") > F.col("sp")).alias("exceeds_source_peak"),
        (20 * F.log10(F.try_divide("rms", "sr"))).alias("band_rms_db_relative_to_source"),
    )


def synthesis_error(blocks: DataFrame, centres: Sequence[float], rate: float) -> DataFrame:
    """RMS error, relative to the source in dB, of re-weighting the bands and adding them, and of adding them as they are."""

    def errors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                b = bank(row.samples, centres, rate)
                w = weights(np.fft.rfftfreq(b.shape[1], 1 / rate), centres)
                again = np.fft.irfft((np.fft.rfft(b[1:]) * w).sum(0), b.shape[1])
                d, e = again - b[0], b[1:].sum(0) - b[0]
                yield pd.DataFrame({k: [getattr(row, k)] for k in KEYS} | {"s": [float(b[0] @ b[0])], "d": [float(d @ d)], "e": [float(e @ e)]})

    rows = blocks.select(*KEYS, "samples").mapInPandas(errors, f"{_types(blocks, KEYS)}, s double, d double, e double")
    db = lambda c: F.coalesce(10 * F.log10(F.try_divide(F.sum(c), F.sum("s"))), F.lit(-400.0))
    return rows.groupBy(*KEYS).agg(db("d").alias("weighted_error_db"), db("e").alias("direct_error_db"))


def series_validity(panes: DataFrame, keys=KEYS) -> DataFrame:
    """Are all bands finite and equally long; how many windows, and the least and largest crest factor of a window."""
    full = F.max("n").over(Window.partitionBy(*keys))
    p = panes.withColumn("full", full).withColumn("rms", F.sqrt(F.col("squares") / F.col("n")))
    per_band = p.groupBy(*keys, "band_hz").agg(
        F.sum("n").alias("samples"), F.count_if(F.col("n") == F.col("full")).alias("windows"), F.count_if(F.isnan("squares") | (F.col("squares") == float("inf"))).alias("bad"),
        F.min(F.when(F.col("n") == F.col("full"), crest_db(F.col("peak"), F.col("rms")))).alias("lo"), F.max(F.when(F.col("n") == F.col("full"), crest_db(F.col("peak"), F.col("rms")))).alias("hi"),
    )
    return per_band.groupBy(*keys).agg(
        F.max("samples").alias("num_samples"), (F.count("*") - 1).alias("num_bands"), (F.min("samples") == F.max("samples")).alias("same_length"), (F.sum("bad") == 0).alias("all_finite"),
        F.max("windows").alias("crest_factor_windows"), F.min(F.when(F.col("band_hz") > 0, F.col("lo"))).alias("min_band_crest_factor_db"), F.max(F.when(F.col("band_hz") > 0, F.col("hi"))).alias("max_band_crest_factor_db"),
    )


def band_edges(freqs: DataFrame, centres: Sequence[float]) -> DataFrame:
    """For ``(freq)``: the two strongest bands, their power shares and the sum over all bands."""
    b = freqs.crossJoin(F.broadcast(bands_frame(freqs.sparkSession, centres)))  # a fixed list of bands
    p = b.select("freq", "band_hz", F.pow(weight(F.col("freq"), F.col("band_hz"), F.col("lower_hz"), F.col("upper_hz")), 2).alias("p"))
    top = F.sort_array(F.collect_list(F.struct("p", (-F.col("band_hz")).alias("b"))), asc=False)
    s = p.groupBy("freq").agg(top.alias("t"), F.sum("p").alias("power_sum"))
    return s.select("freq", (-F.col("t")[0]["b"]).alias("primary_band"), F.col("t")[0]["p"].alias("primary_power"), (-F.col("t")[1]["b"]).alias("secondary_band"), F.col("t")[1]["p"].alias("secondary_power"), "power_sum")


def band_acceptance(spark: SparkSession, centres: Sequence[float], rate: float) -> DataFrame:
    """``(test_type, freq, lower_band, upper_band, ..., passed)``: do bands stand where they should?

    At its ``center`` a band has all power; at the ``crossover`` of two
    neighbours, the geometric mean of their centres, each has half of it and
    no other band any. Frequencies from half the rate on are left out.
    """
    bands = bands_frame(spark, centres)
    center = bands.select(F.lit("center").alias("test_type"), F.col("band_hz").alias("freq"), F.col("band_hz").alias("_a"), F.col("band_hz").alias("_b"))
    cross = bands.where("upper_hz is not null").select(F.lit("crossover").alias("test_type"), F.sqrt(F.col("band_hz") * F.col("upper_hz")).alias("freq"), F.col("band_hz").alias("_a"), F.col("upper_hz").alias("_b"))
    tests = center.unionByName(cross).where(F.col("freq") < rate / 2)
    found = tests.join(band_edges(tests.select("freq").distinct(), centres), "freq")
    single = F.col("test_type") == "center"
    half = lambda p: F.abs(F.col(p) - 0.5) <= 5e-6
    pair = (F.least("primary_band", "secondary_band") == F.col("_a")) & (F.greatest("primary_band", "secondary_band") == F.col("_b"))
    top = F.when(single, F.col("primary_power")).otherwise(F.col("primary_power") + F.col("secondary_power"))
    passed = F.when(single, (F.col("primary_band") == F.col("_a")) & (F.col("primary_power") >= 0.999999)).otherwise(pair & half("primary_power") & half("secondary_power") & (F.abs(top - 1) <= 1e-5))
    return found.select(
        "test_type", "freq", F.when(single, F.col("primary_band")).otherwise(F.least("primary_band", "secondary_band")).alias("lower_band"),
        F.when(single, F.col("primary_band")).otherwise(F.greatest("primary_band", "secondary_band")).alias("upper_band"),
        (100 * F.col("primary_power")).alias("primary_power_percent"), (100 * top).alias("top_power_percent"), (100 * F.col("power_sum")).alias("power_sum_percent"), passed.alias("passed"),
    )


def phase_acceptance(freqs: DataFrame, centres: Sequence[float], active: float = 1e-12) -> DataFrame:
    """For each band over the given ``(freq)``: how many of them it lets through, its least and largest weight there,
    and whether it turns any phase: weights are real, so only a negative one would, by half a turn."""
    b = freqs.crossJoin(F.broadcast(bands_frame(freqs.sparkSession, centres)))  # a fixed list of bands
    w = b.select("band_hz", weight(F.col("freq"), F.col("band_hz"), F.col("lower_hz"), F.col("upper_hz")).alias("w"))
    on = F.when(F.abs("w") > active, F.col("w"))
    s = w.groupBy("band_hz").agg(F.count(on).alias("active_bins"), F.min(on).alias("min_active_weight"), F.max(on).alias("max_active_weight"), F.count_if(F.col("w") < 0).alias("negative_weights"), F.max(F.when(on < 0, 180.0).otherwise(0.0)).alias("max_phase_shift_degrees"))
    return s.withColumn("passed", (F.col("negative_weights") == 0) & (F.col("max_phase_shift_degrees") == 0))


def target_power(power: DataFrame, targets: Sequence[float], keys=KEYS) -> DataFrame:
    """Share of the bands' power inside a set of target bands, and the loudest of these."""
    inside = F.col("band_hz").isin([float(t) for t in targets])
    s = power.where("band_hz > 0").groupBy(*keys).agg(
        F.sum(F.when(inside, F.col("power"))).alias("a"), F.sum("power").alias("b"), F.max_by("band_hz", F.when(inside, F.struct("power", -F.col("band_hz")))).alias("loudest_target_hz")
    )
    return s.select(*keys, "loudest_target_hz", (100 * F.coalesce(F.try_divide("a", "b"), F.lit(0.0))).alias("target_power_percent"))


def rank_low_frequency(power: DataFrame, low: Column, keys=KEYS) -> DataFrame:
    """Which channel of a track has the largest share of its power in low bands: the likely LFE."""
    r = power.where("band_hz > 0").groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.when(low, F.col("power"))), F.sum("power")), F.lit(0.0)).alias("low_ratio"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("low_ratio"), "channel_index")))
