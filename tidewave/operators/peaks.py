"""Peaks of an envelope: detection, and attack, hold, decay and recovery times around them.

All of it is done block by block. What a block can't say by itself, because
its first or last runs of equal levels, or its first or last islands of peaks,
may go on in the next block, are a few rows a block, which alone are put
together along the series.

Levels come as rows ``(keys, sample_idx, db)`` or, with no row a sample, as
blocks ``(keys, start_sample, levels)`` of any length. A block that is marked
as the ``whole`` of its series, in a column of that name, has nothing to be put
together, so its peaks are found where it is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import walk
from .extrema import Many
from .quantiles import percentiles, percentiles_of_short

KEYS = ("track_id", "channel_index")
#: Samples of a block, at least; a block's task sees what lies around it, too.
BLOCK = 1 << 16
#: The cases that are examined in full, at least.
LEAST_CASES = 3


def _runs(idx: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last sample, and level, of each run of equal levels."""
    start = np.flatnonzero(np.concatenate([[True], db[1:] != db[:-1]]))
    return idx[start], idx[np.append(start[1:], len(db)) - 1], db[start]


def _samples(rows: walk.Columns) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and levels of the samples of rows, or of blocks in order."""
    if "levels" not in rows:
        return rows["sample_idx"], rows["db"]
    blocks = list(zip(rows["start_sample"].tolist(), rows["levels"], strict=True))
    if not blocks:
        return np.empty(0, np.int64), np.empty(0)
    return np.concatenate([np.arange(a, a + len(x)) for a, x in blocks]).astype(np.int64), np.concatenate([x for _, x in blocks])


def in_blocks(levels: DataFrame) -> bool:
    return "levels" in levels.columns


def _flat(start: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and levels of all samples of many blocks, and the lengths of these."""
    n = walk.lengths_of(levels)
    held = [x for x, k in zip(levels, n.tolist(), strict=True) if k]
    first = np.cumsum(n) - n
    return np.arange(n.sum()) + np.repeat(start - first, n), np.concatenate(held) if held else np.empty(0), n


def _lone(rows: DataFrame, keys: list[str], least: float, distance: int) -> DataFrame:
    """The peaks of series of one block: of many series at once, and no row is shuffled."""

    def search(held: walk.Columns) -> tuple[np.ndarray, walk.Columns]:
        idx, db, n = _flat(held["start_sample"], held["levels"])
        own = np.repeat(np.arange(len(n)), n)
        start = np.flatnonzero(np.concatenate([[True], (db[1:] != db[:-1]) | (own[1:] != own[:-1])])) if len(db) else np.empty(0, np.int64)
        end = np.append(start[1:], len(db)) - 1 if len(start) else start
        v, row = db[start], own[start]
        k = np.arange(1, max(len(v) - 1, 1))
        k = k[(row[k - 1] == row[k]) & (row[k] == row[k + 1])] if len(v) > 2 else k[:0]
        k = k[(v[k] > v[k - 1]) & (v[k] > v[k + 1]) & (v[k] >= least)]
        at, row, v = (idx[start[k]] + idx[end[k]]) // 2, row[k], v[k]
        if distance > 1:
            apart = at - held["start_sample"][row] + row * (n.max(initial=0) + distance)
            stays = suppress(apart, v, distance)
            at, row, v = at[stays], row[stays], v[stays]
        return row, {"peak_idx": at, "peak_db": v}

    return walk.by_rows(rows.select(*keys, "start_sample", "levels"), keys, search, "peak_idx long, peak_db double", "levels")


def local_maxima(rows: DataFrame, keys=KEYS, height: float | None = None, block: int = BLOCK) -> DataFrame:
    """Strict local maxima of levels; a plateau counts once, at its middle.

    The ends of a series are no maxima. Blocks are searched by themselves;
    the three runs of equal values at either of a block's ends are put
    together along the series.
    """
    keys = list(keys)
    least = -np.inf if height is None else height
    if "whole" in rows.columns:
        return _lone(rows.where("whole"), keys, least, 1).unionByName(local_maxima(rows.where("not whole").drop("whole"), keys, height, block))

    def search(_, rows: walk.Columns) -> walk.Columns:
        a, b, v = _runs(*_samples(rows))
        inner = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]) & (v[1:-1] >= least)) + 1
        # the first and last runs may go on in the next block, and the second ones are judged beside them
        inner = inner[(inner > 1) & (inner < len(v) - 2)] if len(v) > 6 else inner[:0]
        edge = np.concatenate([np.arange(3), np.arange(len(v) - 3, len(v))]) if len(v) > 6 else np.arange(len(v))
        at = np.concatenate([inner, edge])
        gap = np.zeros(len(at), bool)
        if len(v) > 6:  # what comes before the last three is not here
            gap[-3] = True
        return {"inner": np.arange(len(at)) < len(inner), "gap": gap, "a": a[at], "b": b[at], "db": v[at]}

    def settle(_, rows: walk.Columns) -> walk.Columns:
        runs: list[list] = []
        for a, b, v, gap in zip(rows["a"].tolist(), rows["b"].tolist(), rows["db"].tolist(), rows["gap"].tolist(), strict=True):
            if gap:
                runs.append([a, a, None])
            if runs and runs[-1][2] == v:
                runs[-1][1] = b
            else:
                runs.append([a, b, v])
        found = [(x[0], x[1], x[2]) for w, x, y in zip(runs, runs[1:], runs[2:], strict=False) if None not in (w[2], x[2], y[2]) and w[2] < x[2] > y[2] and x[2] >= least]
        return {"peak_idx": [(a + b) // 2 for a, b, _ in found], "peak_db": [v for *_, v in found]}

    columns = "inner boolean, gap boolean, a long, b long, db double"
    if in_blocks(rows):
        runs = walk.by_row(rows.select(*keys, "start_sample", "levels").where(F.size("levels") > 0), keys, search, columns)
    else:
        blocks = rows.select(*keys, F.expr(f"sample_idx div {block}").alias("_block"), "sample_idx", "db")
        runs = walk.by_group(blocks, [*keys, "_block"], ["sample_idx"], search, columns, keys)
    inner = runs.where("inner").select(*keys, F.expr("(a + b) div 2").alias("peak_idx"), F.col("db").alias("peak_db"))
    return inner.unionByName(walk.by_group(runs.where("not inner"), keys, ["a"], settle, "peak_idx long, peak_db double"))


#: Neighbours and rounds up to which peaks are suppressed all together.
NEIGHBOURS, ROUNDS = 32, 64


def suppress(idx: np.ndarray, db: np.ndarray, distance: int) -> np.ndarray:
    """Which peaks stay when the highest remove all nearer than ``distance``; of equal ones the later is first.

    In a round all peaks that are higher than their neighbours stay, and these go. What many neighbours or rounds
    leave open is done peak by peak.
    """
    keep, place = np.zeros(len(idx), bool), np.empty(len(idx), np.int64)
    order = np.lexsort((-idx, -db))
    place[order] = np.arange(len(idx))
    left = np.arange(len(idx))
    for _ in range(ROUNDS):
        at, rank, pairs = idx[left], place[left], []
        for k in range(1, len(left)):
            near = np.flatnonzero(at[k:] - at[:-k] < distance)
            if not len(near) or k > NEIGHBOURS:
                break
            pairs.append((near, near + k))
        else:
            near = left[:0]
        if len(near):
            break
        stays, goes = np.ones(len(left), bool), np.zeros(len(left), bool)
        for a, b in pairs:
            over = rank[b] < rank[a]
            stays[np.where(over, a, b)] = False
        for a, b in pairs:
            goes[a[stays[b]]] = goes[b[stays[a]]] = True
        keep[left[stays]] = True
        left = left[~stays & ~goes]
        if not len(left):
            return keep
    at, open_ = idx[left], np.ones(len(left), bool)
    for i in np.argsort(place[left]):
        if open_[i]:
            a, b = np.searchsorted(at, [at[i] - distance + 1, at[i] + distance])
            open_[a:b] = False
            keep[left[i]] = True
    return keep


def find_peaks(rows: DataFrame, height: float, distance: int, keys=KEYS, block: int = BLOCK) -> DataFrame:
    """``(keys, peak_idx, peak_db)``: maxima of a height, no two nearer than ``distance``.

    Where the gap between neighbouring maxima is ``distance`` at least, what
    lies on either side is independent. A block suppresses the islands that
    lie inside of it; those that its neighbours may add to, because they come
    within ``distance`` of its ends, are suppressed along the series.
    """
    keys = list(keys)
    if "whole" in rows.columns:
        return _lone(rows.where("whole"), keys, height, distance).unionByName(find_peaks(rows.where("not whole").drop("whole"), height, distance, keys, block))
    found = local_maxima(rows, keys, height, block)
    if distance <= 1:
        return found

    def islands(key: tuple, rows: walk.Columns) -> walk.Columns:
        at, db = rows["peak_idx"], rows["peak_db"]
        start, end = key[-1] * block, (key[-1] + 1) * block
        cut = np.flatnonzero(np.diff(at) >= distance) + 1
        a = cut[0] if len(cut) else len(at)  # the first island, and the last
        z = cut[-1] if len(cut) else 0
        a = a if start and at[0] - start + 1 < distance else 0
        z = z if end - at[-1] < distance else len(at)
        edge = (np.arange(len(at)) < a) | (np.arange(len(at)) >= z)
        stays = suppress(at, db, distance) | edge
        return {"edge": edge[stays], "peak_idx": at[stays], "peak_db": db[stays]}

    def greedy(_, rows: walk.Columns) -> walk.Columns:
        stays = suppress(rows["peak_idx"], rows["peak_db"], distance)
        return {"peak_idx": rows["peak_idx"][stays], "peak_db": rows["peak_db"][stays]}

    blocks = found.select(*keys, F.expr(f"peak_idx div {block}").alias("_block"), "peak_idx", "peak_db")
    held = walk.by_group(blocks, [*keys, "_block"], ["peak_idx"], islands, "edge boolean, peak_idx long, peak_db double", keys)
    edges = walk.by_group(held.where("edge").drop("edge"), keys, ["peak_idx"], greedy, "peak_idx long, peak_db double")
    return held.where("not edge").drop("edge").unionByName(edges)


def around(peaks: DataFrame, rows: DataFrame, back: int, ahead: int, measure, columns: str, keys=KEYS, few: bool = False, carried: Sequence[str] = ()) -> DataFrame:
    """``measure(levels, peak_idx, peak_db, ...)`` of all peaks; ``levels`` has the samples up to ``back`` before and ``ahead`` after each.

    A block's task has the block's peaks, and the samples of the block and of
    what lies around it: a sample is in few blocks, however many peaks are
    near it, and is looked at through :class:`Many`. ``measure`` takes the
    peaks of many blocks at once, with their doubles named ``carried``, which
    are also in the result. It gives ``columns``, with a value for each peak
    or for those that it keeps, and which it keeps, None for all. ``few``:
    most blocks have no peak, so the samples of long series are left where
    they are.
    """
    keys, carried = list(keys), list(carried)
    size = max(BLOCK, back + ahead)
    names = [c.split()[0] for c in columns.split(", ")]
    held = peaks.select(*(F.col(k).alias(k) for k in keys), F.expr(f"peak_idx div {size}").alias("_block"), F.lit(True).alias("_peak"), F.col("peak_idx").alias("idx"), F.col("peak_db").alias("db"), *carried)
    blocks = in_blocks(rows)
    first = F.col("start_sample" if blocks else "sample_idx")
    last = first + F.size("levels") - 1 if blocks else first
    near = F.explode(F.sequence(F.floor(F.greatest(first - ahead, F.lit(0)) / size), F.floor((last + back) / size))).alias("_block")

    def dealt(rows: DataFrame) -> DataFrame:
        return (rows.where(F.size("levels") > 0) if blocks else rows).select(*keys, near, F.lit(False).alias("_peak"), first.alias("idx"), "levels" if blocks else "db")

    if not few:
        samples = dealt(rows)
    else:
        asked, lone = held.select(*keys, "_block").distinct(), "whole" in rows.columns
        samples = dealt(rows.where("not whole") if lone else rows).join(asked, [*keys, "_block"], "left_semi")
        if lone:
            samples = samples.unionByName(dealt(rows.where("whole")))

    def look(held: walk.Columns, cuts: np.ndarray) -> tuple[np.ndarray, walk.Columns]:
        peak = held["_peak"].astype(bool)
        row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        if blocks:
            idx, db, n = _flat(held["idx"][~peak], held["levels"][~peak])
        else:
            idx, db = held["idx"][~peak], held["db"][~peak]
            n = np.ones(len(idx), np.int64)
        size = np.zeros(len(cuts) - 1, np.int64)
        np.add.at(size, row[~peak], n)
        own, i, v = row[peak], held["idx"][peak], held["db"][peak]
        if not len(own):
            return own, {}
        more = [held[c][peak] for c in carried]
        found, keeps = measure(Many(idx, db, np.concatenate([[0], np.cumsum(size)]), own), i, v, *more)
        keeps = np.ones(len(own), bool) if keeps is None else keeps
        return own[keeps], {"peak_idx": i[keeps], "peak_db": v[keeps]} | {c: x[keeps] for c, x in zip(carried, more, strict=True)} | dict(zip(names, found, strict=True))

    both = samples.unionByName(held, allowMissingColumns=True)
    schema = "".join(f"{c} double, " for c in carried)
    return walk.by_stretch(both, [*keys, "_block"], ["_peak", "idx"], look, f"peak_idx long, peak_db double, {schema}{columns}", keys, "levels" if blocks else None)


def _attack(x: Many, i: np.ndarray, v: np.ndarray, rate: float, threshold: float, back: int) -> np.ndarray:
    low, there = x.last(i - back, i + 1, v - threshold, "below")
    return np.maximum((i - np.where(there, low + 1, np.maximum(i - back, 0))) / rate * 1000, 0.0)


def _hold(x: Many, i: np.ndarray, v: np.ndarray, rate: float, threshold: float, n: int) -> np.ndarray:
    """NaN, and so null, where no sample is that high."""
    first, there = x.first(i - n, i + n, v - threshold, "at least")
    last, _ = x.last(i - n, i + n, v - threshold, "at least")
    return np.where(there, (last - first) / rate * 1000, np.nan)


def _cap(x: Many, i: np.ndarray, n: int) -> np.ndarray:
    """Where searches of ``n`` samples end: with them, or with the series."""
    a, b = x.between(i, i + n)
    return np.where(b > a, x.idx[np.maximum(b - 1, 0)] + 1, i) if len(x.idx) else i


def _decay(x: Many, i: np.ndarray, v: np.ndarray, rate: float, thresholds: Sequence[float], n: int, relative: bool = True) -> list[np.ndarray]:
    """Times to each threshold, and whether it is reached; a search ends with the series, or after ``n`` samples."""
    out, cap = [], _cap(x, i, n)
    for t in thresholds:
        end, there = x.first(i, i + n, v + t if relative else np.full(len(i), float(t)), "at most")
        out += [(np.where(there, end, cap) - i) / rate * 1000, there]
    return out


def attack_times(peaks: DataFrame, rows: DataFrame, rate: float, threshold: float = 20.0, seconds: float = 10.0, keys=KEYS) -> DataFrame:
    """Milliseconds from the last sample more than ``threshold`` dB under the peak, looking back, to the peak."""
    back = int(seconds * rate)
    return around(peaks, rows, back, 0, lambda x, i, v: ([_attack(x, i, v, rate, threshold, back)], None), "attack_time_ms double", keys)


def hold_times(peaks: DataFrame, rows: DataFrame, rate: float, threshold: float = 1.0, seconds: float = 5.0, keys=KEYS) -> DataFrame:
    """Milliseconds between the first and the last sample around the peak within ``threshold`` dB of it."""
    n = int(seconds * rate)
    found = around(peaks, rows, n, n - 1, lambda x, i, v: ([_hold(x, i, v, rate, threshold, n)], None), "peak_hold_time_ms double", keys)
    return found.drop("peak_db").where("peak_hold_time_ms is not null")


def decay_times(peaks: DataFrame, rows: DataFrame, rate: float, thresholds: Sequence[float] = (-3, -6, -9, -12), seconds: float = 30.0, keys=KEYS, relative: bool = True) -> DataFrame:
    """Milliseconds until the envelope is at or under each threshold, capped at the end of the search."""
    n = int(seconds * rate)
    columns = ", ".join(f"decay_{abs(int(t))}db_ms double, decay_{abs(int(t))}db_reached boolean" for t in thresholds)
    return around(peaks, rows, 0, n - 1, lambda x, i, v: (_decay(x, i, v, rate, thresholds, n, relative), None), columns, keys)


def sustained_events(peaks: DataFrame, rows: DataFrame, rate: float, least_db: float = -3.0, thresholds: Sequence[float] = (-3, -6, -9, -12), seconds: float = 5.0, keys=KEYS, relative: bool = True) -> DataFrame:
    """Of peaks of ``least_db`` or more: how long the level holds within 1 dB, and the recovery times."""
    n = int(seconds * rate)

    def measure(x: Many, i: np.ndarray, v: np.ndarray) -> tuple[list, None]:
        end, there = x.first(i, i + n, v - 1.0, "below")
        return [*_decay(x, i, v, rate, thresholds, n, relative)[::2], (np.where(there, end, _cap(x, i, n)) - i) / rate * 1000], None

    columns = ", ".join(f"t{abs(int(t))}_ms double" for t in thresholds) + ", hold_ms double"
    found = around(peaks.where(F.col("peak_db") >= least_db), rows, 0, n - 1, measure, columns, keys)
    return found.withColumn("peak_time_seconds", F.col("peak_idx") / rate)


def sustained_summary(events: DataFrame, series: DataFrame, names: Sequence[str] = ("hold_ms", "t3_ms", "t6_ms", "t9_ms", "t12_ms"), keys=KEYS, stored: bool = False) -> DataFrame:
    """Number, mean, median, p90, p95 and maximum of each time, for all of ``series``; zeros where there is no event.

    ``stored`` events are read twice more, which tells series of few events from others; to make them anew would cost
    more than it saves.
    """
    q = (percentiles_of_short if stored else percentiles)(events, keys, {f"_{c}": F.col(c) for c in names}, [0.5, 0.9, 0.95])
    plain = events.groupBy(*keys).agg(F.count("*").alias("n_peaks"), *(f.alias(f"{c}_{n}") for c in names for n, f in (("mean", F.avg(c)), ("max", F.max(c)))))
    at = [F.col(f"_{c}")[k].alias(f"{c}_{n}") for c in names for k, n in enumerate(("median", "p90", "p95"))]
    s = plain.join(q, list(keys), "left").select(*plain.columns, *at)
    s = s.select(*keys, "n_peaks", *(f"{c}_{n}" for c in names for n in ("mean", "median", "p90", "p95", "max")))
    return series.select(*keys).distinct().join(s, list(keys), "left").na.fill(0, [c for c in s.columns if c not in keys])


def worst_case(
    peaks: DataFrame, rows: DataFrame, rate: float, top: int = 5, exclude: DataFrame | None = None, sort_by: str = "peak_value", attack: float = 20.0, hold: float = 1.0, keys=KEYS,
    window: int | dict[float, int] | None = None,
) -> DataFrame:
    """The ``top`` peaks, and ``LEAST_CASES`` at least, that are not among those of ``exclude``, with their attack, hold and decay times.

    ``sort_by``: ``peak_value``, also for ``energy``; ``decay_time`` ranks by
    the time to 12 dB under the peak. With a ``window``, as for
    :func:`windows_around`, the result has that of each peak, or null.
    """
    keys = list(keys)
    peaks = peaks.select(*keys, "peak_idx", "peak_db")
    if exclude is not None:
        peaks = peaks.join(exclude.select(*keys, "peak_idx").distinct(), [*keys, "peak_idx"], "left_anti")
    order = [F.desc("peak_db"), F.asc("peak_idx")]
    if sort_by == "decay_time":
        peaks = decay_times(peaks, rows, rate, (-12,), 30.0, keys).select(*keys, "peak_idx", "peak_db", "decay_12db_ms")
        order = [F.desc("decay_12db_ms"), *order]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = peaks.withColumn("rank", place).where(F.col("rank") <= max(top, LEAST_CASES)).select(*keys, "rank", "peak_idx", "peak_db")
    thresholds, back, five, thirty = (-3, -6, -9, -12), int(10.0 * rate), int(5.0 * rate), int(30.0 * rate)

    def measure(x: Many, i: np.ndarray, v: np.ndarray, _: np.ndarray, *size: np.ndarray) -> tuple[list, None]:
        times = [_attack(x, i, v, rate, attack, back), _hold(x, i, v, rate, hold, five), *_decay(x, i, v, rate, thresholds, thirty)]
        if not size:
            return times, None
        start, cut, enough = _cut(x, i, *size)
        return [*times, np.where(enough, start, np.nan), walk.Lists(cut.flat, cut.lengths, enough)], None

    columns = "attack_time_ms double, peak_hold_time_ms double, " + ", ".join(f"decay_{-t}db_ms double, decay_{-t}db_reached boolean" for t in thresholds)
    ranked = ranked.dropna(subset=keys).withColumn("_rank", F.col("rank").cast("double"))
    half, more, carried = 0, [], ["_rank"]
    if window is not None:
        size, half = _sizes(window)
        ranked, columns, more, carried = ranked.withColumn("_size", size), columns + ", start_idx long, window array<double>", ["start_idx", "window"], ["_rank", "_size"]
    found = around(ranked, rows, max(back, five, half), max(thirty, half) - 1, measure, columns, keys, few=True, carried=carried)
    times = [c for c in found.columns if c not in (*keys, "peak_idx", "peak_db", *carried, *more)]
    return found.select(*keys, "peak_idx", F.col("_rank").cast("int").alias("rank"), "peak_db", *times, (F.col("peak_idx") / rate).alias("peak_time_seconds"), *more)


def _sizes(window: int | dict[float, int]) -> tuple[Column, int]:
    """The length of each peak's window as a double, by its ``band_hz`` for a dict, and half of the longest."""
    if isinstance(window, dict):
        return F.try_element_at(F.create_map(*(F.lit(v) for k in window.items() for v in k)), "band_hz").cast("double"), max(window.values()) // 2
    return F.lit(float(window)), window // 2


def _cut(x: Many, i: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, walk.Lists, np.ndarray]:
    """First samples and levels of windows, and whether they have half of their samples; the levels only of those."""
    if np.isnan(size).any():
        raise ValueError("a band has no length of windows")
    half = size.astype(np.int64) // 2
    a, b = x.between(i - half, i + half)
    enough = b - a >= np.maximum(1, half)
    n = np.where(enough, b - a, 0)
    flat = x.db[np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)]
    return x.idx[np.minimum(a, len(x.idx) - 1)] if len(x.idx) else i, walk.Lists(flat, n), enough


def windows_around(peaks: DataFrame, rows: DataFrame, window: int | dict[float, int], keys=KEYS, few: bool = False) -> DataFrame:
    """``start_idx`` and ``window``: the levels from half a window before each peak to half a window after it, clipped
    at the ends of the series; peaks with less than half of the samples go. A dict has the lengths of bands, by ``band_hz``."""
    size, half = _sizes(window)

    def cut(x: Many, i: np.ndarray, _: np.ndarray, size: np.ndarray) -> tuple[list, np.ndarray]:
        start, held, enough = _cut(x, i, size)
        return [start[enough], walk.Lists(held.flat, held.lengths[enough])], enough

    asked = peaks.select(*keys, "peak_idx", "peak_db", size.alias("_size"))
    return around(asked, rows, half, half - 1, cut, "start_idx long, window array<double>", keys, few, ["_size"]).drop("_size")


#: A pattern's window is no longer than this.
LONGEST_MS = 500.0


def window_ms(band_hz: float, wavelengths: float, fallback_ms: float, cap_ms: float = LONGEST_MS) -> float:
    """:func:`window_length_ms` of one band."""
    return min(wavelengths / band_hz * 1000, cap_ms) if band_hz > 0 else 2 * fallback_ms


def window_length_ms(band_hz: Column, wavelengths: float, fallback_ms: float, cap_ms: float = LONGEST_MS) -> Column:
    """Length of a pattern window: wavelengths of the band up to a cap, twice the fallback for the full spectrum."""
    return F.when(band_hz > 0, F.least(wavelengths / band_hz * 1000, F.lit(cap_ms))).otherwise(F.lit(2 * fallback_ms))
