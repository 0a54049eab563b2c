"""Repeating patterns: windows around peaks, their correlations, groups and intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import walk

KEYS = ("track_id", "channel_index")
#: Peaks of a series that take part, the highest first: a limit of the operator itself.
MOST_PEAKS = 500
#: Windows of a series up to which it is compared and grouped with others at once, bit by bit; numbers that are held for that, about.
FEW, STRETCH = 32, 1 << 20


def let(x: Column, f) -> Column:
    """``f`` of a value that is computed once: higher-order functions share no common subexpressions."""
    return F.transform(F.array(x), f)[0]


def normalised(window: Column) -> Column:
    """A window scaled from 0 to 1; zeros where it is constant."""
    bounds = F.struct(window.alias("w"), F.array_min(window).alias("lo"), F.array_max(window).alias("hi"))
    return let(bounds, lambda b: F.transform(b["w"], lambda x: F.when(b["hi"] - b["lo"] > 1e-10, (x - b["lo"]) / (b["hi"] - b["lo"])).otherwise(0.0)))


def resampled(window: Column, n: Column) -> Column:
    """Linear interpolation of a window at ``n`` equal steps from its first to its last sample."""

    def at(w: Column, i: Column) -> Column:
        top = F.size(w) - 1
        x = F.when(n > 1, i * top / F.nullif(n - 1, F.lit(0))).otherwise(0.0)
        k = F.least(F.floor(x), F.greatest(top - 1, F.lit(0))).cast("int")
        return F.element_at(w, k + 1) + (F.element_at(w, F.least(k + 1, top) + 1) - F.element_at(w, k + 1)) * (x - k)

    return let(window, lambda w: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(w, i)))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's coefficient of two arrays of one length; null where one is constant."""
    centre = lambda x: let(x, lambda v: let(_total(v) / F.size(v), lambda m: F.transform(v, lambda y: y - m)))
    dot = lambda x, y: _total(F.zip_with(x, y, lambda p, q: p * q))
    ratio = lambda s: let(F.sqrt(dot(s["a"], s["a"]) * dot(s["b"], s["b"])), lambda d: F.when(d > 1e-14, dot(s["a"], s["b"]) / d))
    return let(F.struct(centre(a).alias("a"), centre(b).alias("b")), ratio)


def similarity(a: Column, b: Column) -> Column:
    """How alike two windows are in shape: scaled, brought to the shorter length, correlated. Constant
    windows are alike if they are equal."""
    fit = lambda x, n: F.when(F.size(x) == n, x).otherwise(resampled(x, n))
    flat = (F.array_max(a) - F.array_min(a) < 1e-10) | (F.array_max(b) - F.array_min(b) < 1e-10)
    equal = F.when(F.abs(F.array_max(a) - F.array_max(b)) < 1e-10, 1.0).otherwise(0.0)
    both = F.struct(normalised(a).alias("a"), normalised(b).alias("b"), F.least(F.size(a), F.size(b)).alias("n"))
    fitted = let(both, lambda s: F.coalesce(correlation(fit(s["a"], s["n"]), fit(s["b"], s["n"])), F.lit(0.0)))
    return F.when(flat, equal).otherwise(fitted)


def alike(windows: list, threshold: float) -> pd.DataFrame:
    """:func:`alike_pairs` as a table ``(i, j, same, r)``."""
    return pd.DataFrame(dict(zip(("i", "j", "same", "r"), alike_pairs(windows, threshold), strict=True)))


def alike_pairs(windows: list, threshold: float) -> list[np.ndarray]:
    """``i, j, same, r``: pairs (i < j) of one series' windows that are alike, and whether their lengths are equal.

    All windows of one length are compared with all of another in one product
    of matrices. Windows of different lengths are scaled, the longer ones
    resampled, and constant ones are alike if they are equal; of one length,
    constant windows are like none.
    """
    windows = [np.asarray(w, np.float64) for w in windows]
    lengths = np.array([len(w) for w in windows])
    by = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    spans = {}
    for n, at in by.items():
        x = np.array([windows[k] for k in at])
        lo, hi = x.min(1), x.max(1)
        wide = np.where(hi - lo > 1e-10, hi - lo, 1.0)[:, None]
        spans[n] = np.where((hi - lo > 1e-10)[:, None], (x - lo[:, None]) / wide, 0.0), hi, hi - lo < 1e-10

    def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x - x.mean(1, keepdims=True)
        return x, np.einsum("ij,ij->i", x, x)

    found = []
    for a, at in by.items():
        for b, others in by.items():
            if b < a:
                continue
            (x, hi_x, flat_x), (y, hi_y, flat_y) = spans[a], spans[b]
            if a != b:
                grid = np.arange(a) * ((b - 1) / (a - 1)) if a > 1 else np.zeros(a)
                k = np.minimum(grid.astype(np.int64), b - 2)
                y = y[:, k] + (y[:, k + 1] - y[:, k]) * (grid - k)
            (p, pp), (q, qq) = centred(x), centred(y)
            size = np.sqrt(np.outer(pp, qq))
            r = np.where(size > 1e-14, p @ q.T / np.where(size > 1e-14, size, 1), np.nan if a == b else 0.0)
            if a != b:
                flat = flat_x[:, None] | flat_y[None, :]
                r = np.where(flat, (np.abs(hi_x[:, None] - hi_y[None, :]) < 1e-10).astype(float), r)
            i, j = np.nonzero(r >= threshold)
            first, second, r = np.minimum(at[i], others[j]), np.maximum(at[i], others[j]), r[i, j]
            keep = at[i] < others[j] if a == b else np.ones(len(r), bool)
            found.append((first[keep], second[keep], np.full(keep.sum(), a == b), r[keep]))
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0)] * 4


def similar_pairs(windows: DataFrame, threshold: float, keys=KEYS) -> DataFrame:
    """:func:`alike` over the windows numbered ``n`` of every series, of which it takes ``MOST_PEAKS`` at most."""
    keys = list(keys)

    def pairs(_, rows: walk.Columns) -> walk.Columns:
        found, n = alike(list(rows["window"]), threshold), rows["n"]
        return {"i": n[found["i"].to_numpy(np.int64)], "j": n[found["j"].to_numpy(np.int64)], "same": found["same"].to_numpy(bool), "r": found["r"].to_numpy(np.float64)}

    return walk.by_group(windows.select(*keys, "n", "window"), keys, ["n"], pairs, "i int, j int, same boolean, r double")


def greedy_groups(n: int, edges: list[tuple[int, int, bool]], lengths: dict[int, int], least: int) -> list[list[int]]:
    """Groups in the order of their first window: first with windows of its length, then of others.

    A window that joins a group takes part in no other, also where the group stays too small.
    """
    near: dict[tuple[int, bool], list[int]] = {}
    for i, j, same in sorted(edges):
        near.setdefault((i, same), []).append(j)
    used: set[int] = set()
    groups = []
    order = sorted(range(n), key=_first(lengths, n))
    for same, places in ((True, order), (False, range(n))):
        for i in places:
            if i in used:
                continue
            group = [i, *(j for j in near.get((i, same), []) if j not in used)]
            if same and len(group) == 1:
                continue
            used.update(group[1:])
            if len(group) >= least:
                groups.append(group)
                used.add(i)
    return groups


def _first(lengths: dict[int, int], n: int):
    first: dict[int, int] = {}
    for i in range(n):
        first.setdefault(lengths[i], i)
    return lambda i: (first[lengths[i]], i)


def pairs_of_many(windows: np.ndarray, cuts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``i, j, same``: :func:`alike_pairs` of each of many series, whose windows go from ``cuts[g]`` up to ``cuts[g + 1]``.

    Pairs of like lengths are compared at once, of whatever series they are.
    """
    lengths, x = walk.lengths_of(windows), np.concatenate([np.empty(0), *windows])
    first = np.cumsum(lengths) - lengths
    lo, hi = (least.reduceat(x, first) if len(x) else x for least in (np.minimum, np.maximum))
    wide = hi - lo > 1e-10
    scaled = np.where(np.repeat(wide, lengths), (x - np.repeat(lo, lengths)) / np.repeat(np.where(wide, hi - lo, 1.0), lengths), 0.0)
    flat, some = hi - lo < 1e-10, [(np.empty(0, np.int64),) * 2]
    for k in np.unique(np.diff(cuts)):
        base = cuts[:-1][np.diff(cuts) == k]
        some.append(tuple((base[:, None] + at).ravel() for at in np.triu_indices(k, 1)))
    i, j = (np.concatenate(c) for c in zip(*some, strict=True))
    short, long = np.where(lengths[i] <= lengths[j], i, j), np.where(lengths[i] <= lengths[j], j, i)
    kind = lengths[short] * (lengths.max(initial=0) + 1) + lengths[long]
    order = np.argsort(kind, kind="stable")
    hits = np.zeros(len(i), bool)
    for one in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        if not len(one):
            continue
        a, b = int(lengths[short[one[0]]]), int(lengths[long[one[0]]])
        step = max(1, STRETCH // b)
        for held in (one[c : c + step] for c in range(0, len(one), step)):
            s, t = short[held], long[held]
            p, q = scaled[first[s][:, None] + np.arange(a)], scaled[first[t][:, None] + np.arange(b)]
            if a != b:
                grid = np.arange(a) * ((b - 1) / (a - 1)) if a > 1 else np.zeros(a)
                k = np.minimum(grid.astype(np.int64), b - 2)
                q = q[:, k] + (q[:, k + 1] - q[:, k]) * (grid - k)
            p, q = (v - v.mean(1, keepdims=True) for v in (p, q))
            size = np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
            r = np.where(size > 1e-14, np.einsum("ij,ij->i", p, q) / np.where(size > 1e-14, size, 1), np.nan if a == b else 0.0)
            if a != b:
                r = np.where(flat[s] | flat[t], (np.abs(hi[s] - hi[t]) < 1e-10).astype(float), r)
            hits[held] = r >= threshold
    return i[hits], j[hits], (lengths[i] == lengths[j])[hits]


def groups_of_many(lengths: np.ndarray, cuts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` largest of the :func:`greedy_groups` of each of many series of ``FEW`` windows at most: the series,
    the number of the group and the window of each member. A set of windows is a number's bits, and a step is one
    window of every series."""
    i, j, same = pairs
    sizes = np.diff(cuts)
    own, n = np.repeat(np.arange(len(sizes)), sizes), np.arange(cuts[-1]) - np.repeat(cuts[:-1], sizes)
    bit = np.uint64(1) << n.astype(np.uint64)
    near = {}
    for like in (True, False):
        near[like] = np.zeros(len(n), np.uint64)
        np.bitwise_or.at(near[like], i[same == like], bit[j[same == like]])
    _, at, back = np.unique(own * (lengths.max(initial=0) + 1) + lengths, return_index=True, return_inverse=True)
    order = {True: np.lexsort((n, n[at][back], own)), False: np.arange(len(n))}
    used, found = np.zeros(len(sizes), np.uint64), []
    for like in (True, False):
        for step in range(int(sizes.max(initial=0))):
            there = np.flatnonzero(sizes > step)
            row = order[like][cuts[there] + step]
            members = near[like][row] & ~used[there]
            goes = (used[there] & bit[row] == 0) & ((members != 0) | (not like))
            there, row, members = there[goes], row[goes], members[goes]
            used[there] |= members
            enough = np.bitwise_count(members) + 1 >= least
            there, row, members = there[enough], row[enough], members[enough]
            used[there] |= bit[row]
            found.append((there, members | bit[row]))
    series, members = (np.concatenate(c) for c in zip((np.empty(0, np.int64), np.empty(0, np.uint64)), *found, strict=True))
    size = np.bitwise_count(members).astype(np.int64)
    by = np.lexsort((-size, series))  # found in order, and of one size in that order
    series, members = series[by], members[by]
    number = np.arange(len(series)) - np.searchsorted(series, series)
    series, members, number = series[number < most], members[number < most], number[number < most]
    which, place = np.nonzero(members[:, None] >> np.arange(FEW, dtype=np.uint64) & np.uint64(1))
    return series[which], number[which] + 1, cuts[series[which]] + place


def repeating_patterns(windows: DataFrame, threshold: float = 0.9, least: int = 3, most: int = 10, keys=KEYS, most_peaks: int = MOST_PEAKS) -> DataFrame:
    """``(keys, pattern_num, peak_idx, peak_db)`` of the groups of alike windows, the largest groups first.

    A series' highest ``most_peaks`` windows are compared and grouped by one
    task, which never sees more of it than these; series of few windows many
    at once.
    """
    keys = list(keys)
    top = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("peak_db"), "peak_idx"))
    kept = windows.withColumn("_top", top).where(F.col("_top") <= most_peaks).select(*keys, "peak_idx", "peak_db", "window")

    def group(held: list) -> tuple[list[int], list[int]]:
        i, j, same, _ = alike_pairs(held, threshold)
        lengths = dict(enumerate(map(len, held)))
        edges = list(zip(i.tolist(), j.tolist(), same.tolist(), strict=True))
        found = sorted(greedy_groups(len(lengths), edges, lengths, least), key=len, reverse=True)[:most]
        return [k for k, g in enumerate(found, 1) for _ in g], [n for g in found for n in g]

    def work(rows: walk.Columns, cuts: np.ndarray) -> tuple[np.ndarray, walk.Columns]:
        sizes, held = np.diff(cuts), rows["window"]
        few = np.flatnonzero(sizes <= FEW)
        row = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
        own = np.concatenate([[0], np.cumsum(sizes[few])])
        series, number, at = groups_of_many(walk.lengths_of(held[row]), own, pairs_of_many(held[row], own, threshold), least, most)
        out = [(few[series], number, row[at])]
        for g in np.flatnonzero(sizes > FEW).tolist():
            number, at = (np.array(x, np.int64) for x in group(list(held[cuts[g] : cuts[g + 1]])))
            out.append((np.full(len(at), g), number, cuts[g] + at))
        series, number, at = (np.concatenate(c) for c in zip(*out, strict=True))
        return series, {"pattern_num": number.astype(np.int32), "peak_idx": rows["peak_idx"][at], "peak_db": rows["peak_db"][at]}

    return walk.by_stretch(kept, keys, ["peak_idx"], work, "pattern_num int, peak_idx long, peak_db double", heavy="window", dealt=True)


def pattern_statistics(members: DataFrame, rate: float, keys=KEYS) -> DataFrame:
    """Intervals of each pattern, their regularity, its confidence and the beats a minute."""
    by = [*keys, "pattern_num"]
    gap = (F.col("peak_idx") - F.lag("peak_idx").over(Window.partitionBy(*by).orderBy("peak_idx"))) / rate
    m = members.withColumn("gap", gap)
    s = m.groupBy(*by).agg(
        F.count("*").alias("num_repetitions"), F.avg("gap").alias("mean_interval_seconds"), F.stddev_pop("gap").alias("std_interval_seconds"), F.percentile("gap", F.lit(0.5)).alias("median_interval_seconds"),
        F.min("gap").alias("min_interval_seconds"), F.max("gap").alias("max_interval_seconds"),
    )
    cv = F.try_divide("std_interval_seconds", "mean_interval_seconds")
    return s.select(
        "*", (1 / (1 + F.coalesce(cv, F.lit(0.0)))).alias("pattern_regularity_score"),
        F.when(cv < 0.1, "high").when(cv < 0.3, "medium").otherwise("low").alias("pattern_confidence"),
        F.coalesce(F.try_divide(F.lit(60.0), F.col("mean_interval_seconds")), F.lit(0.0)).alias("beats_per_minute"),
    )


def top_windows(windows: DataFrame, limit: int, keys=KEYS) -> DataFrame:
    """The ``limit`` windows of the highest level of each series, numbered in their own order."""
    level = F.array_max("window")
    best = windows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(level.desc(), "peak_idx"))).where(F.col("_r") <= limit).drop("_r")
    return best.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("peak_idx")))


def display_windows(patterns: DataFrame, independent: DataFrame, limit: int, keys=KEYS) -> DataFrame:
    """Pattern windows that are not among the independent peaks, the highest ``limit``."""
    return top_windows(patterns.join(independent.select(*keys, "peak_idx"), [*keys, "peak_idx"], "left_anti"), limit, keys)
