"""Exact percentiles of groups of any size, by selection.

A percentile lies between two values of known ranks. Values are counted by
bins first, a few hundred for a usual spread; running sums over the bins say
which of them hold the wanted ranks. Only values of those bins are counted by
value and put in order, a bin to a window, which spills where it must. No
state grows with a group: a bin's width is about a hundredth of its value, so
a bin holds a small part of a group unless the group's values are that alike,
and then equal ones are one row.

Where most groups are small, :func:`percentiles_of_short` puts those in order
as they are, and goes this way with the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins to a doubling of the value, and what keeps their numbers positive.
BINS, OFFSET = 64, 1100 * 64
#: Rows of a group that is put in order as an array, at most.
SHORT = 4096


def bin_of(x: Column) -> Column:
    """A whole number that never falls as x grows."""
    size = (F.floor(F.log2(F.least(F.abs(x), F.lit(1.7e308))) * BINS) + OFFSET).cast("int")
    return F.when(x > 0, size).when(x < 0, -size).otherwise(0)


def percentiles(rows: DataFrame, keys: Sequence[str], values: dict[str, Column], shares: Sequence[float]) -> DataFrame:
    """``(keys, names of values)``: an array of the values at each of ``shares`` of each group's values, interpolated
    linearly. Nulls and NaN are left out; where there is nothing else, the array is null. Keys are not null."""
    keys = list(keys)
    by = [*keys, "_name"]
    stacked = F.explode(F.array(*(F.struct(F.lit(name).alias("_name"), x.cast("double").alias("_x")) for name, x in values.items()))).alias("_v")
    x = rows.select(*keys, stacked).select(*keys, "_v.*").where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    x = x.select(*by, (F.col("_x") + F.lit(0.0)).alias("_x")).withColumn("_bin", bin_of(F.col("_x")))
    counts = x.groupBy(*by, "_bin").agg(F.count("*").alias("_c"))
    below = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "_bin", "_c", below.alias("_below"), F.sum("_c").over(Window.partitionBy(*by)).alias("_n"))
    ends = lambda s: [F.floor((F.col("_n") - 1) * s), F.ceil((F.col("_n") - 1) * s)]
    ranks = F.array_distinct(F.array(*(e for s in shares for e in ends(s))))
    here = F.filter(ranks, lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_c")))
    wanted = counts.select(*by, "_bin", "_below", "_n", here.alias("_ranks")).where(F.size("_ranks") > 0)
    held = x.join(wanted.select(*by, "_bin"), [*by, "_bin"], "left_semi").groupBy(*by, "_bin", "_x").agg(F.count("*").alias("_c"))
    along = Window.partitionBy(*by, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_c").over(along), F.lit(0))).join(wanted, [*by, "_bin"])
    first = F.col("_below") + F.col("_before")
    held = held.select(*by, "_n", "_x", F.explode(F.filter("_ranks", lambda r: (r >= first) & (r < first + F.col("_c")))).alias("_rank"))
    found = held.groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))

    def at(share: float) -> Column:
        place = (F.col("_n") - 1) * share
        lower, upper = F.floor(place), F.ceil(place)
        value = lambda r: F.element_at("_at", r)
        return F.when(lower == upper, value(lower)).otherwise((upper - place) * value(lower) + (place - lower) * value(upper))

    arrays = found.select(*keys, "_name", F.array(*map(at, shares)).alias("_q"))
    return arrays.groupBy(*keys).agg(*(F.first(F.when(F.col("_name") == name, F.col("_q")), ignorenulls=True).alias(name) for name in values))


def percentiles_of_short(rows: DataFrame, keys: Sequence[str], values: dict[str, Column], shares: Sequence[float], short: int = SHORT) -> DataFrame:
    """:func:`percentiles` of groups most of which have few rows: those of ``short`` rows at most are arrays in order,
    so rows are shuffled once; the others are selected from."""
    keys = list(keys)
    rows = rows.select(*keys, *(x.cast("double").alias(name) for name, x in values.items()))
    long = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > short).select(*keys)
    few = rows.dropna(subset=keys).join(long, keys, "left_anti")
    held = few.groupBy(*keys).agg(F.collect_list(F.struct(*values)).alias("_all"))
    there = lambda x: x.isNotNull() & ~F.isnan(x)
    ordered = lambda name: F.sort_array(F.filter(F.transform("_all", lambda row: row[name] + F.lit(0.0)), there))
    arrays = held.select(*keys, *(ordered(name).alias(name) for name in values))

    def at(x: Column, share: float) -> Column:
        place = (F.size(x) - 1) * share
        lower, upper = F.floor(place), F.ceil(place)
        value = lambda r: F.get(x, r.cast("int"))
        return F.when(lower == upper, value(lower)).otherwise((upper - place) * value(lower) + (place - lower) * value(upper))

    some = F.greatest(*(F.size(name) for name in values), F.lit(0)) > 0
    found = arrays.where(some).select(*keys, *(F.when(F.size(name) > 0, F.array(*(at(F.col(name), s) for s in shares))).alias(name) for name in values))
    selected = percentiles(rows.join(long, keys, "left_semi"), keys, {name: F.col(name) for name in values}, shares)
    return found.unionByName(selected.select(*found.columns))
