"""Work over the sorted rows of a partition, a group of keys at a time.

A grouped map starts anew for every group; with many short series that start
is most of the work. Here rows are dealt and sorted by key, and one pass over
each partition's batches walks all groups in them. A group that a batch cuts
is held until it is whole, so a group must fit a task: it is a block or the
edges of a series' blocks, never a series of samples.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclasses.dataclass
class Lists:
    """A column of arrays: all of their numbers, one array after another, their lengths, and which are there, None for all."""

    flat: np.ndarray
    lengths: np.ndarray
    there: np.ndarray | None = None

    @classmethod
    def of_rows(cls, x: np.ndarray) -> Lists:
        """An array for each row of a matrix."""
        return cls(x.reshape(-1), np.full(len(x), x.shape[1]))


#: What a group gives: columns of one length, by name; None for no rows. Arrays as :class:`Lists` for many groups at once.
Columns = dict[str, np.ndarray | list | Lists]
#: Rows of results that a task holds before it hands them on, about.
HELD_ROWS = 1 << 10
#: Numbers of arrays, and rows, that are walked at once, about.
STRETCH = 1 << 18


def types_of(df: DataFrame, names: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in names)


def stacked(parts: list) -> np.ndarray | list:
    if all(isinstance(p, np.ndarray) and p.dtype != object for p in parts):
        return np.concatenate(parts)
    return [x for p in parts for x in p]


def _column(values: np.ndarray | list | Lists, kind: pa.DataType) -> pa.Array:
    """NaN is null, as in frames."""
    if not isinstance(values, Lists):
        return pa.array(values, kind, from_pandas=True)
    ends = np.concatenate([[0], np.cumsum(values.lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(values.flat, kind.value_type, from_pandas=True), kind, mask=None if values.there is None else pa.array(~values.there))


def map_frames(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[Columns]], schema: str) -> DataFrame:
    """``mapInPandas`` for work that gives columns: columns of arrays are handed on as they are, not array by array."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in work(b.to_pandas() for b in batches):
            yield pa.RecordBatch.from_arrays([_column(made[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


def _walk(keys: list[str], finish: Callable[[pd.DataFrame, list[int]], Iterator]) -> Callable[[Iterator[pd.DataFrame]], Iterator]:
    """``finish(frame, cuts)`` of whole groups, as many as a batch has."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator:
        open_: list[pd.DataFrame] = []
        for frame in batches:
            if not len(frame):
                continue
            new = np.zeros(len(frame) - 1, bool)
            for k in keys:
                v = frame[k].to_numpy()
                new |= v[1:] != v[:-1]
            cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
            if open_ and any(open_[-1][k].iloc[-1] != frame[k].iloc[0] for k in keys):
                cuts.insert(0, 0)  # what is open has ended with its batch
            if len(cuts) > 1:
                if open_:
                    whole = pd.concat([*open_, frame[: cuts[1]]], ignore_index=True)
                    yield from finish(whole, [0, len(whole)])
                    cuts = cuts[1:]
                if len(cuts) > 1:
                    yield from finish(frame[: cuts[-1]], cuts)
                open_ = []
            open_.append(frame[cuts[-1] :].reset_index(drop=True))
        if open_:
            whole = pd.concat(open_, ignore_index=True)
            yield from finish(whole, [0, len(whole)])

    return walk


def _dealt(df: DataFrame, keys: list[str], order: Sequence[str], dealt: bool = False) -> DataFrame:
    return (df if dealt else df.repartition(*keys)).sortWithinPartitions(*keys, *order)


def by_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[tuple, Columns], Columns | None], columns: str, kept: Sequence[str] | None = None) -> DataFrame:
    """``work(key, columns)`` of each group of ``keys``, its rows in ``order``; ``(kept, columns)``.

    ``kept``: the keys that the result has; all, where it isn't given. Keys
    are not null.
    """
    keys, kept = list(keys), list(keys if kept is None else kept)
    places = [keys.index(k) for k in kept]
    names = [c.split()[0] for c in columns.split(", ")]

    def finish(frame: pd.DataFrame, cuts: list[int]) -> Iterator[pd.DataFrame]:
        held = {c: frame[c].to_numpy() for c in frame.columns}
        found: list[tuple[tuple, Columns, int]] = []
        rows = 0

        def made() -> pd.DataFrame:
            sizes = [n for *_, n in found]
            own = {k: np.repeat(np.array([key[p] for key, *_ in found], frame[k].dtype), sizes) for k, p in zip(kept, places, strict=True)}
            return pd.DataFrame(own | {n: stacked([out[n] for _, out, _ in found]) for n in names})

        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(held[k][a] for k in keys)
            out = work(key, {c: v[a:b] for c, v in held.items()})
            if out is not None and len(out[names[0]]):
                found.append((key, out, len(out[names[0]])))
                rows += found[-1][2]
            if rows >= HELD_ROWS:  # no more results wait than these, however many a batch gives
                yield made()
                found, rows = [], 0
        if found:
            yield made()

    types = types_of(df, kept)
    return _dealt(df, keys, order).mapInPandas(_walk(keys, finish), f"{types}, {columns}" if types else columns)


def by_stretch(df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[Columns, np.ndarray], tuple[np.ndarray, Columns]], columns: str, kept: Sequence[str] | None = None, heavy: str | None = None, dealt: bool = False) -> DataFrame:
    """:func:`by_group` for work that takes many groups at once: ``work(columns, cuts)`` has the rows of whole groups,
    group ``g`` from ``cuts[g]`` up to ``cuts[g + 1]``, and gives the group of each row of the result, and the columns.

    A stretch has some ``STRETCH`` rows, counted with the lengths of the arrays of column ``heavy``, or a group.
    ``dealt``: the rows of a group are in one partition already, as after a window over the keys.
    """
    keys, kept = list(keys), list(keys if kept is None else kept)

    def finish(frame: pd.DataFrame, cuts: list[int]) -> Iterator[Columns]:
        held, at = {c: frame[c].to_numpy() for c in frame.columns}, np.array(cuts)
        for a, b in stretches(lengths_of(held[heavy]) + 1 if heavy else np.ones(len(frame), np.int64), at):
            own = at[a : b + 1]
            group, out = work({c: v[own[0] : own[-1]] for c, v in held.items()}, own - own[0])
            if len(group):
                yield {k: held[k][own[group]] for k in kept} | out

    types = types_of(df, kept)
    return map_frames(_dealt(df, keys, order, dealt), _walk(keys, finish), f"{types}, {columns}" if types else columns)


def lengths_of(arrays: np.ndarray) -> np.ndarray:
    """Lengths of a column's arrays, 0 for nulls."""
    return np.fromiter((0 if x is None else len(x) for x in arrays), np.int64, len(arrays))


def stretches(weight: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last groups of pieces of some ``STRETCH`` of weight, or of one group."""
    before = np.concatenate([[0], np.cumsum(weight)])[cuts]
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(before, before[a] + STRETCH, side="right")) - 1)
        yield a, b
        a = b


def by_row(df: DataFrame, kept: Sequence[str], work: Callable[[tuple, Columns], Columns | None], columns: str) -> DataFrame:
    """:func:`by_group` where each row is a group by itself, so none is shuffled."""
    kept = list(kept)
    names = [c.split()[0] for c in columns.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for a in range(0, len(frame), HELD_ROWS):
                held = {c: frame[c].to_numpy()[a : a + HELD_ROWS] for c in frame.columns}
                found = [work((), {c: v[i : i + 1] for c, v in held.items()}) for i in range(min(HELD_ROWS, len(frame) - a))]
                sizes = [0 if out is None else len(out[names[0]]) for out in found]
                if sum(sizes):
                    made = [out for out, n in zip(found, sizes, strict=True) if n]
                    yield pd.DataFrame({k: np.repeat(held[k], sizes) for k in kept} | {n: stacked([out[n] for out in made]) for n in names})

    return df.mapInPandas(walk, f"{types_of(df, kept)}, {columns}")


def by_rows(df: DataFrame, kept: Sequence[str], work: Callable[[Columns], tuple[np.ndarray, Columns]], columns: str, heavy: str) -> DataFrame:
    """:func:`by_stretch` where each row is a group by itself, so none is shuffled."""
    kept = list(kept)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[Columns]:
        for frame in batches:
            held = {c: frame[c].to_numpy() for c in frame.columns}
            for a, b in stretches(lengths_of(held[heavy]) + 1, np.arange(len(frame) + 1)):
                row, out = work({c: v[a:b] for c, v in held.items()})
                if len(row):
                    yield {k: held[k][a + row] for k in kept} | out

    return map_frames(df, walk, f"{types_of(df, kept)}, {columns}")
