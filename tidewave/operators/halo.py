"""Windows over samples by halo exchange: each block is given its neighbours' edges, so no window spans a series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import walk

KEYS = ("track_id", "channel_index")
#: Samples of a block, at least.
BLOCK = 1 << 16


def exchange(rows: DataFrame, back: int, ahead: int, work: Callable[[np.ndarray, np.ndarray, int, int], walk.Columns | None], columns: str, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """``work(sample_idx, value, start, end)`` of each block of ``(keys, sample_idx, value)``.

    The arrays have the block's samples, from place ``start`` up to ``end``,
    and up to ``back`` samples before and ``ahead`` after them, as far as the
    series has them. Blocks are no shorter than the halos, so a sample goes to
    its block and, near an end, to one neighbour.
    """
    keys, size = list(keys), max(block, back, ahead)
    at, own = F.expr(f"sample_idx % {size}"), F.expr(f"sample_idx div {size}")
    after = F.when((at >= size - back) & F.lit(back > 0), own + 1)
    before = F.when((at < ahead) & (own > 0), own - 1)
    dealt = rows.select(*keys, F.explode(F.array_compact(F.array(own, after, before))).alias("_block"), "sample_idx", "value")

    def inside(key: tuple, held: walk.Columns) -> walk.Columns | None:
        start, end = np.searchsorted(held["sample_idx"], [key[-1] * size, (key[-1] + 1) * size])
        return work(held["sample_idx"], held["value"], int(start), int(end)) if end > start else None

    return walk.by_group(dealt, [*keys, "_block"], ["sample_idx"], inside, columns, keys)
