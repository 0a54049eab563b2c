"""First and last hits in a stretch of levels by a tree of minima and maxima.

Each level of the tree has the extrema of 64 nodes of the level below. A
search goes along the nodes of the highest level that fits where it is, and
goes down into the first node that holds a hit, so it looks at some 64 values
a level instead of at every sample up to the hit.

Many searches at once look at the samples that are near first, all of them
together, and only those without a hit there go to a tree.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

FANOUT = 64
#: Samples that many searches look at before they go to the trees, about; searches that look together.
NEAR, TOGETHER = 256, 1 << 13


class Extrema:
    """Levels ``db`` at ascending samples ``idx``, which may have holes."""

    def __init__(self, idx: np.ndarray, db: np.ndarray):
        self.idx, self.db = idx, db
        #: Values looked at so far.
        self.looked = 0

    @cached_property
    def low(self) -> list[np.ndarray]:
        return _tree(self.db, np.fmin)

    @cached_property
    def high(self) -> list[np.ndarray]:
        return _tree(self.db, np.fmax)

    @cached_property
    def backwards(self) -> Extrema:
        return Extrema(-self.idx[::-1], self.db[::-1])

    def between(self, start: int, end: int) -> tuple[int, int]:
        """Places of the samples from ``start`` up to ``end``."""
        a, b = np.searchsorted(self.idx, [start, end])
        return int(a), int(b)

    def _first(self, tree: list[np.ndarray], a: int, b: int, test) -> int | None:
        k, size, top = 0, 1, len(tree) - 1
        while a < b:
            while k < top and a % (size * FANOUT) == 0 and a + size * FANOUT <= b:
                k, size = k + 1, size * FANOUT
            while k and a + size > b:
                k, size = k - 1, size // FANOUT
            at = a // size
            stop = min(b // size, (at // FANOUT + 1) * FANOUT)
            hits = test(tree[k][at:stop])
            self.looked += stop - at
            j = int(hits.argmax())
            if not hits[j]:
                a = stop * size
            elif k == 0:
                return a + j
            else:  # the hit is in this node: down, and not up again
                a += j * size
                b, top = min(b, a + size), k - 1
                k, size = k - 1, size // FANOUT
        return None

    def first(self, start: int, end: int, level: float, test: str) -> int | None:
        """The first sample from ``start`` up to ``end`` whose level is ``at most``, ``below`` or ``at least`` the given one."""
        a, b = self.between(start, end)
        if test == "at least":
            found = self._first(self.high, a, b, lambda x: x >= level)
        elif test == "below":
            found = self._first(self.low, a, b, lambda x: x < level)
        else:
            found = self._first(self.low, a, b, lambda x: x <= level)
        return None if found is None else int(self.idx[found])

    def last(self, start: int, end: int, level: float, test: str) -> int | None:
        """The last such sample."""
        found = self.backwards.first(1 - end, 1 - start, level, test)
        return None if found is None else -found


class Many:
    """The levels of many groups, group ``g`` from ``cuts[g]`` up to ``cuts[g + 1]``, each with ascending samples, and
    searches of the groups ``own``: all arguments and results have a value for each of these."""

    def __init__(self, idx: np.ndarray, db: np.ndarray, cuts: np.ndarray, own: np.ndarray):
        self.idx, self.db, self.cuts, self.own = idx, db, cuts, own
        self.low, self.high = cuts[own], cuts[own + 1]
        breaks = np.concatenate([[0], np.cumsum(np.diff(idx) != 1), [0]]) if len(idx) else np.zeros(1, np.int64)
        there = self.high > self.low
        #: Groups without holes: a sample's place is known from its number.
        self.even = ~there | (breaks[np.maximum(self.high - 1, 0)] == breaks[np.minimum(self.low, len(breaks) - 1)])
        self.zero = idx[np.minimum(self.low, len(idx) - 1)] if len(idx) else np.zeros(len(own), np.int64)
        self.trees: dict[int, Extrema] = {}

    def tree(self, k: int) -> Extrema:
        g = int(self.own[k])
        if g not in self.trees:
            self.trees[g] = Extrema(self.idx[self.cuts[g] : self.cuts[g + 1]], self.db[self.cuts[g] : self.cuts[g + 1]])
        return self.trees[g]

    def between(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the samples from ``start`` up to ``end`` in all levels."""
        n = self.high - self.low
        a, b = (self.low + np.clip(x - self.zero, 0, n) for x in (start, end))
        for k in np.flatnonzero(~self.even).tolist():
            a[k], b[k] = (int(self.low[k]) + x for x in self.tree(k).between(int(start[k]), int(end[k])))
        return a, b

    def _search(self, start: np.ndarray, end: np.ndarray, level: np.ndarray, test: str, back: bool) -> tuple[np.ndarray, np.ndarray]:
        hit = {"at least": np.greater_equal, "below": np.less, "at most": np.less_equal}[test]
        found, there = np.zeros(len(start), np.int64), np.zeros(len(start), bool)
        a, b = self.between(start, end)
        far = [np.flatnonzero(~self.even)]
        every = np.flatnonzero(self.even & (a < b))
        for some in np.split(every, range(TOGETHER, len(every), TOGETHER)):
            seen, width = 0, 16
            while len(some) and seen < NEAR:
                step = np.arange(seen, seen + width)
                at = b[some, None] - 1 - step if back else a[some, None] + step
                inside = at >= a[some, None] if back else at < b[some, None]
                hits = hit(self.db[np.clip(at, 0, len(self.db) - 1)], level[some, None]) & inside
                first = hits.argmax(1)
                got = hits[np.arange(len(some)), first]
                found[some[got]] = self.idx[at[got, first[got]]]
                there[some[got]] = True
                seen, width = seen + width, 2 * width
                some = some[~got & (b[some] - a[some] > seen)]
            far.append(some)
        for k in np.concatenate(far).tolist():
            x = self.tree(k)
            one = (x.last if back else x.first)(int(start[k]), int(end[k]), float(level[k]), test)
            if one is not None:
                found[k], there[k] = one, True
        return found, there

    def first(self, start: np.ndarray, end: np.ndarray, level: np.ndarray, test: str) -> tuple[np.ndarray, np.ndarray]:
        """The first sample from ``start`` up to ``end`` of such a level, see :class:`Extrema`, and whether there is one."""
        return self._search(start, end, level, test, False)

    def last(self, start: np.ndarray, end: np.ndarray, level: np.ndarray, test: str) -> tuple[np.ndarray, np.ndarray]:
        """The last such sample."""
        return self._search(start, end, level, test, True)


def _tree(x: np.ndarray, least: np.ufunc) -> list[np.ndarray]:
    levels = [x]
    while len(levels[-1]) > FANOUT:
        levels.append(least.reduceat(levels[-1], np.arange(0, len(levels[-1]), FANOUT)))
    return levels
