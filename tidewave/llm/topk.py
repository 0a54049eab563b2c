"""Exact top-k search by Fagin's threshold algorithm.

The candidates are dealt into blocks. In a block every dimension has its list
of vectors, sorted by the component. A query walks all lists at once from the
end that helps it; each vector met is scored in full. Lists of more weight
in the query are walked deeper. The components at the current depths, and the longest vector of the block, bound what the rest of the
block can reach; the walk stops when that bound cannot beat the kth result.
Some blocks are searched first, and the kth scores that they give are the
floor that every later block must reach. The best of the blocks are the best.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

K, SCALE, EVERY = 10, 1024, 100
#: Vectors of a block of candidates and of one of queries: equal sides copy the fewest rows.
BLOCK = 8192
#: One block of so many is searched first, for the floors.
FIRST = 16
#: A list is walked as deep as its weight in the query, relative to the largest, to this power.
STEEP = 4.0
#: Queries that are finished at a time, where a walk has met half of a block.
TOGETHER = 128
LONG = np.iinfo(np.int64).max
EXACT = 1 << 53
#: Steps at which the bound by length is tried, times the length that the whole query would give.
STEPS = np.array([1, 1.05, 1.1, 1.2, 1.35, 1.6, 2, 3, 5, 10, 100])[:, None]


def whole(embedding: str) -> Column:
    """The components as doubles; null where the vector takes no part."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    return F.when(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), x)


def scaled(column: pd.Series, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x): doubles where they hold it exactly, else Python's integers."""
    x = np.array(column.tolist(), np.float64).reshape(len(column), dims)
    if np.abs(x).max(initial=0) < EXACT / scale:
        return np.floor(x * scale)
    exact = [math.floor(v * scale) if abs(v) < EXACT / scale else int(v) * scale for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def fits(rows: np.ndarray, query: np.ndarray) -> bool:
    """Do doubles hold every inner product of rows and query, and all sums on the way?"""
    return rows.dtype != object and query.dtype != object and np.abs(rows).max(initial=0) * np.abs(query).max(initial=0) * max(1, rows.shape[1]) < EXACT


def scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as longs; one beyond a long's range becomes the end of the range."""
    if fits(rows, query):
        return (rows @ query).astype(np.int64)
    whole_rows, whole_query = (np.array([int(v) for v in a.ravel()], object).reshape(a.shape) for a in (rows, query))
    return np.array([min(max(sum(a * b for a, b in zip(r, whole_query, strict=True)), -LONG), LONG) for r in whole_rows], np.int64)


def bound(query: np.ndarray, last: np.ndarray, length: float) -> float:
    """No vector of ``length`` at most, with no component beyond ``last`` on the query's side, has a higher product.

    Weak duality: for any step the sum below is an upper bound, so rounding
    cannot make it too low but by its own last digits.
    """
    a, cap = np.abs(query), np.where(query > 0, last, -last)
    step = STEPS * (length / max(float(np.sqrt(a @ a)), 1e-300))
    y = np.minimum(cap, step * a)
    dual = (a * y - y * y / (2 * step)).sum(1) + length * length / (2 * step[:, 0])
    slack = 1e-9 * float((a * np.abs(cap)).sum() + a.sum() * length)  # far beyond what rounding takes off
    return float(min(dual.min(), (a * cap).sum())) + slack


def best(ids: np.ndarray, got: np.ndarray, k: int, floor: int) -> np.ndarray:
    """Places of the k highest scores of ``floor`` or more, ties to smaller ids."""
    if len(got) > k:
        floor = max(floor, int(np.partition(got, len(got) - k)[len(got) - k]))
    at = np.flatnonzero(got >= floor)
    return at[np.lexsort((ids[at], -got[at]))[:k]]


def threshold_search(ids: np.ndarray, numbers: np.ndarray, rows: np.ndarray, order: np.ndarray, own: int, query: np.ndarray, k: int, floor: int = -LONG, length: float | None = None, give_up: float = 1.0) -> tuple[np.ndarray, np.ndarray, int] | None:
    """``(places, scores, met)`` of the k best rows of a block for one query, none below ``floor``.

    ``order``: per dimension, row numbers by ascending component. The row
    numbered ``own`` is no candidate. Ties go to smaller ids, so the walk goes
    on while the bound equals the kth score. None when more than the share
    ``give_up`` of the block was met.
    """
    n, exact = len(rows), fits(rows, query)
    used = np.flatnonzero(query)
    lists = [order[i, ::-1] if query[i] > 0 else order[i] for i in used]
    share = np.array([abs(v) for v in query[used]], np.float64)
    share = (share / share.max(initial=1e-300)) ** STEEP
    seen = np.zeros(n, bool)
    places, got = np.empty(0, np.int64), np.empty(0, np.int64)
    depth, most, met = np.zeros(len(used), np.int64), max(4, k), 0
    while met < n:
        to = np.minimum(n, np.ceil(most * share)).astype(np.int64)
        fresh = np.zeros(n, bool)
        for one, a, b in zip(lists, depth.tolist(), to.tolist(), strict=True):
            fresh[one[a:b]] = True
        if most >= 16 * n or not len(used):  # short lists of small weight need no walk of their own
            fresh[:] = True
        fresh &= ~seen
        seen |= fresh
        at = np.flatnonzero(fresh)
        met += len(at)
        if met > give_up * n:
            return None
        at = at[numbers[at] != own]
        places, got = np.concatenate([places, at]), np.concatenate([got, scores(rows[at], query)])
        kept = best(ids[places], got, k, floor)
        places, got = places[kept], got[kept]
        depth, most = to, 2 * most
        least = int(got[-1]) if len(got) == k else floor
        if met < n and least > -LONG:
            last = np.array([rows[one[d - 1], i] for one, d, i in zip(lists, depth.tolist(), used.tolist(), strict=True)], rows.dtype)
            top = bound(query[used], last, length) if exact and length is not None else sum(int(a) * int(b) for a, b in zip(last, query[used], strict=True))
            if top < least:
                break
    return places, got, met


def _search(k: int, scale: int):
    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": [], "met": []}, dtype="int64")]
        for dims, part in block.groupby("dims"):
            asked = queries[queries["dims"] == dims]
            if asked.empty:
                continue
            ids, numbers = part["vec_id"].to_numpy(np.int64), part["row"].to_numpy(np.int64)
            rows, wanted = scaled(part["e"], dims, scale), scaled(asked["e"], dims, scale)
            order = np.argsort(rows, axis=0, kind="stable").T if dims else np.empty((0, len(ids)), np.int64)
            length = float(np.sqrt((rows * rows).sum(1).max())) if rows.dtype != object else None
            plain = fits(rows, wanted)
            slow = []

            def add(j: int, places: np.ndarray, got: np.ndarray, met: int, own=asked, ids=ids) -> None:
                q = own.iloc[j]
                out.append(pd.DataFrame({"query": q["row"], "query_id": q["vec_id"], "vec_id": ids[places], "score": got, "met": met}))

            for j, (number, floor) in enumerate(zip(asked["row"].tolist(), asked["floor"].tolist(), strict=True)):
                found = threshold_search(ids, numbers, rows, order, number, wanted[j], k, floor, length, 0.5 if plain else 1.0)
                if found is None:
                    slow.append(j)
                else:
                    add(j, *found)
            # walks that the lists don't end: the rest of the block in one product for many queries
            for at in range(0, len(slow), TOGETHER):
                group = slow[at : at + TOGETHER]
                s = (rows @ wanted[group].T).astype(np.int64)
                for c, j in enumerate(group):
                    others = np.flatnonzero(numbers != asked["row"].iloc[j])
                    places = others[best(ids[others], s[others, c], k, asked["floor"].iloc[j])]
                    add(j, places, s[places, c], len(rows))
        return pd.concat(out).astype("int64")

    return search


FOUND = "query long, query_id long, vec_id long, score long, met long"


def search_blocks(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """``(query, query_id, vec_id, score, met)``: the best of each block for each query, ``met`` of whose rows it met."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole("embedding").alias("e")).where("vec_id is not null and e is not null")
    rows = settle(rows.withColumn("dims", F.size("e")))  # written, so a row keeps its number
    n, n_asked = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    n_cand, n_query = max(1, -(-n // BLOCK)), max(1, -(-n_asked // BLOCK))
    first = max(1, n_cand // FIRST)
    every_query = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query - 1).cast("long"))).alias("qb")
    blocks = rows.select("*", F.pmod(F.xxhash64("row"), F.lit(n_cand)).alias("cb")).select("*", every_query)
    # columns of their own, or the two sides of the grouping would be mistaken for each other
    own = [F.col(c).alias(c) for c in rows.columns]
    asked = rows.where(F.col("vec_id") % every == 0).select(*own).select("*", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_query)).alias("qb"))

    def met(asked: DataFrame, a: int, b: int) -> DataFrame:
        dealt = asked.select("*", F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b - 1).cast("long"))).alias("cb"))
        inside = blocks.where(F.col("cb").between(a, b - 1))
        return dealt.groupBy("cb", "qb").cogroup(inside.groupBy("cb", "qb")).applyInPandas(_search(k, scale), FOUND)

    begun = met(asked.withColumn("floor", F.lit(-LONG)), 0, first)
    if first == n_cand:
        return begun
    begun = settle(begun)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    floors = begun.select("query", "score", place.alias("n")).where(F.col("n") == k).select(F.col("query").alias("row"), F.col("score").alias("floor"))
    later = asked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(-LONG)))
    return begun.unionByName(met(later, first, n_cand))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` over ``(vec_id, embedding)``.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; their
    candidates are all other rows, also those that repeat the query's id or
    its vector: every row is a row of its own. Null vectors, vectors that hold
    a null or non-finite component and rows of a null id take no part; vectors
    are compared with those of their length. Ties go to the smaller id; a
    score beyond a long's range counts as the end of the range; a query with
    fewer candidates has fewer rows; an empty table has none. Queries and
    candidates meet block by block, in blocks of equal size: every query
    against every row, which is what a stated query set asks for. No side is
    broadcast.
    """
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return search_blocks(vectors, k, every, scale).select("query_id", place, "vec_id", "score").where(F.col("rank") <= k)


ORACLE = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.r <> q.r),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
