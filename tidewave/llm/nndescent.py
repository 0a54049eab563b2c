"""Near-duplicate embeddings by NN-descent.

Every vector keeps a list of its nearest known neighbours. The lists start in
buckets of random hyperplanes; then, round by round, the vectors that have a
neighbour in common meet there and are compared, and better neighbours replace
worse ones. A list that holds links only may lack some: it is saturated, and
is made twice as long, up to ``LONGEST``. Rounds end when no list grows and
one has found hardly any new link. The edges at or over the threshold are
kept. Every meeting also gives a forest of all links in it, so that a list
that is full of a dense group's own members hides no other group.

A vector with more links than the longest list holds is crowded, and its
component is a dense group. Its links are counted exactly: members are binned by their angle from the group's
centre, bins that lie near the centre are linked as wholes and far bins not at
all, both by the triangle inequality, and only what is left between is
compared. So a group of near copies costs no more than its size.

An audit compares a sample of vectors with all rows. While recall is low there
are more rounds with longer lists and more buckets; where it is low to the
end, all vectors are compared with all. The measured recall is part of the
result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .components import components

THRESHOLD = 0.9
#: Length of a list at first and at most, least tables of hyperplanes, and rounds: at least, at most.
NEIGHBOURS, LONGEST, TABLES, ROUNDS, MOST_ROUNDS = 8, 64, 8, 2, 8
#: The probability that a pair at the threshold shares one of the first buckets.
SHARED = 0.99
#: Vectors of a bucket or tile that are compared with each other at a time; rows of a task's group.
TILE, GROUP_ROWS = 512, 16_384
#: The audit's sample of each kind, at most; the true links it wants to see; the recall it asks for.
AUDIT, AUDIT_MOST, AUDIT_LINKS, RECALL = 512, 4096, 100, 0.95
#: The share of links found last that is too few for another round.
FEW = 0.001
#: Edges of a forest that one vector has, where its neighbours are linked with each other.
FAN = 16
#: Width of a bin of angles from a dense group's centre, and what angles are trusted to.
BIN, SLACK = math.pi / 360, 1e-6
#: Rows of lists have no tie; rows of ties (v, tie) list the tie alone; rows of crowded vectors list nothing.
LISTS = "v long, s array<double>, u array<long>, tie long, crowded boolean"


def _unit(column: pd.Series) -> np.ndarray:
    x = np.concatenate(column.to_list()).astype(np.float64).reshape(len(column), -1)  # all of one length
    x = x / np.abs(x).max(1, keepdims=True)  # or the squares of large components would not be finite
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _linked(x: np.ndarray, y: np.ndarray, threshold: float, s: np.ndarray | None = None) -> np.ndarray:
    """Which rows of unit vectors are linked. Products near the threshold are made anew pair
    by pair, so that a pair is judged alike wherever it is met."""
    s = x @ y.T if s is None else s
    linked = s >= threshold
    i, j = np.nonzero(np.abs(s - threshold) < 1e-12)
    linked[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return linked


def _by_length(pdf: pd.DataFrame):
    for _, part in pdf.groupby(pdf["e"].map(len), sort=True):
        yield part.reset_index(drop=True)


def _tables(bits: int, threshold: float) -> int:
    """As many tables as let a pair at the threshold share a bucket with the probability ``SHARED``."""
    one = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return max(TABLES, math.ceil(math.log(1 - SHARED) / math.log1p(-one))) if one < 1 else TABLES


def _signatures(tables: int, bits: int, seed: int = 11):
    def sign(parts):
        for pdf in parts:
            for part in _by_length(pdf):
                x = _unit(part["e"])
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], tables * bits))
                on = (x @ planes > 0).reshape(len(x), tables, bits)
                g = (on * (1 << np.arange(bits, dtype=np.int64))).sum(2) * tables + np.arange(tables)
                yield pd.DataFrame({"g": g.ravel() * 4096 + x.shape[1] % 4096, "v": np.repeat(part["v"].to_numpy(), tables)})

    return sign


def _best(v: np.ndarray, u: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    """The distinct neighbours of each v, the nearest first."""
    order = np.lexsort((u, -s, v))
    v, u, s = v[order], u[order], s[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (u[1:] != u[:-1])])
    v, u, s = v[new], u[new], s[new]
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    ends = np.append(starts[1:], len(v))
    cut = lambda x: [x[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pd.DataFrame({"v": v[starts], "s": cut(s), "u": cut(u)})


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what a symmetric matrix of links connects, few at any one vector where they can be."""
    left, ends, starts = linked.any(1), [], []
    for first in np.flatnonzero(left):
        if not left[first]:
            continue
        left[first], queue = False, [first]
        for i in queue:
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            queue.extend(new.tolist())
            ends.append(new)
            up = new[np.maximum(np.arange(len(new)) // FAN - 1, 0)]
            starts.append(np.where((np.arange(len(new)) >= FAN) & linked[up, new], up, i))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends])


def _meet(threshold: float):
    """The members of each g are compared; of each the k best that beat its kth neighbour are kept, and a forest of all links."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        vs, us, ss = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        ties, tied, crowded = [np.empty((0, 2), np.int64)], [np.empty(0)], [np.empty(0, np.int64)]
        # by v, too: forests and ties must not depend on the order in which rows arrive
        for part in _by_length(pdf.sort_values(["g", "v"])):
            x, v, g = _unit(part["e"]), part["v"].to_numpy(), part["g"].to_numpy()
            kth, k = part["kth"].to_numpy(), part["k"].to_numpy()
            cut = np.flatnonzero(g[1:] != g[:-1]) + 1
            for a, b in zip([0, *cut], [*cut, len(g)], strict=True):
                if b - a < 2:
                    continue
                s = x[a:b] @ x[a:b].T
                np.fill_diagonal(s, -3)
                linked = _linked(x[a:b], x[a:b], threshold, s)
                # as many links as the longest list holds: no list would do, so none is kept
                full = linked.sum(1) >= LONGEST
                crowded.append(v[a:b][full])
                i, j = _forest(linked)
                i, j = np.concatenate([i, j]), np.concatenate([j, i])
                ties.append(np.stack([v[a + i], v[a + j]], 1))
                tied.append(np.einsum("ij,ij->i", x[a + i], x[a + j]))
                n = min(int(k[a:b].max()), b - a - 1)
                top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                near = np.take_along_axis(s, top, 1)
                order = np.argsort(-near, axis=1)
                top, near = np.take_along_axis(top, order, 1), np.take_along_axis(near, order, 1)
                i, j = np.nonzero((near > kth[a:b, None] + 1e-12) & (np.arange(n) < k[a:b, None]) & ~full[:, None])
                j = top[i, j]
                vs.append(v[a + i])
                us.append(v[a + j])
                # pair by pair, so that a pair has one value wherever it is met
                ss.append(np.einsum("ij,ij->i", x[a + i], x[a + j]))
        v, u, s = map(np.concatenate, (vs, us, ss))
        lists = _best(v, u, s) if len(v) else pd.DataFrame({"v": v, "s": [], "u": []})
        ties, first = np.unique(np.concatenate(ties), axis=0, return_index=True)
        crowded = np.unique(np.concatenate(crowded))
        v, tie = np.concatenate([lists["v"], ties[:, 0], crowded]), pd.array([*[None] * len(lists), *ties[:, 1], *[None] * len(crowded)], "Int64")
        none = [np.empty(0)] * len(crowded)
        s = [*lists["s"], *np.concatenate(tied)[first][:, None], *none]
        u = [*lists["u"], *ties[:, 1:], *[x.astype(np.int64) for x in none]]
        return pd.DataFrame({"v": v, "s": s, "u": u, "tie": tie, "crowded": np.arange(len(v)) >= len(v) - len(crowded)})

    return meet


def _met(rows: DataFrame, reps: DataFrame, threshold: float, total: int) -> DataFrame:
    dealt = rows.join(reps.select("v", "e"), "v").withColumn("b", F.pmod(F.xxhash64("g"), F.lit(max(1, -(-total // GROUP_ROWS)))))
    met = dealt.groupBy("b").applyInPandas(_meet(threshold), LISTS)
    return settle(met.select("v", F.arrays_zip("s", "u").alias("near"), "tie", "crowded"))


def _ties(met: DataFrame) -> DataFrame:
    return met.where("tie is not null").select(F.greatest("v", "tie").alias("a"), F.least("v", "tie").alias("b"))


def _compare(groups: DataFrame, reps: DataFrame, threshold: float, salt: int, full: bool = False) -> DataFrame:
    """Lists and ties from ``(g, v, kth, k)``. Groups over ``TILE`` are dealt into tiles, anew with every salt.

    If ``full``, members outside of the group's largest component then are
    compared with all members, which costs their number times the group's.
    """
    sizes = settle(groups.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("hub")).where("n > 1"))
    tiles = F.ceil(F.col("n") / TILE)
    held = groups.join(sizes, "g").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("v", "g", F.lit(salt)), tiles))
    # one member of a large group is in all of its tiles, and so connects those that are near it
    several = F.when(F.col("v") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).otherwise(F.array("tile"))
    rows = held.select("g", "v", "kth", "k", "n", F.explode(several).alias("tile"))
    rows = rows.select(F.when(F.col("n") > TILE, F.xxhash64("g", "tile")).otherwise(F.col("g")).alias("g"), "v", "kth", "k")
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    met = _met(rows, reps, threshold, total)
    if not full or most <= TILE:
        return met
    roots = settle(components(_ties(met))).select(F.col("node").alias("v"), "root")
    large = settle(held.where("tiles > 1").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")))
    # the members of the commonest component of a group know each other; the others are compared with all
    most_common = large.groupBy("g", "root").agg(F.count("*").alias("in_root")).groupBy("g").agg(F.max_by("root", F.struct("in_root", "root")).alias("main"), F.sum("in_root").alias("all"), F.max("in_root").alias("in_main"))
    mixed = settle(most_common.where(F.col("all") > F.col("in_main")).select("g", "main", F.ceil((F.col("all") - F.col("in_main")) / TILE).alias("parts")))
    every = large.join(mixed, "g")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pairs = every.select("g", "v", "kth", "k", "tile", each("parts").alias("part"))
    others = every.where(F.col("root") != F.col("main")).withColumn("part", F.pmod(F.xxhash64("v", F.lit(salt)), "parts"))
    pairs = pairs.unionByName(others.select("g", "v", "kth", "k", each("tiles").alias("tile"), "part")).distinct()
    pairs = settle(pairs.select(F.xxhash64("g", "tile", "part").alias("g"), "v", "kth", "k"))
    return met.unionByName(_met(pairs, reps, threshold, count)) if (count := pairs.count()) else met


def _merge(lists: DataFrame, threshold: float) -> DataFrame:
    """``(v, k, near, full, crowded)`` of ``(v, k, near, crowded)``: the k best of all lists of v.

    A list of links only is ``full``, and gets twice the length up to
    ``LONGEST``; one that is full at that length makes v crowded.
    """
    rows = lists.groupBy("v").agg(F.max("k").alias("k"), F.collect_list(F.when(~F.col("crowded"), F.col("near"))).alias("near"), F.max("crowded").alias("crowded"))
    near = F.when(~F.col("crowded"), F.col("near")).otherwise(F.slice("near", 1, 0))
    rows = rows.select("v", "k", "crowded", F.slice(F.sort_array(F.array_distinct(F.flatten(near)), asc=False), F.lit(1), F.col("k")).alias("near"))
    full = (F.size("near") > 0) & (F.size("near") >= F.col("k")) & (F.try_element_at("near", F.lit(-1))["s"] >= threshold)
    crowded = F.col("crowded") | (full & (F.col("k") >= LONGEST))
    return settle(rows.select("v", F.when(full, F.least(F.col("k") * 2, F.lit(LONGEST))).otherwise(F.col("k")).alias("k"), "near", full.alias("full"), crowded.alias("crowded")))


def _progress(state: DataFrame, threshold: float) -> tuple[int, int]:
    """How many lists are still to grow, and the links that all lists hold; crowded vectors count as lists of the longest."""
    links = F.when(F.col("crowded"), LONGEST).otherwise(F.size(F.filter("near", lambda x: x["s"] >= threshold)))
    return tuple(state.agg(F.count_if(F.col("full") & ~F.col("crowded")), F.coalesce(F.sum(links), F.lit(0))).first())


def _round(state: DataFrame, reps: DataFrame, threshold: float, salt: int) -> DataFrame:
    """Vectors meet at each neighbour that they have: those with a neighbour in common, and the neighbour.
    Crowded ones stay away: their groups are counted exactly in the end."""
    kth = F.when(F.size("near") >= F.col("k"), F.element_at("near", -1)["s"]).otherwise(-2.0)
    at = F.explode(F.concat(F.array("v"), F.col("near.u"))).alias("g")
    return _compare(state.where("not crowded and size(near) > 0").select(at, "v", kth.alias("kth"), "k"), reps, threshold, salt)


def _facts(state: DataFrame, ties: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``, the edges found, and ``(v, root, dense)`` of the vectors that have any."""
    near = state.select(F.col("v"), F.explode("near").alias("x")).where(F.col("x.s") >= threshold)
    edges = near.select(F.greatest("v", "x.u").alias("a"), F.least("v", "x.u").alias("b"))
    edges = settle(edges.unionByName(ties.select("a", "b")).distinct())
    roots = settle(components(edges).select(F.col("node").alias("v"), "root"))
    dense = settle(roots.join(state.where("crowded").select("v"), "v", "left_semi").select("root").distinct().withColumn("dense", F.lit(True)))
    return edges, settle(roots.join(dense, "root", "left").select("v", "root", F.coalesce("dense", F.lit(False)).alias("dense")))


def audit(reps: DataFrame, edges: DataFrame, roots: DataFrame, threshold: float = THRESHOLD, size: int = AUDIT) -> tuple[float | None, int]:
    """The share of true links that were found, and how many true links were seen; None where none were.

    Hashed samples of ``size`` vectors with links, of a vector of each of
    ``size`` components, and of ``size`` vectors of any kind are compared with
    all rows; until ``AUDIT_LINKS`` links are seen, the last sample grows up to
    ``AUDIT_MOST``. The average over the vectors that have links and that over
    their components, where a large one weighs no more than a small one, are
    both taken; the lower counts. The samples are bounded, so they may come to
    the driver. Links inside of dense groups are counted exactly later, so
    there it is being in the group that counts.
    """
    by = lambda column, k: F.xxhash64(column, F.lit(k))
    one = roots.groupBy("root").agg(F.min_by("v", by("v", 7)).alias("v")).orderBy(by("root", 7)).limit(size).select("v")
    fixed = settle(roots.orderBy(by("v", 6)).limit(size).select("v").unionByName(one))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    while True:
        asked = settle(fixed.unionByName(reps.orderBy(by("v", 5)).limit(size).select("v")).distinct())
        known = reps.select("v", "e").join(F.broadcast(asked), "v", "left_semi").join(roots, "v", "left")
        near = both.join(F.broadcast(asked.withColumnRenamed("v", "a")), "a", "left_semi").groupBy("a").agg(F.collect_set("b").alias("near"))
        # no nulls beside numbers: pandas would make them doubles
        asked = known.join(near.withColumnRenamed("a", "v"), "v", "left").select("v", "e", F.coalesce("root", "v").alias("root"), F.coalesce("dense", F.lit(False)).alias("dense"), F.coalesce("near", F.array().cast("array<bigint>")).alias("near")).toPandas()
        counts = _true_links(reps, roots, asked, threshold)
        seen = int(counts["n"].sum()) if len(counts) else 0
        if seen >= AUDIT_LINKS or size >= AUDIT_MOST:
            break
        size = min(size * 8, AUDIT_MOST)
    if not seen:
        return None, 0
    share = counts["met"] / counts["n"]
    return float(min(share.mean(), share.groupby(counts["root"]).mean().mean())), seen


def _true_links(reps: DataFrame, roots: DataFrame, asked: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """``(v, root, n, met)`` of the asked vectors that have links: how many, and how many of these were found."""
    queries = [(p["v"].to_numpy(), p["root"].to_numpy(), p["dense"].to_numpy(), [np.array(n, np.int64) for n in p["near"]], _unit(p["e"])) for p in _by_length(asked)]

    def truth(parts):
        for pdf in parts:
            for part in _by_length(pdf):
                x, v, root = _unit(part["e"]), part["v"].to_numpy(), part["root"].to_numpy()
                for q, own, dense, near, y in queries:
                    if y.shape[1] == x.shape[1]:
                        linked = _linked(y, x, threshold) & (q[:, None] != v)
                        n = linked.sum(1)
                        met = np.array([(root[at] == o).sum() if d else np.isin(v[at], k).sum() for at, o, d, k in zip(map(np.flatnonzero, linked), own, dense, near, strict=True)], np.int64)
                        yield pd.DataFrame({"v": q, "root": own, "n": n, "met": met})[n > 0]

    rows = reps.select("v", "e").join(roots.select("v", "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    return rows.mapInPandas(truth, "v long, root long, n long, met long").groupBy("v", "root").agg(F.sum("n").alias("n"), F.sum("met").alias("met")).toPandas()


def _sums(parts):
    """The sum of each group's unit vectors, a batch at a time."""
    for pdf in parts:
        for c, part in pdf.groupby("c"):
            yield pd.DataFrame({"c": [c], "sum": [_unit(part["e"]).sum(0).tolist()]})


def _angles(parts):
    for pdf in parts:
        for part in _by_length(pdf):
            x, y = _unit(part["e"]), np.array(part["centre"].tolist(), np.float64).reshape(len(part), -1)
            length = np.sqrt(np.einsum("ij,ij->i", y, y))
            y = np.where(length[:, None] > 1e-9, y / np.maximum(length, 1e-9)[:, None], np.eye(1, x.shape[1]))
            yield part[["v", "c", "m"]].assign(angle=np.arccos(np.clip(np.einsum("ij,ij->i", x, y), -1, 1)))


def _tiles(threshold: float):
    """Per vector the number of vectors linked to it, copies counted, among those it meets here."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        v_, n_ = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for _, pair in pdf.groupby(["c", "i", "j"], sort=False):
            x, v, m = _unit(pair["e"]), pair["v"].to_numpy(), pair["m"].to_numpy()
            mine, i, j = pair["own"].to_numpy(), pair["i"].iloc[0], pair["j"].iloc[0]
            left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            linked = _linked(x[left], x[right], threshold)
            if i == j:
                np.fill_diagonal(linked, False)
            v_.append(v[left])
            n_.append(linked @ m[right])
            if i != j:
                v_.append(v[right])
                n_.append(m[left] @ linked)
        return pd.DataFrame({"v": np.concatenate(v_), "n": np.concatenate(n_)})

    return count


def count_dense(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(v, n)``: the links of every vector of ``(v, c, e, m)`` inside its group c, exactly.

    The angle between two members is at most the sum and at least the
    difference of their angles from the group's centre. Bins of angles (there
    are a few hundred at most) whose ends settle it are counted as wholes; the
    others are compared, in tiles.
    """
    limit = math.acos(min(1.0, threshold))
    sums = members.select("c", "e").mapInPandas(_sums, "c long, sum array<double>").select("c", F.posexplode("sum").alias("i", "x"))
    centres = sums.groupBy("c", "i").agg(F.sum("x").alias("x")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centre"))
    held = settle(members.join(settle(centres), "c").mapInPandas(_angles, "v long, c long, m long, angle double"))
    held = held.withColumn("bin", F.floor(F.col("angle") / BIN))
    bins = settle(held.groupBy("c", "bin").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.sum("m").alias("sum"), F.ceil(F.count("*") / TILE).alias("tiles")))
    a, b = bins.alias("a"), bins.select(*(F.col(c).alias(c) for c in bins.columns)).alias("b")
    pairs = a.join(b, F.col("a.c") == F.col("b.c"))  # bins, not members
    near = F.col("a.hi") + F.col("b.hi") <= limit - SLACK
    far = F.greatest(F.col("a.lo"), F.col("b.lo")) - F.least(F.col("a.hi"), F.col("b.hi")) >= limit + SLACK
    wholes = pairs.where(near).groupBy("a.c", "a.bin").agg(F.sum("b.sum").alias("whole"), F.max(F.col("a.bin") == F.col("b.bin")).alias("itself"))
    out = held.join(settle(wholes), ["c", "bin"]).select("v", (F.col("whole") - F.when(F.col("itself"), F.col("m")).otherwise(0)).alias("n"))
    doubt = settle(pairs.where(~near & ~far).select(F.col("a.c").alias("c"), F.col("a.bin").alias("bin"), F.col("a.tiles").alias("tiles"), F.col("b.bin").alias("other"), F.col("b.tiles").alias("others")))
    rows = held.join(doubt, ["c", "bin"]).select("v", "c", "m", F.struct("bin", F.pmod(F.xxhash64("v"), "tiles").alias("t")).alias("own"), "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("t"))
    rows = settle(rows.select("v", "c", "m", "own", F.struct(F.col("other").alias("bin"), "t").alias("with")))
    number = lambda x: x["bin"] * (1 << 40) + x["t"]
    rows = rows.select("v", "c", "m", number(F.col("own")).alias("own"), number(F.least("own", "with")).alias("i"), number(F.greatest("own", "with")).alias("j"))
    groups = max(1, -(-rows.count() // (4 * TILE)))
    rows = rows.join(members.select("v", "e"), "v").withColumn("b", F.pmod(F.xxhash64("c", "i", "j"), F.lit(groups)))
    return out.unionByName(rows.groupBy("b").applyInPandas(_tiles(threshold), "v long, n long")).groupBy("v").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept, audit_recall, audit_links)``, a row for each of ``vectors``.

    Vectors that are null, zero, empty or hold null or non-finite components,
    and rows of a null id, link with nothing. Equal vectors are compared as
    one; their rows link with each other, repeated ids included. Vectors of
    different lengths don't link. An empty table gives no rows; ``embedding``
    and ``vec_id`` alone are read. ``audit_recall`` is the recall of links
    that the audit measured, ``audit_links`` how many true links it saw; the
    recall is null where it saw none, and 1 where all were compared with all.
    """
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = settle(rows.select("vec_id", F.when(F.col("vec_id").isNotNull() & fine, F.transform("e", lambda x: x + F.lit(0.0))).alias("e")))
    # e as key: groups of copies are counted before they are shuffled
    reps = settle(rows.where("e is not null").groupBy("e").agg(F.min("vec_id").alias("least"), F.count("*").alias("m")))
    # different vectors may share an id; a node's number is its own
    reps = settle(reps.select(F.xxhash64("e").alias("v"), "least", "m", "e"))
    edges, roots, recall, seen = descend(reps, threshold)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    plain = both.join(reps.select(F.col("v").alias("b"), "m"), "b").groupBy("a").agg(F.sum("m").alias("n")).withColumnRenamed("a", "v")
    plain = roots.where("not dense").select("v").join(plain, "v")
    dense = settle(roots.where("dense").select("v", F.col("root").alias("c")).join(reps.select("v", "e", "m"), "v"))
    counts = plain if dense.isEmpty() else plain.unionByName(count_dense(dense, threshold))
    names = settle(roots.join(reps.select("v", "least"), "v").groupBy("root").agg(F.min("least").alias("component_id")))
    named = settle(roots.join(names, "root").select("v", "component_id"))
    facts = reps.join(settle(counts), "v", "left").join(named, "v", "left")
    facts = settle(facts.select("v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    out = rows.select("vec_id", F.when(F.col("e").isNotNull(), F.xxhash64("e")).alias("v")).join(facts, "v", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return out.select("*", F.lit(recall).cast("double").alias("audit_recall"), F.lit(seen).cast("long").alias("audit_links"))


def descend(reps: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, float | None, int]:
    """Edges ``(a, b)`` between distinct vectors ``(v, e)``, ``(v, root, dense)`` of those that have any, and the audit's figures.

    When the audit is not content after the last round, all vectors are
    compared with all, tile by tile, which costs the square of the table;
    what is connected then counts as dense, and is counted exactly.
    """
    bits = min(40, max(1, (reps.count() // (TILE // 2)).bit_length()))
    tables = _tables(bits, threshold)

    def drawn(k: int, salt: int) -> DataFrame:
        groups = settle(reps.select("v", "e").mapInPandas(_signatures(tables, bits, 11 + salt), "g long, v long"))
        return _compare(groups.select("g", "v", F.lit(-2.0).alias("kth"), F.lit(k).alias("k")), reps, threshold, salt, full=True)

    new = lambda met, k: met.select("v", F.lit(k).alias("k"), "near", "crowded")
    k = NEIGHBOURS
    met = drawn(k, 0)
    # ties stay at hand: one that a short list had no room for has a place when the list has grown
    state, ties = _merge(new(met, k), threshold), met.where("tie is not null")
    _, links = _progress(state, threshold)
    for r in range(1, MOST_ROUNDS + 1):
        met = _round(state, reps, threshold, r)
        if r > ROUNDS and k > NEIGHBOURS:
            met = met.unionByName(drawn(k, r))
        lists = state.select("v", F.greatest("k", F.lit(k)).alias("k"), "near", "crowded").unionByName(new(met, k)).unionByName(new(ties, k))
        state, ties = _merge(lists, threshold), ties.unionByName(met.where("tie is not null"))
        before, (growing, links) = links, _progress(state, threshold)
        if r >= ROUNDS and (r == MOST_ROUNDS or not growing and links - before <= FEW * links):
            edges, roots = _facts(state, _ties(ties), threshold)
            recall, seen = audit(reps, edges, roots, threshold)
            if recall is None or recall >= RECALL:
                return edges, roots, recall, seen
            k *= 2
    everyone = reps.select(F.lit(0).cast("long").alias("g"), "v", F.lit(-2.0).alias("kth"), F.lit(1).alias("k"))
    edges = settle(_ties(_compare(everyone, reps, threshold, 0, full=True)).select("a", "b").distinct())
    roots = components(edges).select(F.col("node").alias("v"), "root", F.lit(True).alias("dense"))
    return edges, settle(roots), 1.0, seen
