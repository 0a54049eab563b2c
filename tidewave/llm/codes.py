"""Product quantisation of vectors, its codebooks by Lloyd's rounds over cover trees.

Rows are put into trees where they lie, ``TREE`` at a time, one cover tree for
each part of the vectors: a node holds the points within its reach of its
centre, the centre is its first child's centre too, and centres of one node's
children are further apart than the children's limit. Points are kept in the
order of the tree, so a node is a run of points, and running sums over that
order give any node's sum. The trees are written out once and read again in
every round.

A round walks the trees from the roots, a level of nodes at a time. Where a
node's centre is nearer to one entry than to any other by more than twice the
node's reach, the triangle inequality gives that entry to all its points, and
their sum is a difference of running sums. Other nodes are replaced by their
children, and the points of leaves that stay in doubt are compared with all
entries. A task's answer is a sum and a count for each entry of each part.

All components are integers and all comparisons exact, so neither the trees
nor the partitions show in the result.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Points of a tree; points of a node that has no children; how much nearer to its centre a child's points are.
TREE, LEAF, SHRINK = 1024, 16, 1.3
#: Components are held between these bounds, so that 64 bits hold every sum.
REACH = 1 << 26
#: Shares of the rows among which the cut behind the first entries is looked for.
SHARES = [10.0**-k for k in range(8, -1, -1)]


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, x)`` of the vectors without null or non-finite components, as whole numbers."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select("vec_id", "label", x.alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.floor(F.greatest(F.lit(float(-REACH)), F.least(F.lit(float(REACH)), c * scale)))
    return rows.where(F.col("x").isNotNull() & fine).withColumn("x", F.transform("x", whole))


def first_entries(rows: DataFrame, entries: int = ENTRIES) -> list[np.ndarray]:
    """The vectors of the smallest ids, by id and components; nulls are the largest.

    Approximate quantiles give an id that has few rows below it but enough, so
    that not every task has to send its own first rows to the last one.
    """
    n, cuts = rows.agg(F.count("vec_id"), F.percentile_approx("vec_id", SHARES, 100_000)).first()
    by = [F.asc_nulls_last("vec_id"), "x"]
    for share, cut in zip(SHARES, cuts or [], strict=False):
        if share * n >= 2 * entries:
            found = rows.where(F.col("vec_id") <= cut).orderBy(*by).limit(entries).select("x").collect()
            if len(found) >= entries:
                return [np.array(r["x"], np.int64) for r in found]
    return [np.array(r["x"], np.int64) for r in rows.orderBy(*by).limit(entries).select("x").collect()]


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    at = [k * width // parts for k in range(parts + 1)]
    return list(zip(at[:-1], at[1:], strict=True))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of whole vectors, exactly: products of doubles where all sums stay below 2^53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)), 1)
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:
        x, y = x.astype(np.float64), y.astype(np.float64)
        d = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)
        return d.astype(np.int64)
    d = np.zeros((len(x), len(y)), np.int64)
    for k in range(x.shape[1]):
        d += (x[:, k, None] - y[:, k]) ** 2
    return d


class CoverTree:
    """Points in the tree's order, and its nodes level by level, each with its run of points, its reach and its children."""

    def __init__(self, order: np.ndarray, points: np.ndarray, nodes: np.ndarray):
        self.order, self.points = order, points
        self.start, self.end, self.reach, self.first, self.children = nodes
        self.sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])

    @staticmethod
    def build(points: np.ndarray, leaf: int = LEAF, shrink: float = SHRINK) -> CoverTree:
        between = distances(points, points)
        order = np.arange(len(points))
        start, end, reach, first, children = [0], [len(points)], [], [], []
        k = 0
        while k < len(start):
            ids = order[start[k] : end[k]]
            d = between[ids[0], ids]
            reach.append(int(d.max()))
            first.append(len(start))
            if len(ids) > leaf and reach[k]:
                limit, at, left = reach[k] / shrink**2, start[k], ids.copy()
                while len(left):
                    near = d <= limit
                    group = left[near]
                    order[at : at + len(group)] = group
                    start.append(at)
                    at += len(group)
                    end.append(at)
                    left = left[~near]
                    d = between[left[0], left] if len(left) else d
            children.append(len(start) - first[k])
            k += 1
        return CoverTree(order, points[order], np.array([start, end, reach, first, children], np.int64))

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entry of every point, in the tree's order; the sum and the count of every entry's points."""
        entry = np.empty(len(self.points), np.int64)
        sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
        nodes, doubt = np.zeros(1, np.int64), []
        while len(nodes):
            d = distances(self.points[self.start[nodes]], book)
            best = d.argmin(1)
            rows = np.arange(len(nodes))
            near = d[rows, best].astype(np.float64)
            d[rows, best] = np.iinfo(np.int64).max
            wide = self.reach[nodes]
            # whole nodes: copies of one point, or points that no other entry can be as near to
            sure = (wide == 0) | ((np.sqrt(near) + 2 * np.sqrt(wide)) * (1 + 1e-12) < np.sqrt(d.min(1).astype(np.float64)))
            a, b, e = self.start[nodes[sure]], self.end[nodes[sure]], best[sure]
            entry[spans(a, b)] = np.repeat(e, b - a)
            np.add.at(sums, e, self.sums[b] - self.sums[a])
            np.add.at(counts, e, b - a)
            nodes = nodes[~sure]
            ends = self.children[nodes] == 0
            doubt.append(spans(self.start[nodes[ends]], self.end[nodes[ends]]))
            nodes = nodes[~ends]
            nodes = spans(self.first[nodes], self.first[nodes] + self.children[nodes])
        at = np.concatenate(doubt)
        entry[at] = distances(self.points[at], book).argmin(1)
        np.add.at(sums, entry[at], self.points[at])
        np.add.at(counts, entry[at], 1)
        return entry, sums, counts


def spans(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of all ranges from a up to b, one after the other."""
    n = b - a
    return np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else a, n) + np.arange(n.sum())


def _packed(trees: list[CoverTree]) -> bytes:
    out = io.BytesIO()
    narrow = lambda x: x.astype(np.min_scalar_type(-int(np.abs(x).max(initial=0)) - 1))
    arrays = {}
    for k, t in enumerate(trees):
        nodes = np.stack([t.start, t.end, t.reach, t.first, t.children])
        arrays |= {f"order{k}": narrow(t.order), f"points{k}": narrow(t.points), f"nodes{k}": narrow(nodes)}
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes, parts: int) -> list[CoverTree]:
    with np.load(io.BytesIO(data)) as held:
        wide = lambda name: held[name].astype(np.int64)
        return [CoverTree(wide(f"order{k}"), wide(f"points{k}"), wide(f"nodes{k}")) for k in range(parts)]


def _grow(width: int, parts: int, size: int):
    """A row for each tree's worth of rows: who they are, and a tree for each part."""

    def row(held: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(held["x"].to_list()).astype(np.int64).reshape(len(held), width)
        trees = _packed([CoverTree.build(x[:, a:b]) for a, b in cuts(width, parts)])
        return pd.DataFrame({"who": [held["who"].to_list()], "trees": [trees]})

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= size:
                yield row(held[:size])
                held = held[size:].reset_index(drop=True)
        if held is not None and len(held):
            yield row(held)

    return grow


def _sum_up(books: list[np.ndarray]):
    """Of a task's trees the sum and count of every entry that has points."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books]
        for pdf in batches:
            for data in pdf["trees"]:
                for (s, n), tree, book in zip(total, _unpacked(data, len(books)), books, strict=True):
                    _, more, counts = tree.nearest(book)
                    s += more
                    n += counts
        for k, (s, n) in enumerate(total):
            if len(at := np.flatnonzero(n)):
                yield pd.DataFrame({"part": k, "entry": at, "n": n[at], "total": list(s[at])})

    return sums


def _encode(books: list[np.ndarray]):
    digits = np.array([f"{k:02x}" for k in range(max(map(len, books)))])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for who, data in zip(pdf["who"], pdf["trees"], strict=True):
                code, error = np.full(len(who), ""), np.zeros(len(who), np.int64)
                for tree, book in zip(_unpacked(data, len(books)), books, strict=True):
                    entry, back = tree.nearest(book)[0], np.argsort(tree.order)
                    code = np.char.add(code, digits[entry[back]])
                    error += ((tree.points - book[entry]) ** 2).sum(1)[back]
                yield pd.DataFrame({"who": [[w] for w in who], "code": code, "error": error})

    return encode


def _sum_of(column: Column, width: int) -> list[Column]:
    return [F.sum(F.try_element_at(column, F.lit(i + 1))).alias(f"s{i}") for i in range(width)]


def learn(trees: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds; of each round a row for each entry, a fixed number, comes to the driver."""
    width = max(b.shape[1] for b in books)
    for _ in range(rounds):
        sums = trees.select("trees").mapInPandas(_sum_up(books), "part int, entry long, n long, total array<long>")
        books = [b.copy() for b in books]
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *_sum_of(F.col("total"), width)).collect():
            book = books[r["part"]]
            book[r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(book.shape[1])]
    return books


def fingerprint(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, tree: int = TREE) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of ``(vec_id, embedding, label)``.

    Vectors that are null or hold null or non-finite components are dropped,
    and so are those of another length than the first one by id. A length
    that ``parts`` doesn't divide is cut as evenly as it goes. Components
    beyond ``REACH`` count as that. Repeated rows and repeated ids are rows of
    their own; null ids are coded and come last where the first entries are
    chosen; with fewer rows than entries there are as many entries as rows; an
    empty table gives no rows. ``label_error`` is null where it doesn't fit a
    long. Other columns are not read.
    """
    rows = integers(vectors)
    found = first_entries(rows, entries)
    width = len(found[0]) if found else 0
    first = [x for x in found if len(x) == width]
    if len(first) < len(found):
        first = first_entries(rows.where(F.size("x") == width), entries)
    label = vectors.schema["label"].dataType.simpleString()
    who = f"struct<vec_id: long, label: {label}>"  # no nulls beside numbers: pandas would make them doubles
    held = rows.where(F.size("x") == width).select(F.struct(F.col("vec_id").cast("long").alias("vec_id"), "label").alias("who"), "x")
    held = stored(held.mapInPandas(_grow(width, parts, tree), f"who array<{who}>, trees binary"))
    books = [np.stack(first)[:, a:b] for a, b in cuts(width, parts)] if first else [np.zeros((1, 0), np.int64)] * parts
    books = learn(held, books, rounds)
    coded = stored(held.mapInPandas(_encode(books), f"who array<{who}>, code string, error long").select(F.inline("who"), "code", "error"))
    forget(held)
    # a sum is made where the rows lie before it is shuffled, so a label of many rows costs no more than others
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books if first else [])).alias("codebooks_sha256"))


def _oracle() -> str:
    near = "list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x)"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT r, part, min(({near})::BIGINT * {ENTRIES} + entry) AS best FROM pieces p JOIN book{k} b USING (part) GROUP BY r, part)""")
        if k < ROUNDS:
            steps.append(f"""means{k} AS (SELECT part, best % {ENTRIES} AS entry, j, floor(sum(p.x[j])::HUGEINT / count(*)) AS m FROM near{k} JOIN pieces p USING (r, part), unnest(range(1, len(p.x) + 1)) u(j) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (SELECT part, entry, list(m::DOUBLE ORDER BY j) AS x FROM means{k} GROUP BY ALL) m USING (part, entry))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pieces AS MATERIALIZED (SELECT r, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x FROM kept, unnest(range({PARTS})) u(part)),
book0 AS MATERIALIZED (SELECT part, r AS entry, x FROM pieces WHERE r < {ENTRIES}),
{", ".join(steps)},
sha AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM book{ROUNDS})),
coded AS (SELECT r, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM near{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), sha
"""


ORACLE = _oracle()
