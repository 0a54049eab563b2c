"""Near copies by resemblance: SimHash's covering tables and min-wise keys, then a check of every candidate.

At 80 % of common five-word shingles two SimHash fingerprints differ in some 4
to 11 of 64 bits, which covering masks of any usable number don't reach (a
radius of 7 takes 255 tables). So a document has, beside the seven keys of
its fingerprint, a few keys from its least shingles under several orders: a
pair at 80 % shares one with a probability over 99.9 %. Documents that meet in
any table are compared by their shingles, in full up to ``SKETCH`` distinct
ones and by the least ``SKETCH`` beyond that; estimates within four standard
errors of the threshold, on either side, are settled by the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, words_of
from .components import components
from .simhash import SEED, fingerprint, masks

WIDTH, SIMILAR = 5, 0.8
#: Tables of min-wise keys, shingles of a key, and shingles of a sketch.
TABLES, BAND, SKETCH = 8, 2, 160
#: Documents of a bucket that are compared at a time, and rows of a task's group.
TILE, GROUP_ROWS = 512, 8192
_ORDERS = np.random.default_rng(17).integers(1, 1 << 63, (TABLES * BAND, 1)).astype(np.uint64) | np.uint64(1)
_MASKS = np.array(masks(), np.int64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a whole text's word shingles, ascending; a shorter text is one shingle."""
    w = words_of(text)
    if not w:
        return np.empty(0, np.uint64)
    found = [b" ".join(w)] if len(w) < width else map(b" ".join, zip(*(w[k:] for k in range(width)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64))


def _least(h: np.ndarray) -> np.ndarray:
    """The least of the hashes in each order, slice by slice."""
    least = np.full(len(_ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 1 << 16):
        x = h[k : k + (1 << 16)] * _ORDERS
        least = np.minimum(least, (x ^ x >> np.uint64(29)).min(1))
    return least


def _describe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        same, keys, sketches = [], [], []
        for text in pdf["text"]:
            h = shingles(text)
            same.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63))
            least = _least(h).reshape(TABLES, BAND)
            bands = [xxhash.xxh64_intdigest(b.tobytes()) - (1 << 63) for b in least]
            keys.append([*(fingerprint(text) & _MASKS).tolist(), *bands])
            sketches.append((h[:SKETCH] >> np.uint64(1)).astype(np.int64).tolist())
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "body": pdf["body"], "same": same, "keys": keys, "sketch": sketches})


def resemblances(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimates of the resemblance of one sketch to rows of others (padded with the largest long).

    Up to the smaller of the two ends everything is known of both; a sketch
    that is not full has no end, so short texts are compared exactly.
    """
    top = np.iinfo(np.int64).max
    end = np.minimum(np.where(others[:, -1] == top, top - 1, others[:, -1]), sketch[-1] if sketch[-1] != top else top - 1)
    inside = others <= end[:, None]
    common = (np.isin(others, sketch[sketch != top]) & inside).sum(1)
    a = np.searchsorted(sketch, end, side="right")
    return common / np.maximum(a + inside.sum(1) - common, 1)


def _compare(similar: float):
    """Links of a task's buckets, as a forest: what is already together isn't compared.

    Those of long texts whose estimates are up to four standard errors from
    ``similar`` are left for an exact comparison; the others are ``sure``.
    """
    error = 4 * (similar * (1 - similar) / SKETCH) ** 0.5
    doubted, trusted = similar - error, min(similar + error, 1.0)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [np.empty((0, 3), np.int64)]
        pdf = pdf.sort_values(["g", "same"])
        g, v = pdf["g"].to_numpy(), pdf["same"].to_numpy()
        rows = np.full((len(pdf), SKETCH), np.iinfo(np.int64).max, np.int64)
        for k, s in enumerate(pdf["sketch"]):
            rows[k, : len(s)] = s
        long = rows[:, -1] != np.iinfo(np.int64).max
        cut = np.flatnonzero(g[1:] != g[:-1]) + 1
        for a, b in zip([0, *cut], [*cut, len(g)], strict=True):
            own, doubts = pd.factorize(pdf["root"].to_numpy()[a:b])[0], []
            for k in range(b - a - 1):
                at = k + 1 + np.flatnonzero(own[k + 1 :] != own[k])
                if not len(at):
                    continue
                r = resemblances(rows[a + k], rows[a + at])
                whole = ~(long[a + k] | long[a + at])
                sure = r >= np.where(whole, similar, trusted)
                groups, first = np.unique(own[at[sure]], return_index=True)
                near = at[sure][first]
                found.append(np.stack([np.full(len(near), v[a + k]), v[a + near], np.ones(len(near), np.int64)], 1))
                own[np.isin(own, groups)] = own[k]
                near = at[(r >= doubted) & ~sure & ~whole]
                doubts.append(np.stack([np.full(len(near), k), near], 1))
            if doubts:
                i, j = np.concatenate(doubts).T
                i, j = i[own[i] != own[j]], j[own[i] != own[j]]
                found.append(np.stack([v[a + i], v[a + j], np.zeros(len(i), np.int64)], 1))
        x, y, sure = np.concatenate(found).T
        return pd.DataFrame({"a": x, "b": y, "sure": sure == 1}).drop_duplicates()

    return compare


def _links(members: DataFrame, nodes: DataFrame, similar: float, rows: int) -> DataFrame:
    """``(a, b, sure)`` from buckets of ``(g, same, root)``, written out; ``rows``: how many there are."""
    dealt = members.join(nodes.select("same", "sketch"), "same").withColumn("b", F.pmod(F.xxhash64("g"), F.lit(max(1, -(-rows // GROUP_ROWS)))))
    return settle(dealt.groupBy("b").applyInPandas(_compare(similar), "a long, b long, sure boolean").distinct())


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    rooted = components(links.select("a", "b")).withColumnRenamed("node", "same")
    return settle(nodes.select("same", "least").join(rooted, "same", "left").select("same", "least", F.coalesce("root", "same").alias("root")))


def _whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        sets = [shingles(t) for t in pdf["text"]]
        yield pd.DataFrame({"same": [xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63) for h in sets], "whole": [h.view(np.int64).tolist() for h in sets]})


def _verified(doubts: DataFrame, docs: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """Those of ``(a, b)`` whose whole sets of shingles resemble each other enough."""
    wanted = settle(doubts.select(F.explode(F.array("a", "b")).alias("same")).distinct())
    ids = nodes.join(wanted, "same", "left_semi").select(F.col("least").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.withColumnRenamed("doc_id", "i"), F.col("doc_id").eqNullSafe(F.col("i"))).select("text")
    sets = texts.mapInPandas(_whole, "same long, whole array<long>").join(wanted, "same", "left_semi")
    sets = settle(sets.groupBy("same").agg(F.first("whole").alias("whole")))
    x, y = sets.select(F.col("same").alias("a"), F.col("whole").alias("x")), sets.select(F.col("same").alias("b"), F.col("whole").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return doubts.join(x, "a").join(y, "b").where(common >= similar * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``(doc_id, component_id)``: documents by what resembles at least ``similar``, a row for each of ``docs``.

    ``component_id`` is the smallest id of the group. Equal sets of shingles
    are one node, so groups of copies cost one row each. Null and empty texts
    are copies of each other; null ids get a group and never name one;
    repeated rows stay; an empty table gives no rows. A bucket of over
    ``TILE`` different texts is compared within tiles first; only where it is
    not one group then are its tiles compared with each other.
    """
    described, named = _grouped(docs, similar)
    return described.join(named, "same").select("doc_id", "component_id")


def _grouped(docs: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, body, same)`` of each row, ``body`` a hash of its text, and ``(same, root, component_id)``."""
    described = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", body_of(F.col("text")).alias("body"))
    described = settle(described.mapInPandas(_describe, "doc_id string, body long, same long, keys array<long>, sketch array<long>"))
    nodes = settle(described.groupBy("same").agg(F.min(F.col("doc_id").cast("long")).alias("least"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    tables = nodes.where(F.size("sketch") > 0).select("same", F.posexplode("keys").alias("t", "key")).select("same", F.xxhash64("t", "key").alias("g"))
    sizes = settle(tables.groupBy("g").agg(F.count("*").alias("n"), F.min("same").alias("hub")).where("n > 1"))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rows = settle(tables.join(sizes, "g").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("same"), tiles).cast("int")))
    small = rows.where("tiles = 1").select("g", "same")
    # the least text of a large bucket is in all of its tiles, and holds them together
    large = rows.where("tiles > 1").select(F.xxhash64("g", "tile").alias("g"), F.explode(F.array("same", "hub")).alias("same")).distinct()
    links = _links(small.unionByName(large).withColumn("root", F.col("same")), nodes, similar, rows.count())
    rooted = _rooted(nodes, links.where("sure"))
    # large buckets that are not one group
    large = settle(rows.where("tiles > 1").join(rooted.select("same", "root"), "same"))
    mixed = large.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("g")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pairs = large.join(mixed, "g", "left_semi").select("g", "same", "root", "tile", other).where("tile <> other")
    pairs = settle(pairs.select(F.xxhash64("g", F.least("tile", "other"), F.greatest("tile", "other")).alias("g"), "same", "root"))
    if count := pairs.count():
        more = _links(pairs, nodes, similar, count)
        links = links.unionByName(more)
        rooted = rooted if more.where("sure").isEmpty() else _rooted(nodes, links.where("sure"))
    side = lambda k: rooted.select(F.col("same").alias(k), F.col("root").alias(f"root_{k}"))
    doubts = links.where("not sure").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").where("root_a <> root_b")
    doubts = settle(doubts.select("a", "b"))
    if not doubts.isEmpty():
        more = settle(_verified(doubts, docs, nodes, similar))
        rooted = rooted if more.isEmpty() else _rooted(nodes, links.where("sure").select("a", "b").unionByName(more))
    names = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = settle(rooted.join(names, "root").select("same", "root", "component_id"))
    return described.select(F.col("doc_id").cast("long").alias("doc_id"), "body", "same"), named


def body_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of each group: that of the smallest id, of several the one of the least text hash.

    Each row is judged by its own text, so of two texts under one id one may
    stay and one go. Rows of a null id stay where their group has no other;
    of rows that repeat the id and the text one stays; all columns are passed
    on, those of the row that stays; an empty table gives an empty one.
    """
    described, named = _grouped(docs, similar)
    rows = described.join(named, "same").groupBy("root", "doc_id", "body").agg(F.count("*").alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), F.col("body").alias("_body"), F.col("times").alias("_times")))
    kept = settle(rows.groupBy("root").agg(first.alias("k")).select("k._id", "k._body", "k._times"))
    found = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (body_of(F.col("text")) == F.col("_body")))
    if kept.where("_times > 1").isEmpty():
        return found.select(*docs.columns)
    once = found.where("_times = 1").select(*docs.columns)
    return once.unionByName(found.where("_times > 1").dropDuplicates(["_id", "_body"]).select(*docs.columns))
