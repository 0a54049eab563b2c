"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position has a nonzero vector of ``radius + 1`` bits; every nonzero
vector ``v`` gives a mask of the positions whose vector has an odd product
with ``v``. Of any ``radius`` positions some mask takes none, so two
fingerprints that differ there alone agree under it: every pair within the
radius meets in some of the ``2^(radius+1) - 1`` tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import settle, words_of
from .components import components

BITS, RADIUS, SEED, WIDTH = 64, 2, 42, 3
#: Buckets of up to so many fingerprints are compared at once; larger ones are
#: split further by the balls around their members, which is exact too.
BUCKET = 48
SLICE = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The covering masks, as signed 64-bit numbers."""
    n = (1 << (radius + 1)) - 1
    return [_signed(sum(1 << i for i in range(bits) if (i % n + 1 & v).bit_count() & 1)) for v in range(1, n + 1)]


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The signed 64-bit SimHash of a whole text over its word shingles."""
    w = words_of(text)
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < width else map(b" ".join, zip(*(w[k:] for k in range(width)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), SLICE):
        part = h[k : k + SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints ``fp`` of ``prints``.

    They connect exactly what pairs within the radius connect. Small buckets
    give their pairs within the radius. A larger bucket is dealt anew by every
    fingerprint's ball of radius 1 over the bits outside the mask: two
    fingerprints at most 2 apart share a member of their balls, a ball member
    has few owners, and all its owners are within 2 of each other, so a star
    to the least owner serves. Nothing grows with the square of a bucket.
    """
    if radius != 2:
        raise ValueError("large buckets are split for a radius of 2")
    m = masks(BITS, radius)
    tables = F.posexplode(F.array(*map(F.lit, m))).alias("t", "mask")
    rows = prints.select("fp", tables).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    rows = settle(rows)
    sizes = settle(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    rows = settle(rows.join(sizes, ["t", "key"]).select("t", "key", "fp", "n"))
    near = lambda x, y: (F.bit_count(x.bitwiseXOR(y)) <= radius) & (x < y)
    small = rows.where(F.col("n") <= BUCKET).groupBy("t", "key").agg(F.collect_list("fp").alias("f"))
    pairs = F.flatten(F.transform("f", lambda x: F.transform(F.filter("f", lambda y: near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    small = small.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    flips = F.array(*(F.array(*(F.lit(_signed(1 << i)) for i in range(BITS) if not k >> i & 1)) for k in m))
    ball = F.concat(F.array("fp"), F.transform(F.element_at(flips, F.col("t") + 1), lambda bit: F.col("fp").bitwiseXOR(bit)))
    large = rows.where(F.col("n") > BUCKET).select("fp", F.explode(ball).alias("mid"))
    # without the table in the key: a star then joins over all tables at once
    least = large.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.collect_set("fp").alias("f")).where("a < z")
    large = least.select("a", F.explode("f").alias("b")).where("a < b")
    return small.unionByName(large).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links of 2 differing bits
    or fewer lead to, the document's own included. Null and empty texts have
    fingerprint zero and link like any other; null ids get a component but
    never name one; repeated rows stay; an empty table gives none. Other
    columns are not read. Equal fingerprints are one node, so groups of
    copies cost one row each.
    """
    prints = settle(docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(F.col(text)).alias("fp")))
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(links(nodes.select("fp")))
    rooted = settle(nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    rooted = settle(rooted.join(names, "root").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(rooted, "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that have a smaller id in their component.

    Of rows that repeat the kept id, all stay; rows with a null id stay.
    """
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
