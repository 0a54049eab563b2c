"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. The documents are range-sorted by source
and key; the sums of the ranges are added up along a source, and a window
inside each range completes the distributed prefix sum. A source's budget is
then cut exactly: whole epochs first, then the documents in front of
the cut, and of the document at the cut the words that are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, settle

WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives its words so often at most.
MOST = 3
#: Rows that one range holds on average, and the fewest ranges.
RANGE_ROWS, RANGES = 65_536, 16


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from rows of ``(source, size)``.

    Sources stand by code point, null last, and the weights repeat over them.
    A target is ``min(most * size, level * weight)``; the level shares all
    words out: it is what resharing the excess, again and again, ends at.
    The windows run over one row a source.
    """
    s = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", n.alias("n"), w.alias("w")).withColumn("full", F.lit(most) * F.col("source_size"))
    by = Window.orderBy(F.col("full") / F.col("w"), "n")
    s = s.withColumn("full_before", F.coalesce(F.sum("full").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("w_after", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.col("full_before")) / F.col("w_after"))
    level = F.min(F.when(F.col("level") <= F.col("full") / F.col("w"), F.struct(F.col("full") / F.col("w"), F.col("n"), F.col("level").alias("v")))).over(Window.partitionBy())
    return s.select("source", "source_size", F.round(F.least(F.col("full").cast("double"), level["v"] * F.col("w")), 6).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, copies)``, a row for each of ``docs``.

    ``taken`` counts the words that the mix takes of the document, repeats
    included; the sum over a source is its target rounded to a whole word.
    ``copies`` is the nearest whole number of times the document is used. The
    order of a source depends on ``doc_id`` and, among rows that repeat one,
    on ``size``, so reruns agree. Null and
    empty texts have size 0 and take 0 words; a null source is a source of
    its own; repeated rows are rows of their own; an empty table gives none.
    Further columns of ``docs`` are not read.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = settle(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row")))
    order = ["key", "doc_id", "size", "row"]  # the row last: rows that repeat an id are no one range
    ranged = rows.repartitionByRange(max(RANGES, -(-rows.count() // RANGE_ROWS)), "source", *order)
    rows = settle(ranged.withColumn("part", F.spark_partition_id()))
    sums = settle(rows.groupBy("source", "part").agg(F.sum("size").alias("words")))
    along = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = sums.select("source", "part", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("before"))
    heads = settle(
        offsets.alias("o").join(targets(sums.select("source", F.col("words").alias("size")), weights, most).alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
        .select("o.source", "part", "before", "source_size", "target", F.round("target").cast("long").alias("budget"))
    )
    rows = rows.alias("r").join(heads.alias("h"), F.col("r.source").eqNullSafe(F.col("h.source")) & (F.col("r.part") == F.col("h.part")))
    rows = rows.select("doc_id", "r.source", "r.part", "key", "size", "row", "before", "source_size", "target", "budget")
    inside = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    left = F.col("budget") - epochs * F.col("source_size") - F.col("before")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        (epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", left))).cast("long").alias("taken"),
        (epochs + F.when((left > 0) & (2 * left >= F.col("size")), 1).otherwise(0)).cast("int").alias("copies"),
    )


def repeat(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` mixed: every document as a whole, ``copies`` times.

    A document that the mix uses less than half of goes. Documents with one id
    and one source, null ones too, are each repeated as their id is; the plan
    has a row for each of them.
    """
    plan = mix(docs, weights, most).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    plan = settle(plan)
    d = docs.withColumn("_size", n_words(F.col("text"))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d._size") == F.col("p.size"))
    rows = d.join(plan.alias("p"), same).select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("p.copies").alias("_copies"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][n % 3 + 1]::DOUBLE AS w, 3 * source_size AS full_size FROM n),
o AS (SELECT *, coalesce(sum(full_size) OVER (ORDER BY full_size / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
      sum(w) OVER (ORDER BY full_size / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - full_before) / w_after AS level FROM o),
v AS (SELECT level FROM l WHERE level <= full_size / w ORDER BY full_size / w, n LIMIT 1),
t AS (SELECT source, source_size, round(least(full_size::DOUBLE, (SELECT level FROM v) * w), 6) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
      CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM e
"""
