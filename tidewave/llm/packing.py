"""Best-fit packing under conflicts.

Texts longer than a bin are cut into pieces. Pieces are dealt by hash into
groups of bounded size, and each group is packed by itself, largest piece
first. The open bins of a group stand in order of their residual room; each
carries a bitmap of the sources and one of the duplicate clusters it holds. A
piece searches from the first bin with enough room on to the next larger
residual until neither bitmap has its bit: that is the tightest compatible
bin. If there is none, it opens a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, n_words, settle

CAPACITY = 2048
#: Pieces of one group on average; a task holds one group at a time.
GROUP_PIECES = 2048
#: Bins of a group have numbers below this.
GROUP_BINS = 1 << 24


def best_fit(words: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For pieces in the order to pack: the bin of each, and its place inside."""
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    with_source: list[int] = []
    with_cluster: list[int] = []
    bins, starts = [], []
    for n, s, c in zip(words, sources, clusters, strict=True):
        s_bit, c_bit = 1 << s, 1 << c
        k = bisect_left(open_bins, (n, -1))
        while k < len(open_bins) and (with_source[b := open_bins[k][1]] & s_bit or with_cluster[b] & c_bit):
            k += 1
        if k < len(open_bins):
            room, b = open_bins.pop(k)
            with_source[b] |= s_bit
            with_cluster[b] |= c_bit
        else:
            room, b = capacity, len(with_source)
            with_source.append(s_bit)
            with_cluster.append(c_bit)
        bins.append(b)
        starts.append(capacity - room)
        if room > n:
            insort(open_bins, (room - n, b))
    return bins, starts


def _pack_group(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["words", "doc_id", "piece", "cluster", "row"], ascending=[False, True, True, True, True], kind="stable", na_position="last")
        sources = pd.factorize(pdf["source"], use_na_sentinel=False)[0]
        clusters = pd.factorize(pdf["cluster"], use_na_sentinel=False)[0]
        bins, starts = best_fit(pdf["words"].tolist(), sources.tolist(), clusters.tolist(), capacity)
        return pdf.assign(bin_id=pdf["part"] * GROUP_BINS + pd.Series(bins, index=pdf.index, dtype="int64"), bin_start=pd.Series(starts, index=pdf.index, dtype="int64"))[
            ["doc_id", "piece", "source", "cluster", "start_word", "words", "bin_id", "bin_start"]
        ]

    return pack


def cluster_of(text: Column) -> Column:
    """Texts equal but for A-Z and white space share a cluster; null is the empty text."""
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+", " ")))


def pack(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Packs ``(doc_id, source, words, cluster)`` into bins of ``capacity`` words.

    One row a piece: ``doc_id, piece, source, cluster, start_word, words,
    bin_id, bin_start``. No bin holds two pieces of one source or of one
    cluster, or more words than its capacity. A document of no words has one
    piece of none, packed last; null sources are one source, null clusters
    one cluster; repeated rows are packed each; an empty table gives no rows.
    Further columns are not read.
    """
    n = F.greatest(F.coalesce(F.col("words"), F.lit(0)), F.lit(0)).cast("long")
    pieces = docs.select("doc_id", "source", "cluster", n.alias("n")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}"))))
    )
    start = F.col("piece") * capacity
    words = F.least(F.lit(capacity), F.col("n") - start).alias("words")
    pieces = settle(pieces.select("doc_id", "piece", "source", "cluster", start.alias("start_word"), words, F.monotonically_increasing_id().alias("row")))
    groups = max(1, -(-pieces.count() // group_pieces))
    # dealt by row, so that rows that repeat an id and a text are spread as any others
    grouped = pieces.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece long, source string, cluster long, start_word long, words long, bin_id long, bin_start long"
    return grouped.groupBy("part").applyInPandas(_pack_group(capacity), schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """:func:`pack` over whole documents; each piece's words are those of ``common.WORD``."""
    return pack(docs.select("doc_id", "source", n_words(F.col("text")).alias("words"), cluster_of(F.col("text")).alias("cluster")), capacity, group_pieces)


def bin_texts(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """``(bin_id, bin_start, doc_id, piece, text)``: the words of every piece, joined by spaces; a row for each of ``packed``.

    A piece is found by id and cluster, null ids too. Rows that repeat both
    have equal words but for A-Z; the least of their texts is taken.
    """
    same = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), cluster_of(F.col("text")).alias("_cluster"))
    same = same.groupBy("doc_id", "_cluster").agg(F.min("text").alias("text")).withColumnRenamed("doc_id", "_doc_id")
    word_list = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    own = F.array_join(F.slice(word_list, (F.col("start_word") + 1).cast("int"), F.col("words").cast("int")), " ").alias("text")
    rows = packed.join(same, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("cluster") == F.col("_cluster")))
    return rows.select("bin_id", "bin_start", "doc_id", "piece", own)
