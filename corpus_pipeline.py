"""The corpus pipeline: five stages over documents, each written and read again.

Toxic documents go, then those of low quality, then near copies; what is left
is mixed to the sources' target weights and packed into bins. Every stage
works on all that its predecessor kept, on whole texts, and all but the last
return the columns of ``documents``.

In all stages null and empty texts are documents of no words, null ids and
sources are values like others, repeated rows are rows of their own until the
near copies go, further columns of ``docs`` are dropped, and an empty table
gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewave.llm import mixing, packing, quality, resemblance, toxicity
from tidewave.llm.common import remove, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored toxic go, each by its own text; with no labels all stay."""
    return toxicity.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored low go, each by its own text, source, language and length; with no labels all stay."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash's tables, and more of the kind, at five words and a resemblance of 0.8. One row of each group
    stays, that of the smallest id; empty texts are a group, and so are rows that repeat an id and a text."""
    return resemblance.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix uses it; a source's epochs repeat its rows. Texts of no words are
    used as often as their place in the order of their source says."""
    return mixing.repeat(docs.select(*COLUMNS))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its bin; ``packing.bin_texts`` gives the pieces' words."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: SQL can express neither the trained classifiers nor what follows from them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread; what no stage reads any more is deleted."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
