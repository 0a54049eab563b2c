"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: the longest run of characters other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on a single machine, as in tests, a folder of our
    own is made and set as the checkpoint folder of the context. On a cluster
    a folder of one machine would be lost on the others: that is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidewave-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table and read again.

    For loops: a checkpoint keeps the size that was estimated for its plan, and
    as joins multiply sizes, the digits of the estimate would double in each
    round, until planning stands still. A table's size is that of its files.
    """
    path = f"{shared_dir(df.sparkSession)}/{STORED}{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


STORED = "stored-"


def forget(df: DataFrame) -> None:
    """Delete the files of a :func:`stored` table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith(STORED):
            remove(df.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 with A-Z in lower case; null has none.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at exactly
    the characters of ``WORD``.
    """
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
