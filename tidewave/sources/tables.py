"""Result tables: Parquet partitioned by track and channel, manifests, CSV, and sectioned CSV."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEYS = ["track_id", "channel_index"]
#: Names in a store of versions: the files that make a version known, and the table of the channels it has.
COMMIT, CHANNELS = "commit-", "channels"


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """Write a table; only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str, schema: StructType, track_id: str | None = None, channel_index: int | None = None) -> DataFrame:
    """A table, one track or one channel of it by partition pruning; no rows where it was never written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(f"{folder}/{name}")
    if track_id is not None:
        df = df.where(F.col("track_id") == track_id)
    return df if channel_index is None else df.where(F.col("channel_index") == channel_index)


def find_tables(spark: SparkSession, folder: str) -> DataFrame:
    """``(table, files, bytes)`` of the tables under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"/([^/=]+)/track_id=", 1).alias("table")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def upsert_manifest(old: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The latest entry of each key: those of ``new`` over those of ``old``."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_age"))).where("_n = 1").drop("_n", "_age")


def _files(spark: SparkSession, folder: str):
    """Hadoop's file system and file context of a folder, and its path. The context's rename fails where the target exists."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path(folder), spark._jsc.hadoopConfiguration()
    return path.getFileSystem(conf), spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf), path


def commits(spark: SparkSession, folder: str, version: int | None = None) -> list[tuple[int, str]]:
    """``(version, data folder)`` of a store's commits in order, up to ``version`` if one is given."""
    fs, _, path = _files(spark, folder)
    if not fs.exists(path) or not any(f.getPath().getName().startswith(COMMIT) for f in fs.listStatus(path)):
        return []
    rows = spark.read.text(f"{folder}/{COMMIT}*").select("value", F.regexp_extract(F.input_file_name(), COMMIT + r"(\d+)", 1).cast("int").alias("v")).collect()
    return sorted((r["v"], f"{folder}/{r['value']}") for r in rows if version is None or r["v"] <= version)


def commit(tables: dict[str, DataFrame], channels: DataFrame, folder: str) -> int:
    """Write the tables of the results of ``channels`` as one version of a store; returns its number, from 1.

    The tables go to a folder that no reader knows. A small file that names it,
    written under another name and renamed to the next free number, makes all
    of them known at once; a writer that finds its number taken takes the
    next. So readers see whole versions only, whoever writes beside them, and
    a writer that dies leaves nothing but a folder that is never read.
    """
    spark, data = channels.sparkSession, f"data-{uuid.uuid4().hex}"
    channels.select(*KEYS).distinct().write.parquet(f"{folder}/{data}/{CHANNELS}")
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{data}/{name}")
    fs, context, path = _files(spark, folder)
    of = lambda name: spark._jvm.org.apache.hadoop.fs.Path(path, name)
    draft = of(f"draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(data, "ascii"))
    out.close()
    never_over = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    version = max([v for v, _ in commits(spark, folder)], default=0) + 1
    while fs.exists(draft):
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(of(f"{COMMIT}{version:09d}")), never_over)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            version += 1
    return version


def read_version(spark: SparkSession, folder: str, name: str, schema: StructType, version: int | None = None) -> DataFrame:
    """A table of a store as of a version, or of the latest: of each channel what the last commit that has it wrote, be it no rows."""
    held = commits(spark, folder, version)
    if not held:
        return spark.createDataFrame([], schema)
    fs, _, _ = _files(spark, folder)
    there = [(v, data) for v, data in held if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{data}/{name}"))]
    of = lambda read, pairs: functools.reduce(DataFrame.unionByName, (read(data).withColumn("_v", F.lit(v)) for v, data in pairs))
    last = of(lambda data: spark.read.parquet(f"{data}/{CHANNELS}"), held).groupBy(*KEYS).agg(F.max("_v").alias("_v"))
    if not there:
        return spark.createDataFrame([], schema)
    return of(lambda data: spark.read.schema(schema).parquet(f"{data}/{name}"), there).join(last, [*KEYS, "_v"], "left_semi").drop("_v")


def missing_artifacts(found: DataFrame, expected: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """For every channel of ``found (keys, artifact)`` what it has and what it lacks."""
    every = found.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, expected))).alias("artifact"))
    j = every.join(found.select(*keys, "artifact").distinct().withColumn("_has", F.lit(True)), [*keys, "artifact"], "left")
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("artifact"))))
    return j.groupBy(*keys).agg(names(F.col("_has").isNotNull()).alias("present"), names(F.col("_has").isNull()).alias("missing"))


def write_csv(df: DataFrame, folder: str) -> None:
    """One CSV directory a table, and so a section."""
    df.write.mode("overwrite").csv(folder, header=True)


# The sections of a full export, in its order.
SECTIONS = (
    "track_metadata", "octave_band_analysis", "time_domain_summary", "time_domain_analysis", "advanced_statistics", "extreme_chunks_octave_analysis",
    "histogram_linear", "histogram_log_db", "octave_time_metrics", "envelope_statistics", "envelope_pattern_analysis", "sustained_peaks_summary", "sustained_peaks_events",
)


#: Sections that are written at a time: one's last tasks leave no core idle while another has some.
AT_ONCE = 3


def write_sections(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """A full export: every table of an analysis as CSV of its own name; returns the names, in the export's order.

    Arrays and structs, which CSV has no form for, are written as JSON. A
    table of another name is an error. Some sections are written at once.
    """
    if unknown := set(tables) - set(SECTIONS):
        raise ValueError(f"no such sections: {sorted(unknown)}")
    names = [n for n in SECTIONS if n in tables]

    def write(name: str) -> None:
        df = tables[name]
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        write_csv(df.select(*flat), f"{folder}/{name}")

    with ThreadPoolExecutor(AT_ONCE) as some:
        list(some.map(write, names))  # the first failure is raised, and what has not begun is left
    return names


def read_section(spark: SparkSession, path: str, section: str, columns: Sequence[str]) -> DataFrame:
    """The rows of one ``[SECTION]`` of sectioned CSV files: after its header, until a blank line or the next
    section; rows of another width are skipped. ``(path, line, columns)``."""
    lines = spark.read.format("text").option("wholetext", True).load(path).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return parse_sections(lines, section, columns)


def parse_sections(lines: DataFrame, section: str, columns: Sequence[str]) -> DataFrame:
    """:func:`read_section` over lines ``(path, line, value)``; a file's lines are one window partition."""
    text = F.trim("value")
    mark = F.when(text.rlike(r"^\[.*\]$"), text).when(text == "", "")
    by = Window.partitionBy("path").orderBy("line")
    held = lines.select("path", "line", text.alias("value"), F.last(mark, ignorenulls=True).over(by).alias("section"), mark.alias("mark"))
    rows = held.where((F.col("section") == f"[{section}]") & F.col("mark").isNull())
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where("_n > 1")
    cells = F.split("value", ",")
    return rows.where(F.size(cells) == len(columns)).select("path", "line", *(F.trim(cells[i]).alias(c) for i, c in enumerate(columns)))
