"""Media files: discovery, WAV decoding inside tasks, and the choice of what is new."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "track_id string, channel_index int, block_idx long, start_sample long, sample_rate int, samples array<double>"


def discover(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """``(path, modificationTime, length)`` of the media under a folder; result folders are skipped. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return unique_paths(files.select("path", "modificationTime", "length").where(~F.col("path").contains("/results/")))


def unique_paths(files: DataFrame) -> DataFrame:
    """One row a path, in the order of their lower-case forms."""
    return files.dropDuplicates(["path"]).orderBy(F.lower("path"), "path")


def wav_header(read, length: int) -> tuple[int, int, int, int, int, int]:
    """Kind, bits, channels, rate, and where the samples of a RIFF file are: ``(kind, bits, channels, rate, at, bytes)``.

    ``read(at, n)`` gives n bytes of the file. A length of samples beyond the
    file, as writers of streams leave it, ends with the file.
    """
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, bits, channels, rate = 12, 0, 0, 0, 0
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt ":
            fmt = read(at + 8, min(size, 40))
            kind, channels, rate = struct.unpack_from("<HHI", fmt)
            bits = struct.unpack_from("<H", fmt, 14)[0]
            if kind == 0xFFFE:
                kind = struct.unpack_from("<H", fmt, 24)[0]
        elif name == b"data":
            if not channels or (kind, bits) not in ((1, 16), (1, 24), (1, 32), (3, 32), (3, 64)):
                raise ValueError(f"PCM of kind {kind} and {bits} bits is not read")
            return kind, bits, channels, rate, at + 8, min(size, length - at - 8)
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def pcm(body: bytes, kind: int, bits: int, channels: int) -> np.ndarray:
    """Samples (frame, channel), from -1 to 1, of whole frames."""
    if kind == 3:
        x = np.frombuffer(body, f"<f{bits // 8}").astype(np.float64)
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(body, f"<i{bits // 8}") / float(1 << (bits - 1))
    return x.reshape(-1, channels)


def _open(path: str):
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    store, name = fs.FileSystem.from_uri(uri)
    return store.open_input_file(name)


def wav_headers(files: DataFrame) -> DataFrame:
    """``(path, kind, bits, channels, rate, at, frames)`` of each file, from its first bytes."""

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path in pdf["path"]:
                with _open(path) as f:
                    kind, bits, channels, rate, at, n = wav_header(lambda at, n, f=f: f.read_at(n, at), f.size())
                rows.append((path, kind, bits, channels, rate, at, n // (channels * bits // 8)))
            yield pd.DataFrame(rows, columns=["path", "kind", "bits", "channels", "rate", "at", "frames"])

    return files.select("path").mapInPandas(look, "path string, kind int, bits int, channels int, rate int, at long, frames long")


def wav_blocks(files: DataFrame, size: int = 1 << 16, read_frames: int = 1 << 22) -> DataFrame:
    """The files ``(path)`` as blocks of a channel's samples, at the native rate.

    A file is cut into reads of ``read_frames`` frames at most, each a row that
    any task may take: files are as large as they like, and none is held whole.
    """
    per = max(1, read_frames // size) * size

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                wide = r.channels * r.bits // 8
                with _open(r.path) as f:
                    x = pcm(f.read_at(min(per, r.frames - r.start) * wide, r.at + r.start * wide), r.kind, r.bits, r.channels)
                for k in range(0, len(x), size):
                    block = x[k : k + size]
                    yield pd.DataFrame(
                        {"track_id": r.path, "channel_index": np.arange(r.channels, dtype=np.int32), "block_idx": (r.start + k) // size, "start_sample": r.start + k, "sample_rate": np.int32(r.rate), "samples": [c.tolist() for c in block.T]}
                    )

    reads = wav_headers(files).where("frames > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(per).cast("long"))))
    return reads.repartition("path", "start").mapInPandas(decode, BLOCKS)


def parameter_hash(**parameters: object) -> Column:
    """A hash of all parameters, whatever their order."""
    return F.md5(F.lit(repr(sorted(parameters.items()))))


def unprocessed(media: DataFrame, processed: DataFrame, config_hash: Column) -> DataFrame:
    """Media that were not processed in their present state with the present parameters."""
    now = media.withColumn("config_hash", config_hash)
    return now.join(processed.select("path", "mtime", "config_hash"), ["path", "mtime", "config_hash"], "left_anti")


def track_folders(files: DataFrame, marker: str = "analysis_results.csv", cache: str = "analysis_cache.json") -> DataFrame:
    """Folders of tracks: those that hold a cache file, and for the others those two levels over a channel's results."""
    own = files.select(F.regexp_extract("path", rf"^(.*)/{cache}$", 1).alias("track_folder")).where("track_folder <> ''").distinct()
    two = files.select(F.regexp_extract("path", rf"^(.*)/[^/]+/{marker}$", 1).alias("track_folder")).where("track_folder <> ''").distinct()
    return own.unionByName(two).distinct()
