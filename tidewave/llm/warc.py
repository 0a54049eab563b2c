"""A deterministic, sharded WARC writer, and the reader that takes it back.

Digests are made in the JVM. The records are range-sorted by page, so that a
partition is a run of pages; its task writes one gzip member a record, rolls
to the next file by compressed size, and moves each file from a temporary name
to its own only when it is whole. The manifest lists the files that count; it
is written last, so that lost or repeated tasks leave nothing that is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, shared_dir

ROLL_BYTES = 64 << 20
PARTITION_BYTES = 64 << 20
LEVEL = 5
#: The record date (the tables have none) and the profile of a revisit.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: object, digest: str, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{n}')}>"


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c not in "\r\n")


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, n: int = 0) -> bytes:
    """One WARC/1.1 record with headers made anew; ``refers_to`` makes it a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest, n)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest, 0)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


class _Files:
    """The files of one partition, rolled by compressed size."""

    def __init__(self, folder: str, part: int, attempt: str, roll: int):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.part, self.attempt, self.roll, self.n, self.out = part, attempt, roll, 0, None

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.tmp = posixpath.join(self.folder, f".tmp-{self.part:06d}-{self.n:05d}-{self.attempt}")
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.tmp), 0, 0, hashlib.sha256()
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.size >= self.roll:
            yield self.close()

    def close(self) -> tuple:
        self.out.close()
        name = f"part-{self.part:06d}-{self.n:05d}.warc.gz"
        self.fs.move(self.tmp, posixpath.join(self.folder, name))
        self.out, self.n = None, self.n + 1
        return name, self.records, self.size, self.sha.hexdigest()


def _write(folder: str, roll: int):
    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        files, done = _Files(folder, context.partitionId(), f"{context.attemptNumber()}-{uuid.uuid4().hex}", roll), []
        seen, first, n = None, None, 0
        for pdf in parts:
            for page_id, deal, kind, url, html, digest, least in pdf.itertuples(index=False):
                page_id = None if pd.isna(page_id) else page_id
                if kind == 0:  # what the digests say of the page's rows
                    first = {} if seen != (page_id, deal) else first
                    seen, n = (page_id, deal), int(deal) << 32
                    first[digest] = [None if pd.isna(least) else least, False]
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = base32_sha1(payload)
                state = first[digest]
                plain = state[0] is None or state[0] == page_id and not state[1]
                state[1] = True
                done += files.add(record(page_id, url, payload, digest, None if plain else state[0], n))
                n += 1
        if files.out is not None:
            done.append(files.close())
        yield pd.DataFrame(done, columns=["file", "records", "bytes", "sha256"])

    return write


def base32_of(sha1_hex):
    """A column of 40 hex digits as upper-case base32: 8 digits of 5 bits from each 10 hex digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for k in range(0, 40, 10):
        n = F.conv(F.substring(sha1_hex, k + 1, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(letters), (F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for s in range(35, -1, -5)]
    return F.concat(*parts)


def write_warc(pages: DataFrame, folder: str, min_payload: int = 0, roll_bytes: int = ROLL_BYTES, partitions: int | None = None) -> DataFrame:
    """Write ``(page_id, url, html)`` into ``folder``; returns the manifest, which is also written there.

    Payloads are the html in UTF-8, null being empty. Of records with equal
    payloads of at least ``min_payload`` bytes the one of the smallest page is
    a response and the others revisit it; smaller ones are all responses, and
    so is every record whose payload has no page id. Of rows that repeat that
    page the first is the response. Equal tables give equal files; rows
    without a page are dealt by their place in the table.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    size = F.octet_length(html)
    facts = settle(pages.select("page_id", base32_of(F.sha1(html.cast("binary"))).alias("digest"), size.cast("long").alias("size")).distinct())
    least = settle(facts.where(F.col("size") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("least")))
    null = lambda kind: F.lit(None).cast(kind)
    told = facts.join(least, "digest", "left").select("page_id", F.lit(0).alias("kind"), null("string").alias("url"), null("string").alias("html"), "digest", "least")
    rows = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", null("string").alias("digest"), null("long").alias("least"))
    if partitions is None:
        total = facts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        partitions = max(8, -(-total // PARTITION_BYTES))
    # rows without a page are no one's first, so they may be dealt anyhow, with a copy of their facts for each deal
    salts = max(1, facts.where("page_id is null").count() and partitions)
    salt = F.pmod(F.xxhash64("url", "html", F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    several = F.when(F.col("page_id").isNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    told = told.withColumn("deal", F.explode(several))
    rows = rows.withColumn("deal", F.when(F.col("page_id").isNull(), salt).otherwise(0))
    # one shuffle of the payloads: a page's facts travel to where it is sorted
    dealt = told.unionByName(rows).repartitionByRange(partitions, "page_id", "deal").sortWithinPartitions("page_id", "deal", "kind", "digest", "url", "html")
    # ids as text: pandas would turn longs beside nulls into doubles
    dealt = dealt.select(F.col("page_id").cast("string"), "deal", "kind", "url", "html", "digest", F.col("least").cast("string"))
    manifest = settle(dealt.mapInPandas(_write(folder, roll_bytes), MANIFEST))
    manifest.write.mode("overwrite").parquet(posixpath.join(folder, "manifest"))
    return manifest


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if f"sha1:{base32_sha1(block)}" != head["warc-block-digest"]:
            raise ValueError("a block differs from its digest")
        yield head, block


def _read(folder: str):
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        for pdf in parts:
            for name in pdf["file"]:
                with store.open_input_stream(posixpath.join(base, name), compression=None) as raw, gzip.open(raw) as plain:
                    rows = []
                    for head, block in parse(plain):
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response" and digest != base32_sha1(block.partition(b"\r\n\r\n")[2]):
                            raise ValueError("a payload differs from its digest")
                        page, refers = head["warc-page-id"], head.get("warc-refers-to-page-id")
                        rows.append((int(page) if page else None, head["warc-target-uri"], int(head["warc-payload-length"]), digest, head["warc-type"], int(refers) if refers else None))
                        if len(rows) == 4096:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)

    return read


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return pdf.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the files that the manifest lists; every digest is checked on the way."""
    files = manifest.select("file").repartition(max(1, manifest.count()), "file")
    return files.mapInPandas(_read(folder), RECORD)


def round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write ``pages`` under the shared folder and read the archives back: a row for each page."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    fs_java = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    fs_java.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).mkdirs(fs_java)
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return read_warc(write_warc(pages, folder, min_payload), folder)


#: Payloads of pages without ids alone are responses all: no page could be referred to. No base32 or 160-bit numbers in SQL: the digest's hex digits are read 10 at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least, row_number() OVER (PARTITION BY h, page_id) AS k FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, CAST(j // 8 * 10 + 1 AS BIGINT), 10))::BIGINT >> (35 - 5 * (j % 8))) & 31 AS BIGINT) + 1, 1)
    FOR j IN range(32)], '') AS payload_digest,
  CASE WHEN least IS NULL OR page_id = least AND k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN least IS NULL OR page_id = least AND k = 1 THEN NULL ELSE least END AS refers_to
FROM f
"""
