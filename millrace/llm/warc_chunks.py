"""WARC archives through a table of record chunks (operator 4).

Writing: a record's payload is cut into chunks of at most CHUNK_BYTES, rows of record key and
chunk number, before any of it reaches Python. The first chunk is a response record, later
ones are continuation records with segment numbers, as the format has for long payloads. Each
carries the digest of the payload so far, kept up while the chunks stream by; what is handed on
at once is bounded in bytes, and no whole record is built. A payload is also cut inside every ``WARC/1.1``, so that this string
stands only at a record's start and Spark's text reader can split the archives at it.
Archives are compressed files of at most FILE_RECORDS records, so they are read in parallel
file by file.

Reading: one row per chunk, (record key, chunk number, bytes). Records of one chunk are
digested at once; the chunks of longer ones are dealt by record, sorted by number and
streamed through a running digest. A task never holds more of a payload than one batch of
chunks. The archives are written and read by Spark's own writers, in the shared folder.

Of records with equal payloads of at least MIN_REVISIT bytes, that with the largest id is
a response and the others revisit it without a payload. That is found from ids, sizes and
digests; payloads are not shuffled for it unless more than BROADCAST_ROWS payloads have copies.

Defined results: null html is an empty payload; null url has no target line; a null id is
a record of its own that neither revisits nor is revisited; rows with equal id and payload
are all responses or all revisits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import blocks_of, in_two_stages, shared_dir, ship, staged

CHUNK_BYTES = 16_384
MIN_REVISIT = 1_000
FILE_RECORDS = 20_000
#: Chunks per Arrow batch of the running digest: bounds what a task holds.
BATCH_CHUNKS = 256
#: Bytes of records that a writing task hands on at once.
BATCH_BYTES = 4_000_000
#: Payloads with copies whose digests are broadcast, at most: about 64 bytes each.
BROADCAST_ROWS = 400_000

VERSION = b"WARC/1.1"
START = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
ID = "urn:millrace:page:"


def with_roles(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, size, digest, refers_to): refers_to is set for revisits."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn(
        "digest", F.sha1("html")
    )
    # Copies are counted before the shuffle. Only payloads seen twice are looked up, and
    # a payload that many pages share can be split by adaptive execution.
    copies = (
        rows.filter((F.col("size") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "largest")
    )
    copies = staged(copies, "warc-copies")
    few = copies.count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(copies) if few else in_two_stages(copies), "digest", "left")
    return found.select(
        "page_id", "url", "html", "size", "digest",
        F.when(F.col("largest") != F.col("page_id"), F.col("largest")).alias("refers_to"),
    )


def payload_chunks(pages: DataFrame, chunk_bytes: int) -> DataFrame:
    """(record_key, page_id, url, size, digest, refers_to, data): the rows of with_roles by
    chunk, those of a record behind each other in order; revisits have one without bytes."""
    rows = pages.withColumn("record_key", F.expr("uuid()"))
    response = F.col("refers_to").isNull()
    chunks = F.when(response, F.ceil(F.col("size") / chunk_bytes)).otherwise(0)
    number = F.sequence(F.lit(0), F.greatest(chunks.cast("int"), F.lit(1)) - 1)
    rows = rows.withColumn("html", F.col("html").cast("binary")).withColumn("number", F.explode(number))
    part = F.substring("html", F.col("number") * chunk_bytes + 1, F.lit(chunk_bytes))
    return rows.select(
        "record_key",
        "page_id",
        "url",
        "size",
        "digest",
        "refers_to",
        F.when(response, part).otherwise(F.lit(b"")).alias("data"),
    )


def views_of(data: pa.Array) -> list[memoryview]:
    """The values of a binary column without nulls, not copied."""
    _, offsets, values = data.buffers()
    ends = np.frombuffer(offsets, np.int32)[data.offset : data.offset + len(data) + 1].tolist()
    whole = memoryview(values) if values is not None else memoryview(b"")
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


def cut_at_versions(chunk: memoryview) -> Iterator[memoryview]:
    """The chunk, cut inside each version string; itself if it is empty."""
    first = 0
    for found in re.finditer(VERSION, chunk):
        yield chunk[first : found.start() + 1]
        first = found.start() + 1
    yield chunk[first:]


class RecordWriter:
    """Records of the chunks of one payload after another."""

    def __init__(self, row: dict):
        self.row = row
        self.running, self.number, self.done = hashlib.sha1(), 0, 0
        page, url = row["page_id"], row["url"]
        # A page table has no fetch time: the date is fixed, so that archives are repeatable.
        self.head = [
            f"WARC-Record-ID: <{ID}{'' if page is None else page}>",
            "WARC-Date: 1970-01-01T00:00:00Z",
            f"X-Row: {row['record_key']}",
            f"X-Payload-Length: {row['size']}",
            f"WARC-Payload-Digest: sha1:{row['digest']}",
        ]
        if url is not None:
            address = quote(url, safe="!#$%&'()*+,/:;=?@[]~").replace("WARC/1.1", "WARC%2F1.1")
            self.head.append(f"WARC-Target-URI: {address}")

    def revisit(self) -> bytes:
        own = [
            "WARC-Type: revisit",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{ID}{self.row['refers_to']}>",
            "Content-Length: 0",
        ]
        return (START + "\r\n".join(self.head + own) + BREAK).encode() + b"\r\n"

    def record(self, chunk: memoryview) -> bytes:
        """Without its last line break, which the writer of the archive adds."""
        self.number += 1
        self.running.update(chunk)
        self.done += len(chunk)
        own = [
            f"WARC-Type: {'response' if self.number == 1 else 'continuation'}",
            f"WARC-Segment-Number: {self.number}",
            f"X-Digest-So-Far: sha1:{self.running.hexdigest()}",
            f"Content-Length: {len(chunk)}",
        ]
        if self.done == self.row["size"]:
            own.append(f"WARC-Segment-Total-Length: {self.done}")
        return b"".join([(START + "\r\n".join(self.head + own) + BREAK).encode(), chunk, b"\r\n"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer: RecordWriter | None = None
    out: list[bytes] = []
    size = 0

    def handed_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    for batch in batches:
        heads = batch.select(batch.schema.names[:-1]).to_pylist()
        for row, chunk in zip(heads, views_of(batch["data"]), strict=True):
            if writer is None or writer.row["record_key"] != row["record_key"]:
                writer = RecordWriter(row)
            if row["refers_to"] is not None:
                out.append(writer.revisit())
                size += len(out[-1])
            else:
                for part in cut_at_versions(chunk):
                    out.append(writer.record(part))
                    size += len(out[-1])
            if size >= BATCH_BYTES:
                yield handed_on()
                out, size = [], 0
    if out:
        yield handed_on()


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    ship(pages.sparkSession)
    records = payload_chunks(with_roles(pages), chunk_bytes).mapInArrow(_records, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option(
        "lineSep", "\r\n"
    ).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1)


def _number(text: Column) -> Column:
    return F.when(text != "", text).cast("long")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(record_key, page_id, record_type, refers_to, payload_bytes, payload_digest, chunk_no,
    so_far, last, data): a row per record of the archives. For chunks, record_type is that
    of the whole record and payload_bytes and payload_digest are what its head states."""
    lines = spark.read.option("lineSep", START).text(path).filter(F.length("value") > 0)
    parts = lines.select(
        F.col("value").cast("binary").alias("bytes"),
        F.substring_index("value", BREAK, 1).alias("head"),
    )
    size = _number(_field("Content-Length"))
    start = F.octet_length("head") + len(BREAK) + 1
    kind = _field("WARC-Type")
    return parts.select(
        _field("X-Row").alias("record_key"),
        _number(F.regexp_extract("head", rf"WARC-Record-ID: <{ID}(-?\d*)>", 1)).alias("page_id"),
        F.when(kind == "revisit", kind).otherwise(F.lit("response")).alias("record_type"),
        _number(F.regexp_extract("head", rf"WARC-Refers-To: <{ID}(-?\d+)>", 1)).alias("refers_to"),
        _number(_field("X-Payload-Length")).alias("payload_bytes"),
        F.substring(_field("WARC-Payload-Digest"), 6, 40).alias("payload_digest"),
        F.coalesce(_number(_field("WARC-Segment-Number")), F.lit(1)).alias("chunk_no"),
        F.substring(_field("X-Digest-So-Far"), 6, 40).alias("so_far"),
        ((kind == "revisit") | (_field("WARC-Segment-Total-Length") != "")).alias("last"),
        F.substring(F.col("bytes"), start, size).alias("data"),
    )


def _folded(chunks: DataFrame) -> DataFrame:
    """One row per record of several chunks, its digest taken while they stream by."""
    names = ["record_key", "page_id", "record_type", "refers_to", "chunk_no", "so_far", "last", "data"]
    dealt = (
        chunks.select(*names)
        .repartition(blocks_of(chunks.sparkSession), "record_key")
        .sortWithinPartitions("record_key", "chunk_no")
    )
    schema = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running, size, number = None, hashlib.sha1(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_CHUNKS):
                out = []
                for row in batch.slice(at, BATCH_CHUNKS).to_pylist():
                    if row["record_key"] != key:
                        key, running, size, number = row["record_key"], hashlib.sha1(), 0, 0
                    number += 1
                    running.update(row["data"])
                    size += len(row["data"])
                    if row["chunk_no"] != number or running.hexdigest() != row["so_far"]:
                        raise ValueError(f"chunk {number} of page {row['page_id']} is damaged")
                    if row["last"]:
                        out.append(
                            {
                                "page_id": row["page_id"],
                                "payload_bytes": size,
                                "payload_digest": running.hexdigest(),
                                "record_type": row["record_type"],
                                "refers_to": row["refers_to"],
                            }
                        )
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[n] for r in out], k) for n, k in zip(out[0], kinds)],
                        names=list(out[0]),
                    )

    return dealt.mapInArrow(run, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row per record.
    A response's size and digest are those of the bytes read; a revisit's are stated ones."""
    ship(spark)
    chunks = read_chunks(spark, path)
    alone = (F.col("chunk_no") == 1) & F.col("last")
    revisit = F.col("record_type") == "revisit"
    short = chunks.filter(alone).select(
        "page_id",
        F.when(revisit, F.col("payload_bytes"))
        .otherwise(F.octet_length("data").cast("long"))
        .alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha1("data")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
    return short.unionByName(_folded(chunks.filter(~alone)))


def round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Archives of all pages, written into the shared folder and read back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/millrace-warc-{uuid.uuid4().hex}"
    write_archives(pages, path, chunk_bytes)
    return read_records(spark, path)


SQL = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), digested AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS digest
  FROM sized
), largest AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest, payload_bytes) AS top FROM digested
)
SELECT page_id, payload_bytes, digest AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM largest
"""
