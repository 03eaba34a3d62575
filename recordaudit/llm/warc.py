"""A content-addressed web archive.

Payload bytes are stored once each, under their SHA-256; the exact header of every WARC record (with its HTTP head) is stored
apart. Original records come back by a join of the two and are read like any WARC record, their digests verified.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordaudit.llm.common import new_path, stored, table

SEEN = 1 << 18  # digests that a task remembers so as not to hand the same payload on again
DATE = "1970-01-01T00:00:00Z"  # the tables have no capture time
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INTAKE = "row long, page_id long, url string, length long, sha1 string, digest binary, packed binary"
READ = "page_id long, payload_digest string, record_type string, refers_to long, payload binary"


class Archive(NamedTuple):
    """Where the two tables of an archive are."""

    headers: str  # row, page_id, digest, has_payload, header
    payloads: str  # digest, length, packed (zstd)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack, seen = zstandard.ZstdCompressor(level=3).compress, set()
    for batch in batches:
        row, page_id, url, html = batch.columns
        lengths, sha1, digests, packed = [], [], [], []
        for text in html.to_pylist():
            payload = (text or "").encode("utf-8", "surrogatepass")
            digest = hashlib.sha256(payload).digest()
            lengths.append(len(payload))
            sha1.append(base32_sha1(payload))
            digests.append(digest)
            packed.append(None if digest in seen else pack(payload))
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(digest)
        yield pa.RecordBatch.from_arrays([row, page_id, url, pa.array(lengths, pa.int64()), pa.array(sha1, pa.string()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["row", "page_id", "url", "length", "sha1", "digest", "packed"])


def write_archive(pages: DataFrame, least_bytes: int = 0) -> Archive:
    """Write a record for every row of `pages` (page_id, url, html; a null html is an empty payload) into the shared folder.

    Of the records with equal payloads of at least `least_bytes` bytes, that with the largest page_id (nulls last; of repeated ids
    any one) is a response and the others revisit it; records with smaller payloads are all responses. Line ends in a url are
    written as %0D and %0A; a null url has no target line. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    intake = stored(rows.mapInArrow(_describe, INTAKE), "intake")
    out = Archive(new_path(spark, "warc-headers"), new_path(spark, "warc-payloads"))
    owned = intake.groupBy("digest").agg(F.first("packed", ignorenulls=True).alias("packed"), F.first("length").alias("length"), F.max(F.struct("page_id", "row")).alias("owner"))
    owned.write.parquet(out.payloads)
    owners = spark.read.parquet(out.payloads).select("digest", "owner")
    told = intake.drop("packed").join(owners, "digest")
    response = (F.col("length") < least_bytes) | (F.col("row") == F.col("owner.row"))
    name = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(response, "response").otherwise("revisit")), line("WARC-Record-ID", name(F.col("page_id"), F.col("row"))), line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(response, "").otherwise(F.concat(line("WARC-Refers-To", name(F.col("owner.page_id"), F.col("owner.row"))), line("WARC-Profile", F.lit(PROFILE)))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", (F.when(response, F.col("length")).otherwise(0) + len(HTTP)).cast("string")), F.lit("\r\n" + HTTP))
    told.select("row", "page_id", "digest", response.alias("has_payload"), header.cast("binary").alias("header")).write.parquet(out.headers)
    return out


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """(row, page_id, head, packed): every record as its exact header and, for responses, its payload (zstd) from the store."""
    headers, payloads = spark.read.parquet(archive.headers), spark.read.parquet(archive.payloads)
    with_payload = headers.where("has_payload").join(payloads.select("digest", "packed"), "digest")
    without = headers.where("NOT has_payload").withColumn("packed", F.lit(None).cast("binary"))
    return with_payload.select("row", "page_id", "header", "packed").union(without.select("row", "page_id", "header", "packed"))


def record_bytes(header: bytes, packed: bytes | None) -> bytes:
    """The original record: header, payload, and the two line ends that close it."""
    return header + (zstandard.ZstdDecompressor().decompress(packed) if packed is not None else b"") + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[int | None, str, str, int | None, bytes]:
    """(page_id, payload digest, type, page_id referred to, payload) of one WARC record. Raises ValueError on a wrong length or digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']}: the block does not have {size} bytes")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have the digest {digest}")
    page = lambda name: None if name is None or name.split(":")[2] == "null" else int(name.split(":")[2])
    return page(fields["WARC-Record-ID"]), digest, fields["WARC-Type"], page(fields.get("WARC-Refers-To")), payload


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in READ.split(", ")]
    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, max(whole.num_rows, 1), 256)):
        rows = [parse_record(record_bytes(h, p)) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds, strict=True)], names)


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Rebuild and parse every record: page_id, payload_digest, record_type, refers_to, payload (empty for revisits)."""
    return records(spark, archive).select("header", "packed").mapInArrow(_parse, READ)


def digest_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive all pages, read the archive back and tell of every record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload is that of the response with its digest. Repeated rows give a record each; an empty table gives none.
    """
    read = read_archive(pages.sparkSession, write_archive(pages, least_bytes))
    slim = stored(read.select("page_id", F.octet_length("payload").cast("long").alias("n"), "payload_digest", "record_type", "refers_to"), "records")
    own = slim.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("n").alias("payload_bytes"))
    return slim.join(own, "payload_digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_warc(spark, sf_dir):
    return digest_pages(table(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
w AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS owner, sha1(h) AS x FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM w
"""
