r"""A content-addressed WARC archive.

Two tables make an archive: ``payloads`` holds the bytes of each distinct payload once, compressed, under
their SHA-256; ``headers`` holds the exact header bytes of every record (WARC header block and HTTP header
block) with the digest of its payload. A record comes back as header + payload by a join on the digest, and
the bytes are digested again on the way, so that a damaged or mistaken payload never passes for another.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, shared_path, table

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:landloom:record:"


def _header(record_type: Column, own: Column, refers: Column, uri: Column, sha1: Column, size: Column) -> tuple[Column, Column]:
    """The WARC header block and the HTTP header block of a record."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2))
    content = F.octet_length(http) + F.when(record_type == "response", size).otherwise(F.lit(0))
    # a line break in an address would end its header line
    address = F.replace(F.replace(uri, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    name = lambda c: F.concat(F.lit(f"<{ID}"), c.cast("string"), F.lit(">"))
    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", F.coalesce(name(own), F.lit(f"<{ID}none>"))),
        line("WARC-Target-URI", address),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(record_type == "revisit", F.concat(line("WARC-Refers-To", name(refers)), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", content.cast("string")),
        F.lit(CRLF),
    )
    return warc, http


def write_archive(records: DataFrame, path: str, revisit_from: int = 1000) -> None:
    """Write ``record_id long, uri string, payload binary`` rows as an archive under ``path``.

    Of records with equal payloads of at least ``revisit_from`` bytes, the one with the largest ``record_id`` is a
    response and the others revisit it; smaller ones are all responses. A null payload is an empty one, a null
    ``uri`` leaves its header line out, a null ``record_id`` counts as the smallest. Rows that repeat a
    ``record_id`` and its payload are of one type. Other columns are ignored. An empty table gives an empty archive.
    """
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    named = records.select("record_id", "uri", payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"))

    def shrink(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = pa.array([press(x.as_buffer()) for x in b.column(1)], pa.binary())
            yield pa.record_batch([b.column(0), b.column(2), z], names=["digest", "size", "packed"])

    blobs = named.select("digest", "payload", F.octet_length("payload").cast("long").alias("size")).mapInArrow(shrink, "digest binary, size long, packed binary")
    # equal digests meet on the map side first, so a payload that many records share travels once per task
    once = blobs.groupBy("digest").agg(F.any_value("packed").alias("packed"), F.max("size").alias("size"), (F.min("size") == F.max("size")).alias("one_size"))
    once = once.withColumn("size", F.when(F.col("one_size"), F.col("size")).otherwise(F.raise_error(F.lit("payloads of one digest differ")).cast("long")))
    once.drop("one_size").write.option("compression", "uncompressed").parquet(f"{path}/payloads")

    narrow = named.select("record_id", "uri", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    narrow.write.parquet(f"{path}/records")
    spark = records.sparkSession
    narrow = spark.read.schema(narrow.schema).parquet(f"{path}/records")
    order = F.coalesce("record_id", F.lit(NULL_ID))
    shared = narrow.where(F.col("size") >= revisit_from).groupBy("digest").agg(F.max(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    shared.select("digest", "first").write.parquet(f"{path}/shared")
    shared = spark.read.schema("digest binary, first long").parquet(f"{path}/shared")
    found = narrow.join(shared, "digest", "left")
    kind = F.when(F.col("first").isNotNull() & (order < F.col("first")), "revisit").otherwise("response")
    warc, http = _header(kind, F.col("record_id"), F.col("first"), F.col("uri"), F.col("sha1"), F.col("size"))
    found.select(F.to_binary(warc, F.lit("utf-8")).alias("warc"), F.to_binary(http, F.lit("utf-8")).alias("http"), "digest").write.parquet(f"{path}/headers")


def fields_of(warc: bytes) -> dict[str, str]:
    """The named fields of a WARC header block."""
    lines = warc.decode("utf-8").split(CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def _number(urn: str | None) -> int | None:
    tail = (urn or "none>").removeprefix(f"<{ID}").removesuffix(">")
    return None if tail == "none" else int(tail)


def read_archive(spark: SparkSession, path: str, with_bytes: bool = True) -> DataFrame:
    """The records of an archive, headers joined with verified payloads.

    ``record_id, record_type, refers_to, uri, payload_bytes, payload_digest`` (SHA-1 of the full payload, in hex), and
    with ``with_bytes`` also ``payload`` and ``record``, the record's exact bytes (a revisit's end after its headers). Every
    record is rebuilt and parsed on the way; its length and digest must be those of its header.
    """
    headers = spark.read.schema("warc binary, http binary, digest binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest binary, packed binary, size long").parquet(f"{path}/payloads")
    kinds = "record_id long, record_type string, refers_to long, uri string, payload_bytes long, payload_digest string"
    kinds += ", payload binary, record binary" if with_bytes else ""
    names = [k.split()[0] for k in kinds.split(", ")]
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    def restore(batches):
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            rows, last = [], (None, None, None)
            for warc, http, digest, packed, size in zip(*(b.column(i).to_pylist() for i in range(5))):
                if digest != last[0]:
                    payload = open_.decompress(packed, max_output_size=max(size, 1))
                    if len(payload) != size or hashlib.sha256(payload).digest() != digest:
                        raise ValueError("a stored payload does not match its digest")
                    last = (digest, payload, hashlib.sha1(payload).hexdigest())
                _, payload, sha1 = last
                f = fields_of(warc)
                content = http + (payload if f["WARC-Type"] == "response" else b"")
                record = warc + content + b"\r\n\r\n"
                if parse_warc(record) != [(warc, content)] or f["WARC-Payload-Digest"] != f"sha1:{sha1}":
                    raise ValueError("a rebuilt record does not agree with its header")
                row = [_number(f["WARC-Record-ID"]), f["WARC-Type"], _number(f.get("WARC-Refers-To")), f.get("WARC-Target-URI"), len(payload), sha1]
                if with_bytes:
                    row += [payload, record]
                rows.append(row)
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, arrow)], names=names)

    joined = headers.join(payloads, "digest").select("warc", "http", "digest", "packed", "size")
    return joined.mapInArrow(restore, kinds)


def parse_warc(data: bytes) -> list[tuple[bytes, bytes]]:
    """(header block, content block) of each record in the bytes of an uncompressed WARC file."""
    found, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        size = int(fields_of(data[at:end])["Content-Length"])
        if data[end + size : end + size + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        found.append((data[at:end], data[end : end + size]))
        at = end + size + 4
    return found


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``path, warc, block`` of every record of uncompressed WARC files, one file per task."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = parse_warc(data)
                yield pa.record_batch([pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "warc", "block"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, warc binary, block binary")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per row of ``pages``, written to an archive and read back; nulls, equal payloads and empty tables as ``write_archive`` defines them."""
    pages = table(spark, sf_dir, "pages")
    path = shared_path(spark, "warc")
    write_archive(pages.select(F.col("page_id").cast("long").alias("record_id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload")), path)
    back = read_archive(spark, path, with_bytes=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as payload_bytes from pages
), marked as (
  select *, max(page_id) over (partition by html) as top from p
)
select page_id, payload_bytes, sha1(html) as payload_digest,
       case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id < top then top end as refers_to
from marked
"""
