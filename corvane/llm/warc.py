"""A content-addressed store of WARC records.

A record is its header, exact to the byte, and its payload.  Payloads are stored
once each, under their SHA-256; headers are stored apart, with the digest.  The
original records come back through a join on the digest.  Digests are verified: one
declared in a header against the payload, and, when records are rebuilt, every payload
against its own digest.

A payload is stored with the number of its records.  One of more than HOT records, an
empty body or an error page, is rebuilt in salted parts: its headers are spread over
copies of the payload, one for each HOT records, so no task gets them all.

Files are read as streams, a record at a time, so a worker holds one record and a block.

Defined results: a null payload is stored as an empty one, a null header as none; a null
id stays null; repeated records stay repeated, and payloads of any length are kept whole
(a single one must fit in memory); a declared digest that doesn't fit gives verified
false, and the payload is stored under its real digest; a header without a digest
verifies; an empty table gives an empty archive; extra columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import shared

CLOSE = b"\r\n\r\n"
#: Records of one payload that are rebuilt in one part.
HOT = 100_000
BLOCK = 1 << 20
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$")


def header_of(page_id: Column, url: Column, html: Column) -> Column:
    """A response header for a crawled page; a missing URL is left empty."""
    line = F.lit("\r\n")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), line,
        F.lit("WARC-Payload-Digest: sha256:"), F.sha2(F.coalesce(html, F.lit("")), 256), line,
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.coalesce(html, F.lit(""))).cast("string"), F.lit("\r\n\r\n"),
    )


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(record_id, header, payload), binary, of a table of pages."""
    rows = shared.plain(pages, record_id=id_col, url=url_col, html=html_col)
    header = header_of(F.col("record_id"), F.col("url"), F.col("html")).cast("binary")
    return rows.select("record_id", header.alias("header"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))


def _inflated(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a file's blocks, inflated where it is of gzip members."""
    member, first = None, True
    for block in blocks:
        if first:
            first = False
            member = zlib.decompressobj(31) if block[:2] == b"\x1f\x8b" else None
            if member is None:
                yield block
                yield from blocks
                return
        while block:
            yield member.decompress(block, BLOCK)
            block = member.unconsumed_tail
            if member.eof:
                block = member.unused_data.lstrip(b"\0")
                member = zlib.decompressobj(31)


def split_records(content: bytes | Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header, payload) of each record of a WARC file, plain or of gzip members, given whole or in blocks."""
    blocks = _inflated(iter([content]) if isinstance(content, bytes) else content)
    held, at = bytearray(), 0

    def more() -> bool:
        block = next(blocks, None)
        if block is None:
            return False
        held.extend(block)
        return True

    while True:
        looked = 0
        while (end := held.find(CLOSE, max(0, looked - 3))) < 0:
            looked = len(held)
            if not more():
                if held:
                    raise ValueError(f"a record header at byte {at} has no end")
                return
        header = bytes(held[: end + 4])
        length = _LENGTH.search(header)
        if not header.startswith(b"WARC/") or length is None:
            raise ValueError(f"no record at byte {at}")
        start, stop = end + 4, end + 4 + int(length[1])
        while len(held) < stop + 4 and more():
            pass
        if held[stop : stop + 4] != CLOSE:
            raise ValueError(f"the record at byte {at} isn't closed")
        yield header, bytes(held[start:stop])
        del held[: stop + 4]
        at += stop + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, path, place, header, payload) of the WARC files under a path; the id is path#place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, place_of_file = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with system.open_input_stream(place_of_file, compression=None) as file:
                    for place, (header, payload) in enumerate(split_records(iter(lambda: file.read(BLOCK), b""))):  # noqa: B023
                        yield pa.RecordBatch.from_pydict({"record_id": [f"{name}#{place}"], "path": [name], "place": pa.array([place], pa.int64()), "header": [header], "payload": [payload]})

    # Only the names are read here; each file is opened by its task.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInArrow(read, "record_id string, path string, place bigint, header binary, payload binary")


def _columns(records: DataFrame) -> DataFrame:
    rows = records.select("record_id", F.coalesce("header", F.lit(b"")).alias("header"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256))


def headers(records: DataFrame) -> DataFrame:
    """(record_id, header, digest, verified): all that a record is but its payload."""
    declared = F.lower(F.regexp_extract(F.decode("header", "ISO-8859-1"), r"(?im)^WARC-Payload-Digest:[ \t]*sha256:([0-9A-Fa-f]{64})[ \t]*\r?$", 1))
    return _columns(records).select("record_id", "header", "digest", ((declared == "") | (declared == F.col("digest"))).alias("verified"))


def payloads(records: DataFrame) -> DataFrame:
    """(digest, payload, n): each payload once, and how many records have it."""
    return _columns(records).groupBy("digest").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))


def rebuild(heads: DataFrame, bodies: DataFrame, hot: int = HOT) -> DataFrame:
    """(record_id, digest, verified, n_bytes, record): the original records, each payload checked against its digest."""
    # At most one digest in every `hot` records, so the list is small: 40 MB for 10**11 records.
    parts = bodies.where(F.col("n") > hot).select(F.col("digest").alias("hot_digest"), F.ceil(F.col("n") / hot).alias("parts"))
    spread = heads.join(F.broadcast(parts), F.col("digest") == F.col("hot_digest"), "left")
    salt = F.pmod(F.xxhash64("record_id", "header"), F.coalesce("parts", F.lit(1)))
    copies = bodies.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.greatest(F.col("n"), F.lit(1)) / hot) - 1)))
    joined = spread.select("record_id", "header", "digest", "verified", salt.alias("salt")).join(copies, ["digest", "salt"])
    record = F.concat("header", "payload", F.lit(CLOSE))
    sound = F.col("verified") & (F.sha2("payload", 256) == F.col("digest"))
    return joined.select("record_id", "digest", sound.alias("verified"), F.octet_length(record).cast("bigint").alias("n_bytes"), record.alias("record"))


def write_archive(records: DataFrame, path: str) -> None:
    """Store headers and payloads as Parquet tables under a path."""
    headers(records).write.mode("overwrite").parquet(f"{path}/headers")
    payloads(records).write.mode("overwrite").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str, hot: int = HOT) -> DataFrame:
    return rebuild(spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads"), hot)
