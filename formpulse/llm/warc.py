"""WARC archives: a writer for pages, and a sequential reader.

Each task writes one archive, one gzip member per record, under a name of its own and then moves it
into place, so a task that runs again after an executor is lost replaces nothing but its own work.
The reader streams an archive in blocks, inflates member by member, frames records by their
Content-Length and checks digests; it holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formpulse.session import work_folder

from .common import stored, table

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
BLOCK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """A record that is cut off, badly framed or does not match its digest."""


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None) -> bytes:
    """One gzip member with a response record, or a revisit of the page ``refers_to``."""
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    body = b"" if refers_to is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(body)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def members(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated gzip members of a stream that comes in blocks."""
    unpacker, parts = zlib.decompressobj(31), []
    for block in blocks:
        while block:
            parts.append(unpacker.decompress(block))
            block = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
    if parts:
        raise ArchiveError("the last member is cut off")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and body of one record; checks framing and digest."""
    head, blank, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not blank or not first.startswith("WARC/"):
        raise ArchiveError("no record header")
    headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
    length = int(headers.get("content-length", -1))
    if length < 0 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError("the content does not end where its length says")
    body = rest[:length]
    if headers.get("warc-type") == "response":
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if headers.get("warc-payload-digest") != f"sha1:{sha}":
            raise ArchiveError("the payload does not match its digest")
    return headers, body


def _page(reference: str | None) -> int | None:
    number = (reference or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def write_archives(pages: DataFrame, folder: str, at_least: int = REVISIT_BYTES) -> DataFrame:
    """Write a record for every row of (page_id, url, html); returns the archives: path, records.

    The payload is the html in UTF-8. Of equal payloads of ``at_least`` bytes the row with the
    largest page_id is the response and the others revisit it; rows whose page_id is null are
    responses, and so is every row that repeats the largest page_id. Null html is empty, null urls
    are left out. Keys of a group of copies are reduced before the shuffle, and a hot payload is a
    skewed join that adaptive execution splits.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url",
                        F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = rows.where(F.octet_length("html") >= at_least)
    copied = large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("winner"))
    copied = copied.where("n > 1").select("digest", "winner")
    rows = rows.join(copied, "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.when(F.col("page_id") < F.col("winner"), F.col("winner")).alias("refers_to"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _store(folder)
        name, count = uuid.uuid4().hex, 0
        fs.create_dir(top, recursive=True)
        unfinished, path = f"{top}/.{name}.unfinished", f"{top}/{name}.warc.gz"
        with fs.open_output_stream(unfinished, compression=None) as out:
            for batch in found:
                for first in range(0, batch.num_rows, 256):
                    for row in batch.slice(first, 256).to_pylist():
                        out.write(record(row["page_id"], row["url"], row["html"].encode("utf-8", "replace"),
                                         row["digest"], row["refers_to"]))
                        count += 1
        fs.move(unfinished, path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

    # Only archives whose task was committed are listed; others are never read.
    return stored(rows.mapInArrow(batches, "path string, records bigint"), "archives")


def read_archives(archives: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Records of the listed archives: page_id, url, record_type, refers_to, payload_digest (hex),
    payload_bytes, payload (null for revisits, or if not asked for).

    Fails on a record that is cut off, badly framed or does not match its digest.
    """
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(folder)
        shape = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                           ("refers_to", pa.int64()), ("payload_digest", pa.string()),
                           ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in found:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for member in members(iter(lambda: stream.read(BLOCK), b"")):  # noqa: B023
                        headers, body = parse(member)
                        kind = headers["warc-type"]
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append({
                            "page_id": _page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"),
                            "record_type": kind, "refers_to": _page(headers.get("warc-refers-to")),
                            "payload_digest": digest, "payload_bytes": int(headers["warc-payload-length"]),
                            "payload": body if payload and kind == "response" else None})
                        held += len(body) if payload else 256
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, shape)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, shape)

    spark = archives.sparkSession
    listed = archives.select("path").repartition(max(1, spark.sparkContext.defaultParallelism))
    return listed.mapInArrow(batches, "page_id bigint, url string, record_type string, refers_to bigint, "
                                      "payload_digest string, payload_bytes bigint, payload binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    folder = f"{work_folder(spark)}-warc"
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(archives, folder, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
