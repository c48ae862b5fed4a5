"""WARC archives: a writer through Spark's own file writer, and a sequential reader.

Archives are files of one gzip member per record. They are written and read by Spark, so any file system that Spark
reaches will do, and a task that is run again leaves no half archive. The reader decompresses one member at a time in
steps, frames the record by its Content-Length, and verifies the block and payload digests.

Duplicate payloads of at least ``min_revisit_bytes`` are written once: the record with the smallest page_id is a
response, the others are revisits that name it.

Edge cases: null html is an empty payload; null or line-broken URLs lose the target header or the line breaks; a null
page_id comes back null and never serves as the response of others; rows with the same page_id and payload are all
responses if that page_id is the smallest; an empty table gives no records; a truncated or damaged record raises
``WarcError``. Columns other than the three named ones are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_path

#: Bytes that a block of members has before it is handed to the writer, and blocks to a file.
BLOCK_BYTES, BLOCKS_PER_FILE = 4 << 20, 8
STEP = 1 << 16
RECORD_SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string"


class WarcError(ValueError):
    """A record that is damaged, truncated or doesn't match its digest."""


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with one WARC record; a revisit (``refers_to`` is set) holds the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", "", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of each gzip member of a stream, decompressed step by step; zero bytes between members are padding."""
    d, parts, rest = None, [], b""
    for chunk in chunks:
        rest = rest + chunk if rest else chunk
        while rest:
            if d is None:
                rest = rest.lstrip(b"\0")
                if not rest:
                    break
                d = zlib.decompressobj(31)
            try:
                parts.append(d.decompress(rest))
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            rest = d.unused_data
            if not d.eof:
                break
            yield b"".join(parts)
            d, parts = None, []
    if d is not None:
        raise WarcError("the last gzip member is cut short")


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    return out


def _page(uri: str | None) -> str | None:
    m = re.fullmatch(r"<urn:page:(.*)>", uri or "")
    return m[1] or None if m else None


def decode_record(raw: bytes) -> dict:
    """Frame one record by its lengths and verify its digests."""
    head, sep, body = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        raise WarcError("no WARC header")
    h = _headers(head)
    try:
        length = int(h["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise WarcError("the block doesn't match its Content-Length")
    block = body[:length]
    if h.get("warc-block-digest", "").removeprefix("sha256:") != hashlib.sha256(block).hexdigest():
        raise WarcError("the block doesn't match its digest")
    http, sep, payload = block.partition(b"\r\n\r\n")
    size, digest = int(_headers(http).get("content-length", len(payload))), h.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = h.get("warc-type")
    if kind == "response" and (size != len(payload) or digest != hashlib.sha256(payload).hexdigest()):
        raise WarcError("the payload doesn't match its digest")
    return {"record_type": kind, "record_id": _page(h.get("warc-record-id")), "target_uri": h.get("warc-target-uri"), "refers_to": _page(h.get("warc-refers-to")), "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest}


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """page_id, url, html, payload_digest and refers_to (null for responses).

    Only payloads that occur under more than one page_id are joined back; their first page is found by a partial
    aggregate, so a payload of a third of all rows is summed up before it moves, and the join's hot side can be split.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    p = p.withColumn("payload_digest", F.sha2(F.encode("html", "UTF-8"), 256))
    firsts = p.where(F.octet_length("html") >= min_revisit_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"))
    # written, so that its size is known: a small one is sent to the pages, a large one is joined by digest
    firsts = materialize(firsts.where("first_page < last_page").select("payload_digest", "first_page"), "firsts")
    return p.join(firsts, "payload_digest", "left").withColumn("refers_to", F.expr("CASE WHEN page_id > first_page OR page_id IS NULL THEN first_page END")).drop("first_page")


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 100) -> None:
    """Write one record for each row to gzip archives below ``path``.

    Spark's text writer ends each row with a separator; it is set to a zero byte, which stands for the last byte of a
    member's length field (zero below 16 MiB) or else is padding that gzip readers pass over.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            block = b"".join(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([block.removesuffix(b"\0")], pa.binary())], names=["value"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(encode_record(row[0], row[1], row[2].encode(), row[3], row[4]))
                size += len(held[-1])
                if size >= BLOCK_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    rows = with_revisits(pages, min_revisit_bytes).select("page_id", "url", "html", "payload_digest", "refers_to")
    out = rows.mapInArrow(blocks, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", "\0").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``, in the order in which they stand in each file."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"binary": pa.binary(), "long": pa.int64()}.get(t, pa.string())) for n, t in (x.split() for x in RECORD_SCHEMA.split(", "))])
        for batch in batches:
            for content in batch.column(0):
                view = memoryview(content.as_buffer() or b"")
                held, size = [], 0
                for raw in members(bytes(view[i : i + STEP]) for i in range(0, len(view), STEP)):
                    held.append(decode_record(raw))
                    size += len(raw)
                    if size >= BLOCK_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(records, RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes)
    return read_archives(spark, path)
