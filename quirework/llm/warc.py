"""WARC archives with Zstandard frames: one frame per record, the dictionary in a leading skippable frame.

An archive is one binary value: a row of a table with a ``content`` column, as written by ``write_archives`` or as read from
files by ``spark.read.format("binaryFile")``.  Archives are cut at ``archive_bytes`` of records, so a task holds one archive and
one Arrow batch at a time.  A payload that occurs again is written as a ``revisit`` record without payload; the record with the
largest id among equal payloads is the ``response``.

Edge cases: a null payload is empty, and empty payloads are equal to each other.  Rows that repeat the largest id of a payload
are all responses.  A null id comes back as null and counts as the smallest; if all rows of a payload have null ids, all are
responses.  A null url gives a record without target address; control characters in an address are percent-encoded.  Extra
columns are ignored.  A record that fails a check (magic, checksum, version line, header, length, digest) comes back as a row
with ``error`` set and nulls; reading goes on at the next frame if the frame's own bounds are sound.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

DICT_MAGIC, FRAME_MAGIC, RAW_DICT = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, error string"
_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())]
)
_URN = re.compile(rb"^<urn:x-page:(-?\d+|none)>$")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to=None, revisit=False, date="2024-01-01T00:00:00Z") -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    urn = lambda v: b"<urn:x-page:%s>" % (b"none" if v is None else str(v).encode())
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + urn(page_id), b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], utf8(url)))
    head.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + urn(refers_to)]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = 3, dict_bytes: int = 32 << 10) -> bytes:
    """The records as one archive, with a dictionary trained on at most 2 MB of them."""
    sample, room = [], 2 << 20
    for r in records[:: max(1, len(records) // 400)]:
        if (room := room - len(r)) < 0:
            break
        sample.append(r)
    try:
        trained = zstandard.train_dictionary(dict_bytes, sample)
        lead = struct.pack("<II", DICT_MAGIC, len(trained.as_bytes())) + trained.as_bytes()
    except zstandard.ZstdError:  # too few or too short samples: an archive without a dictionary
        trained, lead = None, b""
    if trained:
        trained.precompute_compress(level=level)
    c = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    return lead + b"".join(c.compress(r) for r in records)


def write_archives(pages: DataFrame, archive_bytes: int = 8 << 20, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """``content``: archives that hold one record per row of ``pages``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = (
        rows.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("digest", "keep", F.lit(True).alias("shared"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_pydict({"content": pa.array([archive(held)], pa.large_binary() if size > 1 << 30 else pa.binary())})
        for batch in batches:
            for part in slices(batch):
                for r in part.to_pylist():
                    revisit = bool(r["shared"]) and r["keep"] != r["page_id"]
                    digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                    held.append(record_bytes(r["page_id"], r["url"], utf8(r["payload"]), digest, r["keep"], revisit))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return rows.join(again, "digest", "left").mapInArrow(write, "content binary")


def frame_end(buf, at: int) -> int:
    """Where the frame at ``at`` ends, from its header and its blocks' headers."""
    p = zstandard.get_frame_parameters(buf[at : at + 32])
    at += zstandard.frame_header_size(buf[at : at + 32])
    while True:
        head = int.from_bytes(buf[at : at + 3], "little")
        if at + 3 > len(buf) or head >> 1 & 3 == 3:
            raise zstandard.ZstdError("broken block")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * p.has_checksum
    if at > len(buf):
        raise zstandard.ZstdError("truncated frame")
    return at


def _headers(raw: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("header line without a name")
        out[name.strip().lower()] = value.strip()
    return out


def _number(urn: bytes):
    m = _URN.match(urn)
    if not m:
        raise ValueError("record id is not of this writer's form")
    return None if m[1] == b"none" else int(m[1])


def parse_record(raw: bytes) -> dict:
    """Fields of one decoded record; ValueError if it breaks a rule."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not sep or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no version line")
    h = _headers(lines)
    missing = [k.decode() for k in (b"warc-type", b"warc-record-id", b"warc-date", b"content-length", b"warc-payload-digest") if k not in h]
    if missing:
        raise ValueError("missing " + ", ".join(missing))
    size = h[b"content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("content length does not hold")
    http, sep, payload = rest[:-4].partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no HTTP header")
    inner = _headers(http.partition(b"\r\n")[2])
    length, kind = int(inner.get(b"content-length", b"-1")), h[b"warc-type"].decode()
    digest = h[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError("payload length or digest does not hold")
    if kind == "revisit" and (payload or length < 0 or b"warc-refers-to" not in h):
        raise ValueError("revisit record with a payload, or without length or target")
    url = h.get(b"warc-target-uri")
    return {
        "page_id": _number(h[b"warc-record-id"]),
        "url": None if url is None else url.decode("utf-8", "replace"),
        "record_type": kind,
        "payload_digest": digest,
        "payload_bytes": length,
        "refers_to": _number(h[b"warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
        "error": None,
    }


def read_archive(content: bytes, payloads: bool = True) -> Iterator[dict]:
    """Records of one archive in order; a broken one as a row that has only ``error``."""
    buf, at = memoryview(content), 0
    broken = lambda e: dict.fromkeys(_ARROW.names) | {"error": f"byte {at}: {e}"}
    decoder = zstandard.ZstdDecompressor()
    while at < len(buf):
        magic, size = int.from_bytes(buf[at : at + 4], "little"), int.from_bytes(buf[at + 4 : at + 8], "little")
        try:
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                if at + 8 + size > len(buf):
                    raise ValueError("truncated skippable frame")
                if at == 0 and magic == DICT_MAGIC:
                    raw = bytes(buf[8 : 8 + size])
                    if int.from_bytes(raw[:4], "little") == FRAME_MAGIC:
                        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                    if int.from_bytes(raw[:4], "little") != RAW_DICT:
                        raise ValueError("no dictionary in the leading frame")
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                at += 8 + size
                continue
            if magic != FRAME_MAGIC:
                raise ValueError("no frame")
            end = frame_end(buf, at)
        except (ValueError, zstandard.ZstdError) as e:  # bounds unknown: what follows can't be told apart
            yield broken(e)
            return
        try:
            r = parse_record(decoder.decompressobj().decompress(bytes(buf[at:end])))
            yield r if payloads else r | {"payload": None}
        except (ValueError, zstandard.ZstdError) as e:
            yield broken(e)
        at = end


def read_archives(archives: DataFrame, payloads: bool = True, content: str = "content") -> DataFrame:
    """Columns of ``RECORD``, one row per record.  ``payloads=False`` checks payloads but does not return them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                held, size = [], 0
                for r in read_archive(value.as_py() or b"", payloads):
                    held.append(r)
                    size += 200 + len(r["payload"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)

    return archives.select(content).mapInArrow(read, RECORD)


def read_files(spark, path: str, payloads: bool = True) -> DataFrame:
    """Records of ``.warc.zst`` files, one task's work per file."""
    return read_archives(spark.read.format("binaryFile").load(path), payloads)
