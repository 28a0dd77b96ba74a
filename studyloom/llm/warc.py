"""WARC archives: one gzip member per record, written block by block and read back in sequence.

An archive is a row (archive, content): content holds whole gzip members, so every row is a valid
``.warc.gz`` by itself and rows joined end to end are one too. Rows go through Spark's own writer, so
any shared store works and a lost executor's part is written anew.

Payload digests are bare upper-case base32 SHA-1. Of rows with equal payloads, the one with the smallest page id
becomes a ``response``; the others become a ``revisit`` that names it and holds no payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_SHARE, batch, rows, text_or_empty, written

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"

ARCHIVES = "archive string, content binary"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"
RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                           ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_())])


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def first_of_equals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows (page_id, url, payload, first): first is the smallest page id with the same payload.

    Payloads are grouped by their SHA-1, aggregated before the shuffle. A payload that holds a large share of
    all rows is joined from a broadcast list, which by that share has at most 1 / HEAVY_SHARE rows; the others
    go through an ordinary join. Payloads under ``min_bytes`` keep a null ``first``.
    """
    keyed = pages.withColumn("_sha", F.when(F.length("payload") >= min_bytes, F.sha1("payload")))
    ids = keyed.select("page_id", "_sha").where("_sha is not null")
    # two passes over the groups, so they are written once
    groups = written(ids.groupBy("_sha").agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1"), "warc-groups")
    least = max(2, int(pages.count() * HEAVY_SHARE))
    heavy = groups.where(F.col("_n") >= least).select("_sha", F.struct("first").alias("_h"))
    light = groups.where(F.col("_n") < least).select("_sha", F.struct("first").alias("_l"))
    out = keyed.join(F.broadcast(heavy), "_sha", "left")
    # rows that are settled get a key of their own, so that a heavy payload does not meet in one task
    spread = F.when(F.col("_sha").isNotNull() & F.col("_h").isNull(), F.col("_sha")).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string")))
    out = out.withColumn("_sha", spread).join(light, "_sha", "left")
    return out.select("page_id", "url", "payload", F.coalesce("_h.first", "_l.first").alias("first"))


def _urn(page_id: int | None, url: str | None) -> str:
    return f"<{URN}{page_id if page_id is not None else 'none-' + sha1_base32((url or '').encode())}>"


def _page_of(urn: str) -> int | None:
    found = re.fullmatch(rf"<{URN}(-?[0-9]+)>", urn)
    return int(found[1]) if found else None


def _record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """One gzip member. A page is a revisit if another, smaller page id has the same payload."""
    revisit = first is not None and page_id != first
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), f"WARC-Record-ID: {_urn(page_id, url)}".encode(), f"WARC-Date: {date}".encode()]
    if url is not None:  # control characters would break the framing
        head.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode("utf-8", "replace"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}".encode(), f"WARC-Refers-To: {_urn(first, None)}".encode()]
    head += [f"WARC-Payload-Digest: sha1:{digest}".encode(), f"WARC-Block-Digest: sha1:{sha1_base32(block)}".encode(),
             b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=5, mtime=0)


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
                   archive_bytes: int = 8 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive rows for a table of pages, written to the shared folder.

    Null html is an empty payload, a null url gives a record without target, a null page id a record without a number;
    among equals, rows that share the smallest id are all responses, and so are all of a group without any id.
    A record is never cut: one larger than ``archive_bytes`` fills an archive of its own.
    """
    src = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.encode(text_or_empty(html), "UTF-8").alias("payload"))
    schema = pa.schema([("archive", pa.string()), ("content", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, buffer = TaskContext.get().partitionId(), 0, io.BytesIO()
        for some in rows(batches, 64):
            for r in some:
                buffer.write(_record(r["page_id"], r["url"], r["payload"], r["first"], date))
                if buffer.tell() >= archive_bytes:
                    yield batch(schema, [[f"{part:06d}-{number:06d}"], [buffer.getvalue()]])
                    number, buffer = number + 1, io.BytesIO()
        if buffer.tell():
            yield batch(schema, [[f"{part:06d}-{number:06d}"], [buffer.getvalue()]])

    return written(first_of_equals(src, min_bytes).mapInArrow(write, ARCHIVES), "warc")


def members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of an archive one after the other, inflated a step at a time."""
    at = 0
    while at < len(content):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            piece = content[at:at + step]
            if not piece:
                raise ValueError("archive ends inside a gzip member")
            out.append(inflate.decompress(piece))
            at += len(piece)
        at -= len(inflate.unused_data)
        yield b"".join(out)


def _number(fields: dict[str, str], name: str) -> int | None:
    value = fields.get(name, "")
    return int(value) if re.fullmatch("[0-9]+", value) else None


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
        else:
            key, _, value = line.partition(b":")
            name = key.strip().lower().decode("utf-8", "replace")
            out[name] = value.strip().decode("utf-8", "replace")
    return out


def _agrees(stated: str, data: bytes) -> bool | None:
    """Whether a stated digest is that of the data; None for an algorithm or spelling that is not checked."""
    kind, _, value = stated.partition(":")
    name = {"sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "md5": "md5"}.get(kind.lower())
    if name is None:
        return None
    raw = hashlib.new(name, data).digest()
    if len(value) == 2 * len(raw):
        return value.lower() == raw.hex()
    return value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def _bare(stated: str | None) -> str | None:
    """A stated SHA-1 as bare base32, or None."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() not in ("sha1", "sha-1"):
        return None
    return base64.b32encode(bytes.fromhex(value)).decode() if re.fullmatch("[0-9a-fA-F]{40}", value) else value.upper()


def parse_record(data: bytes) -> dict:
    """Fields of one record of any type; Content-Length frames the block, digests are computed anew and compared.

    HTTP blocks are cut into head and payload; of other blocks all is payload. ``digest_ok`` is null if the record states nothing
    that could be checked. Without a stated SHA-1 the computed one is given. A revisit's size and digest are those it states, or null.
    """
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _fields(lines[1:])
    length = _number(fields, "content-length")
    if length is None:
        raise ValueError("record without Content-Length")
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("record does not end where Content-Length says")
    kind = fields.get("warc-type", "unknown").lower()
    revisit, size, payload = kind == "revisit", None, block
    if block.startswith(b"HTTP/") or fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        http_fields = _fields(http.split(b"\r\n")[1:])
        # a coded transfer has no length of its own
        size = None if "transfer-encoding" in http_fields else _number(http_fields, "content-length")
    stated = fields.get("warc-payload-digest")
    found = [_agrees(fields["warc-block-digest"], block) if "warc-block-digest" in fields else None]
    if not revisit:
        found += [_agrees(stated, payload) if stated else None, size == len(payload) if size is not None and kind == "response" else None]
    found = [x for x in found if x is not None]
    return {"page_id": _page_of(fields.get("warc-record-id", "")), "url": fields.get("warc-target-uri"), "payload": None if revisit else payload,
            "payload_bytes": size if revisit else len(payload), "payload_digest": _bare(stated) or (None if revisit else sha1_base32(payload)),
            "record_type": kind, "refers_to": _page_of(fields.get("warc-refers-to", "")) if revisit else None, "digest_ok": all(found) if found else None}


def _damaged(data: bytes | None) -> dict:
    return {n: None for n in RECORD_SCHEMA.names} | {"payload": data, "payload_bytes": len(data) if data is not None else None, "record_type": "damaged", "digest_ok": False}


def records_of(content: bytes, strict: bool = True) -> Iterator[tuple[int, dict]]:
    """The records of an archive with their inflated sizes; see :func:`read_archives` for ``strict``."""
    try:
        for member in members(content):
            try:
                record = parse_record(member)
            except ValueError:
                if strict:
                    raise
                record = _damaged(member)
            yield len(member), record
    except (ValueError, zlib.error):
        if strict:
            raise
        yield 0, _damaged(None)


def read_archives(archives: DataFrame, strict: bool = True) -> DataFrame:
    """Read archive rows in sequence, records of any WARC type. A wrong digest shows in ``digest_ok``.

    Damaged framing fails the task; with ``strict`` off, such a record is a row of type ``damaged`` with its bytes as payload, and an archive
    whose compression breaks off gives what stands before the break and one ``damaged`` row without payload for the rest.

    A revisit has no payload of its own: its size and digest are those its record states for the response;
    :func:`revisit_faults` compares them with the response itself. Null and empty archives have no record.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                held, size = [], 0
                for inflated, record in records_of(content.as_py() or b"", strict):
                    held.append(record)
                    size += inflated
                    if size >= 4 << 20:
                        yield batch(RECORD_SCHEMA, [[r[n] for r in held] for n in RECORD_SCHEMA.names])
                        held, size = [], 0
                if held:
                    yield batch(RECORD_SCHEMA, [[r[n] for r in held] for n in RECORD_SCHEMA.names])

    return archives.select("content").mapInArrow(read, RECORDS)


def revisit_faults(records: DataFrame) -> DataFrame:
    """Revisits, grouped by what they claim, whose response is missing or differs in size or digest."""
    claims = records.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest", "payload_bytes").agg(F.count("*").alias("n_revisits"))
    there = records.where("record_type = 'response' and digest_ok").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return claims.join(there, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def read_files(spark, paths: str, strict: bool = True) -> DataFrame:
    """Records of ``.warc.gz`` files at a path or glob, one file per row as Spark's binary source reads it (2 GB a file at most)."""
    return read_archives(spark.read.format("binaryFile").load(paths).select("content"), strict)
