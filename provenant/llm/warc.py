"""WARC archives: a writer that keeps each payload once, and a salvage reader.

The reader checks every gzip member and record (compression, version line, length, block digest). After a failed check
it searches for the next member or version line that passes, goes on there, and logs the bytes between as a gap. In a member
that is cut or damaged, what could be unpacked before is searched in the same way.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import checkpoint

#: Payloads from this size on are stored once; equal ones revisit that record.
LEAST = 1000
#: Bytes after which an archive ends and the next one begins.
ARCHIVE = 8 << 20
#: Compression level of the members.
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 14
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: A record's headers end within so many bytes; longer ones are taken for damage.
_HEADERS = 1 << 20


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page: str) -> str:
    return f"<urn:page:{page}>"


def record(kind: str, page: str, url: str, payload: bytes, refers_to: str | None = None, level: int = LEVEL) -> bytes:
    """One gzip member with a response record, or a revisit record that leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: {_digest(block)}", f"WARC-Payload-Digest: {_digest(payload)}",
        *([f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _record(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record at a place of plain bytes, and where it ends; None if a check fails."""
    if not _VERSION.match(data, at):
        return None
    body = data.find(b"\r\n\r\n", at, at + _HEADERS) + 4
    if body < 4:
        return None
    pairs = (line.partition(b":") for line in data[at:body].split(b"\r\n")[1:] if b":" in line)
    heads = {k.decode("latin-1").lower(): v.strip().decode("utf-8", "replace") for k, _, v in pairs}
    length = heads.get("content-length", "")
    if not length.isdigit() or data[body + int(length) : body + int(length) + 4] != b"\r\n\r\n":
        return None
    block = data[body : body + int(length)]
    if heads.get("warc-block-digest", "").startswith("sha1:") and heads["warc-block-digest"] != _digest(block):
        return None
    return {"heads": heads, "block": block}, body + int(length) + 4


def _member(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at a place unpacks to, and where it ends; None if it is cut or damaged, or no member at all."""
    unpacker, parts, i, step = zlib.decompressobj(31), [], at, 256  # most false members fail in their first bytes
    try:
        while not unpacker.eof and i < len(data):
            parts.append(unpacker.decompress(data[i : i + step]))
            i, step = min(len(data), i + step), min(2 * step, _CHUNK)
    except zlib.error:
        return b"".join(parts), None
    return b"".join(parts), i - len(unpacker.unused_data) if unpacker.eof else None


def _inside(plain: bytes) -> Iterator[tuple[int, int, dict | None]]:
    """(start, end, record) of the records of plain bytes that pass, and (start, end, None) of the gaps between them."""
    at, gap = 0, -1
    while at < len(plain):
        found = _record(plain, at)
        if found:
            if gap >= 0:
                yield gap, at, None
                gap = -1
            yield at, found[1], found[0]
            at = found[1]
            continue
        gap = at if gap < 0 else gap
        following = _VERSION.search(plain, at + 1)
        at = following.start() if following else len(plain)
    if gap >= 0:
        yield gap, len(plain), None


@dataclass(frozen=True)
class Found:
    """A record, or a gap (without one), at bytes start to end of an archive; inner: its place in what the member there unpacks to,
    if that has other records or is damaged."""

    start: int
    end: int
    record: dict | None
    inner: tuple[int, int] | None = None


def salvage(data: bytes) -> Iterator[Found]:
    """All records that pass and the gaps, in the order of the bytes. A damaged member's bytes are a gap as a whole; the records
    unpacked before the damage come before it."""
    at, gap, members, versions = 0, -1, -2, -2  # the next places of either kind, from where they were searched last
    kept: list[Found] = []  # of the damaged member that the gap begins with, or later ones
    while at < len(data):
        own: list[Found] = []
        end = None
        if data.startswith(_MAGIC, at):
            plain, end = _member(data, at)
            parts = list(_inside(plain))
            whole = end is not None and len(parts) == 1 and parts[0][2] is not None
            if end is not None and any(one for _, _, one in parts):
                own = [Found(at, end, one, None if whole else (a, b)) for a, b, one in parts]
            else:
                end = None
                kept += [Found(at, at, one, (a, b)) for a, b, one in parts if one]
        else:
            found = _record(data, at)
            if found:
                end = found[1]
                own = [Found(at, end, found[0])]
        if end is not None:
            if gap >= 0:
                yield from (replace(x, end=at) for x in kept)
                yield Found(gap, at, None)
                gap, kept = -1, []
            yield from own
            at = end
            continue
        gap = at if gap < 0 else gap
        if members <= at:
            place = data.find(_MAGIC, at + 1)
            members = place if place >= 0 else len(data)
        if versions <= at:
            place = _VERSION.search(data, at + 1)
            versions = place.start() if place else len(data)
        at = min(members, versions)
    if gap >= 0:
        yield from (replace(x, end=len(data)) for x in kept)
        yield Found(gap, len(data), None)


def archives(pages: DataFrame, least: int = LEAST, size: int = ARCHIVE, level: int = LEVEL) -> DataFrame:
    """page_id, url, html -> archive (name), content (binary): archives of about `size` bytes, a record for each row.

    Of rows with equal payloads of at least `least` bytes, those with the largest page_id are responses and others revisit
    them; a null html is empty, a null url is written as an empty one, a null page_id counts as less than any other.
    Repeated rows get a record each; an empty table gives no archive; other columns are not read.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("payload_sha1"))
    slim = checkpoint(rows.where(F.octet_length("html") >= least).select("page_id", "payload_sha1"))
    top = slim.groupBy("payload_sha1").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = slim.join(top, "payload_sha1").where("page_id IS NULL AND top IS NOT NULL OR page_id < top").distinct()
    own = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    revisits = revisits.select(own.alias("page"), F.col("payload_sha1").alias("equal_sha1"), "top")
    keyed = rows.withColumn("page", own)
    told = keyed.join(revisits, (keyed["page"] == revisits["page"]) & (F.col("payload_sha1") == F.col("equal_sha1")), "left").select(keyed["page"], "url", "html", F.col("top").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, number, held, total = context.partitionId() if context else 0, 0, [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "content"])

        for batch in batches:
            for page, url, text, top_page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record("response" if top_page is None else "revisit", page, url, text.encode(), top_page, level))
                total += len(held[-1])
                if total >= size:
                    yield closed()
                    number, held, total = number + 1, [], 0
        if held:
            yield closed()

    return told.mapInArrow(run, "archive string, content binary")


def read(found: DataFrame, with_payload: bool = True) -> DataFrame:
    """archive, content -> a row per record or gap: archive, start, end (bytes), inner_start, inner_end (see Found), kind ('record'
    or 'gap'), record_type, record_id, target_uri, refers_to, payload_bytes, payload_sha1 and, if asked for, payload.

    Any binary column will do, so spark.read.format("binaryFile") reads archives of other writers. Size and digest are those
    of the bytes read; a revisit, which has none, tells those of its headers. Null or empty content gives no rows.
    """

    def row(archive: str, found: Found) -> tuple:
        place, one = (archive, found.start, found.end, *(found.inner or (None, None))), found.record
        if one is None:
            return (*place, "gap", *[None] * 7)
        heads, block = one["heads"], one["block"]
        http = block.startswith(b"HTTP/")
        top, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if heads.get("warc-type") == "revisit":
            length = re.search(rb"(?im)^content-length:\s*(\d+)", top)
            size = int(length[1]) if length else None
            said = heads.get("warc-payload-digest", "")
            digest = base64.b32decode(said[5:]).hex() if re.fullmatch(r"sha1:[A-Z2-7]{32}", said) else None
        return *place, "record", heads.get("warc-type"), heads.get("warc-record-id"), heads.get("warc-target-uri"), heads.get("warc-refers-to"), size, digest, payload if with_payload else None

    kinds = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
    names = ["archive", "start", "end", "inner_start", "inner_end", "kind", "record_type", "record_id", "target_uri", "refers_to", "payload_bytes", "payload_sha1", "payload"]
    keep = len(names) if with_payload else len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [row(archive.as_py(), x) for x in salvage(content.as_py() or b"")]
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns[:keep], names[:keep])

    schema = "archive string, start long, end long, inner_start long, inner_end long, kind string, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_sha1 string"
    return found.select("archive", "content").mapInArrow(run, schema + ", payload binary" * with_payload)


def page_of(urn: str) -> str:
    """SQL for the page number in a record id of ours."""
    return f"try_cast(regexp_extract({urn}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)"
