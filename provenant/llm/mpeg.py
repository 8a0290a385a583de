"""MPEG audio columns: bytes stored as Layer III main data, and a reader that resynchronises and checks frames.

The reader skips and parses ID3v2 and ID3v1 tags, finds frame headers (after damage: the next header that another one
follows), parses Xing, Info and VBRI tables, verifies frame checksums, and returns exact durations and frame offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import small, text_of

#: Payloads are filled with spaces to a positive multiple of this many bytes.
MULTIPLE = 192

# Fixed values of the MPEG audio format: kbit/s by (MPEG-1 or not, layer) for the indices 1 to 14, and Hz by version bits.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Layer II's bits of allocation as (subbands, bits), by the standard's tables a to d and that of lower rates.
ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2))}


def crc16(data: bytes, bits: int | None = None) -> int:
    """The format's checksum of the first bits (or all) of data: polynomial 0x8005, most significant bit first."""
    value = 0xFFFF
    for i in range(8 * len(data) if bits is None else bits):
        out = value >> 15 ^ data[i >> 3] >> 7 - (i & 7) & 1
        value = (value << 1 ^ 0x8005 if out else value << 1) & 0xFFFF
    return value


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int
    #: Subbands from here on have one allocation for both channels (joint stereo).
    bound: int = 32

    @property
    def kind(self) -> tuple[int, int, int]:
        """What all frames of a stream have in common."""
        return self.version, self.layer, self.rate


def header_of(word: bytes) -> Header | None:
    """The frame header in four bytes; None if they are none (free-format frames, of unknown size, included)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    index, rate_index = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3 or word[3] & 3 == 2:
        return None
    first, rate = version == 3, RATES[version][rate_index]
    kbits, padding = BITRATES[first, layer][index - 1], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12000 * kbits // rate + padding) * 4 if layer == 1 else samples // 8 * kbits * 1000 // rate + padding
    mono = word[3] >> 6 == 3
    side = (17 if mono else 32) if first else (9 if mono else 17)
    bound = 4 * ((word[3] >> 4 & 3) + 1) if word[3] >> 6 == 1 else 32
    return Header(version, layer, not word[1] & 1, kbits, rate, mono, size, samples, side if layer == 3 else 0, bound)


def covered_bits(head: Header, body: bytes) -> int | None:
    """How many bits of what follows a frame's checksum it covers, besides half of the header: Layer III's side information,
    the other layers' bit allocation, and in Layer II the scale factors' selection where bits are allocated. None if body ends before."""
    if head.layer == 3:
        return 8 * head.side if len(body) >= head.side else None
    channels = 1 if head.mono else 2
    if head.layer == 1:
        bits = 4 * 32 if head.mono else 4 * (2 * min(head.bound, 32) + 32 - min(head.bound, 32))
        return bits if 8 * len(body) >= bits else None
    each = head.kbits // channels
    if head.version != 3:
        kind = "low"
    elif each < 56:
        kind = "d" if head.rate == 32000 else "c"
    else:
        kind = "a" if head.rate == 48000 or each <= 80 else "b"
    at, chosen, subband = 0, 0, 0
    whole, end = int.from_bytes(body[:64], "big"), 8 * len(body[:64])  # the longest allocation takes less
    for many, width in ALLOCATION[kind]:
        for _ in range(many):
            shared = subband >= head.bound
            for _ in range(1 if shared else channels):
                at += width
                if at > end:
                    return None
                chosen += (whole >> end - at & (1 << width) - 1 != 0) * (channels if shared else 1)
            subband += 1
    return at + 2 * chosen if at + 2 * chosen <= 8 * len(body) else None


@dataclass
class Stream:
    """What a reader finds: frames in order, tags, the variable-bitrate table, and what it had to skip."""

    payload: bytes = b""
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bitrates: set[int] = field(default_factory=set)
    checked: int = 0
    failed: int = 0
    gaps: list[tuple[int, int]] = field(default_factory=list)
    table: dict = field(default_factory=dict)
    tags: dict = field(default_factory=dict)

    @property
    def duration_us(self) -> int:
        """Microseconds, rounded down; samples over rate is the exact duration."""
        return self.samples * 1_000_000 // self.rate if self.rate else 0


# The encoder's stream: MPEG-1 Layer III, 48 kHz, one channel, with checksums.
_RATE, _SIDE = 48000, 17
_HEAD = 4 + 2 + _SIDE
_SIZES = [3 * k for k in BITRATES[True, 3]]
_LARGEST = _SIZES[-1] - _HEAD


def _opening(index: int, count: int) -> bytes:
    """Header, checksum and side information of a frame whose granules hold count bytes of main data."""
    head = bytes((0xFF, 0xFA, index + 1 << 4 | 1 << 2, 0xC0))
    first = (count + 1) // 2
    bits = format(0, "018b") + "".join(format(8 * n, "012b") + "0" * 47 for n in (first, count - first))
    side = int(bits, 2).to_bytes(_SIDE, "big")
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes, title: str = "text") -> bytes:
    """payload as main data of 320 kbit/s frames and one shorter last frame, after an ID3v2 tag and a Xing table."""
    full, rest = divmod(len(payload), _LARGEST)
    parts = []
    if full:
        body = np.frombuffer(payload, np.uint8, full * _LARGEST).reshape(full, _LARGEST)
        opening = np.frombuffer(_opening(len(_SIZES) - 1, _LARGEST), np.uint8)
        parts.append(np.hstack([np.broadcast_to(opening, (full, _HEAD)), body]).tobytes())
    if rest:
        index = next(i for i, size in enumerate(_SIZES) if size - _HEAD >= rest)
        parts.append((_opening(index, rest) + payload[full * _LARGEST :]).ljust(_SIZES[index], b"\0"))
    audio = b"".join(parts)
    frames, info = full + bool(rest), 192
    total = info + len(audio)
    toc = bytes(min(255, (info + min(frames * i // 100, full) * _SIZES[-1]) * 256 // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 15, frames, total) + toc + struct.pack(">I", 0)
    first = (bytes((0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0)) + bytes(_SIDE) + table).ljust(info, b"\0")
    text = b"\0" + title.encode("latin-1", "replace")
    tag = b"TIT2" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag + first + audio


def _number(data: bytes, bits: int) -> int:
    """A big-endian number of which each byte has so many bits."""
    value = 0
    for byte in data:
        value = value << bits | byte & (1 << bits) - 1
    return value


#: How text is encoded, by the first byte of a text frame.
_ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _tag(data: bytes) -> tuple[dict, int]:
    """Text frames of a leading ID3v2 tag (versions 2 to 4), and where it ends; 0 without one."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return {}, 0
    version, flags = data[3], data[5]
    end = 10 + _number(data[6:10], 7)
    body = data[10 : min(len(data), end)]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")  # unsynchronised as a whole
    at = 0
    if flags & 0x40 and version > 2:  # an extended header; its size counts itself from version 4 on
        at = _number(body[:4], 7) if version == 4 else 4 + _number(body[:4], 8)
    name, head = (3, 6) if version == 2 else (4, 10)
    found = {}
    while at + head <= len(body) and body[at : at + name].strip(b"\0"):
        length = _number(body[at + name : at + (6 if version == 2 else 8)], 7 if version == 4 else 8)
        content = body[at + head : at + head + length]
        if version == 4 and body[at + 9] & 1:
            content = content[4:]  # a data length stands before
        if version == 4 and body[at + 9] & 2:
            content = content.replace(b"\xff\0", b"\xff")
        if body[at : at + 1] == b"T" and content:
            found[body[at : at + name].decode("latin-1")] = content[1:].decode(_ENCODINGS.get(content[0], "latin-1"), "replace").rstrip("\0")
        at += head + length
    return found, end + 10 * bool(flags & 0x10 and version == 4)


def _table(frame: bytes, head: Header) -> dict:
    """A Xing, Info or VBRI table in a first frame."""
    at = 4 + 2 * head.protected + head.side
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        found: dict = {"kind": frame[at : at + 4].decode()}
        flags, at = struct.unpack(">I", frame[at + 4 : at + 8])[0], at + 8
        for bit, name, width in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit and len(frame) >= at + width:
                found[name] = list(frame[at : at + width]) if name == "toc" else struct.unpack(">I", frame[at : at + 4])[0]
                at += width
        return found
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, stride = struct.unpack(">IIHHHH", frame[46:62])
        rows = [frame[62 + i * width : 62 + (i + 1) * width] for i in range(entries)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "stride": stride, "toc": [scale * int.from_bytes(x, "big") for x in rows if len(x) == width]}
    return {}


def decode(data: bytes) -> Stream:
    """Every frame of data, damaged stretches between them as gaps; empty input gives an empty stream."""
    out = Stream()
    out.tags, at = _tag(data)
    end = len(data)
    tag = end - 128 if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" else -1  # an ID3v1 tag, unless in a whole frame
    heads: dict[bytes, Header | None] = {}
    sums: dict[tuple[bytes, int | None], int] = {}
    parts, synced, first = [], True, True

    def at_header(i: int) -> Header | None:
        word = data[i : i + 4]
        if word not in heads:
            heads[word] = header_of(word)
        return heads[word]

    while at < end:
        if at == tag:
            out.tags.setdefault("TIT2", data[tag + 3 : tag + 33].rstrip(b"\0 ").decode("latin-1"))
            break
        head = at_header(at)
        after = at + head.size if head else 0
        if head and at < tag < after < end:  # a frame cut by the tag, unless another of its kind follows
            follower = at_header(after)
            head = head if follower and follower.kind == head.kind else None
        if head and not synced:  # damaged before: believe a header only if another of its kind, or the end, follows
            follower = at_header(after) if after < end else None
            head = head if after in (end, tag) or follower and follower.kind == head.kind else None
        if not head or after > end:
            synced = False
            start, at = at, data.find(b"\xff", at + 1, end)
            at = end if at < 0 else at
            at = tag if start < tag < at else at
            if out.gaps and out.gaps[-1][1] == start:
                out.gaps[-1] = (out.gaps[-1][0], at)
            else:
                out.gaps.append((start, at))
            continue
        synced = True
        frame = data[at:after]
        if first:
            first = False
            out.table = _table(frame, head)
            if out.table:
                at = after
                continue
        body = 4 + 2 * head.protected + head.side
        if head.protected:
            bits = covered_bits(head, frame[6:])
            covered = frame[2:4] + frame[6 : 6 + -(-(bits or 0) // 8)]
            if (covered, bits) not in sums:
                sums[covered, bits] = crc16(covered, 16 + (bits or 0))
            out.checked += 1
            out.failed += bits is None or sums[covered, bits] != frame[4] << 8 | frame[5]
        if head.version == 3 and head.layer == 3 and head.mono:
            side = int.from_bytes(frame[body - _SIDE : body], "big")
            count = ((side >> 106 & 0xFFF) + (side >> 47 & 0xFFF)) // 8
            parts.append(frame[body : body + count])
        out.offsets.append(at)
        out.samples += head.samples
        out.rate = out.rate or head.rate
        out.bitrates.add(head.kbits)
        at = after
    out.payload = b"".join(parts)
    return out


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary): each text's UTF-8 bytes, filled with spaces, as an MPEG audio stream.

    One row per row; a null or empty text is one block of spaces; null ids stay null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                raw = text.encode()
                sizes.append(len(raw))
                media.append(encode(raw.ljust(max(1, -(-len(raw) // MULTIPLE)) * MULTIPLE)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, n_frames long, frames_failed long, gap_bytes long, seek_offsets array<int>"


def features(media: DataFrame) -> DataFrame:
    """Columns doc_id, n_bytes and media -> doc_id, n_bytes and what the stored bytes hold; null media read as empty.

    seek_offsets has the place of every frame; duration_us and n_frames leave out the table's frame.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for data in batch.column(2).to_pylist():
                data = data or b""
                s = decode(data)
                digest = hashlib.sha256(s.payload).hexdigest()
                says = f"mpeg;hz={s.rate};frames={len(s.offsets)};samples={s.samples};kbits={'/'.join(map(str, sorted(s.bitrates)))};table={s.table.get('kind', '-')}:{s.table.get('frames', 0)};crc={s.checked - s.failed}/{s.checked};gaps={len(s.gaps)};first={s.offsets[0] if s.offsets else 0};payload={digest[:16]}"
                rows.append((len(s.payload), digest, zlib.crc32(s.payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), says, s.duration_us, len(s.offsets), s.failed, sum(b - a for a, b in s.gaps), s.offsets))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int32())]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "n_bytes", *(x.split()[0] for x in FEATURES.split(", "))])

    return media.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), "media").mapInArrow(run, f"doc_id long, n_bytes long, {FEATURES}")
