"""MPEG audio columns: payloads in Layer III frames, and a reader that resynchronises, verifies and indexes them.

A clip is an ID3v2 tag, one variable-bitrate ("Xing") frame, then MPEG-2 Layer III frames of 576 samples. Each frame is
protected by a CRC-16 and carries 576 payload bytes behind an all-zero (silent) side information block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame

from tracequarry.llm.common import arrow_schema, bounded_batches, map_rows

# Fixed values of the MPEG audio header (ISO/IEC 11172-3 and 13818-3): kbit/s by index, Hz by index.
BITRATES = {
    ("1", 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    ("1", 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    ("1", 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    ("2", 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    ("2", 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    ("2", 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
SAMPLES = {("1", 1): 384, ("1", 2): 1152, ("1", 3): 1152, ("2", 1): 384, ("2", 2): 1152, ("2", 3): 576}
UNIT = 576


def crc16(data: bytes, value: int = 0xFFFF) -> int:
    """The frame checksum: polynomial 0x8005, most significant bit first."""
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = ((value << 1) ^ 0x8005) & 0xFFFF if value & 0x8000 else value << 1
    return value


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    mode: int
    extension: int

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def bound(self) -> int:
        """The subband from which both channels share what is said, in Layers I and II."""
        return 4 * (self.extension + 1) if self.mode == 1 else 32

    @property
    def samples(self) -> int:
        return SAMPLES["1" if self.version == "1" else "2", self.layer]

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12 * self.bitrate * 1000 // self.rate + self.padding) * 4
        return self.samples // 8 * self.bitrate * 1000 // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of side information, which Layer III has."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == "1" else (9 if self.mono else 17)


_headers: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The header in four bytes, None if they aren't one (free-format frames included)."""
    if four not in _headers:
        if len(_headers) > 50_000:
            _headers.clear()
        _headers[four] = _header(four)
    return _headers[four]


def _header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {0: "2.5", 2: "2", 3: "1"}.get(four[1] >> 3 & 3)
    layer = {1: 3, 2: 2, 3: 1}.get(four[1] >> 1 & 3)
    rate, speed = four[2] >> 2 & 3, four[2] >> 4
    if version is None or layer is None or rate == 3 or speed in (0, 15) or four[3] & 3 == 2:
        return None
    bitrate = BITRATES["1" if version == "1" else "2", layer][speed]
    return Header(version, layer, not four[1] & 1, bitrate, RATES[version][rate], four[2] >> 1 & 1, four[3] >> 6, four[3] >> 4 & 3)


def crc16_bits(data: bytes, bits: int, value: int) -> int:
    """crc16 over a number of bits."""
    value = crc16(data[: bits // 8], value)
    for i in range(bits // 8 * 8, bits):
        top = (value >> 15) ^ (data[i // 8] >> (7 - i % 8) & 1)
        value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return value


def allocation_widths(h: Header) -> list[int]:
    """Bits that tell each subband's allocation in a Layer II frame, by sampling and bit rate of a channel.

    Fixed values (ISO/IEC 11172-3 tables B.2a-d, 13818-3 table B.1): runs of 4, 3 and 2 bits.
    """
    each = h.bitrate if h.mono else h.bitrate // 2
    if h.version != "1":
        four, three, two = 4, 7, 19
    elif each <= 48:
        four, three, two = (2, 10, 0) if h.rate == 32000 else (2, 6, 0)
    else:
        four, three, two = (11, 12, 4) if h.rate == 48000 or each <= 80 else (11, 12, 7)
    return [4] * four + [3] * three + [2] * two


def protected_bits(h: Header, body: bytes) -> int | None:
    """How many bits behind the checksum it covers; None if the frame is too short to tell."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    shared = lambda sb: channels if sb < h.bound else 1
    if h.layer == 1:
        return 4 * sum(shared(sb) for sb in range(32))
    bits = at = 0
    stream, length = int.from_bytes(body[:64], "big"), 8 * len(body[:64])
    for sb, width in enumerate(allocation_widths(h)):
        for _ in range(shared(sb)):
            if at + width > length:
                return None
            used = stream >> (length - at - width) & ((1 << width) - 1)
            at += width
            bits += 2 * (used > 0) * (1 if sb < h.bound else channels)
    return at + bits


#: MPEG-2, Layer III, protected, 160 kbit/s, 16 kHz, mono: 720 bytes a frame.
FRAME_HEADER = bytes((0xFF, 0xF2, 0xE8, 0xC0))
_H = _header(FRAME_HEADER)
_SIDE = bytes(_H.side)
_LEAD = FRAME_HEADER + crc16(FRAME_HEADER[2:] + _SIDE).to_bytes(2, "big") + _SIDE
_FILL = bytes(_H.size - len(_LEAD) - UNIT)


def pad(raw: bytes) -> bytes:
    """raw and bytes 255 up to a positive multiple of the unit."""
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write_clip(payload: bytes, title: str = "") -> bytes:
    """A clip that holds payload, whose length is a multiple of the unit."""
    frames = len(payload) // UNIT
    text = b"\x03" + title.encode()
    tag = b"TIT2" + synchsafe(len(text)) + b"\0\0" + text
    total = _H.size * (frames + 1)
    toc = bytes(min(255, 256 * (_H.size + _H.size * (frames * p // 100)) // total) for p in range(100))
    info = b"Xing" + struct.pack(">III", 7, frames, total) + toc
    out = [b"ID3\x04\0\0", synchsafe(len(tag)), tag, _LEAD, info, bytes(_H.size - len(_LEAD) - len(info))]
    for at in range(0, len(payload), UNIT):
        out += (_LEAD, payload[at : at + UNIT], _FILL)
    return b"".join(out)


@dataclass
class Clip:
    payload: bytes = b""
    title: str = ""
    frames: int = 0
    samples: int = 0
    rate: int = 0
    crc_bad: int = 0
    skipped: int = 0
    declared_frames: int | None = None
    declared_bytes: int | None = None
    toc: bytes = b""
    offsets: list[int] = field(default_factory=list)
    kbps_sum: int = 0
    artist: str = ""
    table: str = ""

    @property
    def seconds(self) -> Fraction:
        return Fraction(self.samples, self.rate) if self.rate else Fraction(0)


_crcs: dict[bytes, int] = {}


def _holds(data: bytes, at: int, h: Header) -> bool:
    """Whether a protected frame's checksum is that of its header and of what it covers."""
    body = data[at + 6 : at + h.size]
    bits = protected_bits(h, body)
    if bits is None or bits > 8 * len(body):
        return False
    key = data[at + 2 : at + 4] + body[: -(-bits // 8)]
    if h.layer != 3:
        return int.from_bytes(data[at + 4 : at + 6], "big") == crc16_bits(body, bits, crc16(key[:2]))
    if key not in _crcs:
        if len(_crcs) > 50_000:
            _crcs.clear()
        _crcs[key] = crc16(key)
    return int.from_bytes(data[at + 4 : at + 6], "big") == _crcs[key]


def _text(raw: bytes) -> str:
    """A text frame of an ID3v2 tag: its first byte names the encoding."""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 3, "utf-8")
    return raw[1:].decode(kind, "replace").strip("\0")


def _table(clip: Clip, data: bytes, at: int, body_at: int) -> bool:
    """Reads a variable-bitrate table if the first frame holds one: Xing or Info behind the side information, or VBRI 32
    bytes behind the header."""
    if data[body_at : body_at + 4] in (b"Xing", b"Info"):
        clip.table = data[body_at : body_at + 4].decode()
        flags, p = int.from_bytes(data[body_at + 4 : body_at + 8], "big"), body_at + 8
        if flags & 1:
            clip.declared_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 2:
            clip.declared_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            clip.toc = data[p : p + 100]
        return True
    p = at + 36
    if data[p : p + 4] == b"VBRI" and len(data) >= p + 26:
        clip.table = "VBRI"
        clip.declared_bytes, clip.declared_frames = struct.unpack(">II", data[p + 10 : p + 18])
        entries, _, width, _ = struct.unpack(">HHHH", data[p + 18 : p + 26])
        clip.toc = data[p + 26 : p + 26 + entries * width]
        return True
    return False


def read_clip(data: bytes, unit: int | None = UNIT) -> Clip:
    """Reads a clip: tags, table of the first frame, then frame after frame; bytes that are no frame are skipped.

    A header counts when the frame it announces ends at another header of the same stream or at the end of the data, or
    when its own checksum holds, so payload bytes that look like a header don't start a frame. Frames whose checksum
    fails are counted, and kept. offsets: where every frame begins. unit: payload bytes of a frame; None: all its bytes
    behind header, checksum and side information.
    """
    clip, at, end = Clip(), 0, len(data)
    if data[:3] == b"ID3" and end >= 10:
        size = 0
        for b in data[6:10]:
            size = size << 7 | b & 0x7F
        body, p = data[10 : 10 + size], 0
        while p + 10 <= len(body) and body[p : p + 4].strip(b"\0"):
            n = 0
            for b in body[p + 4 : p + 8]:  # sizes are synchsafe from version 4 on
                n = n << 7 | b & 0x7F if data[3] >= 4 else n << 8 | b
            if body[p : p + 4] == b"TIT2":
                clip.title = _text(body[p + 10 : p + 10 + n])
            if body[p : p + 4] == b"TPE1":
                clip.artist = _text(body[p + 10 : p + 10 + n])
            p += 10 + n
        at = 10 + size
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        clip.title = clip.title or data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").strip()
        clip.artist = clip.artist or data[end + 33 : end + 63].split(b"\0")[0].decode("latin-1").strip()
    payload, first = [], True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        good = h is not None and at < after <= end
        if good and after + 4 <= end:
            follow = header(data[after : after + 4])
            good = follow is not None and (follow.version, follow.layer, follow.rate) == (h.version, h.layer, h.rate)
            if not good and h.protected:
                good = _holds(data, at, h)
        if not good:
            found = data.find(b"\xff", at + 1, end)
            clip.skipped += (found if found >= 0 else end) - at
            at = found if found >= 0 else end
            continue
        if h.protected and not _holds(data, at, h):
            clip.crc_bad += 1
        body_at = at + 4 + 2 * h.protected + h.side
        if not (first and _table(clip, data, at, body_at)):
            clip.offsets.append(at)
            clip.frames += 1
            clip.samples += h.samples
            clip.rate = h.rate
            clip.kbps_sum += h.bitrate
            payload.append(data[body_at : after if unit is None else body_at + unit])
        first = False
        at = after
    clip.skipped += max(0, end - at)
    clip.payload = b"".join(payload)
    return clip


def feature(clip: Clip) -> str:
    """What the reader found, as one line."""
    s = clip.seconds
    seeks = zlib.crc32(b"".join(x.to_bytes(8, "little") for x in clip.offsets))
    whole = clip.declared_frames == clip.frames
    return (
        f"frames={clip.frames};samples={clip.samples};rate={clip.rate};seconds={s.numerator}/{s.denominator};kbps={clip.kbps_sum // max(clip.frames, 1)};"
        f"crc_bad={clip.crc_bad};skipped={clip.skipped};table={'whole' if whole else 'differs'};toc_crc32={zlib.crc32(clip.toc)};seeks={len(clip.offsets)}:{seeks}"
    )


#: What the reader stores of a clip: the exact duration as a fraction, every frame's offset, and what was wrong with it.
READ = "frames long, samples long, rate long, seconds_numerator long, seconds_denominator long, frame_offsets array<long>, crc_bad long, skipped long, title string, artist string, table string, declared_frames long"


def _read(clip: Clip) -> tuple:
    s = clip.seconds
    return clip.frames, clip.samples, clip.rate, s.numerator, s.denominator, clip.offsets, clip.crc_bad, clip.skipped, clip.title, clip.artist, clip.table, clip.declared_frames


def read_media(df: DataFrame, column: str) -> DataFrame:
    """df with what its binary column of clips, whoever wrote them, holds (see READ; columns of df by these names go).

    Null and empty clips, and bytes without a frame: no frames, a duration of 0/1.
    """
    new = [x.split()[0] for x in READ.split(", ")]
    kept = df.select(*[c for c in df.columns if c not in new], df[column].alias("__clip"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    ddl = f"{ddl}, {READ}"
    target, own = arrow_schema(ddl), arrow_schema(READ)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                rows = [_read(read_clip(x.as_py() or b"", None)) for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array([r[i] for r in rows], f.type) for i, f in enumerate(own)]], schema=target)

    return kept.mapInArrow(run, ddl)


CLIPS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, " + READ


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Stores each text as a clip, reads it back, and returns digests, features and what READ names: the exact duration and
    every frame's offset among it (with_media: the clip too).

    Null and empty texts: one frame of bytes 255. Equal texts give equal values; the clip's tag holds no document id.
    Repeated rows and null ids keep their rows. Empty table: no rows.
    """

    def run(ids: list, texts: list) -> dict:
        out: dict[str, list] = {name: [] for name in names}
        for doc, text in zip(ids, texts, strict=True):
            raw = (text or "").encode("utf-8", "replace")
            media = write_clip(pad(raw), "text")
            clip = read_clip(media)
            out["doc_id"].append(doc)
            out["n_bytes"].append(len(raw))
            out["payload_bytes"].append(len(clip.payload))
            out["payload_sha256"].append(hashlib.sha256(clip.payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(clip.payload[-32:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(feature(clip))
            for name, value in zip(found, _read(clip), strict=True):
                out[name].append(value)
            if with_media:
                out["media"].append(media)
        return out

    found = [x.split()[0] for x in READ.split(", ")]
    ddl = CLIPS + (", media binary" if with_media else "")
    names = [x.split()[0] for x in ddl.split(", ")]
    return map_rows(docs, ddl, run, ["doc_id", "text"], slice_rows=200)
