import hashlib
import random
import zlib

import struct

from tracequarry.llm.media import FRAME_HEADER, UNIT, crc16, crc16_bits, feature, header, media_columns, pad, protected_bits, read_clip, read_media, write_clip


def test_crc16_known_value():
    assert crc16(b"123456789") == 0xAEE7  # polynomial 0x8005, start 0xFFFF, not reflected


def test_header_values():
    h = header(FRAME_HEADER)
    assert (h.version, h.layer, h.bitrate, h.rate, h.samples, h.size, h.protected, h.mono) == ("2", 3, 160, 16000, 576, 720, True, True)
    h = header(bytes((0xFF, 0xFB, 0x90, 0x00)))  # the usual 128 kbit/s 44.1 kHz file
    assert (h.version, h.layer, h.bitrate, h.rate, h.samples, h.size, h.side) == ("1", 3, 128, 44100, 1152, 417, 32)
    assert header(b"\xff\xff\xff\xff") is None and header(b"abcd") is None


def test_round_trip_with_false_headers_inside():
    rng = random.Random(1)
    for n in (0, 1, 575, 576, 577, 5000):
        raw = bytes(rng.choice((0xFF, 0xF2, 0xE8, 0xC0, 7)) for _ in range(n))
        clip = read_clip(write_clip(pad(raw), "t"))
        assert clip.payload == pad(raw) and len(clip.payload) % UNIT == 0 and clip.payload
        assert clip.crc_bad == 0 and clip.skipped == 0 and clip.declared_frames == clip.frames and clip.title == "t"
        assert clip.seconds * 16000 == 576 * clip.frames


def test_resynchronises_and_counts_bad_checksums():
    media = write_clip(pad(bytes(range(256)) * 9), "t")
    clip = read_clip(media)
    at = clip.offsets[0]
    broken = media[:at] + b"\xff\x00junk\xff" + media[at:] + b"rest"
    again = read_clip(broken)
    assert again.payload == clip.payload and again.skipped == 11
    flipped = bytearray(media)
    flipped[at + 5] ^= 1
    assert read_clip(bytes(flipped)).crc_bad == 1
    tagged = read_clip(media + b"TAG" + bytes(125))
    assert tagged.payload == clip.payload and tagged.skipped == 0
    assert read_clip(b"").frames == 0 and read_clip(b"no audio here").frames == 0


def test_columns(odd_docs, no_docs):
    assert media_columns(no_docs).count() == 0
    rows = media_columns(odd_docs, with_media=True).collect()
    assert len(rows) == odd_docs.count()
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    for r in rows:
        own = [pad((t or "").encode()) for d, t in texts if d == r.doc_id]
        assert r.payload_sha256 in {hashlib.sha256(p).hexdigest() for p in own}
        clip = read_clip(bytes(r.media))
        assert r.payload_bytes == len(clip.payload) and r.tail_crc32 == zlib.crc32(clip.payload[-32:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.feature == feature(clip)
        assert (r.seconds_numerator, r.seconds_denominator) == clip.seconds.as_integer_ratio() and r.frame_offsets == clip.offsets
        assert all(bytes(r.media)[at : at + 4] == FRAME_HEADER for at in r.frame_offsets) and len(r.frame_offsets) == r.frames


def frame(four, rng, flip=False):
    """A frame of random bytes with the checksum that its layer asks for."""
    h = header(four)
    body = bytes(rng.randrange(256) for _ in range(h.size - 6))
    bits = protected_bits(h, body)
    crc = crc16_bits(body, bits, crc16(four[2:])) ^ flip
    return four + crc.to_bytes(2, "big") + body


def test_checksums_of_all_layers_and_variable_bitrates():
    rng = random.Random(4)
    for four in (0xFFFE9000, 0xFFFE90C0, 0xFFFE9050, 0xFFFC9000, 0xFFFCA0C0, 0xFFFC5060, 0xFFF49000, 0xFFF490C0, 0xFFFA9000, 0xFFFAC0C0, 0xFFF29040):
        first = four.to_bytes(4, "big")
        other = (four ^ 0x1000).to_bytes(4, "big")  # the next bitrate
        kinds = [first, other, first, other, other]
        clip = read_clip(b"".join(frame(k, rng) for k in kinds), None)
        sizes = [header(k).size for k in kinds]
        assert clip.frames == 5 and clip.crc_bad == 0 and clip.skipped == 0, hex(four)
        assert clip.offsets == [sum(sizes[:i]) for i in range(5)] and clip.seconds * clip.rate == 5 * header(first).samples
        assert read_clip(b"".join(frame(k, rng, i == 2) for i, k in enumerate(kinds)), None).crc_bad == 1


def test_bits_of_a_checksum():
    data = bytes(range(40, 60))
    assert crc16_bits(data, 160, 0xFFFF) == crc16(data)
    assert crc16_bits(data, 13, 0xFFFF) == crc16_bits(data[:2], 13, 0xFFFF) != crc16_bits(data, 12, 0xFFFF)


def test_tables_and_tags_of_other_writers(spark):
    rng = random.Random(6)
    four = bytes((0xFF, 0xFB, 0x90, 0x00))
    plain = b"".join(four + bytes(rng.randrange(256) for _ in range(413)) for _ in range(7))
    vbri = (four + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 417 * 8, 7, 2, 1, 2, 4) + b"\0\4\0\3").ljust(417, b"\0")
    old = b"TAG" + b"Old title".ljust(30, b"\0") + b"Someone".ljust(30, b"\0") + bytes(65)
    new = b"TIT2" + (13).to_bytes(4, "big") + b"\0\0" + b"\1" + "Naïve".encode("utf-16")
    rows = [(1, plain + old, 9), (2, vbri + plain, 9), (3, b"ID3\3\0\0" + bytes((0, 0, 0, len(new))) + new + plain, 9), (4, None, 9), (5, b"", 9), (6, b"no audio", 9)]
    got = {r.id: r for r in read_media(spark.createDataFrame(rows, "id long, clip binary, frames int"), "clip").collect()}
    assert [got[i].frames for i in range(1, 7)] == [7, 7, 7, 0, 0, 0]
    assert (got[1].title, got[1].artist, got[3].title) == ("Old title", "Someone", "Naïve")
    assert got[2].table == "VBRI" and got[2].declared_frames == 7 and got[2].frame_offsets[0] == 417
    assert got[2].seconds_numerator * 44100 == got[2].seconds_denominator * 7 * 1152 and (got[4].seconds_numerator, got[4].seconds_denominator) == (0, 1)
