"""MPEG audio columns: write payloads as frames, and parse streams back.

The writer stores UNIT payload bytes in the main data of each Layer III frame (MPEG-1, mono, 48 kHz, 224 kbit/s, 672
bytes), protected by the header's CRC-16, behind an ID3v2 tag (payload length and CRC-32) and a Xing table
with frame and byte counts and seek points. The parser reads any MPEG-1/2/2.5 stream of Layers I to III, free format
included: it reads ID3v2 (2.2 to 2.4, unsynchronised or not), ID3v1 and APE tags, resynchronises on frame headers, parses
Xing, Info and VBRI tables with their seek points, holds them against the frames found, verifies the CRCs of all
layers, and keeps exact durations (in samples) and the offset of each frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphtrust.llm.common import id_text, map_rows

#: Payload bytes of a frame, and the byte that fills the last.
UNIT, FILL = 576, 255
#: Fixed values of the format: kbit/s by (MPEG-1?, layer), Hz of MPEG-1, samples of a frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
#: Fixed values of the format: bits of a Layer II allocation, subband by subband as (bits, subbands), by table.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "lsf": ((4, 4), (3, 7), (2, 19)),
}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}


@dataclass(frozen=True)
class Header:
    mpeg1: bool
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    size: int
    samples: int
    padding: int = 0
    bound: int = 32

    @property
    def side(self) -> int:
        """Bytes of side information, which Layer III alone has."""
        return 0 if self.layer != 3 else (17 if self.mono else 32) if self.mpeg1 else (9 if self.mono else 17)

    @property
    def kind(self) -> tuple:
        return self.mpeg1, self.layer, self.rate


@lru_cache(4096)
def header_of(four: bytes) -> Header | None:
    """The frame header in four bytes, or None where they are none. A free-format header has bitrate and size 0: the stream tells."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate_index, bitrate_index = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 2 & 3, four[2] >> 4
    if version == 1 or layer == 4 or rate_index == 3 or bitrate_index == 15:
        return None
    mpeg1 = version == 3
    rate = RATES[rate_index] >> {3: 0, 2: 1, 0: 2}[version]
    kbit = BITRATES[mpeg1, layer][bitrate_index]
    padding, samples = four[2] >> 1 & 1, SAMPLES[mpeg1, layer]
    slot = 4 if layer == 1 else 1
    size = (samples // 8 // slot * kbit * 1000 // rate + padding) * slot if kbit else 0
    bound = 4 * (four[3] >> 4 & 3) + 4 if four[3] >> 6 == 1 else 32  # subbands from which joint stereo shares its allocation
    return Header(mpeg1, layer, not four[1] & 1, kbit, rate, four[3] >> 6 == 3, size, samples, padding * slot, bound)


def _crc_table() -> list[int]:
    """CRC-16 by bytes, polynomial 0x8005."""
    table = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        table.append(c)
    return table


_CRC = _crc_table()


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """Of the whole bytes, or of the first so many bits."""
    c, whole = 0xFFFF, len(data) if bits is None else bits // 8
    for b in data[:whole]:
        c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ b]
    for k in range(0 if bits is None else bits % 8):
        top = c >> 15 ^ (data[whole] >> (7 - k) & 1)
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


def _layer2_bits(head: Header, body: bytes) -> int:
    """Bits of a Layer II frame's allocation and scale factor selection, which its CRC covers."""
    channels = 1 if head.mono else 2
    if not head.mpeg1:
        table = "lsf"
    else:
        each = head.bitrate // channels if head.bitrate else 0
        long = each in (56, 64, 80) or (head.rate == 48000 and (each >= 56 or not each))
        table = "a" if long else "b" if each >= 96 or not each else "d" if head.rate == 32000 else "c"
    value, width, at, chosen, band = int.from_bytes(body, "big"), 8 * len(body), 0, 0, 0
    for bits, bands in ALLOCATION[table]:
        for _ in range(bands):
            shared = band >= head.bound
            for _ in range(1 if shared else channels):
                if at + bits > width:
                    return width
                chosen += bool(value >> (width - at - bits) & ((1 << bits) - 1)) * (channels if shared else 1)
                at += bits
            band += 1
    return min(width, at + 2 * chosen)


def _crc_wrong(data: bytes, at: int, head: Header, size: int) -> bool:
    """Whether a protected frame's CRC differs from that of the bits it covers: half the header, and side information or allocation."""
    body = data[at + 6 : at + size]
    if head.layer == 3:
        bits = 8 * head.side
    elif head.layer == 1:
        bits = 4 * 32 if head.mono else 4 * (32 + min(head.bound, 32))
    else:
        body = body[:128]
        bits = _layer2_bits(head, body)
    return crc16(data[at + 2 : at + 4] + body[: -(-bits // 8)], 16 + bits) != int.from_bytes(data[at + 4 : at + 6], "big")


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


_HEAD = bytes([0xFF, 0xFA, 0xC4, 0xC0])  # MPEG-1, Layer III, with CRC; 224 kbit/s, 48 kHz; mono
_FRAME = header_of(_HEAD)
_PREFIX = _HEAD + struct.pack(">H", crc16(_HEAD[2:] + bytes(_FRAME.side))) + bytes(_FRAME.side)
OWNER = b"payload\0"


def padded(payload: bytes) -> bytes:
    """The payload filled up to a positive multiple of UNIT."""
    return payload + bytes([FILL]) * (UNIT - len(payload) % UNIT if len(payload) % UNIT or not payload else 0)


def write_stream(payload: bytes) -> bytes:
    """A stream that carries the payload, whose length is a multiple of UNIT."""
    n = len(payload) // UNIT
    frames = np.zeros((n, _FRAME.size), np.uint8)
    frames[:, : len(_PREFIX)] = np.frombuffer(_PREFIX, np.uint8)
    frames[:, len(_PREFIX) : len(_PREFIX) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    seek = bytes(min(255, 256 * k // 100) for k in range(100))  # all frames are of one size
    xing = _PREFIX + b"Xing" + struct.pack(">III", 7, n, (n + 1) * _FRAME.size) + seek
    private = OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload))
    body = b"PRIV" + struct.pack(">IH", len(private), 0) + private
    return b"ID3\x03\0\0" + _synchsafe(len(body)) + body + xing.ljust(_FRAME.size, b"\0") + frames.tobytes()


@dataclass
class Stream:
    """What a stream holds. offsets: of every audio frame; samples: their exact total; bad: frames with a wrong CRC; lost: bytes skipped.

    seeks: the byte offsets that a table gives, in order of time; astray: the most bytes that one of them lies from the start
    of the frame that stands at its share of the time (Xing) or frames (VBRI); table_wrong: whether its counts differ from the frames found.
    """

    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    checked: int = 0
    bad: int = 0
    lost: int = 0
    bitrates: set = field(default_factory=set)
    tags: list[str] = field(default_factory=list)
    private: dict[bytes, bytes] = field(default_factory=dict)
    fields: list[str] = field(default_factory=list)
    table_at: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    table_wrong: bool = False
    seeks: list[int] = field(default_factory=list)
    seek_frames: int = 0
    astray: int = 0
    data: list[tuple[int, int]] = field(default_factory=list)


def _seven(raw: bytes) -> int:
    """A number in the low seven bits of four bytes."""
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _read_id3(data: bytes, at: int, found: Stream) -> int:
    """The end of an ID3v2 tag that may begin at a place; names of its fields and contents of its private ones are kept."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 0x7F:
        return at
    version, flags, stop = data[at + 3], data[at + 5], min(len(data), at + 10 + _seven(data[at + 6 : at + 10]))
    found.tags.append(f"ID3v2.{version}")
    body, end = data[at + 10 : stop], stop + 10 * bool(version >= 4 and flags & 0x10)
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    p = 0
    if flags & 0x40 and version >= 3 and len(body) >= 4:
        p = _seven(body) if version >= 4 else 4 + int.from_bytes(body[:4], "big")
    name, head = (3, 6) if version < 3 else (4, 10)
    while p + head <= len(body) and body[p]:
        raw = body[p + name : p + name + (3 if version < 3 else 4)]
        n = _seven(raw) if version >= 4 else int.from_bytes(raw, "big")
        value = body[p + head : p + head + n]
        if version >= 4 and body[p + 9] & 2:
            value = value.replace(b"\xff\0", b"\xff")
        found.fields.append(body[p : p + name].decode("latin-1"))
        if body[p : p + name] == b"PRIV":
            owner, _, content = value.partition(b"\0")
            found.private[owner] = content
        p += head + n
    return end


def _leading_tags(data: bytes, found: Stream) -> int:
    """The end of all tags at the stream's start: ID3v2 and APE, in any order."""
    at = 0
    while True:
        end = _read_id3(data, at, found)
        if end == at and data[at : at + 8] == b"APETAGEX" and len(data) >= at + 32 and data[at + 23] & 0x20:  # flags say that it is a head
            found.tags.append("APE")
            end = min(len(data), at + 32 + int.from_bytes(data[at + 12 : at + 16], "little"))
        if end == at:
            return at
        at = end


def _trailing_tags(data: bytes, start: int, found: Stream) -> int:
    """Where the tags at the stream's end begin: ID3v1, APE before it."""
    stop = len(data)
    if stop - start >= 128 and data[stop - 128 : stop - 125] == b"TAG":
        stop -= 128
        found.tags.append("ID3v1")
    foot = data[stop - 32 : stop]
    if stop - start >= 32 and foot[:8] == b"APETAGEX" and not foot[23] & 0x20:
        size = int.from_bytes(foot[12:16], "little") + 32 * bool(foot[23] & 0x80)  # its items and foot, and a head where flags say so
        if size <= stop - start:
            found.tags.append("APE")
            stop -= size
    return stop


def _read_table(data: bytes, at: int, head: Header, found: Stream) -> bool:
    """Whether the frame at `at` is a Xing, Info or VBRI table rather than audio."""
    body, four = at + 4 + 2 * head.protected + head.side, lambda p: int.from_bytes(data[p : p + 4], "big")
    two = lambda p: int.from_bytes(data[p : p + 2], "big")
    if data[body : body + 4] in (b"Xing", b"Info"):
        flags, p = four(body + 4), body + 8
        if flags & 1:
            found.table_frames, p = four(p), p + 4
        if flags & 2:
            found.table_bytes, p = four(p), p + 4
        if flags & 4 and found.table_bytes is not None:
            found.seeks = [at + x * found.table_bytes // 256 for x in data[p : p + 100]]
        found.tags.append(data[body : body + 4].decode())
    elif data[at + 36 : at + 40] == b"VBRI":
        found.table_bytes, found.table_frames = four(at + 46), four(at + 50)
        entries, scale, width, found.seek_frames = (two(at + k) for k in (54, 56, 58, 60))
        place = at + head.size
        for k in range(entries if 1 <= width <= 4 else 0):
            found.seeks.append(place)
            place += int.from_bytes(data[at + 62 + k * width : at + 62 + k * width + width], "big") * scale
        found.tags.append("VBRI")
    else:
        return False
    found.table_at = at
    return True


def _free_size(data: bytes, at: int, stop: int, head: Header) -> int:
    """Bytes of a free-format frame without padding: the distance to the next header of its kind, which another must follow as far on; 0: none.

    A free-format frame is no longer than one of the largest bitrate.
    """
    slot = 4 if head.layer == 1 else 1
    most = (head.samples // 8 // slot * BITRATES[head.mpeg1, head.layer][-1] * 1000 // head.rate + 1) * slot
    p = data.find(b"\xff", at + 4 + head.side, min(stop, at + most + 1))
    while p >= 0:
        after = header_of(data[p : p + 4])
        if after and not after.bitrate and after.kind == head.kind and (p - at - head.padding) % slot == 0:
            size = p - at - head.padding
            third = header_of(data[p + size + after.padding : p + size + after.padding + 4])
            if p + size + after.padding == stop or (third and not third.bitrate and third.kind == head.kind):
                return size
        p = data.find(b"\xff", p + 1, min(stop, at + most + 1))
    return 0


def parse_stream(data: bytes) -> Stream:
    """Everything in a stream. After a break, a header counts once another of its kind (or the end) follows its frame."""
    found = Stream()
    at = _leading_tags(data, found)
    stop = _trailing_tags(data, at, found)
    synced, first, kind, free = False, True, None, 0
    while at + 4 <= stop:
        head = header_of(data[at : at + 4])
        if head is not None and not head.bitrate and not free and (kind is None or head.kind == kind):
            free = _free_size(data, at, stop, head)
        size = 0 if head is None else head.size or (free and free + head.padding)
        good = bool(size) and at + size <= stop and (kind is None or head.kind == kind)
        if good and not synced:
            after = header_of(data[at + size : at + size + 4])
            good = at + size == stop or (after is not None and after.kind == head.kind)
        if not good:
            step = data.find(b"\xff", at + 1, stop)
            step = stop if step < 0 else step
            found.lost += step - at
            at, synced = step, False
            continue
        synced, kind = True, head.kind
        if head.protected:
            found.checked += 1
            found.bad += _crc_wrong(data, at, head, size)
        if not (first and head.layer == 3 and _read_table(data, at, head, found)):
            found.offsets.append(at)
            found.data.append((at + 4 + 2 * head.protected + head.side, at + size))
            found.samples += head.samples
            found.rate = head.rate
            found.bitrates.add(head.bitrate)
        first = False
        at += size
    found.lost += stop - at if at < stop else 0
    _hold_table(found, stop)
    return found


def _hold_table(s: Stream, stop: int) -> None:
    """Hold a table's counts and seek points against the frames found."""
    if s.table_frames is not None:
        s.table_wrong = s.table_frames != len(s.offsets) or (s.table_bytes is not None and s.table_bytes != stop - s.table_at)
    if s.seeks and s.offsets:
        last = len(s.offsets) - 1
        at = [min(last, k * s.seek_frames if s.seek_frames else k * len(s.offsets) // len(s.seeks)) for k in range(len(s.seeks))]
        s.astray = max(abs(place - s.offsets[k]) for place, k in zip(s.seeks, at, strict=True))


def read_payload(data: bytes, stream: Stream) -> bytes:
    """The payload of a stream of write_stream; raises ValueError where it is damaged."""
    n, crc = struct.unpack(">QI", stream.private[b"payload"])
    payload = b"".join([data[a : a + UNIT] for a, _ in stream.data])
    if len(payload) != n or zlib.crc32(payload) != crc or stream.bad or stream.lost or stream.table_wrong:
        raise ValueError("the stream's payload is damaged")
    return payload


def feature_of(s: Stream) -> str:
    """Frames, samples, rate, milliseconds, bitrates, table, tags, CRCs and lost bytes."""
    ms = s.samples * 1000 // s.rate if s.rate else 0
    table = "-" if s.table_frames is None else f"{s.table_frames}/{s.table_bytes}/{'wrong' if s.table_wrong else 'right'}/{s.astray}"
    return (
        f"frames={len(s.offsets)};samples={s.samples};rate={s.rate};ms={ms};kbps={'/'.join(map(str, sorted(s.bitrates)))};"
        f"table={table};tags={'+'.join(s.tags)};crc={s.checked - s.bad}/{s.checked};lost={s.lost}"
    )


def encode_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of each row: its text's UTF-8 bytes, filled up, as a stream.

    Null and empty texts: one unit of fill. Equal texts, repeated rows among them, have equal streams; null ids are kept. A
    very long text is one stream, whose frames are made together in numpy; Parquet and Arrow bound it to below 2 GB. There are no
    ties. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def fn(ids, texts):
        for i, text in zip(ids, texts, strict=True):
            yield i, len(text), write_stream(padded(text))

    return map_rows(id_text(docs, id_col, text_col), fn, schema, as_bytes=True)


def parse_audio(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, frames, samples, rate, checked, bad, lost, table_wrong, astray, offsets, seeks, tags, fields) of each row with a stream.

    Null and empty streams, and bytes that are none, have no frames. Repeated rows have each their result; other columns are
    ignored; an empty table gives no rows.
    """
    longs = ("frames", "samples", "rate", "checked", "bad", "lost")
    lists = (("offsets", T.LongType()), ("seeks", T.LongType()), ("tags", T.StringType()), ("fields", T.StringType()))
    schema = T.StructType([
        T.StructField("id", T.LongType()), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("table_wrong", T.BooleanType()), T.StructField("astray", T.LongType()),
        *(T.StructField(c, T.ArrayType(t)) for c, t in lists),
    ])

    def fn(ids, streams):
        for i, data in zip(ids, streams, strict=True):
            s = parse_stream(data or b"")
            yield i, len(s.offsets), s.samples, s.rate, s.checked, s.bad, s.lost, s.table_wrong, s.astray, s.offsets, s.seeks, s.tags, s.fields

    return map_rows(media.selectExpr(f"cast({id_col} as long) id", media_col), fn, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, frame_offsets) from encode_audio's rows, read back from the stored bytes.

    frame_offsets: of every frame, comma-joined. Raises ValueError where a stream is damaged. Else as encode_audio.
    """
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
        T.StructField("frame_offsets", T.StringType()),
    ])

    def fn(ids, lengths, streams):
        for i, n, data in zip(ids, lengths, streams, strict=True):
            s = parse_stream(data)
            payload = read_payload(data, s)
            yield i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(s), ",".join(map(str, s.offsets))

    return map_rows(encoded.select("id", "n_bytes", "media"), fn, schema)
