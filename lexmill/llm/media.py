"""MPEG audio columns: write, resynchronise, verify, measure.

``encode`` stores a byte payload losslessly in a valid variable-bitrate MPEG-1 Layer III stream (mono, 48 kHz): an
ID3v2 tag, a Xing frame with frame count, byte count and seek table, then frames whose side information is empty
(silence to a player), CRC-protected, with the payload in the bytes that follow it. ``probe`` reads any MPEG audio bytes:
it skips tags, finds frame headers again after damage, parses the variable-bitrate table (Xing, Info or VBRI),
verifies the checksums of all three layers, and gives the exact duration and the offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import staged

UNIT = 192
PAYLOAD_OWNER = b"lexmill/payload\0"

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (low sampling rate, layer) and index 1 to 14, Hz by version.
BITRATES = {
    (False, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (False, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (False, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (True, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (True, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (True, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Bits of a subband's allocation in Layer II, as (subbands, bits) runs: at low rates, at high rates, and of MPEG-2.
LOW_ALLOCATION = ((2, 4), (10, 3))
HIGH_ALLOCATION = ((11, 4), (12, 3), (7, 2))
HALF_ALLOCATION = ((4, 4), (7, 3), (19, 2))


@dataclass(frozen=True)
class Header:
    """A frame header: MPEG version bits (3: 1, 2: 2, 0: 2.5), layer, rates, and the sizes that follow from them."""

    version: int
    layer: int
    protected: bool
    bitrate: int
    sample_rate: int
    mono: bool
    bound: int
    size: int
    samples: int
    side: int
    body: int


@lru_cache(4096)
def header(word: int) -> Header | None:
    """The frame header in a 32-bit word, or None. Free-format frames aren't taken for headers."""
    if word >> 21 != 0x7FF:
        return None
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    rate, hz = word >> 12 & 15, word >> 10 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or word & 3 == 2:
        return None
    kbps, sample_rate, pad = BITRATES[version != 3, layer][rate - 1], SAMPLE_RATES[version][hz], word >> 9 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12_000 * kbps // sample_rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // sample_rate + pad
    mono, protected = word >> 6 & 3 == 3, not word >> 16 & 1
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    # from this subband on both channels share their allocation
    bound = 4 * (word >> 4 & 3) + 4 if word >> 6 & 3 == 1 else 32
    return Header(version, layer, protected, kbps, sample_rate, mono, bound, size, samples, side, 4 + 2 * protected + side)


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        x <<= 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        out.append(x)
    return out


_CRC = _crc_table()


@lru_cache(4096)
def frame_crc(data: bytes, bits: int = 0) -> int:
    """CRC-16 with polynomial 0x8005 from 0xFFFF over the bytes, the last of which counts with its first ``bits`` bits, if given."""
    crc = 0xFFFF
    for x in data[:-1] if bits else data:
        crc = crc << 8 & 0xFFFF ^ _CRC[crc >> 8 ^ x]
    for k in range(bits):
        crc = (crc << 1 ^ 0x8005 if (crc >> 15 ^ data[-1] >> 7 - k) & 1 else crc << 1) & 0xFFFF
    return crc


def allocation(h: Header) -> list[int]:
    """Bits of the allocation of each subband of a Layer I or II frame."""
    if h.layer == 1:
        return [4] * 32
    each = h.bitrate if h.mono else h.bitrate // 2
    if h.version != 3:
        runs, limit = HALF_ALLOCATION, 30
    elif each < 56:
        runs, limit = LOW_ALLOCATION, 12 if h.sample_rate == 32000 else 8
    else:
        runs, limit = HIGH_ALLOCATION, 30 if each >= 96 and h.sample_rate != 48000 else 27
    return [bits for n, bits in runs for _ in range(n)][:limit]


def protected_bits(frame: bytes, h: Header) -> int:
    """How many bits after the checksum it covers: side information, or allocation and, in Layer II, the choice of scale factors."""
    if h.layer == 3:
        return 8 * h.side
    at, chosen, bits = 0, 0, int.from_bytes(frame[6:], "big")
    total = 8 * (len(frame) - 6)
    for band, width in enumerate(allocation(h)):
        shared = h.mono or band >= h.bound
        for _ in range(1 if shared else 2):
            used = bits >> max(0, total - at - width) & ((1 << width) - 1)
            at += width
            # a shared allocation chooses scale factors for each channel
            chosen += 2 * (2 if shared and not h.mono else 1) if used and h.layer == 2 else 0
    return at + chosen


def checksum_holds(frame: bytes, h: Header) -> bool:
    bits = protected_bits(frame, h)
    whole, rest = divmod(bits, 8)
    covered = frame[6 : 6 + whole + (rest > 0)]
    return len(covered) * 8 >= bits and int.from_bytes(frame[4:6], "big") == frame_crc(frame[2:4] + covered, rest)


@lru_cache(32)
def _frame_start(index: int) -> tuple[bytes, int]:
    """Header, checksum and empty side information of a frame with this bitrate index; its size."""
    word = 0x7FF << 21 | 3 << 19 | 1 << 17 | 0 << 16 | index << 12 | 1 << 10 | 3 << 6
    raw = struct.pack(">I", word)
    return raw + struct.pack(">H", frame_crc(raw[2:] + bytes(17))) + bytes(17), header(word).size


#: Largest first: (payload bytes in a frame, bitrate index).
_ROOM = sorted(((_frame_start(i)[1] - len(_frame_start(i)[0]), i) for i in range(1, 15)), reverse=True)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """The payload as an MPEG audio stream; the tag holds its length and CRC-32."""
    full, index = _ROOM[0]
    start, _ = _frame_start(index)
    frames = [start + payload[s : s + full] for s in range(0, len(payload) - full + 1, full)]
    if rest := payload[len(frames) * full :]:
        room, small = next(x for x in reversed(_ROOM) if x[0] >= len(rest))
        frames.append(_frame_start(small)[0] + rest + bytes(room - len(rest)))
    sizes = [len(f) for f in frames]
    info, room = _frame_start(5)
    total = room + sum(sizes)
    table, at, k, n = bytearray(), room, 0, len(sizes)
    for percent in range(100):
        while k < n * percent // 100:
            at += sizes[k]
            k += 1
        table.append(min(255, at * 256 // total))
    xing = b"Xing" + struct.pack(">III", 7, n, total) + bytes(table)
    private = PAYLOAD_OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload))
    tag = b"PRIV" + struct.pack(">I", len(private)) + b"\0\0" + private
    return b"ID3\3\0\0" + _syncsafe(len(tag)) + tag + info + xing + bytes(room - len(info) - len(xing)) + b"".join(frames)


@dataclass
class Probe:
    """What a stream holds. offsets: of each audio frame from the first byte; seek: its table of 100 fractions of 256, or
    a VBRI frame's sizes of equal runs of frames as little-endian unsigned 32-bit integers."""

    tags: list[str] = field(default_factory=list)
    payload_length: int | None = None
    payload_crc: int | None = None
    vbr: str = ""
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    seek: bytes = b""
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    crc_checked: int = 0
    crc_wrong: int = 0
    skipped: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly."""
        return _duration(self.headers)


def _duration(headers: list[Header]) -> Fraction:
    by_rate: dict[int, int] = {}
    for h in headers:
        by_rate[h.sample_rate] = by_rate.get(h.sample_rate, 0) + h.samples
    return sum((Fraction(n, rate) for rate, n in by_rate.items()), Fraction(0))


def _id3v2(data: bytes, out: Probe) -> int:
    """The length of the tag at the start, 0 if there is none; its frames' names are noted."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0
    end = min(len(data), 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]))
    at, wide = 10, data[3] < 4
    while at + 10 <= end and data[at : at + 4].isalnum():
        s = data[at + 4 : at + 8]
        size = int.from_bytes(s, "big") if wide else s[0] << 21 | s[1] << 14 | s[2] << 7 | s[3]
        body = data[at + 10 : at + 10 + size]
        out.tags.append(data[at : at + 4].decode("ascii"))
        if out.tags[-1] == "PRIV" and body.startswith(PAYLOAD_OWNER) and len(body) == len(PAYLOAD_OWNER) + 12:
            out.payload_length, out.payload_crc = struct.unpack(">QI", body[-12:])
        at += 10 + size
    return end + (10 if data[5] & 16 else 0)


def _vbr_table(frame: bytes, h: Header, out: Probe) -> bool:
    """True if the frame is a Xing, Info or VBRI frame rather than audio. What a short frame has no room for is left out."""
    at = h.body
    if frame[at : at + 4] in (b"Xing", b"Info") and at + 8 <= len(frame):
        out.vbr = frame[at : at + 4].decode("ascii")
        flags = int.from_bytes(frame[at + 4 : at + 8], "big")
        at += 8
        for bit, name in ((1, "vbr_frames"), (2, "vbr_bytes")):
            if flags & bit and at + 4 <= len(frame):
                setattr(out, name, int.from_bytes(frame[at : at + 4], "big"))
                at += 4
        if flags & 4:
            out.seek = frame[at : at + 100]
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.vbr = "VBRI"
        out.vbr_bytes, out.vbr_frames, count, scale, width, _ = struct.unpack_from(">IIHHHH", frame, 46)
        table = [int.from_bytes(frame[at : at + width], "big") * scale for at in range(62, min(len(frame), 62 + count * width) - width + 1, width)] if width else []
        out.seek = struct.pack(f"<{len(table)}I", *(x & 0xFFFFFFFF for x in table))
        return True
    return False


def probe(data: bytes) -> Probe:
    """Everything about a stream; any bytes will do. Those that belong to no frame count as skipped."""
    out = Probe()
    end = len(data)
    if end >= 128 and data[-128:-125] == b"TAG":
        out.tags.append("ID3v1")
        end -= 128
    at = _id3v2(data, out)
    lost, first = True, True
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big"))
        fits = h is not None and at + h.size <= end
        if fits and lost and at + h.size != end:
            # a header found by search counts only if another one of its kind follows its frame, or the end does
            n = header(int.from_bytes(data[at + h.size : at + h.size + 4], "big"))
            fits = n is not None and (n.version, n.layer, n.sample_rate) == (h.version, h.layer, h.sample_rate)
        if not fits:
            lost = True
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        lost = False
        if h.protected:
            out.crc_checked += 1
            out.crc_wrong += not checksum_holds(data[at : at + h.size], h)
        if not (first and h.layer == 3 and _vbr_table(data[at : at + h.size], h, out)):
            out.offsets.append(at)
            out.headers.append(h)
        first = False
        at += h.size
    out.skipped += max(0, end - at)
    return out


def payload(data: bytes, found: Probe) -> bytes:
    """The payload that ``encode`` stored; an error if the stream isn't whole."""
    if found.payload_length is None or found.crc_wrong or found.skipped or found.vbr_frames != len(found.offsets):
        raise ValueError("not a whole payload stream")
    out = b"".join([data[o + h.body : o + h.size] for o, h in zip(found.offsets, found.headers, strict=True)])
    out = out[: found.payload_length]
    if len(out) < found.payload_length or zlib.crc32(out) != found.payload_crc:
        raise ValueError("not a whole payload stream")
    return out


def feature(found: Probe) -> str:
    """frames, exact seconds, mean kbit/s, checksums, table and a digest of the frame offsets."""
    d = found.duration
    offsets = zlib.crc32(struct.pack(f"<{len(found.offsets)}Q", *found.offsets))
    size = sum(h.size for h in found.headers)
    kbps = size * 8 / float(d) / 1000 if d else 0.0
    return f"frames={len(found.offsets)};seconds={d.numerator}/{d.denominator};kbps={kbps:.3f};vbr={found.vbr or '-'};crc={found.crc_checked - found.crc_wrong}/{found.crc_checked};skipped={found.skipped};seek={zlib.crc32(found.seek):08x};offsets={offsets:08x}"


def padded(text: bytes | None) -> bytes:
    """UTF-8 bytes with spaces up to a positive multiple of UNIT."""
    text = text or b""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def _store(batches):
    for b in batches:
        texts = [t.as_py() for t in b.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.large_binary())], ["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as MPEG audio. Null or empty text: 192 spaces."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


_FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, seconds double, seek_offsets binary"


def _measure(batches):
    for b in batches:
        rows = []
        for doc_id, n, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            data = media.as_py()
            found = probe(data)
            stored = payload(data, found)
            offsets = zlib.compress(struct.pack(f"<{len(found.offsets)}Q", *found.offsets), 1)
            rows.append((doc_id, n, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(found), len(found.offsets), float(found.duration), offsets))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.binary()]
        names = [x.split()[0] for x in _FIELDS.split(", ")]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def measured(media: DataFrame) -> DataFrame:
    """One row per stored stream, from its bytes alone: payload digests, features, seconds, frame seek offsets.

    seek_offsets: byte offset of every audio frame, as deflated little-endian unsigned 64-bit integers. A stream
    that isn't whole is an error, as it would lose data.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_measure, _FIELDS)


def text_media(docs: DataFrame) -> DataFrame:
    """Stores every text of ``docs`` in the shared folder and measures what it reads back: one row per row, repeated rows included.

    Null text counts as empty; null doc_id stays null; other columns are ignored; an empty table gives an
    empty result. Equal texts give equal values.
    """
    return measured(staged(media_column(docs), "media", compression="zstd"))
