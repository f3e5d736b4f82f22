"""MPEG audio streams: reading any, and storing payloads in silent ones.

``scan`` walks a stream as a player would: it skips ID3v2 and ID3v1 tags,
resynchronises on frame headers that agree with the next one, parses Xing, Info
and VBRI tables, verifies frame checksums, and keeps the exact duration and the
byte offset of every frame.  ``store`` writes a payload, losslessly, as the
ancillary data of silent, checksummed frames; ``load`` gets it back from the
stored bytes through ``scan``.

Cases: an empty payload is stored as one unit of padding; a stream without a
frame scans to zero frames and no duration; damaged frames are counted and the
walk resumes at the next agreeing header; equal payloads give equal streams; what
looks like an ID3v1 tag within frames that end with the stream is audio.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import DataFrame

from tracegraph.llm._common import id_and_text, map_slices

# Fixed values of the MPEG audio format: kbit/s by (version 1 or 2, layer) and index; Hz by version and index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
VERSIONS = {3: 1, 2: 2, 0: 25}

UNIT = 192  # payload bytes in a frame
HEADER = bytes((0xFF, 0xFA, 0x38, 0xC0))  # MPEG-1 layer III, checksummed, 48 kbit/s, 32 kHz, mono: 216 bytes a frame
SIDE = bytes(17)  # no main data in either granule: silence
LEAD = 4 + 2 + 17


def crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


CRC = crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, all ones at first."""
    crc = 0xFFFF
    for b in data:
        crc = (crc << 8 ^ CRC[crc >> 8 ^ b]) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    checked: bool
    kbps: int
    rate: int
    size: int
    samples: int
    side: int  # bytes of side information that the checksum of layer III covers


@lru_cache(maxsize=65536)
def header(raw: bytes) -> Header | None:
    """A frame header, or None if the four bytes are none (free format counts as none)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(raw[1] >> 3 & 3), 4 - (raw[1] >> 1 & 3)
    index, rate_index = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate_index == 3:
        return None
    kbps, rate, pad = BITRATES[min(version, 2), layer][index], RATES[version][rate_index], raw[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    mono = raw[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return Header(version, layer, not raw[1] & 1, kbps, rate, size, samples, side)


@dataclass
class Scan:
    """What ``scan`` finds; offsets are of audio frames, in stream order."""

    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    duration: Fraction = Fraction(0)
    checked: int = 0
    damaged: int = 0
    resyncs: int = 0
    tags: list[str] = field(default_factory=list)
    table: dict | None = None


def tags_of(raw: bytes) -> tuple[int, int, list[str]]:
    """Where audio begins and ends, and the tags around it."""
    begin, end, found = 0, len(raw), []
    while raw[begin : begin + 3] == b"ID3" and len(raw) >= begin + 10:
        n = 0
        for b in raw[begin + 6 : begin + 10]:
            n = n << 7 | b & 127
        found.append(f"ID3v2.{raw[begin + 3]}")
        begin += 10 + n + 10 * (raw[begin + 5] >> 4 & 1)
    if len(raw) - begin >= 128 and raw[-128:-125] == b"TAG":
        found.append("ID3v1")
        end -= 128
    return min(begin, end), end, found


def rate_table(raw: bytes, at: int, h: Header) -> dict | None:
    """The Xing, Info or VBRI table that a first frame may hold instead of audio."""
    for lead in (4 + h.side, 6 + h.side):  # writers place it with or without counting the checksum
        p = at + lead
        if raw[p : p + 4] in (b"Xing", b"Info"):
            out = {"kind": raw[p : p + 4].decode()}
            flags, p = int.from_bytes(raw[p + 4 : p + 8], "big"), p + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = int.from_bytes(raw[p : p + 4], "big"), p + 4
            if flags & 4:
                out["toc"] = list(raw[p : p + 100])
            return out
    p = at + 36
    if raw[p : p + 4] == b"VBRI":
        n, scale, width = (int.from_bytes(raw[p + i : p + i + 2], "big") for i in (18, 20, 22))
        return {
            "kind": "VBRI", "bytes": int.from_bytes(raw[p + 10 : p + 14], "big"), "frames": int.from_bytes(raw[p + 14 : p + 18], "big"),
            "toc": [scale * int.from_bytes(raw[p + 26 + i * width : p + 26 + (i + 1) * width], "big") for i in range(n)],
        }
    return None


def frames_to_end(raw: bytes, at: int) -> bool:
    """Whether whole frames from ``at`` on end exactly where the stream ends."""
    while at < len(raw) and (h := header(raw[at : at + 4])):
        at += h.size
    return at == len(raw)


def scan(raw: bytes) -> Scan:
    out = Scan()
    at, end, out.tags = tags_of(raw)
    samples: dict[int, int] = {}
    locked, first = False, True
    while at + 4 <= end:
        h = header(raw[at : at + 4])
        if end < len(raw) and h is not None and at + h.size > end and (locked or first) and frames_to_end(raw, at):
            end = len(raw)
            out.tags.remove("ID3v1")
        if h is not None and at + h.size > end:
            h = None
        if h is not None and not locked and at + h.size + 4 <= end:
            nxt = header(raw[at + h.size : at + h.size + 4])
            if nxt is None or (nxt.version, nxt.layer, nxt.rate) != (h.version, h.layer, h.rate):
                h = None
        if h is None:
            if locked or first:
                out.resyncs += 1
            locked, first = False, False
            at = raw.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        if not out.offsets and out.table is None and (table := rate_table(raw, at, h)):
            out.table = table
        else:
            if h.checked and h.layer == 3:
                out.checked += 1
                if crc16(raw[at + 2 : at + 4] + raw[at + 6 : at + 6 + h.side]) != int.from_bytes(raw[at + 4 : at + 6], "big"):
                    out.damaged += 1
            out.offsets.append(at)
            out.headers.append(h)
            samples[h.rate] = samples.get(h.rate, 0) + h.samples
        locked, first = True, False
        at += h.size
    out.duration = sum((Fraction(n, rate) for rate, n in samples.items()), Fraction(0))
    return out


def padded(payload: bytes) -> bytes:
    """``payload`` with spaces up to a positive multiple of UNIT."""
    return payload + b" " * (-len(payload) % UNIT or (0 if payload else UNIT))


def store(payload: bytes) -> bytes:
    """A stream whose frames carry ``payload``, a positive multiple of UNIT bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"a payload has a positive multiple of {UNIT} bytes")
    n, size = len(payload) // UNIT, header(HEADER).size
    lead = HEADER + crc16(HEADER[2:] + SIDE).to_bytes(2, "big") + SIDE
    tail = bytes(size - LEAD - UNIT)
    title = b"TIT2" + (8).to_bytes(4, "big") + b"\0\0" + b"\0payload"
    tag = b"ID3\x03\0\0" + bytes((0, 0, 0, len(title))) + title
    toc = bytes(256 * i // 100 for i in range(100))
    table = b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * size).to_bytes(4, "big") + toc
    parts = [tag, lead, table, bytes(size - LEAD - len(table))]
    for at in range(0, len(payload), UNIT):
        parts += (lead, payload[at : at + UNIT], tail)
    return b"".join(parts)


def load(raw: bytes, found: Scan | None = None) -> bytes:
    """The payload of a stored stream."""
    found = found or scan(raw)
    return b"".join([raw[at + LEAD : at + LEAD + UNIT] for at in found.offsets])


def feature(found: Scan) -> str:
    """Format, counts, exact duration and seek offsets (of each hundredth of the frames) in one line."""
    h = found.headers[0] if found.headers else None
    n = len(found.offsets)
    seek = [found.offsets[n * i // 100] for i in range(0, 100, 10)] if n else []
    kind = f"mpeg{h.version},layer{h.layer},{h.rate}Hz,{h.kbps}kbps" if h else "none"
    table = f"{found.table['kind']}:{found.table.get('frames')}" if found.table else "-"
    return f"{kind};frames={n};seconds={found.duration};checked={found.checked};damaged={found.damaged};table={table};tags={'+'.join(found.tags) or '-'};seek={'|'.join(map(str, seek))}"


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Every text stored as a stream and read back.

    ``media binary`` (if kept), ``frame_offsets array<long>``, ``duration_s
    string`` (an exact fraction) and digests of payload and media.
    """
    from hashlib import sha256
    from zlib import crc32

    docs = id_and_text(df, id_col, text_col)

    def make():
        def fn(cols: dict) -> dict:
            out: dict = {k: [] for k in names}
            out[id_col] = cols[id_col]
            for text in cols[text_col]:
                data = text.encode()
                raw = store(padded(data))
                found = scan(raw)
                back = load(raw, found)
                out["n_bytes"].append(len(data))
                out["payload_bytes"].append(len(back))
                out["payload_sha256"].append(sha256(back).hexdigest())
                out["tail_crc32"].append(crc32(back[-16:]))
                out["media_bytes"].append(len(raw))
                out["media_sha256"].append(sha256(raw).hexdigest())
                out["feature"].append(feature(found))
                if keep_media:
                    out["media"].append(raw)
                    out["frame_offsets"].append(found.offsets)
                    out["duration_s"].append(str(found.duration))
            return out

        return fn

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if keep_media:
        schema += ", media binary, frame_offsets array<long>, duration_s string"
    names = [x.split()[0] for x in schema.split(", ")]
    return map_slices(docs, make, schema, rows=64 if keep_media else 256)


def scan_media(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """``scan`` of every stream in a binary column (null: no frames)."""

    def make():
        def fn(cols: dict) -> dict:
            got = [scan(bytes(x or b"")) for x in cols[media_col]]
            return {
                id_col: cols[id_col], "n_frames": [len(s.offsets) for s in got], "duration_s": [str(s.duration) for s in got],
                "damaged": [s.damaged for s in got], "resyncs": [s.resyncs for s in got], "frame_offsets": [s.offsets for s in got], "feature": [feature(s) for s in got],
            }

        return fn

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(id_col, media_col), make, f"{id_col} {kind}, n_frames int, duration_s string, damaged int, resyncs int, frame_offsets array<long>, feature string", rows=64)
