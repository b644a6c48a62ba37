"""Media columns: bytes kept in MPEG audio, and a reader of such streams.

store() writes a payload as an MPEG-1 Layer III stream: an ID3v2 tag, a frame with a variable-bitrate table, then silent frames with checksums whose
ancillary bytes hold the payload; the last frame takes the smallest bit rate that holds the rest. parse() reads streams of all versions and layers but free format: it skips tags, finds the first
header that is confirmed by the next one, resynchronises behind damage, reads Xing, Info and VBRI tables, verifies the CRC-16 of Layer III frames (those of other layers cover
bit allocations that only a decoder knows) and gives exact durations in samples and the offset of every frame for seeking.

Defined results: a null text is the empty text, whose payload is 64 zero bytes; equal texts give equal bytes; a null doc_id is kept; bytes without a frame, and null ones, parse to no
frames and an empty payload; damage makes sound false and ends no job; texts of any length are stored whole; repeated rows are stored each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

# Fixed values of the format: bit rates in kbit/s by (version 1 or 2, layer), and sample rates by version code.
RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SYNC = re.compile(rb"\xff[\xe2-\xff]")

BLOCK = 64
_SIDE, _RATE_KBIT, _SAMPLE_RATE = 17, 320, 32000
_HEAD = 4 + 2 + _SIDE


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbit: int
    sample_rate: int
    length: int
    samples: int
    side: int


def header(word: bytes) -> Header | None:
    """The meaning of 4 bytes, if they can start a frame (free format is not read)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate, sampling = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or sampling == 3 or word[3] & 3 == 2:
        return None
    kbit, hz = RATES[(1 if version == 3 else 2, layer)][rate], SAMPLE_RATES[version][sampling]
    padding, mono = word[2] >> 1 & 1, word[3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    length = (12000 * kbit // hz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbit // hz + padding
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return Header(version, layer, not word[1] & 1, kbit, hz, length, samples, side)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, t << 1 ^ 0x8005, t << 1) & 0xFFFF
    return t


_TABLE = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes, as in protected frames."""
    c = np.full(len(rows), 0xFFFF, np.uint32)
    for i in range(rows.shape[1]):
        c = (c << 8 & 0xFFFF) ^ _TABLE[c >> 8 ^ rows[:, i]]
    return c


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _word(kbit: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA if protected else 0xFB, RATES[(1, 3)].index(kbit) << 4 | 2 << 2, 0xC0))


def _frames(kbit: int, body: np.ndarray) -> np.ndarray:
    """Silent protected frames whose ancillary bytes are the rows of body."""
    out = np.zeros((len(body), _HEAD + body.shape[1]), np.uint8)
    word = np.frombuffer(_word(kbit, True), np.uint8)
    out[:, :4] = word
    crc = int(crc16(np.r_[word[2:], np.zeros(_SIDE, np.uint8)][None, :])[0])
    out[:, 4], out[:, 5] = crc >> 8, crc & 255
    out[:, _HEAD:] = body
    return out


def _length(kbit: int) -> int:
    return 144_000 * kbit // _SAMPLE_RATE


def store(payload: bytes) -> bytes:
    room = _length(_RATE_KBIT) - _HEAD
    whole = len(payload) // room
    rest = payload[whole * room :]
    parts = [_frames(_RATE_KBIT, np.frombuffer(payload[: whole * room], np.uint8).reshape(whole, room)).tobytes()]
    lengths = [_length(_RATE_KBIT)] * whole
    if rest:
        kbit = next(k for k in RATES[(1, 3)][1:] if _length(k) - _HEAD >= len(rest))
        parts.append(_frames(kbit, np.frombuffer(rest.ljust(_length(kbit) - _HEAD, b"\0"), np.uint8)[None, :]).tobytes())
        lengths.append(_length(kbit))
    first = _length(32)
    total = first + sum(lengths)
    starts = np.cumsum([first, *lengths[:-1]])
    toc = bytes(min(255, int(starts[len(lengths) * i // 100]) * 256 // total) for i in range(100))
    table_ = (_word(32, False) + bytes(_SIDE) + b"Xing" + struct.pack(">III", 7, len(lengths), total) + toc).ljust(first, b"\0")
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _syncsafe(len(tag)) + tag + table_ + b"".join(parts)


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict = field(default_factory=dict)
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    kbits: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    samples: int = 0
    sample_rate: int = 0
    checked: int = 0
    damaged: int = 0
    skipped: int = 0
    head: int = 0

    @property
    def seconds(self) -> float:
        return self.samples / self.sample_rate if self.sample_rate else 0.0


def _tags(data: bytes) -> tuple[int, dict[str, str]]:
    """Where sound may begin, and the text frames of ID3v2 tags ahead."""
    at, tags = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = sum((b & 127) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        end, i = min(len(data), at + 10 + size), at + 10
        while i + 10 <= end and data[i : i + 4].strip(b"\0"):
            n = sum((b & 127) << s for b, s in zip(data[i + 4 : i + 8], (21, 14, 7, 0), strict=True)) if data[at + 3] == 4 else int.from_bytes(data[i + 4 : i + 8], "big")
            body = data[i + 10 : i + 10 + n]
            if data[i : i + 1] == b"T" and body:
                code = ("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3]
                parts = body[1:].decode(code, "replace").split("\0")
                tags[parts[0] if data[i : i + 4] == b"TXXX" and len(parts) > 1 else data[i : i + 4].decode("latin-1")] = parts[1 if data[i : i + 4] == b"TXXX" and len(parts) > 1 else 0]
            i += 10 + n
        at = at + 10 + size
    return at, tags


def _find(data: bytes, at: int) -> int:
    """The next place of a header that another header, or the end, follows; the end of data if none."""
    for m in SYNC.finditer(data, at):
        h = header(data[m.start() : m.start() + 4])
        if h:
            end = m.start() + h.length
            if end == len(data) or (end < len(data) and (data[end : end + 3] == b"TAG" or header(data[end : end + 4]))):
                return m.start()
    return len(data)


def parse(data: bytes) -> Stream:
    s = Stream()
    at, s.tags = _tags(data)
    raw = np.frombuffer(data, np.uint8)
    offsets, lengths, kbits = [], [], []
    first = True
    while at < len(data):
        h = header(data[at : at + 4])
        if h is None or at + h.length > len(data):
            if data[at : at + 3] == b"TAG" and len(data) - at == 128:
                break
            found = _find(data, at + 1)
            s.skipped += found - at
            at = found
            continue
        if first:
            first, s.sample_rate = False, h.sample_rate
            mark = at + 4 + 2 * h.protected + h.side
            if data[mark : mark + 4] in (b"Xing", b"Info"):
                flags, i = int.from_bytes(data[mark + 4 : mark + 8], "big"), mark + 8
                for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                    if flags & bit:
                        s.vbr[name] = data[i : i + n] if name == "toc" else int.from_bytes(data[i : i + n], "big")
                        i += n
                s.head = at
                at += h.length
                continue
            if data[at + 36 : at + 40] == b"VBRI":
                s.vbr = {"quality": int.from_bytes(data[at + 44 : at + 46], "big"), "bytes": int.from_bytes(data[at + 46 : at + 50], "big"), "frames": int.from_bytes(data[at + 50 : at + 54], "big")}
                s.head = at
                at += h.length
                continue
        # As many frames as repeat this header at its stride are read at once.
        n = (len(data) - at) // h.length
        run = raw[at : at + n * h.length].reshape(n, h.length)
        same = (run[:, :4] == run[0, :4]).all(axis=1)
        n = n if same.all() else int(np.argmin(same))
        run = run[:n]
        if h.protected and h.layer == 3:
            good = crc16(np.hstack([run[:, 2:4], run[:, 6 : 6 + h.side]])) == (run[:, 4].astype(np.uint32) << 8 | run[:, 5])
            s.checked += n
            s.damaged += int((~good).sum())
        offsets.append(at + np.arange(n, dtype=np.int64) * h.length)
        lengths.append(np.full(n, h.length, np.int64))
        kbits.append(np.full(n, h.kbit, np.int64))
        s.samples += n * h.samples
        at += n * h.length
    if offsets:
        s.offsets, s.lengths, s.kbits = map(np.concatenate, (offsets, lengths, kbits))
    return s


def payload_of(data: bytes, s: Stream) -> bytes:
    """What store() was given."""
    room = np.repeat(s.lengths, 1) - _HEAD
    body = b"".join(data[o + _HEAD : o + _HEAD + r] for o, r in zip(s.offsets.tolist(), room.tolist(), strict=True))
    return body[: int(s.tags.get("payload_bytes", len(body)))]


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            rows = [padded(t.as_py()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([store(p) for _, p in rows], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (the stream)."""
    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate int, sound boolean, frame_offsets array<long>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, n, media in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            media = media or b""
            s = parse(media)
            payload = payload_of(media, s)
            sound = not s.damaged and not s.skipped and len(s.offsets) > 0 and s.vbr.get("frames", len(s.offsets)) == len(s.offsets)
            mean = int(8 * s.lengths.sum() * s.sample_rate // max(1, s.samples))
            feature = f"mpeg1-l3 {s.sample_rate} Hz, {len(s.offsets)} frames, {s.samples} samples, {s.samples * 1000 // max(1, s.sample_rate)} ms, {mean} bit/s, {s.checked} checksums, seek {zlib.crc32(s.offsets.tobytes()):08x}"
            out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.samples, s.sample_rate, sound, s.offsets.tolist()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64())]
        names = [c.split()[0] for c in READ.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=names)


def read_media(media: DataFrame) -> DataFrame:
    """Of doc_id, n_bytes, media: what is read back, durations, whether all checksums and counts hold, and the offset of every frame."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, READ)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_texts(table(spark, sf_dir, "documents")))
