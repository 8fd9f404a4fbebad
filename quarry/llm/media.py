"""Media columns: MPEG audio (MPEG-1, 2 and 2.5, Layers I to III).

`parse` reads any bytes: it skips ID3v2 and ID3v1 tags, resynchronises on frame headers (a header counts if another one of the same
version, layer and rate, or the end, stands where its frame ends), checks the CRC-16 of frames that carry one (not of Layer II, whose
covered bits depend on its allocation tables), reads the Xing, Info or VBRI table of variable bitrate and holds it against the frames
found, and gives the exact duration as samples over rate, and the byte offset of each frame for seeking.

`encode` stores a payload losslessly in such a stream: an ID3v2 tag with its length and CRC-32, a Xing frame, then frames
whose side information is all zero (silence) and whose ancillary bytes carry the payload; the last frame takes
the smallest bitrate that holds the rest. `decode` gets the payload back from the frames and verifies every checksum.

Defined cases: a null or empty text is a payload of 64 zero bytes; equal texts give equal bytes; bytes without a frame parse to no frames and duration 0; a
frame with a wrong checksum is skipped and counted as damaged; frames of free format are not frames here; a table that does not agree
with the frames changes nothing else; a very long text is stored and read as a whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import read

# fixed values of the format: Hz of MPEG-1 (MPEG-2 halves them, 2.5 quarters them), kbit/s by (MPEG-1 or not, layer)
RATES = (44100, 48000, 32000)
KBPS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
LOW_KBPS = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
KBPS_OF = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): KBPS,
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): LOW_KBPS,
    (False, 3): LOW_KBPS,
}
#: The divisor of the rates by the version bits, and what such a version is called.
DIVISOR, VERSION = {3: 1, 2: 2, 0: 4}, {1: "1", 2: "2", 4: "2.5"}
SAMPLES, SIDE = 1152, 32
UNIT = 64


def crc16(data: bytes) -> int:
    """Polynomial 0x8005 from 0xFFFF, as for frame headers."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


class Head(NamedTuple):
    """Length of the frame, (divisor, layer, rate), its samples, whether it has a CRC, bytes of side information, bytes that the CRC covers behind it (None: not known)."""

    length: int
    kind: tuple[int, int, int]
    samples: int
    protected: bool
    side: int
    covered: int | None


@lru_cache(4096)
def header(head: bytes) -> Head | None:
    """What four bytes say as a header; None if they are none."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    divisor, layer = DIVISOR.get(head[1] >> 3 & 3), 4 - (head[1] >> 1 & 3)
    kbps, rate, pad = head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1
    if divisor is None or layer == 4 or not 0 < kbps < 15 or rate == 3:
        return None
    hz, speed, mono = RATES[rate] // divisor, 1000 * KBPS_OF[divisor == 1, layer][kbps], head[3] >> 6 == 3
    protected = not head[1] & 1
    if layer == 1:  # four bits for each of 32 subbands, of each channel below the bound of joint stereo
        bound = 4 * ((head[3] >> 4 & 3) + 1) if head[3] >> 6 == 1 else 32
        return Head((12 * speed // hz + pad) * 4, (divisor, 1, hz), 384, protected, 0, 16 if mono else (32 + bound) // 2)
    samples = 576 if layer == 3 and divisor > 1 else 1152
    side = 0 if layer == 2 else (17 if mono else SIDE) if divisor == 1 else (9 if mono else 17)
    return Head(samples // 8 * speed // hz + pad, (divisor, layer, hz), samples, protected, side, side if layer == 3 else None)


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    kind: tuple[int, int, int] | None = None
    damaged: int = 0
    skipped: int = 0
    vbr: dict | None = None
    duration: Fraction = Fraction(0)

    @property
    def rate(self) -> int:
        return self.kind[2] if self.kind else 0

    @property
    def table_agrees(self) -> bool | None:
        """Whether the table of variable bitrate counts the frames found; None where no table says."""
        return self.vbr["frames"] == len(self.offsets) if self.vbr and "frames" in self.vbr else None

    def seek(self, second) -> int | None:
        """The byte offset of the frame that plays at this time; None outside. All frames of a stream last equally long."""
        if not 0 <= second < self.duration:
            return None
        return self.offsets[int(Fraction(second) * len(self.offsets) / self.duration)]


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3(data: bytes, tags: dict[str, str]) -> int:
    """Reads text frames of an ID3v2 tag; returns where it ends."""
    if len(data) < 10 or data[:3] != b"ID3":
        return 0
    end, at = min(len(data), 10 + _synchsafe(data[6:10])), 10
    while at + 10 <= end and data[at] and data[at] != 0xFF:
        n = _synchsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        if not 0 < n <= end - at - 10:
            break
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + n]
        if name[0] == "T":
            said = body[1:].decode("utf-8" if body[0] == 3 else "utf-16" if body[0] in (1, 2) else "latin-1", "replace").rstrip("\0")
            key, _, value = said.partition("\0") if name == "TXXX" else (name, "", said)
            tags[key] = value
        at += 10 + n
    return end


_sums: dict[bytes, int] = {}


def _crc_of(covered: bytes) -> int:
    """Most frames share their header and side information, so their sums are kept; at most 4096 of them."""
    if covered not in _sums:
        if len(_sums) >= 4096:
            _sums.clear()
        _sums[covered] = crc16(covered)
    return _sums[covered]


def parse(data: bytes | None) -> Audio:
    data = bytes(data or b"")
    out = Audio()
    at, end = _id3(data, out.tags), len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    in_step, played = False, Counter()
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.length if h else 0
        if h and after <= end and not in_step and after + 4 <= end:
            following = header(data[after : after + 4])
            h = h if following and following.kind == h.kind else None
        if not h or after > end:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out.skipped += step - at
            at, in_step = step, False
            continue
        in_step = True
        if h.protected and h.covered is not None and _crc_of(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.covered]) != int.from_bytes(data[at + 4 : at + 6], "big"):
            out.damaged += 1
            at, in_step = after, False
            continue
        table = None
        if out.vbr is None and not out.offsets and h.kind[1] == 3:
            table = _table(data[at:after], (6 if h.protected else 4) + h.side)
        if table is None:
            out.offsets.append(at)
            out.lengths.append(h.length)
            played[h.samples, h.kind[2]] += 1
        else:
            out.vbr = table
        out.kind = out.kind or h.kind
        at = after
    out.skipped += max(0, end - at)
    out.duration = sum((Fraction(samples * n, hz) for (samples, hz), n in played.items()), Fraction(0))
    return out


def _table(frame: bytes, behind_side: int) -> dict | None:
    """The table that a frame holds instead of sound: Xing or Info behind the side information, VBRI 32 bytes behind the header."""
    if frame[behind_side : behind_side + 4] in (b"Xing", b"Info"):
        return _xing(frame[behind_side:])
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, each = struct.unpack(">IIHHHH", frame[46:62])
        sizes = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"frames": frames, "bytes": size, "frames_per_entry": each, "sizes": sizes}
    return None


def _xing(body: bytes) -> dict:
    flags, at, out = int.from_bytes(body[4:8], "big"), 8, {}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name] = int.from_bytes(body[at : at + 4], "big")
            at += 4
    if flags & 4:
        out["toc"] = list(body[at : at + 100])
    return out


def _frame(kbps: int, carried: bytes, rate: int = 2) -> bytes:
    head = bytes((0xFF, 0xFA, kbps << 4 | rate << 2, 0x04))
    room = 144000 * KBPS[kbps] // RATES[rate] - 6 - SIDE
    return head + _crc_of(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE) + carried.ljust(room, b"\0")


ROOM = [144000 * k // RATES[2] - 6 - SIDE for k in KBPS]


def encode(payload: bytes, n_bytes: int | None = None) -> bytes:
    frames = []
    for at in range(0, len(payload), ROOM[-1]):
        piece = payload[at : at + ROOM[-1]]
        frames.append(_frame(next(k for k in range(1, 15) if ROOM[k] >= len(piece)), piece))
    total, seen, toc = sum(map(len, frames)), 0, []
    starts = [0]
    for f in frames:
        starts.append(starts[-1] + len(f))
    for p in range(100):
        seen = starts[len(frames) * p // 100]
        toc.append(seen * 256 // total if total else 0)
    xing = _frame(9, b"Xing" + struct.pack(">III", 7, len(frames), total & 0xFFFFFFFF) + bytes(toc))
    said = b"".join(b"TXXX" + bytes((0, 0, len(b) >> 7, len(b) & 127)) + b"\0\0" + b for b in (b"\x03%s\0%d" % x for x in ((b"n_bytes", len(payload) if n_bytes is None else n_bytes), (b"payload_bytes", len(payload)), (b"crc32", zlib.crc32(payload)))))
    n = len(said)
    return b"ID3\x04\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + said + xing + b"".join(frames)


def decode(media: bytes, audio: Audio | None = None) -> bytes:
    """The payload of a stream from encode(); ValueError where a checksum or a length is wrong."""
    audio = audio or parse(media)
    out = b"".join([media[at + 6 + SIDE : at + n] for at, n in zip(audio.offsets, audio.lengths)])[: int(audio.tags["payload_bytes"])]
    if audio.damaged or len(out) != int(audio.tags["payload_bytes"]) or zlib.crc32(out) != int(audio.tags["crc32"]):
        raise ValueError("the stream is damaged")
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0"), len(raw)


def feature(audio: Audio) -> str:
    seek = hashlib.md5(b",".join(b"%d" % x for x in audio.offsets)).hexdigest()
    d = audio.duration
    divisor, layer, _ = audio.kind or (1, 3, 0)
    return f"mpeg{VERSION[divisor]}-layer{layer} rate={audio.rate} frames={len(audio.offsets)} duration={d.numerator}/{d.denominator} first={audio.offsets[0] if audio.offsets else -1} last={audio.offsets[-1] if audio.offsets else -1} seek_md5={seek} damaged={audio.damaged} skipped={audio.skipped}"


def describe(batches):
    """mapInPandas: content (bytes) to exact duration, seek offsets and what else parse() finds, a row for each."""
    for pdf in batches:
        found = [parse(x) for x in pdf["content"]]
        yield pdf.drop(columns="content").assign(
            version=[VERSION[a.kind[0]] if a.kind else None for a in found],
            layer=pd.array([a.kind[1] if a.kind else None for a in found], "Int32"),
            n_frames=[len(a.offsets) for a in found],
            rate=[a.rate for a in found],
            duration_num=[a.duration.numerator for a in found],
            duration_den=[a.duration.denominator for a in found],
            offsets=[a.offsets for a in found],
            damaged=[a.damaged for a in found],
            skipped=[a.skipped for a in found],
            tags=[a.tags for a in found],
            table_agrees=pd.array([a.table_agrees for a in found], "boolean"),
        )


def audio_columns(media: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """Of a table of files: id, version, layer, n_frames, rate, duration_num / duration_den (seconds), offsets, damaged, skipped, tags, table_agrees
    (null without a table of variable bitrate that counts frames)."""
    rows = media.selectExpr(f"`{id_col}` as id", f"`{content_col}` as content")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(describe, f"id {kind}, version string, layer int, n_frames bigint, rate int, duration_num bigint, duration_den bigint, offsets array<bigint>, damaged bigint, skipped bigint, tags map<string,string>, table_agrees boolean")


SCHEMA = "doc_id string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _store(batches):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            payload, n = payload_of(text)
            media = encode(payload, n)
            audio = parse(media)
            back = decode(media, audio)
            rows.append((doc_id, int(audio.tags["n_bytes"]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(audio)))
        yield pd.DataFrame(rows, columns=names)


def store(docs: DataFrame) -> DataFrame:
    """Of each row the text stored as a stream and read back: doc_id, lengths, digests and features."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text, which pandas keeps as it is
    return rows.mapInPandas(_store, SCHEMA).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op7_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    return store(read(spark, sf_dir, "documents"))
