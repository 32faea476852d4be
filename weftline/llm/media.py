"""MPEG audio as a column: streams are resynchronised, tags and variable-bitrate tables parsed, checksums verified.

probe() reads any MPEG 1, 2 or 2.5 stream of layers I to III. A header counts where the frame before ended just
there, where the next header follows at the end of its own frame, or where the stream ends there; bytes that belong to no
frame are skipped and counted. Durations are exact:
samples and samples a second. Offsets of all frames are kept, to seek by.

wrap() stores bytes without loss as a stream of silent layer III frames, 192 bytes in the ancillary data of each; the
frames' checksums, an identifying tag and a table of contents come with them. unwrap() reads the stored bytes back.

Null texts count as empty; an empty text is one frame of spaces. A null or empty media column has no frames. A stream
cut within a frame loses that frame alone.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version 1 or 2, layer) and index, Hz by version and index.
KBITS = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
HERTZ = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 2.5: [11025, 12000, 8000]}
VERSIONS = {0: 2.5, 2: 2, 3: 1}

BLOCK = 192
#: Version 1, layer III, checksum, 80 kbit/s, 48 kHz, mono: 240 bytes a frame. The first frame has no checksum.
HEADER, FIRST = bytes([0xFF, 0xFA, 0x64, 0xC0]), bytes([0xFF, 0xFB, 0x64, 0xC0])
FRAME, SIDE = 240, 17
DATA = 4 + 2 + SIDE


@lru_cache(1 << 12)
def header(h: bytes) -> dict | None:
    """What four header bytes say, or None."""
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(h[1] >> 3 & 3), 4 - (h[1] >> 1 & 3)
    rate, bits = h[2] >> 2 & 3, h[2] >> 4
    if version is None or layer == 4 or rate == 3 or bits in (0, 15) or h[3] & 3 == 2:
        return None
    kbits, hz = KBITS[1 if version == 1 else 2, layer][bits], HERTZ[version][rate]
    padding, mono = h[2] >> 1 & 1, h[3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    size = (12000 * kbits // hz + padding) * 4 if layer == 1 else samples * 125 * kbits // hz + padding
    side = 0 if layer < 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return {"version": version, "layer": layer, "hz": hz, "kbits": kbits, "samples": samples, "size": size, "side": side, "checked": not h[1] & 1, "kind": (version, layer, hz)}


_CRC = np.zeros(256, np.int64)
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1 ^ 0x8005) if _c & 0x8000 else _c << 1
    _CRC[_i] = _c & 0xFFFF


@lru_cache(1 << 12)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for x in data:
        c = (c << 8 & 0xFF00) ^ int(_CRC[c >> 8 ^ x])
    return c


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def tags(data: bytes) -> tuple[int, dict[str, str]]:
    """Bytes of the ID3v2 tag in front, and its text frames."""
    if len(data) < 10 or data[:3] != b"ID3" or any(x & 0x80 for x in data[6:10]):
        return 0, {}
    end = min(len(data), 10 + _syncsafe(data[6:10]))
    at, found = 10, {}
    while at + 10 <= end and data[at : at + 4].isalnum():
        name = data[at : at + 4].decode()
        size = _syncsafe(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8])
        body = data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 3: "utf-8"}.get(body[0], "utf-16"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            found[key] = value.rstrip("\0")
        at += 10 + size
    return end, found


def variable(frame: bytes, h: dict) -> dict | None:
    """The table of a Xing or Info frame, or of a VBRI frame."""
    for at in (4 + h["side"], 6 + h["side"]):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, at = int.from_bytes(frame[at + 4 : at + 8]), at + 8
            out: dict = {"frames": None, "bytes": None, "toc": None}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], at = int.from_bytes(frame[at : at + 4]), at + 4
            if flags & 4:
                out["toc"] = list(frame[at : at + 100])
            return out
    if frame[36:40] == b"VBRI":
        return {"frames": int.from_bytes(frame[50:54]), "bytes": int.from_bytes(frame[46:50]), "toc": None}
    return None


def probe(data: bytes | None) -> dict:
    """Frames' offsets, samples, checksums, tags and table of a stream."""
    data = data or b""
    at, text = tags(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        text.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    out = {"tags": text, "offsets": [], "samples": 0, "hz": 0, "checked": 0, "bad": 0, "skipped": 0, "table": None, "kbits": 0, "kinds": 0}
    offsets, kind, first, synced = out["offsets"], None, True, -1
    while at + 4 <= end:
        h = header(data[at : at + 4])
        n = at + h["size"] if h else end
        follows = at == synced or n + 4 > end or (x := header(data[n : n + 4])) and x["kind"] == h["kind"]
        if not h or n > end or not follows or kind not in (None, h["kind"]):
            to = data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            out["skipped"] += to - at
            at = to
            continue
        if first:
            first, kind, out["hz"] = False, h["kind"], h["hz"]
            if table := variable(data[at:n], h):
                out["table"], at, synced = table, n, n
                continue
        if h["checked"] and h["layer"] == 3:
            out["checked"] += 1
            out["bad"] += int.from_bytes(data[at + 4 : at + 6]) != crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h["side"]])
        offsets.append(at)
        out["samples"] += h["samples"]
        out["kbits"] += h["kbits"]
        at = synced = n
    out["skipped"] += max(0, end - at)
    return out


def _tag(fields: dict[str, str]) -> bytes:
    body = b""
    for key, value in fields.items():
        x = b"\x03" + f"{key}\0{value}".encode()
        body += b"TXXX" + len(x).to_bytes(4) + b"\0\0" + x
    n = len(body)
    return b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % BLOCK if data else BLOCK)


def wrap(data: bytes) -> bytes:
    """data as a stream; a positive multiple of BLOCK bytes is kept, padded with spaces."""
    payload = np.frombuffer(pad(data), np.uint8).reshape(-1, BLOCK)
    n = len(payload)
    frames = np.zeros((n, FRAME), np.uint8)
    side = bytes(SIDE)
    frames[:, :DATA] = np.frombuffer(HEADER + crc16(HEADER[2:] + side).to_bytes(2) + side, np.uint8)
    frames[:, DATA : DATA + BLOCK] = payload
    total = (n + 1) * FRAME
    toc = bytes(min(255, (1 + i * n // 100) * FRAME * 256 // total) for i in range(100))
    table = b"Info" + (7).to_bytes(4) + n.to_bytes(4) + total.to_bytes(4) + toc
    return _tag({"stored_bytes": str(len(data))}) + (FIRST + side + table).ljust(FRAME, b"\0") + frames.tobytes()


def unwrap(stream: bytes, found: dict | None = None) -> bytes:
    """The payload that wrap() stored, with its padding."""
    return b"".join(stream[at + DATA : at + DATA + BLOCK] for at in (found or probe(stream))["offsets"])


def feature(found: dict) -> str:
    n = len(found["offsets"])
    table = found["table"] or {}
    seconds = Fraction(found["samples"], found["hz"] or 1)
    seek = zlib.crc32(np.array(found["offsets"], "<i8").tobytes())
    return f"mpeg;frames={n};table={table.get('frames')};samples={found['samples']};hz={found['hz']};seconds={seconds};checked={found['checked']};bad={found['bad']};skipped={found['skipped']};last={found['offsets'][-1] if n else -1};seek={seek:08x}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text as a stream."""

    def run(cols):
        return {"doc_id": cols["doc_id"], "media": [wrap((t or "").encode()) for t in cols["text"]]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, media binary")


def describe(stored: DataFrame) -> DataFrame:
    """(doc_id, samples, hz, offsets, checked, bad, skipped, tags, table_frames) of rows (doc_id, media)."""
    schema = "doc_id long, samples long, hz int, offsets array<long>, checked int, bad int, skipped long, tags map<string,string>, table_frames long"

    def run(cols):
        found = [probe(m) for m in cols["media"]]
        out = {k: [x[k] for x in found] for k in ("samples", "hz", "offsets", "checked", "bad", "skipped")}
        return out | {"doc_id": cols["doc_id"], "tags": [list(x["tags"].items()) for x in found], "table_frames": [(x["table"] or {}).get("frames") for x in found]}

    return map_rows(stored.select(F.col("doc_id").cast("long").alias("doc_id"), "media"), run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Each text is stored, its stream read back, and both are digested."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(cols):
        out: dict = {k.split()[0]: [] for k in schema.split(", ")}
        out["doc_id"] = cols["doc_id"]
        for text in cols["text"]:
            media = wrap((text or "").encode())
            found = probe(media)
            payload = unwrap(media, found)
            out["n_bytes"].append(int(found["tags"]["stored_bytes"]))
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-16:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(feature(found))
        return out

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
