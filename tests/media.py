"""Small media files made from bytes."""

import json
import struct
import zlib

import numpy as np


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(image=None, before: bytes = b"", after: bytes = b"", tail: bytes = b"", filters=0) -> bytes:
    image = np.full((24, 32, 3), 90, np.uint8) if image is None else image
    h, w = image.shape[:2]
    colour = {2: 0, 3: 2}[image.ndim] if image.ndim == 2 or image.shape[2] == 3 else 6
    rows = image.reshape(h, -1)
    if filters == 0:
        raw = b"".join(b"\0" + r.tobytes() for r in rows)
    else:
        n = 1 if image.ndim == 2 else image.shape[2]
        raw, above = b"", np.zeros(rows.shape[1], np.uint8)
        for r in rows:
            left = np.concatenate([np.zeros(n, np.uint8), r[:-n]])
            corner = np.concatenate([np.zeros(n, np.uint8), above[:-n]])
            if filters == 1:
                guess = left
            elif filters == 2:
                guess = above
            elif filters == 3:
                guess = ((left.astype(int) + above) // 2).astype(np.uint8)
            else:
                a, b, c = left.astype(int), above.astype(int), corner.astype(int)
                p = a + b - c
                pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)
            raw += bytes([filters]) + (r - guess).tobytes()
            above = r
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + before + chunk(b"IDAT", zlib.compress(raw)) + after + chunk(b"IEND", b"") + tail


def text(key: str, value: str) -> bytes:
    return chunk(b"tEXt", key.encode() + b"\0" + value.encode())


def itxt(key: str, value: str) -> bytes:
    return chunk(b"iTXt", key.encode() + b"\0\0\0\0\0" + value.encode())


def tiff(tags: dict) -> bytes:
    body, entries, place = b"", b"", 8 + 2 + 12 * len(tags) + 4
    for tag, value in sorted(tags.items()):
        raw = value + b"\0"
        entries += struct.pack("<HHI", tag, 2, len(raw)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", place + len(body)))
        body += b"" if len(raw) <= 4 else raw
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + entries + b"\0\0\0\0" + body


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(*segments: bytes, tail: bytes = b"") -> bytes:
    return b"\xff\xd8" + b"".join(segments) + b"\xff\xda\0\2" + b"coded\x00Bria pixels" + b"\xff\xd9" + tail


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + kind + body


LABEL = json.dumps({"Label": "1", "ContentProducer": "91440101MA9Y9T4H7A"}).encode()


def mp4(label: bytes = LABEL) -> bytes:
    keys = box(b"keys", b"\0" * 8 + box(b"mdta", b"title") + box(b"mdta", b"AIGC"))
    items = box(b"ilst", box(b"\0\0\0\1", box(b"data", b"\0" * 8 + b"t")) + box(b"\0\0\0\2", box(b"data", b"\0" * 8 + label)))
    return box(b"ftyp", b"isom") + box(b"mdat", b"x" * 100) + box(b"moov", box(b"udta", box(b"meta", b"\0" * 4 + keys + items)))


def element(name: int, body: bytes) -> bytes:
    raw = name.to_bytes((name.bit_length() + 7) // 8, "big")
    return raw + (0x10000000 | len(body)).to_bytes(4, "big") + body


def mkv(label: bytes = LABEL) -> bytes:
    simple = element(0x67C8, element(0x45A3, b"AIGC") + element(0x4487, label))
    return element(0x1A45DFA3, b"") + element(0x18538067, element(0x1254C367, element(0x7373, simple)))


def riff(kind: bytes, *chunks: tuple[bytes, bytes]) -> bytes:
    body = kind + b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1) for n, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def avi(label: bytes = LABEL) -> bytes:
    return riff(b"AVI ", (b"LIST", b"INFO" + b"AIGC" + struct.pack("<I", len(label)) + label + b"\0" * (len(label) & 1)))


def flv(label: bytes = LABEL) -> bytes:
    body = b"\2\0\x0aonMetaData" + b"\x08\0\0\0\1" + b"\0\4AIGC\2" + struct.pack(">H", len(label)) + label + b"\0\0\x09"
    return b"FLV\1\0" + struct.pack(">I", 9) + b"\0\0\0\0" + bytes([18]) + len(body).to_bytes(3, "big") + b"\0" * 7 + body + b"\0\0\0\0"
