"""Small pictures with metadata in them, for queries and tests: headers alone, without samples."""

from __future__ import annotations

import struct
import zlib


def rationals(degrees: float) -> list[tuple[int, int]]:
    """Degrees, minutes and hundredths of seconds."""
    total = round(degrees * 360_000)
    return [(total // 360_000, 1), (total // 6000 % 60, 1), (total % 6000, 100)]


def directory(entries: dict[int, str | int | bytes | list[tuple[int, int]]], at: int, order: str) -> bytes:
    """A TIFF directory that begins at `at`, with what its entries point to behind it; texts, numbers, bytes or rationals."""
    head, tail = struct.pack(f"{order}H", len(entries)), b""
    behind = at + 2 + 12 * len(entries) + 4
    for tag, v in sorted(entries.items()):
        if isinstance(v, int):
            head += struct.pack(f"{order}HHII", tag, 4, 1, v)
            continue
        if isinstance(v, list):
            kind, count, data = 5, len(v), b"".join(struct.pack(f"{order}II", *x) for x in v)
        else:
            kind, data = (2, v.encode() + b"\0") if isinstance(v, str) else (7, v)
            count = len(data)
        if len(data) <= 4:
            head += struct.pack(f"{order}HHI", tag, kind, count) + data.ljust(4, b"\0")
        else:
            head += struct.pack(f"{order}HHII", tag, kind, count, behind + len(tail))
            tail += data + b"\0" * (len(data) % 2)
    return head + b"\0\0\0\0" + tail


def tiff(main: dict, exif: dict | None = None, gps: dict | None = None, order: str = "<") -> bytes:
    """A TIFF header with its directories."""
    out, main = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", 0), dict(main)
    for tag, part in ((0x8769, exif), (0x8825, gps)):
        if part:
            main[tag] = len(out)
            out += directory(part, len(out), order)
    at = len(out)
    return out[:4] + struct.pack(f"{order}I", at) + out[8:] + directory(main, at, order)


def iptc(keywords: list[str]) -> bytes:
    return b"".join(b"\x1c\x02\x19" + struct.pack(">H", len(k.encode())) + k.encode() for k in keywords)


def jpeg(width: int, height: int, exif: bytes = b"", packet: bytes = b"", keywords: list[str] = ()) -> bytes:
    """Segments up to where samples would begin, and the picture's end."""
    segment = lambda kind, data: bytes([0xFF, kind]) + struct.pack(">H", len(data) + 2) + data
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x02\0\0\1\0\1\0\0")
    if exif:
        out += segment(0xE1, b"Exif\0\0" + exif)
    if packet:
        out += segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + packet)
    if keywords:
        data = iptc(list(keywords))
        out += segment(0xED, b"Photoshop 3.0\0" + b"8BIM\x04\x04\0\0" + struct.pack(">I", len(data)) + data + b"\0" * (len(data) % 2))
    return out + segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0") + segment(0xDA, b"\1\1\0\0\x3f\0") + b"\0\xff\xd9"


def png(width: int, height: int, exif: bytes = b"", packet: bytes = b"") -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
    out += chunk(b"eXIf", exif) if exif else b""
    out += chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + packet) if packet else b""
    return out + chunk(b"IDAT", b"") + chunk(b"IEND", b"")


def webp(width: int, height: int, exif: bytes = b"", packet: bytes = b"") -> bytes:
    chunk = lambda kind, data: kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    body = chunk(b"VP8X", b"\x0c\0\0\0" + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little"))
    body += chunk(b"EXIF", exif) if exif else b""
    body += chunk(b"XMP ", packet) if packet else b""
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
