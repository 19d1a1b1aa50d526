"""Metadata in the files themselves: JPEG and PNG segments, TIFF directories, IPTC records and XMP packets.

A task reads the headers of its files by byte ranges, from segment to segment; pictures' samples are never read. The
columns are those of a metadata dump, so all that works on a dump works on files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumspark.session import ship
from albumspark.sources import xmp
from albumspark.sources.tree import Place

#: Fields of a file; those of LISTS are arrays, the others texts.
FIELDS = (
    "GPSLatitude GPSLongitude GPSLatitudeRef GPSLongitudeRef Make Model DateTimeOriginal CreateDate ImageWidth ImageHeight "
    "FileImageWidth FileImageHeight ImageRegion TaggerVersion OCRRan CountryCode ClipModel ClipEmbedding"
).split()
LISTS = "Keywords Subject TagsList OCRText".split()
SCHEMA = ", ".join(["path string", *(f"{c} string" for c in FIELDS), *(f"{c} array<string>" for c in LISTS), "error string"])
#: Bytes of a segment, and segments of a file, at most; what is larger is no metadata.
SEGMENT, SEGMENTS = 64 << 20, 100_000

# Numbers of the directory entries, and the XMP fields that stand for a column.
_MAIN = {0x0100: "ImageWidth", 0x0101: "ImageHeight", 0x010F: "Make", 0x0110: "Model"}
_EXIF = {0x9003: "DateTimeOriginal", 0x9004: "CreateDate"}
_GPS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude"}
_EXIF_AT, _GPS_AT, _XMP_AT, _IPTC_AT = 0x8769, 0x8825, 0x02BC, 0x83BB
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_XMP = {
    "XMP-dc:Subject": "Subject", "XMP-digiKam:TagsList": "TagsList", "XMP-album:TaggerVersion": "TaggerVersion", "XMP-album:OCRRan": "OCRRan",
    "XMP-album:CountryCode": "CountryCode", "XMP-album:ClipModel": "ClipModel", "XMP-album:ClipEmbedding": "ClipEmbedding", "XMP-album:OCRText": "OCRText",
}

Read = Callable[[int, int], bytes]


class Damaged(ValueError):
    pass


def _exactly(read: Read, at: int, n: int) -> bytes:
    got = read(at, n) if n <= SEGMENT else b""
    if len(got) != n:
        raise Damaged(f"{n} bytes wanted at {at}")
    return got


def _tiff(read: Read, out: dict) -> None:
    """The entries of a TIFF header's directories; read: from its first byte on."""
    head = _exactly(read, 0, 8)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(head[:4])
    if order is None:
        raise Damaged("no TIFF header")

    def entries(at: int) -> dict[int, tuple[int, int, bytes]]:
        (n,) = struct.unpack(f"{order}H", _exactly(read, at, 2))
        rows = _exactly(read, at + 2, 12 * n)
        return {tag: (kind, count, rows[12 * k + 8 : 12 * k + 12]) for k in range(n) for tag, kind, count in [struct.unpack_from(f"{order}HHI", rows, 12 * k)]}

    def raw(entry: tuple[int, int, bytes]) -> bytes:
        kind, count, own = entry
        n = _SIZES.get(kind, 1) * count
        return own[:n] if n <= 4 else _exactly(read, struct.unpack(f"{order}I", own)[0], n)

    def value(entry: tuple[int, int, bytes]) -> str | list[float]:
        kind, count, data = entry[0], entry[1], raw(entry)
        if kind == 2:
            return data.split(b"\0")[0].decode("utf-8", "replace").strip()
        if kind in (5, 10):
            pairs = struct.unpack(f"{order}{2 * count}{'i' if kind == 10 else 'I'}", data)
            return [x / y if y else 0.0 for x, y in zip(pairs[::2], pairs[1::2], strict=True)]
        letter = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
        return list(struct.unpack(f"{order}{count}{letter}", data)) if letter else []

    def put(found: dict[int, tuple[int, int, bytes]], names: dict[int, str]) -> None:
        for tag, name in names.items():
            if tag in found:
                v = value(found[tag])
                if names is _GPS and tag in (2, 4):
                    v = sum(x / 60**k for k, x in enumerate(v[:3])) if v else ""
                elif isinstance(v, list):
                    v = v[0] if v else ""
                if v != "":
                    out.setdefault(name, str(v))

    main = entries(struct.unpack(f"{order}I", head[4:])[0])
    put(main, _MAIN)
    for tag, names in ((_EXIF_AT, _EXIF), (_GPS_AT, _GPS)):
        if tag in main and (at := value(main[tag])):
            put(entries(at[0]), names)
    if _XMP_AT in main:
        _packet(raw(main[_XMP_AT]), out)
    if _IPTC_AT in main:
        _iptc(raw(main[_IPTC_AT]), out)


def _iptc(data: bytes, out: dict) -> None:
    """Keywords of IPTC records."""
    at = 0
    while at + 5 <= len(data) and data[at] == 0x1C:
        record, number, n = data[at + 1], data[at + 2], struct.unpack_from(">H", data, at + 3)[0]
        if (record, number) == (2, 25):
            out.setdefault("Keywords", []).append(data[at + 5 : at + 5 + n].decode("utf-8", "replace"))
        at += 5 + n


def _photoshop(data: bytes, out: dict) -> None:
    """The IPTC records among Photoshop's resources."""
    at = 0
    while at + 12 <= len(data) and data[at : at + 4] == b"8BIM":
        number, name = struct.unpack_from(">HB", data, at + 4)
        at += 7 + name + (name + 1) % 2
        (n,) = struct.unpack_from(">I", data, at)
        if number == 0x0404:
            _iptc(data[at + 4 : at + 4 + n], out)
        at += 4 + n + n % 2


def _packet(data: bytes, out: dict) -> None:
    for field, values in xmp.fields(data).items():
        name = _XMP.get(field)
        if name in LISTS:
            out.setdefault(name, []).extend(values)
        elif name and values:
            out.setdefault(name, values[0])
        elif field == "XMP-iptcExt:ImageRegion":
            out.setdefault("ImageRegion", "[" + ",".join(values) + "]")


def _size(out: dict, width: int, height: int) -> None:
    out.setdefault("FileImageWidth", str(width))
    out.setdefault("FileImageHeight", str(height))


def _jpeg(read: Read, out: dict) -> None:
    at = 2
    for _ in range(SEGMENTS):
        mark = _exactly(read, at, 2)
        if mark[0] != 0xFF:
            raise Damaged(f"no marker at {at}")
        kind = mark[1]
        if kind == 0xFF:  # a byte that fills
            at += 1
            continue
        if kind in (0xDA, 0xD9):  # samples begin, or the picture ends
            return
        if 0xD0 <= kind <= 0xD7 or kind == 0x01:
            at += 2
            continue
        (n,) = struct.unpack(">H", _exactly(read, at + 2, 2))
        if kind == 0xE1:
            data = _exactly(read, at + 4, n - 2)
            if data.startswith(b"Exif\0\0"):
                _tiff(lambda x, size, d=data: d[6 + x : 6 + x + size], out)
            elif data.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
                _packet(data[29:], out)
        elif kind == 0xED:
            data = _exactly(read, at + 4, n - 2)
            if data.startswith(b"Photoshop 3.0\0"):
                _photoshop(data[14:], out)
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", _exactly(read, at + 5, 4))
            _size(out, width, height)
        at += 2 + n


def _png(read: Read, out: dict) -> None:
    at = 8
    for _ in range(SEGMENTS):
        n, kind = struct.unpack(">I4s", _exactly(read, at, 8))
        if kind == b"IEND":
            return
        if kind == b"IHDR":
            _size(out, *struct.unpack(">II", _exactly(read, at + 8, 8)))
        elif kind == b"eXIf":
            data = _exactly(read, at + 8, n)
            _tiff(lambda x, size, d=data: d[x : x + size], out)
        elif kind == b"iTXt" and (data := _exactly(read, at + 8, n)).startswith(b"XML:com.adobe.xmp\0"):
            packed, rest = data[18], data[20:].split(b"\0", 2)[2]
            _packet(zlib.decompress(rest) if packed else rest, out)
        at += 12 + n


def _riff(read: Read, out: dict) -> None:
    """The chunks of a WebP file."""
    at, end = 12, 8 + struct.unpack("<I", _exactly(read, 4, 4))[0]
    for _ in range(SEGMENTS):
        if at + 8 > end:
            return
        kind, n = struct.unpack("<4sI", _exactly(read, at, 8))
        if kind == b"EXIF":
            data = _exactly(read, at + 8, n).removeprefix(b"Exif\0\0")
            _tiff(lambda x, size, d=data: d[x : x + size], out)
        elif kind == b"XMP ":
            _packet(_exactly(read, at + 8, n), out)
        elif kind == b"VP8X":
            data = _exactly(read, at + 8, 10)
            _size(out, int.from_bytes(data[4:7], "little") + 1, int.from_bytes(data[7:10], "little") + 1)
        at += 8 + n + n % 2


def of_file(read: Read, path: str) -> dict:
    """The fields of one file, and error if it is damaged: then what stood before the damage. A file of another kind has
    none."""
    out: dict = {}
    try:
        head = read(0, 12)
        if path.lower().endswith(".xmp"):
            _packet(read(0, SEGMENT), out)
        elif head[:2] == b"\xff\xd8":
            _jpeg(read, out)
        elif head[:8] == b"\x89PNG\r\n\x1a\n":
            _png(read, out)
        elif head[:4] in (b"II*\0", b"MM\0*"):
            _tiff(read, out)
        elif head[:4] == b"RIFF" and head[8:] == b"WEBP":
            _riff(read, out)
    except (ValueError, IndexError, OSError, struct.error, zlib.error) as e:
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def embedded(files: DataFrame) -> DataFrame:
    """files (path, and owner and rank, which pass through) -> path, the fields of a metadata dump, and error.

    Numbers are as in a dump in numeric mode: degrees without sign beside their N, S, E or W. Of a field that a file has
    twice, the first counts; lists add up. A field that is missing is null. A damaged file has error, with the fields that
    stood before the damage; one that is gone or cannot be read, error alone.
    """
    ship(files.sparkSession)
    names = [*FIELDS, *LISTS, "error"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                place = Place(path)
                rows.append(of_file(lambda at, n, p=path, o=place: o.read_at(p, at, n), path))
            columns = [pa.array([r.get(c) for r in rows], pa.list_(pa.string()) if c in LISTS else pa.string()) for c in names]
            yield pa.RecordBatch.from_arrays([b.column("path"), *columns, *b.columns[1:]], names=["path", *names, *b.schema.names[1:]])

    kept = [c for c in ("owner", "rank") if c in files.columns]
    rows = files.select("path", *kept)
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, SCHEMA + kinds)


def merged_files(every: DataFrame) -> DataFrame:
    """every (path, source: embedded or sidecar, physical: the file or its sidecar) -> as embedded(), a row for each path:
    lists are united, the file's first; of another field the sidecar's counts where it has it. A sidecar that is damaged
    says nothing; error is the file's own."""
    from albumspark.operators.merge import merged

    found = embedded(every.select(F.col("physical").alias("path"), F.col("path").alias("owner"), (F.col("source") == "sidecar").cast("int").alias("rank"))).drop("path")
    own = F.col("rank") == 0
    rows = found.filter(own | F.col("error").isNull()).withColumn("error", F.when(own, F.col("error")))
    return merged(rows, ["owner"], LISTS, [*FIELDS, "error"]).withColumnRenamed("owner", "path")
