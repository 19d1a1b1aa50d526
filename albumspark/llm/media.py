"""Media columns: payloads as 8-bit grey PNG members of archives, read back by a Spark data source.

An archive is a file of members laid end to end, then an index of fixed 32-byte rows (offset, length, row number,
crc32), then the index's length and a magic word. write_archives() writes one archive, or several of bounded size, a
task. MediaArchive plans byte ranges over an archive directory: a partition is a file and a range, and reads the
members that begin inside it, streaming Arrow batches of bounded size. Each member is fetched by its own offset,
checked, and retried on its own.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from albumspark.session import ship

from .common import batch, files, scratch, texts, tidied

#: Fixed: samples in a row of the picture (24 by 24), and the value that fills the last row.
ROW, FILL = 576, 255
MAGIC = b"ALBUMED1"
ENTRY = np.dtype([("offset", "<i8"), ("length", "<i8"), ("doc_id", "<i8"), ("crc", "<u4"), ("null", "<u4")])
#: Bytes of an archive at most (but for one member), of a byte range, and of a batch.
ARCHIVE, RANGE, BATCH = 64 << 20, 8 << 20, 4 << 20
TRIES, PARTITIONS, MANIFEST = 4, 100_000, "manifest"

_MANIFEST = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())])
_MEMBER = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


def payload(text: bytes) -> bytes:
    """The text, filled with 255 up to a positive multiple of 576 bytes."""
    return text + bytes([FILL]) * (max(1, -(-len(text) // ROW)) * ROW - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: bytes, level: int = 1) -> bytes:
    """An 8-bit grey PNG, 576 samples wide."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)  # filter 0 before each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of such a picture; ValueError where a chunk is damaged."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data = 8, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, ROW + 1)
    if raw[:, 0].any():
        raise ValueError("unknown row filter")
    return raw[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and mean step of the samples, and the 64-bit average hash of the mean 24 by 24 frame."""
    x = np.frombuffer(samples, np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    squares = int(np.dot(x.astype(np.int64), x.astype(np.int64)))
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    frame = x.reshape(-1, 8, 3, 8, 3).sum(axis=(0, 2, 4), dtype=np.int64).ravel()
    bits = np.packbits(frame * 64 > frame.sum()).tobytes().hex()
    return f"{total / n:.4f} {max(0, squares / n - (total / n) ** 2) ** 0.5:.4f} {step / n:.4f} {bits}"


def write_archives(docs: DataFrame, directory: str, archive: int = ARCHIVE) -> DataFrame:
    """Write each document's payload as a member; path, bytes and members of each archive, which is the manifest.

    A task that fails leaves files that the manifest does not name, and its next try writes others. Null texts are empty
    payloads; a null doc_id stays null. The manifest is a table in the directory, with a row for up to 64 MB of media.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]):
        system, base = files(directory)
        system.create_dir(base, recursive=True)
        out = index = name = None

        def close():
            rows = np.array(index, ENTRY).tobytes()
            size = out.tell() + len(rows) + 16
            out.write(rows + struct.pack("<q", len(rows)) + MAGIC)
            out.close()
            return batch(_MANIFEST, [name], [size], [len(index)])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b.column("text")), strict=True):
                if out is None:
                    name, index = f"{base}/{uuid.uuid4().hex}.media", []
                    out = system.open_output_stream(name)
                media = encode(payload(text))
                index.append((out.tell(), len(media), doc_id or 0, zlib.crc32(media), doc_id is None))
                out.write(media)
                if out.tell() >= archive:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "path string, bytes long, members long")
    at = f"{directory.rstrip('/')}/{MANIFEST}"
    rows.write.mode("overwrite").parquet(at)
    return spark.read.schema("path string, bytes long, members long").parquet(at)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class MediaArchive(DataSource):
    """spark.read.format("media_archive"): doc_id, path, offset, media, error of each member.

    Options: path, an archive directory with its manifest; range and batch, in bytes; tries. Ranges grow with the archives
    so that there are at most PARTITIONS of them, or one an archive. A member that cannot be read after all tries has
    error set and media null; with onError=fail, the default, the task fails instead and Spark runs it again.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, path string, offset long, media binary, error string"

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.directory = options["path"]

    def _int(self, name: str, default: int) -> int:
        return int(self.options.get(name.lower(), self.options.get(name, default)))

    def partitions(self) -> list[Range]:
        from pyarrow import fs, parquet

        system, base = files(self.directory)
        parts = [f.path for f in system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{MANIFEST}")) if f.path.endswith(".parquet")]
        tables = [parquet.ParquetFile(system.open_input_file(p)).read(["path", "bytes"]) for p in parts]
        found = sorted(zip(*(pa.concat_tables(tables).column(c).to_pylist() for c in ("path", "bytes")), strict=True)) if tables else []
        step = max(self._int("range", RANGE), sum(size for _, size in found) // PARTITIONS)
        return [Range(path, at, at + step) for path, size in found for at in range(0, size, step)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, _ = files(self.directory)
        out, held = ([], [], [], [], []), 0
        with system.open_input_file(part.path) as f:
            size = f.size()
            n, magic = struct.unpack("<q8s", f.read_at(16, size - 16))
            if magic != MAGIC:
                raise ValueError(f"{part.path} is not an archive")
            index = np.frombuffer(f.read_at(n, size - 16 - n), ENTRY)
            index = index[(index["offset"] >= part.start) & (index["offset"] < part.end)]
            for e in index:
                media, error = self._member(f, e, part.path)
                for column, v in zip(out, (None if e["null"] else int(e["doc_id"]), part.path, int(e["offset"]), media, error), strict=True):
                    column.append(v)
                held += len(media or b"")
                if held >= self._int("batch", BATCH):
                    yield batch(_MEMBER, *out)
                    out, held = ([], [], [], [], []), 0
        if out[0]:
            yield batch(_MEMBER, *out)

    def _member(self, f, e, path: str) -> tuple[bytes | None, str | None]:
        for last in range(self._int("tries", TRIES) - 1, -1, -1):
            try:
                media = f.read_at(int(e["length"]), int(e["offset"]))
                if len(media) == e["length"] and zlib.crc32(media) == e["crc"]:
                    return media, None
                error = "checksum"
            except OSError as x:
                error = str(x)
            if not last and self.options.get("onerror", self.options.get("onError", "fail")) == "fail":
                raise OSError(f"{path} at {e['offset']}: {error}")
        return None, error


def read_archives(spark: SparkSession, directory: str, **options) -> DataFrame:
    ship(spark)
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**{k: str(v) for k, v in options.items()}).load(directory)


_DIGEST = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(members: DataFrame) -> DataFrame:
    """What the stored members hold. No UTF-8 text has a byte 255, so the fill shows where the text ends."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for doc_id, media in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                x = decode(media)
                rows.append((
                    doc_id, len(x.rstrip(b"\xff")), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]),
                    len(media), hashlib.sha256(media).hexdigest(), feature(x),
                ))
            yield batch(_DIGEST, *zip(*rows, strict=True)) if rows else batch(_DIGEST, *[[]] * 8)

    return members.select("doc_id", "media").mapInArrow(tidied(run), DIGEST)


def media_columns(docs: DataFrame) -> DataFrame:
    """Write the documents to archives in the shared folder and read the members back.

    docs: doc_id, text; other columns are left out. Null and empty texts are one row of fill. Repeated rows are
    members of their own; equal texts have equal bytes.
    """
    directory = scratch(docs.sparkSession, "media")
    write_archives(docs, directory)
    return read_archives(docs.sparkSession, directory)
