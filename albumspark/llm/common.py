"""What the operators share: durable cuts of lineage, shared folders, tokens and Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumspark.operators.components import checkpointed, freed
from albumspark.session import checkpoint_dir, ship

#: Fixed: a token is a run of anything but ASCII white space.
WORD = rb"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
SPACE = "[\\x20\\x09-\\x0D]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]+"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The same as a look-up table of byte values.
LOWER = np.frombuffer(_LOWER, np.uint8)


def lower_ascii(text: bytes) -> bytes:
    """A-Z to a-z; every other byte stays."""
    return text.translate(_LOWER)


#: Folders that this process has made under the shared folder.
_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of this job's own under the shared folder, as a URI or path; clean() removes it."""
    ship(spark)
    _MADE.append(f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clean(spark: SparkSession) -> None:
    """Remove all that stored() and scratch() have written. Call it when no frame that reads from there is needed."""
    conf = spark._jsc.hadoopConfiguration()
    while _MADE:
        at = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        at.getFileSystem(conf).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """As checkpointed(), but as compressed Parquet, for wide rows."""
    at = scratch(df.sparkSession, "albumspark")
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def crc32_id(c: str = "doc_id") -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))


def crc32_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def free_names(df: DataFrame, *names: str) -> list[str]:
    """As free_name(), for several names."""
    return [free_name(df, n) for n in names]


def sliced(batches: Iterable[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in batches of some `size` bytes of text, or of one row where that is longer."""
    for b in batches:
        n = pc.binary_length(b.column(b.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        at = np.flatnonzero(np.diff((np.cumsum(n) - n) // size, prepend=-1)).tolist()
        yield from (b.slice(x, y - x) for x, y in zip(at, [*at[1:], len(n)], strict=True))


def tidy() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # glibc alone has it
        pass


def tidied(run):
    """run, which maps batches to batches, tidies up at its end: workers live on from task to task, and the next task may
    be of another operator."""

    def mapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return mapped


def tidied_group(run):
    """As tidied(), of a function on one group."""

    def mapped(t):
        out = run(t)
        tidy()
        return out

    return mapped


def tidied_cogroup(run):
    """As tidied(), of a function on two groups."""

    def mapped(left, right):
        out = run(left, right)
        tidy()
        return out

    return mapped


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins, with the end of the last; null is empty."""
    c = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(c.buffers()[1], "<i8")[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int64)
    data = np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """data between neighbouring offsets as texts, without a copy."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, "<i8")), pa.py_buffer(np.ascontiguousarray(data))])


def files(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema, strict=True)], schema=schema)
