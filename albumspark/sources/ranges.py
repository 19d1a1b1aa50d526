"""Elements of large JSON files, by byte ranges: a file that is one object or array is read by many tasks.

A range does not know whether it begins inside a string, nor how deep. So a first pass gives, for each range, whether it
holds an odd number of quotes and how much deeper it ends, once if it begins outside a string and once if inside; sums over
the ranges before it, a row a range, then tell each range its state. In a second pass a range gives the elements that begin
in it, reading on where its last one ends. Elements are what stands between commas of the container that is asked for: the
whole file's, or that of one key in it, which is found by the same means.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from albumspark.operators.components import checkpointed
from albumspark.session import ship
from albumspark.sources.tree import Place

#: Bytes of a range, and bytes read at once behind a range's end; a key's bytes at most.
RANGE, AHEAD, KEY = 16 << 20, 1 << 20, 1 << 16

_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Where strings begin or end; escaped: the first byte is."""
    quote = data == ord('"')
    slash = np.flatnonzero(data == ord("\\"))
    if escaped:
        quote[:1] = False
        slash = slash[slash > 0]
    if len(slash):
        # In a run of backslashes every second one is escaped, and what follows a run of odd length.
        first = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
        length = np.diff(np.append(first, len(slash)))
        behind = slash[first] + length
        behind = behind[(length % 2 == 1) & (behind < len(data))]
        quote[behind] = False
    return quote


def _escaped(place: Place, path: str, at: int) -> bool:
    """Whether the byte there is escaped: an odd number of backslashes stands before it."""
    n = 0
    while at:
        size = min(at, 256)
        before = place.read_at(path, at - size, size)
        run = len(before) - len(before.rstrip(b"\\"))
        n += run
        if run < size:
            break
        at -= size
    return n % 2 == 1


class Lexed:
    """A piece of JSON: the places of brackets and commas outside strings, and the depth behind each."""

    def __init__(self, data: bytes, escaped: bool, inside: bool, depth: int):
        x = np.frombuffer(data, np.uint8)
        quote = _quotes(x, escaped)
        within = (np.cumsum(quote) + inside) % 2 == 1  # behind each byte; a quote that ends a string is outside
        step = np.where(within, 0, _STEP[x])
        self.at = np.flatnonzero((step != 0) | ((x == ord(",")) & ~within))
        self.byte = x[self.at]
        self.depth = depth + np.cumsum(step[self.at], dtype=np.int64)
        self.inside = bool((quote.sum() + inside) % 2)
        self.last = int(self.depth[-1]) if len(self.at) else depth

    def borders(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where elements at this depth may begin behind (their container's bracket, or a comma), and where one must end
        (a comma, or that container's other bracket)."""
        opens, closes, comma = _STEP[self.byte] == 1, _STEP[self.byte] == -1, self.byte == ord(",")
        begins = self.at[(opens | comma) & (self.depth == depth)]
        return begins, self.at[(comma & (self.depth == depth)) | (closes & (self.depth == depth - 1))]


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """path, k, start, end, bytes of each range of each file there."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes")).filter("bytes > 0")
    rows = files.select("path", "bytes", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {size})")).alias("k"))
    return rows.select("path", "k", (F.col("k") * size).alias("start"), F.least(F.col("bytes"), (F.col("k") + 1) * size).alias("end"), "bytes")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(max(1, min(rows.count(), 10_000)))


def states(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """path, k, start, end, bytes, escaped, inside, depth: the state in which each range begins. Checkpointed."""
    ship(spark)
    columns = ["path", "k", "start", "end", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            made = []
            for row in b.to_pylist():
                place = Place(row["path"])
                escaped = _escaped(place, row["path"], row["start"])
                data = place.read_at(row["path"], row["start"], row["end"] - row["start"])
                both = [Lexed(data, escaped, inside, 0) for inside in (False, True)]
                made.append((escaped, both[0].inside, both[0].last, both[1].last))
            kinds = (pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 4, kinds, strict=True))], names=[*columns, "escaped", "odd", "out", "in"])

    kinds = "path string, k long, start long, end long, bytes long"
    found = checkpointed(_dealt(_ranges(spark, path, size)).mapInArrow(run, f"{kinds}, escaped boolean, odd boolean, out long, in long"))
    before = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # rows are ranges
    found = found.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    deeper = F.when(F.col("inside"), F.col("in")).otherwise(F.col("out"))
    return checkpointed(found.withColumn("depth", F.coalesce(F.sum(deeper).over(before), F.lit(0))).select(*columns, "escaped", "inside", "depth"))


def _elements(place: Place, row: dict, depth: int, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """Where they begin, and the text, of the elements that begin in a range; low, high: what their container takes."""
    path, start, end = row["path"], row["start"], row["end"]
    data = place.read_at(path, start, end - start)
    lexed = Lexed(data, row["escaped"], row["inside"], row["depth"])
    begins, ends = lexed.borders(depth)
    begins = begins[(begins + start >= low) & (begins + start < high)]
    if not len(begins):
        return
    stops = np.searchsorted(ends, begins, side="right")
    closed = stops < len(ends)
    for x, y in zip(begins[closed].tolist(), ends[stops[closed]].tolist(), strict=True):
        yield start + x, data[x + 1 : y]
    if not closed[-1]:  # the last element ends behind the range
        parts, at, inside, now = [data[int(begins[-1]) + 1 :]], end, lexed.inside, lexed.last
        while at < row["bytes"]:
            more = place.read_at(path, at, AHEAD)
            ahead = Lexed(more, _escaped(place, path, at), inside, now)
            _, ends = ahead.borders(depth)
            if len(ends):
                parts.append(more[: int(ends[0])])
                break
            parts.append(more)
            at, inside, now = at + len(more), ahead.inside, ahead.last
        yield start + int(begins[-1]), b"".join(parts)


def _heads(place: Place, row: dict) -> Iterator[tuple[int, str | None]]:
    """The borders of the outermost container's members in a range, and the key of each that begins there."""
    data = place.read_at(row["path"], row["start"], row["end"] - row["start"])
    begins, ends = Lexed(data, row["escaped"], row["inside"], row["depth"]).borders(1)
    for x in np.union1d(begins, ends).tolist():
        at = row["start"] + x
        head = place.read_at(row["path"], at + 1, KEY).lstrip() if x in begins else b""
        yield at, _key(head)[0]


def _key(text: bytes) -> tuple[str | None, bytes]:
    """The key of a member of an object, and its value; (None, text) of an element of an array."""
    text = text.strip()
    if text.startswith(b'"'):
        quote = np.flatnonzero(_quotes(np.frombuffer(text, np.uint8), False))
        if len(quote) > 1:
            rest = text[quote[1] + 1 :].lstrip()
            if rest.startswith(b":"):
                return json.loads(text[: quote[1] + 1], strict=False), rest[1:].strip()
    return None, text


def elements(spark: SparkSession, path: str, key: str | None = None, size: int = RANGE) -> DataFrame:
    """path, ord (from 0, in each file), key (null in an array), value (JSON text) of the members of each file's outermost
    object or array, or of the object or array that its member `key` is.

    Whatever the size of ranges, the rows are the same. A task reads its range, and on to the end of its last element. A
    file without that key, or without any element, gives no row. Files are UTF-8; a file that is no JSON gives undefined
    rows, none or damaged ones, and no error.
    """
    found = states(spark, path, size)
    if key is None:
        bounds = found.select("path", "bytes").distinct().select("path", F.lit(-1).cast("long").alias("low"), F.col("bytes").alias("high"))
        depth = 1
    else:

        def heads(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                rows = [(r["path"], at, k) for r in b.to_pylist() for at, k in _heads(Place(r["path"]), r)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "low", "member"])

        members = _dealt(found).mapInArrow(heads, "path string, low long, member string")
        members = members.withColumn("high", F.lead("low").over(Window.partitionBy("path").orderBy("low")))
        bounds, depth = members.filter(F.col("member") == key).select("path", "low", "high"), 2
    asked = found.join(checkpointed(bounds), "path").filter("end > low AND start < high")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for r in b.to_pylist():
                rows = []
                for at, text in _elements(Place(r["path"]), r, depth, r["low"], r["high"]):
                    k, value = _key(text)
                    if value:
                        rows.append((r["path"], r["k"], at, k, value.decode("utf-8", "replace")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["path", "k", "at", "key", "value"])

    made = checkpointed(_dealt(asked).mapInArrow(run, "path string, k long, at long, key string, value string"))
    counts = made.groupBy("path", "k").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # rows are ranges
    own = F.row_number().over(Window.partitionBy("path", "k").orderBy("at"))
    return made.withColumn("own", own).join(counts.select("path", "k", first.alias("first")), ["path", "k"]).select("path", (F.col("first") + F.col("own") - 1).alias("ord"), "key", "value")


def member(spark: SparkSession, path: str, key: str, size: int = RANGE) -> DataFrame:
    """path, value: the JSON text of a small member, under KEY bytes, of each file's outermost object."""
    ship(spark)
    found = states(spark, path, size)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                place = Place(r["path"])
                for at, k in _heads(place, r):
                    if k == key:
                        text = place.read_at(r["path"], at + 1, KEY)
                        _, ends = Lexed(text, False, False, 1).borders(1)
                        rows.append((r["path"], _key(text[: ends[0]] if len(ends) else text)[1].decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 2)], names=["path", "value"])

    return _dealt(found).mapInArrow(run, "path string, value string")
