"""A log of moves as numbered commits, published one by one.

The rows of a commit are written first, as JSON lines in a folder of their own; then a small file named by the commit's
number is renamed into place, which fails if that number is taken. So a write that dies leaves rows that no commit names,
readers see whole commits alone, and of two writers at once the second takes the next number, or, if it rewrites, begins
anew from what the first has made of the log. A rewrite is a commit that names all rows there are from then on. Order is
that of commits, then of rows in each.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "original string, moved_to string, ts timestamp"
_ROW = f"{ENTRY}, row long"
#: Commits after which an append rewrites the log as one.
COMPACT = 64


class Taken(Exception):
    """Another writer has published a commit of this number."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    at, system = _fs(spark, path)
    system.delete(at, True)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all commits, ascending."""
    at, system = _fs(spark, f"{path.rstrip('/')}/commits")
    if not system.exists(at):
        return []
    names = [f.getPath().getName() for f in system.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _fs(spark, path)
    return system.exists(at)


def is_log(spark: SparkSession, path: str) -> bool:
    return bool(_numbers(spark, path))


def _commits(spark: SparkSession, path: str) -> list[dict]:
    """The commits that make up the log now, from the last rewrite on: at most COMPACT or so, each a line."""
    found = []
    for n in reversed(_numbers(spark, path)):
        at, system = _fs(spark, f"{path.rstrip('/')}/commits/{n:020d}.json")
        stream = system.open(at)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found.append(json.loads(text))
        if found[-1]["rewrites"]:
            break
    return found[::-1]


def _publish(spark: SparkSession, path: str, number: int, data: str | None, rewrites: bool) -> None:
    base, jvm = path.rstrip("/"), spark._jvm
    commits, system = _fs(spark, f"{base}/commits")
    system.mkdirs(commits)
    made, _ = _fs(spark, f"{base}/commits/.{uuid.uuid4().hex}")
    out = system.create(made)
    out.write(bytearray(json.dumps({"number": number, "data": data, "rewrites": rewrites}).encode()))
    out.close()
    to, _ = _fs(spark, f"{base}/commits/{number:020d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # do not overwrite
    try:
        context.rename(made, to, never)
    except Exception as e:
        system.delete(made, False)
        if number in _numbers(spark, path):
            raise Taken(number) from e
        raise


def _written(rows: DataFrame, path: str) -> str | None:
    """The folder of these rows (original, moved_to, ts, in their order), or None if there are none."""
    name = uuid.uuid4().hex
    at = f"{path.rstrip('/')}/data/{name}"
    rows.select("original", "moved_to", F.col("ts").cast("timestamp").alias("ts"), F.monotonically_increasing_id().alias("row")).write.json(at)
    if rows.sparkSession.read.schema(_ROW).json(at).isEmpty():
        _remove(rows.sparkSession, at)
        return None
    return name


def append(moves: DataFrame, path: str) -> int | None:
    """Add moves (original, moved_to, ts) in their order; the commit's number, or None if there is nothing to add."""
    spark = moves.sparkSession
    data = _written(moves, path)
    if data is None:
        return None
    while True:
        taken = _numbers(spark, path)
        try:
            _publish(spark, path, number := max(taken, default=0) + 1, data, False)
        except Taken:
            continue  # appends do not mind each other
        if len(_commits(spark, path)) > COMPACT:
            rewrite(spark, path, lambda rows: rows)
        return number


def read(spark: SparkSession, path: str) -> DataFrame:
    """original, moved_to, ts, line_no (commit and row, which compare as the log is ordered) of the log as it is now."""
    out = None
    for c in _commits(spark, path):
        if c["data"] is not None:
            rows = spark.read.schema(_ROW).json(f"{path.rstrip('/')}/data/{c['data']}")
            rows = rows.select("original", "moved_to", "ts", F.struct(F.lit(c["number"]).cast("long").alias("commit"), "row").alias("line_no"))
            out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], f"{ENTRY}, line_no struct<commit:long,row:long>") if out is None else out


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> int | None:
    """Put change(rows) in place of the log, rows as read() has them; the new commit's number, or None for a log that is gone.

    Until the commit is published the old log stands. If another writer publishes first, change is asked again. What the
    log no longer needs is removed then, and the whole log if nothing is left of it.
    """
    while True:
        before = _numbers(spark, path)
        if not before:
            return None
        old = _commits(spark, path)
        data = _written(change(read(spark, path)).orderBy("line_no"), path)
        try:
            _publish(spark, path, number := before[-1] + 1, data, True)
        except Taken:
            if data is not None:
                _remove(spark, f"{path.rstrip('/')}/data/{data}")
            continue
        for c in old:
            if c["data"] is not None:
                _remove(spark, f"{path.rstrip('/')}/data/{c['data']}")
        for n in before:
            _remove(spark, f"{path.rstrip('/')}/commits/{n:020d}.json")
        if data is None and _numbers(spark, path) == [number]:
            _remove(spark, path)
        return number


def without(spark: SparkSession, path: str, originals: DataFrame) -> int | None:
    """Drop the entries of these originals."""
    gone = originals.select("original").distinct()
    return rewrite(spark, path, lambda rows: rows.join(gone, "original", "left_anti"))
