"""Watch a directory: new files go through a batch function, or one by one through a function of one file, as they appear.

A poll lists the tree, and a stateful step of the stream lets each file through once, by its path without links. Its state
is in the checkpoint, so a file's age does not matter, a file that changes is not seen again, and a query that starts
anew goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from albumspark.functions.files import motion_companion, supported
from albumspark.session import ship
from albumspark.sources.tree import looked_up, polled

FAILED = "path string, error string, batch_id long"


def new_files(spark: SparkSession, directory: str, subtrees: int = 64) -> DataFrame:
    """A stream of path, real of supported files below the directory, each once; of several links to one file, any one."""
    rows = polled(spark, directory, subtrees).filter(supported(F.col("path")) & ~motion_companion(F.col("path")))
    return rows.dropDuplicates(["real"])


def _remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def one_by_one(rows: DataFrame, process: Callable[[dict], None]) -> DataFrame:
    """path, error (null: none) of each row that process was given, in tasks; what it raises is its row's error alone."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            errors = []
            for row in b.to_pylist():
                try:
                    process(row)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one file must not end the others
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(errors, pa.string())], names=["path", "error"])

    return rows.select("path", "name", "size", "mtime").mapInArrow(run, "path string, error string")


def watch(
    spark: SparkSession,
    directory: str,
    checkpoint: str,
    process: Callable[[DataFrame, int], None] | None = None,
    versions: Callable[[SparkSession], DataFrame] | None = None,
    version: str = "",
    every: str = "5 seconds",
    once: bool = False,
    each: Callable[[dict], None] | None = None,
) -> StreamingQuery:
    """Give each batch of new files (path, name, size, mtime) to process(rows, batch_id), or each of its files to each(row).

    versions() is read anew for each batch (path, version), and files at the current version are left out; they count as
    seen. A batch is a table while it is processed, so process may read it as often as it likes; a batch that fails is
    given again when the query starts anew. What each() raises sets that file aside, in failures(), and ends nothing.
    """
    if not isinstance(directory, str) or "," in directory:
        raise ValueError("one directory can be watched at a time")
    if (process is None) == (each is None):
        raise ValueError("give either process or each")
    base = checkpoint.rstrip("/")

    def batch(rows: DataFrame, batch_id: int) -> None:
        session, at = rows.sparkSession, f"{base}/new/{batch_id}"
        rows.select("path").write.mode("overwrite").parquet(at)
        new = session.read.schema("path string").parquet(at)
        if not new.isEmpty():
            if versions is not None:
                done = versions(session).filter(F.col("version") == version).select("path").distinct()
                new = new.join(done, "path", "left_anti")
            found = looked_up(new)
            if each is None:
                process(found, batch_id)
            else:
                set_aside = one_by_one(found, each).withColumn("batch_id", F.lit(batch_id).cast("long")).filter("error IS NOT NULL")
                set_aside.write.mode("overwrite").parquet(f"{base}/failed/batch-{batch_id}")
        _remove(session, at)

    writer = new_files(spark, directory).writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/stream")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def failures(spark: SparkSession, checkpoint: str) -> DataFrame:
    """path, error, batch_id of the files that were set aside."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/failed")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], FAILED)
    return spark.read.schema(FAILED).option("recursiveFileLookup", "true").parquet(path.toString())
