"""Changes written into XMP sidecars, in two phases.

First, tasks read each sidecar that is there, apply its changes and write the new one under a name of its own beside it;
nothing that anyone reads has changed yet, and a task that is lost and run again computes the same from the same. The list
of what was written, a table, names the files of the tries that succeeded. Publishing the job renames one small file; until
then it can be given up. Second, tasks put each new sidecar in the place of the old one by a rename. That phase can be run
again at any time, by anyone: what is in place already is passed over.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumspark.session import ship
from albumspark.sources import xmp
from albumspark.sources.tree import Place

_STAGED = "target string, staged string, digest string, error string"


def after(values: list[str], steps: list[dict]) -> list[str]:
    """A field's values after steps (op, value) in order: = replaces, and values of one run of it stand together; -= removes;
    += appends what is not there; an empty = leaves nothing."""
    last = None
    for s in steps:
        op, value = s["op"], s["value"]
        if op == "=":
            values = (values if last == "=" else []) + ([value] if value else [])
        elif op == "-=":
            values = [v for v in values if v != value]
        elif value not in values:
            values = [*values, *([value] if value else [])]
        last = op
    return values


def _fs(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _tasks(spark: SparkSession) -> int:
    """Tasks that files are dealt to. Left alone, Spark counts bytes and merges them to one or two, but a file costs time."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def stage(mutations: DataFrame, job: str) -> DataFrame:
    """Write the new sidecars of mutations (target, field, op, value, and op_seq) beside the old; target, staged, digest,
    error of each. job: a new folder that all executors see, for the list.

    Targets that do not end in .xmp and fields that are not XMP are passed over. Changes of one field go in the order of
    op_seq, then =, -=, +=, then value, as in applied(). A sidecar that is not there begins empty; one that is no XMP has
    error, and stays as it is.
    """
    spark = mutations.sparkSession
    ship(spark)
    own = mutations.filter(F.lower("target").endswith(".xmp") & F.col("field").startswith("XMP-"))
    seq = F.col("op_seq") if "op_seq" in mutations.columns else F.lit(0)
    rank = F.when(F.col("op") == "=", 0).when(F.col("op") == "-=", 1).otherwise(2)
    steps = F.array_sort(F.collect_list(F.struct("field", seq.alias("seq"), rank.alias("rank"), F.coalesce("value", F.lit("")).alias("value"), "op")))
    grouped = own.repartition(_tasks(spark), "target").groupBy("target").agg(steps.alias("steps"))  # a file's own changes

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for row in b.to_pylist():
                place, target = Place(row["target"]), row["target"]
                if not place.local:
                    raise ValueError(f"{target}: sidecars are written where files are renamed in place")
                at, staged = place.inside(target), f"{place.inside(target)}.{uuid.uuid4().hex}.new"
                try:
                    old = open(at, "rb").read() if os.path.exists(at) else None
                    by_field: dict[str, list[dict]] = {}
                    for s in row["steps"]:
                        by_field.setdefault(s["field"], []).append(s)
                    new = xmp.changed(old, lambda have, by_field=by_field: {f: after(have.get(f, []), own) for f, own in by_field.items()})
                except ValueError as e:
                    rows.append((target, None, None, str(e)))
                    continue
                with open(staged, "wb") as out:
                    out.write(new)
                rows.append((target, staged, hashlib.sha256(new).hexdigest(), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["target", "staged", "digest", "error"])

    grouped.mapInArrow(run, _STAGED).write.mode("overwrite").parquet(f"{job.rstrip('/')}/staged")
    return spark.read.schema(_STAGED).parquet(f"{job.rstrip('/')}/staged")


def publish(spark: SparkSession, job: str) -> None:
    """From now on the job's sidecars count: put() will bring them to their places."""
    base = job.rstrip("/")
    made, system = _fs(spark, f"{base}/.{uuid.uuid4().hex}")
    system.create(made).close()
    if not system.rename(made, _fs(spark, f"{base}/published")[0]) and not is_published(spark, job):
        raise OSError(f"{job} cannot be published")


def is_published(spark: SparkSession, job: str) -> bool:
    path, system = _fs(spark, f"{job.rstrip('/')}/published")
    return system.exists(path)


def _each(staged: DataFrame, do) -> int:
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(do(r) for r in b.to_pylist())], pa.int64())})

    # In the order of the list, in which the files were made: dealt anew, they would lie all over the disk.
    done = staged.filter("staged IS NOT NULL").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    return done or 0


def put(spark: SparkSession, job: str) -> int:
    """Bring a published job's sidecars to their places; how many were not there yet. To be run again after a failure."""
    if not is_published(spark, job):
        raise ValueError(f"{job} is not published")

    def do(row: dict) -> int:
        if os.path.exists(row["staged"]):
            os.replace(row["staged"], Place(row["target"]).inside(row["target"]))  # at once, or not at all
            return 1
        return 0

    return _each(spark.read.schema(_STAGED).parquet(f"{job.rstrip('/')}/staged"), do)


def give_up(spark: SparkSession, job: str) -> None:
    """Remove what an unpublished job has written beside the sidecars."""
    if is_published(spark, job):
        raise ValueError(f"{job} is published")
    path, system = _fs(spark, f"{job.rstrip('/')}/staged")
    if system.exists(path):

        def do(row: dict) -> int:
            if os.path.exists(row["staged"]):
                os.remove(row["staged"])
            return 1

        _each(spark.read.schema(_STAGED).parquet(path.toString()), do)
    system.delete(_fs(spark, job)[0], True)


def write(mutations: DataFrame, job: str) -> DataFrame:
    """Both phases; target, error of each sidecar."""
    made = stage(mutations, job)
    publish(mutations.sparkSession, job)
    put(mutations.sparkSession, job)
    return made.select("target", "error")


def read(files: DataFrame) -> DataFrame:
    """files (path) -> path, field, values of all known fields of sidecars; those that are no XMP have no row."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                place = Place(path)
                try:
                    rows += [(path, f, v) for f, v in xmp.fields(place.read_at(path, 0, 64 << 20)).items()]
                except (ValueError, OSError):
                    continue
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)], names=["path", "field", "values"])

    return files.select("path").repartition(_tasks(files.sparkSession)).mapInArrow(run, "path string, field string, values array<string>")
