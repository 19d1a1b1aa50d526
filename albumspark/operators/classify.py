"""Tags by learned directions: a class is the mean direction of its examples, and what lies closer to it than they do has it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumspark.functions.vectors import dot
from albumspark.operators.select import vector_mean
from albumspark.session import ship

#: Classes at most, of which every task has the directions.
CLASSES = 20_000
_FOUND = "path {path}, raw_tag string, score double, class_threshold double, raw_ord long"


def directions(examples: DataFrame) -> DataFrame:
    """examples (label, vec) -> raw_tag, vec (the normalized mean), class_threshold (the mean score of its own examples)."""
    means = vector_mean(examples.select(F.col("label").cast("string").alias("id"), "vec")).withColumnRenamed("id", "raw_tag")
    own = examples.select(F.col("label").cast("string").alias("raw_tag"), F.col("vec").alias("example")).join(means, "raw_tag")
    return means.join(own.groupBy("raw_tag").agg(F.avg(dot(F.col("example"), F.col("vec"))).alias("class_threshold")), "raw_tag")


def predicted(vectors: DataFrame, classes: DataFrame) -> DataFrame:
    """vectors (path, vec) -> path, raw_tag, score, class_threshold, raw_ord: every class's inner product with each vector, the
    best first, ties by name; vectors that are null or of another length have none.

    classes (raw_tag, vec, class_threshold): at most CLASSES, which go to every task as one matrix; more is an error.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = classes.select("raw_tag", F.col("vec").cast("array<double>").alias("vec"), "class_threshold").orderBy("raw_tag").limit(CLASSES + 1).collect()
    if len(rows) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    shared = spark.sparkContext.broadcast((np.array([r["vec"] for r in rows], float).reshape(len(rows), -1), [r["raw_tag"] for r in rows], np.array([r["class_threshold"] for r in rows], float)))

    def run(batches: Iterator[pa.RecordBatch]):
        m, names, thresholds = shared.value
        for b in batches:
            b = b.filter(pa.array([v is not None and len(v) == m.shape[1] for v in b.column("vec")], pa.bool_()))
            if not b.num_rows or not names:
                continue
            scores = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, m.shape[1]) @ m.T
            order = np.argsort(-scores, axis=1, kind="stable")
            flat, each = order.ravel(), np.repeat(np.arange(b.num_rows), len(names))
            columns = [b.column("path").take(pa.array(each)), pa.array(names).take(pa.array(flat)), pa.array(scores[each, flat]), pa.array(thresholds[flat]), pa.array(np.tile(np.arange(len(names)), b.num_rows))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "raw_tag", "score", "class_threshold", "raw_ord"])

    rows = vectors.select("path", F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, _FOUND.format(path=rows.schema["path"].dataType.simpleString()))
