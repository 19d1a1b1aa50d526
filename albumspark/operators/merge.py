"""Metadata of a file and its sidecar, merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumspark.functions.text import other_sidecar, sidecar


def merged(rows: DataFrame, keys: list[str], lists: list[str], scalars: list[str]) -> DataFrame:
    """rows (keys, rank, lists, scalars) -> a row for each key.

    Lists are united in the order of rank, first occurrences; null lists are empty. Of scalars the last counts that is
    neither null nor an empty text; 0 and false do count.
    """

    def union(c: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("rank", F.col(c).alias("v")))))
        return F.array_distinct(F.flatten(F.transform(parts, lambda p: p["v"]))).alias(c)

    def last(c: str) -> Column:
        kept = F.when(F.col(c).cast("string") != "", F.col("rank"))
        return F.max_by(c, kept).alias(c)

    return rows.groupBy(*keys).agg(*[union(c) for c in lists], *[last(c) for c in scalars])


def with_sidecars(files: DataFrame, existing: DataFrame) -> DataFrame:
    """files (path) -> path, source, physical: the file itself and its sidecar, name.ext.xmp or else name.xmp."""
    have = existing.select(F.col("path").alias("physical")).distinct()
    named = files.select("path", sidecar(F.col("path")).alias("a"), other_sidecar(F.col("path")).alias("b"))
    first = named.join(have.withColumnRenamed("physical", "a"), "a", "left_semi").select("path", F.lit("sidecar").alias("source"), F.col("a").alias("physical"))
    second = named.join(have.withColumnRenamed("physical", "a"), "a", "left_anti").join(have.withColumnRenamed("physical", "b"), "b", "left_semi")
    second = second.select("path", F.lit("sidecar").alias("source"), F.col("b").alias("physical"))
    return files.select("path", F.lit("embedded").alias("source"), F.col("path").alias("physical")).unionByName(first).unionByName(second)
