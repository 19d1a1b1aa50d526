"""Backfill of missing dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumspark.functions.temporal import exif_text, from_sources

_IMAGE_FIELDS = ("EXIF:DateTimeOriginal", "EXIF:CreateDate", "EXIF:ModifyDate", "XMP-photoshop:DateCreated")
_XMP_FIELDS = ("XMP-xmp:CreateDate",)


def missing(rows: DataFrame, force: bool = False) -> DataFrame:
    """rows (path, original, created): those in which both are null or empty; all with force."""
    return rows if force else rows.filter((F.coalesce("original", F.lit("")) == "") & (F.coalesce("created", F.lit("")) == ""))


def backfill(rows: DataFrame, sources: list[str], force: bool = False) -> DataFrame:
    """rows (path, name, mtime, original, created) -> path, ts, label for files whose date was found."""
    found = missing(rows, force).withColumn("_d", from_sources(F.col("name"), F.col("mtime"), sources))
    return found.filter("_d IS NOT NULL").select("path", "_d.ts", "_d.label")


def preview(rows: DataFrame, sources: list[str], force: bool = False, resolved: int = 50, unmatched: int = 20) -> DataFrame:
    """What a dry run shows of a backfill: kind (resolved or unmatched), pos, path, ts, label, more: the first of each kind
    by path, and how many more there are."""
    found = missing(rows, force).withColumn("_d", from_sources(F.col("name"), F.col("mtime"), sources))
    kind = F.when(F.col("_d").isNotNull(), "resolved").otherwise("unmatched")
    found = found.select(kind.alias("kind"), "path", "_d.ts", "_d.label")
    first = None
    for k, n in (("resolved", resolved), ("unmatched", unmatched)):
        own = found.filter(F.col("kind") == k).orderBy("path").limit(n)
        first = own if first is None else first.unionByName(own)
    pos = F.row_number().over(Window.partitionBy("kind").orderBy("path"))  # of what is shown
    counts = found.groupBy("kind").agg(F.count("*").alias("n"))
    most = F.when(F.col("kind") == "resolved", resolved).otherwise(unmatched)
    return first.withColumn("pos", pos).join(counts, "kind").select("kind", "pos", "path", "ts", "label", F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def backfill_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("label").agg(F.count("*").alias("n")).orderBy("label")


def date_mutations(found: DataFrame) -> DataFrame:
    """found (path, ts, label, is_video) -> mutations; films get the XMP fields alone."""
    fields = F.when(F.col("is_video"), F.array(*map(F.lit, _XMP_FIELDS))).otherwise(F.array(*map(F.lit, _IMAGE_FIELDS + _XMP_FIELDS)))
    dated = found.select("path", F.explode(fields).alias("field"), F.lit("=").alias("op"), exif_text(F.col("ts")).alias("value"))
    return dated.unionByName(found.select("path", F.lit("XMP-album:DateSource").alias("field"), F.lit("=").alias("op"), F.col("label").alias("value")))
