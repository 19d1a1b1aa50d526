"""Nearest-timestamp as-of join, both directions, within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from albumspark.functions.temporal import micros


def nearest(rows: DataFrame, tolerance_s: int = 1800) -> DataFrame:
    """rows (seq, ts, lat, lon, others) with near_lat, near_lon, gap_s.

    Rows with coordinates keep them, gap null. Others take those of the nearest located row in time, the earlier on a
    tie, if it is within the tolerance. Of located rows at one time, the last counts from later rows and the first
    from rows at that time or before it, in the order of seq. Null times find nothing. Times without zone are subtracted as
    they stand, whatever the session's zone.

    Time is cut into buckets of the tolerance; a located row also stands in the buckets beside its own, so every
    window is over one bucket and nothing is sorted globally. A bucket keeps one anchor a timestamp.
    """
    at_micros = lambda c: micros(F.col(c), isinstance(rows.schema["ts"].dataType, T.TimestampNTZType))
    bucket = F.floor(at_micros("ts") / F.lit(max(1, tolerance_s) * 1_000_000))
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    at = F.struct("lat", "lon")
    anchors = rows.filter(located & F.col("ts").isNotNull()).groupBy("ts").agg(F.min_by(at, "seq").alias("first"), F.max_by(at, "seq").alias("last"))
    anchors = anchors.withColumn("bucket", F.explode(F.array(*[bucket + k for k in (-1, 0, 1)])))
    asked = rows.filter(~located & F.col("ts").isNotNull()).select("seq", "ts").distinct().withColumn("bucket", bucket)
    both = asked.withColumn("kind", F.lit(0)).unionByName(anchors.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("bucket").orderBy("ts", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def side(column: str, frame) -> Column:
        value = F.when(F.col("kind") == 1, F.struct(F.col("ts").alias("ts"), F.col(column).alias("at")))
        return (F.last_value if column == "last" else F.first_value)(value, F.lit(True)).over(frame)

    gap = lambda c: F.abs(at_micros(f"{c}.ts") - at_micros("ts")) / 1e6
    found = both.withColumns({"b": side("last", before), "a": side("first", after)}).filter("kind = 0")
    found = found.select("seq", "ts", F.col("b.at").alias("b_at"), gap("b").alias("b_gap"), F.col("a.at").alias("a_at"), gap("a").alias("a_gap"))
    earlier = F.col("a_gap").isNull() | (F.col("b_gap") <= F.col("a_gap"))
    found = found.select("seq", "ts", F.when(earlier, F.col("b_at")).otherwise(F.col("a_at")).alias("at"), F.when(earlier, F.col("b_gap")).otherwise(F.col("a_gap")).alias("gap_s"))
    found = found.filter(F.col("gap_s") <= tolerance_s)
    joined = rows.alias("r").join(found.alias("f"), F.col("r.seq").eqNullSafe(F.col("f.seq")) & (F.col("r.ts") == F.col("f.ts")) & ~located, "left")
    return joined.select(
        "r.*", F.coalesce("r.lat", "f.at.lat").alias("near_lat"), F.coalesce("r.lon", "f.at.lon").alias("near_lon"), "f.gap_s"
    )
