"""Mix sources to target weights: hash-random order, distributed prefix sums, cut at each source's budget.

Native: DataFrame functions only. Each document gets a uniform hash key. The key's leading bits are a range of the
order within its source, so the range sort needs no sampling and every rerun agrees: sums by (source, range) give
each range its offset, a window inside the range gives each document its prefix, and the document is cut against its
source's budget. A source that holds a third of all rows is dealt over all of its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, checkpointed, free_name, free_names

#: Ranges of the hash order in each source; a range is what one task sorts at once.
RANGES_HEX = 3


def word_count(text: str = "text") -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size -> weight and target.

    Sources by code point, null last, weigh weights in turn and share `share` of all words; a target stops at `most`
    times its source's size, and the excess is dealt anew by weight until none is above. In the order of size by
    weight, sources stop from the smallest on; the first that does not stop fixes the level of all after it. There is
    one row a source here, so its two global windows see sources, never documents.
    """
    n = len(weights)
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_code) - 1) % n + 1).cast("int"))
    s = sources.withColumn("weight", weight)
    cap = F.lit(float(most)) * F.col("source_size")
    by_ratio = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "_level": (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
        "_at": F.row_number().over(by_ratio),
    })
    s = s.withColumn("_stops", cap <= F.col("weight") * F.col("_level"))
    s = s.withColumn("_level", F.min_by("_level", F.when(~F.col("_stops"), F.col("_at"))).over(everything)).withColumn(
        "_first", F.min(F.when(~F.col("_stops"), F.col("_at"))).over(everything)
    )
    target = F.when(F.col("_first").isNull() | (F.col("_at") < F.col("_first")), cap).otherwise(F.col("weight") * F.col("_level"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, seed: str = "", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, whole: bool = False) -> DataFrame:
    """Documents with size, source_size, target, taken and copies.

    docs: doc_id, source and either text or size; other columns pass through. taken: words that the mix takes, the
    repeats of whole epochs counted; the document on the border gives its first words only, so that each source's
    taken words are its target, rounded down. With whole, it is taken whole if at least half of it is within the
    budget, and copies says how often the document stands in the mix.

    Null text: size 0. Null source: a source of its own, last in order. Null doc_id: keyed as empty text. Empty
    tables give an empty result. Repeated rows are taken one by one. Ties of the key fall by doc_id, then size, then a
    hash of the text where there is one, so reruns take the same texts.
    """
    own = {"size", "source_size", "target", "taken", "copies"}
    keep = [c for c in docs.columns if c.lower() not in own]
    key, part, before_it, tie = free_names(docs, "_key", "_range", "_before", "_tie")
    size = F.col("size").cast("long") if "size" in docs.columns else word_count()
    hashed = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    text = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], size.alias("size"), hashed.alias(key), text.alias(tie)).withColumn(part, F.substring(key, 1, RANGES_HEX))
    ranges = checkpointed(rows.groupBy("source", F.col(part).alias("part")).agg(F.sum("size").alias("sum")))
    sources = targets(ranges.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, most)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    ranges = ranges.alias("r").join(sources.alias("s"), same("r", "s")).select("r.source", "part", "offset", "source_size", "target")
    inside = Window.partitionBy("source", part).orderBy(key, "doc_id", "size", tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(before_it, F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.alias("d").join(ranges.alias("r"), same("d", "r") & (F.col(f"d.{part}") == F.col("r.part")))
    source_size, target, d_size = F.col("r.source_size"), F.col("r.target"), F.col("d.size")
    full = F.when(source_size > 0, F.floor(target / source_size)).otherwise(0).cast("long")
    rest = F.floor(target).cast("long") - full * source_size
    start = F.col("r.offset") + F.col(f"d.{before_it}")
    if whole:
        copies = full + F.when((rest > 0) & (start * 2 + d_size <= rest * 2), 1).otherwise(0)
        taken = copies * d_size
    else:
        first = F.greatest(F.lit(0).cast("long"), F.least(d_size, rest - start))
        copies, taken = full + F.when(first > 0, 1).otherwise(0), full * d_size + first
    made = [d_size, source_size, target, taken.cast("long").alias("taken"), copies.cast("long").alias("copies")]
    return rows.select(*[F.col(f"d.`{c}`") for c in keep], *made)


def documents_of(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: a row for each copy of each document."""
    copy = free_name(mixed, "_copy")
    every = mixed.withColumn(copy, F.explode(F.expr("sequence(1L, greatest(copies, 1L))"))).filter("copies > 0")
    return every.select(*[F.col(f"`{c}`") for c in columns])


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM s),
l AS (
  SELECT *, row_number() OVER o AS pos,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0.0::DOUBLE))
    / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
  FROM w
  WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, encode(source) NULLS LAST),
         b AS (ORDER BY 2.0::DOUBLE * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(pos) AS first_open, arg_min(level, pos) AS level FROM l WHERE NOT 2.0::DOUBLE * source_size <= weight * level),
t AS (
  SELECT l.source, l.source_size,
         CASE WHEN f.first_open IS NULL OR l.pos < f.first_open THEN 2.0::DOUBLE * l.source_size ELSE l.weight * f.level END AS target
  FROM l, f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (n * size + greatest(0, least(size, floor(target)::BIGINT - n * source_size - before)))::BIGINT AS taken
FROM p
"""
