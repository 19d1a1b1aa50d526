"""Selections under caps and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumspark.functions.geo import REGION_SHARE
from albumspark.functions.text import SKIPPED_EXTENSIONS, extension

# Image properties in order of preference.
IMAGE_PROPERTIES = ("P18", "P3451", "P8517", "P5252", "P7417")
# The types of landmarks, with how many of each are asked for.
TYPES = {
    "tourist attraction": 2000, "archaeological site": 1500, "monument": 2000, "architectural structure": 2000, "landmark": 500,
    "church building": 1500, "mosque": 1500, "temple": 1500, "synagogue": 500, "pagoda": 500, "stupa": 500, "Shinto shrine": 1000,
    "castle": 1500, "palace": 1500, "fortification": 1000, "house": 2000, "bridge": 1500, "tower": 1500, "lighthouse": 500, "skyscraper": 1000, "fountain": 500,
    "museum": 1500, "stadium": 1500, "statue": 1500, "town square": 1000,
    "natural landmark": 500, "mountain": 1500, "volcano": 500, "lake": 1500, "waterfall": 500, "cave": 500,
}
# The boxes of the second pass (least and greatest latitude, least and greatest longitude), and its types.
BOXES = {"Asia": (5, 72, 35, 150), "Africa": (-35, 35, -20, 35), "N.America": (10, 72, -170, -50), "S.America": (-55, 15, -85, -35), "Oceania": (-50, -10, 110, 180)}
BOX_TYPES = {"tourist attraction": 400, "monument": 400, "archaeological site": 400, "architectural structure": 400, "temple": 300, "museum": 300, "mountain": 300, "palace": 300}


def first_query_wins(candidates: DataFrame, key: str = "wikidata_id") -> DataFrame:
    """Of rows with one key, that of the first query; within it, the one of least ord."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("query_ord", "ord"))
    return candidates.withColumn("_n", n).filter("_n = 1").drop("_n")


def _quota(rows: DataFrame, stratum: list[str], quota: Column, cap: Column, most: int) -> DataFrame:
    """Within a stratum: each type's best up to the quota, in the order in which types appear; then the rest by
    sitelinks; up to the cap. _pos is the place in that order."""
    keys = [*stratum, "type"]
    firsts = rows.groupBy(*keys).agg(F.min("ord").alias("_type_first"))
    # No cap is over `most`, so a type's rows beyond it never count and go before any window over a stratum.
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("sitelinks"), "ord"))
    rows = rows.withColumn("_rank", rank).filter(F.col("_rank") <= most).join(firsts, keys).withColumn("_over", F.col("_rank") > quota)
    order = ["_over", F.when(F.col("_over"), -F.col("sitelinks")).otherwise(F.col("_type_first")), "_type_first", "_rank"]
    pos = F.row_number().over(Window.partitionBy(*stratum).orderBy(*order)) if stratum else F.row_number().over(Window.orderBy(*order))
    return rows.withColumn("_pos", pos).filter(F.col("_pos") <= cap)


def region_cap(limit: int, shares: dict[str, float] = REGION_SHARE) -> Column:
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("region")), F.lit(0.05))
    return F.greatest((share * F.lit(float(limit))).cast("int"), F.lit(1))


def by_region_cap(candidates: DataFrame, limit: int, n_types: int = 31, shares: dict[str, float] = REGION_SHARE) -> DataFrame:
    """candidates (ord, region, type, sitelinks, others) -> at most limit of them, with place.

    A region has at most its share of the limit, and one at least; each of its types a quota of that, and one at least.
    What a region leaves unused is not dealt to others. The whole is in order of sitelinks, then of regions as they
    first appear.
    """
    cap = region_cap(limit, shares)
    quota = F.greatest(F.floor(cap / n_types).cast("int"), F.lit(1))
    first = candidates.groupBy("region").agg(F.min("ord").alias("_region_first"))
    picked = _quota(candidates, ["region"], quota, cap, max(limit, 1)).join(first, "region")
    picked = picked.orderBy(F.desc("sitelinks"), "_region_first", "_pos").limit(limit)  # a report of at most limit rows
    place = F.row_number().over(Window.orderBy(F.desc("sitelinks"), "_region_first", "_pos"))
    return picked.withColumn("place", place).select(*candidates.columns, "place")


def by_type_quota(candidates: DataFrame, limit: int, n_types: int) -> DataFrame:
    """As above without regions: limit // n_types of each type, then the rest by sitelinks; in that order."""
    picked = _quota(candidates, [], F.lit(limit // max(1, n_types)), F.lit(limit), limit)
    return picked.withColumn("place", F.col("_pos")).select(*candidates.columns, "place")


def region_pools(candidates: DataFrame, picked: DataFrame, limit: int, shares: dict[str, float] = REGION_SHARE) -> DataFrame:
    """region, pool, cap, picked: how many candidates a region has, may give and gave."""
    pools = candidates.groupBy("region").agg(F.count("*").alias("pool")).withColumn("cap", region_cap(limit, shares))
    return pools.join(picked.groupBy("region").agg(F.count("*").alias("picked")), "region", "left").fillna(0, ["picked"])


def typed_query(items: DataFrame, kind: str, limit: int, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """items (type, sitelinks, lat, lon, wikidata_id, others): up to limit of a type, most sitelinks first, in a box of
    least and greatest latitude and longitude."""
    rows = items.filter((F.col("type") == kind) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if box is not None:
        rows = rows.filter(F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:]))
    return rows.orderBy(F.desc("sitelinks"), "wikidata_id").limit(limit)


def candidate_pool(items: DataFrame, types: list[tuple[str, int]], boxes: list[tuple[float, float, float, float]], box_types: list[tuple[str, int]]) -> DataFrame:
    """The two passes of queries, of types everywhere and then of some types in each box; of repeated ids the first counts.

    One window over all queries ranks each query's rows, in place of a query each.
    """
    asked = [(kind, n, None) for kind, n in types] + [(kind, n, box) for box in boxes for kind, n in box_types]
    inside = lambda box: F.lit(True) if box is None else F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:])
    hits = F.array_compact(F.array(*[
        F.when((F.col("type") == kind) & inside(box), F.struct(F.lit(k).alias("query_ord"), F.lit(n).alias("most"))) for k, (kind, n, box) in enumerate(asked)
    ]))
    rows = items.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("*", F.inline(hits))
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("query_ord").orderBy(F.desc("sitelinks"), "wikidata_id")))
    rows = rows.filter(F.col("ord") <= max((n for _, n, _ in asked), default=0)).filter("ord <= most")
    return first_query_wins(rows.drop("most"))


def to_embed(landmarks: DataFrame, existing: DataFrame) -> DataFrame:
    """Landmarks that are not there yet with an embedding; those without one are tried again."""
    done = existing.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("wikidata_id").distinct()
    return landmarks.join(done, "wikidata_id", "left_anti")


def to_fetch(landmarks: DataFrame, urls: DataFrame) -> DataFrame:
    """Landmarks whose image URLs are not kept yet."""
    return landmarks.join(urls.select("wikidata_id").distinct(), "wikidata_id", "left_anti")


def to_download(images: DataFrame, kept: DataFrame, least: int) -> DataFrame:
    """images (wikidata_id, idx, url) of which no file of at least `least` bytes is kept; kept: name, size."""
    from albumspark.functions.text import cache_name

    names = images.withColumn("_name", cache_name(F.col("wikidata_id"), F.col("idx"), F.col("url")))
    have = kept.filter(F.col("size") >= least).select(F.col("name").alias("_name")).distinct()
    return names.join(have, "_name", "left_anti").select(*images.columns)


def images(claims: DataFrame, target: int) -> DataFrame:
    """claims (wikidata_id, prop, claim_ord, filename) -> up to target of each id, with place and source.

    Properties in order of preference; names that differ by case or by spaces and underscores are one; skipped
    extensions go before names are compared.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for k, p in enumerate(IMAGE_PROPERTIES) for x in (p, k)]), F.col("prop"))
    rows = claims.filter(F.col("prop").isin(*IMAGE_PROPERTIES) & F.col("filename").isNotNull() & ~extension(F.col("filename")).isin(*SKIPPED_EXTENSIONS))
    rows = rows.withColumns({"_prop": rank, "_key": F.lower(F.replace(F.col("filename"), F.lit(" "), F.lit("_")))})
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("wikidata_id", "_key").orderBy("_prop", "claim_ord"))).filter("_n = 1")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("wikidata_id").orderBy("_prop", "claim_ord")))
    return placed.filter(F.col("place") <= target).select("wikidata_id", "filename", F.concat(F.lit("wikidata:"), F.col("prop")).alias("source"), "place")


def vector_mean(vectors: DataFrame) -> DataFrame:
    """vectors (id, vec) -> id, vec: the mean of each id's vectors, scaled to length one."""
    from albumspark.functions.vectors import normalized

    each = vectors.select("id", F.posexplode("vec").alias("pos", "x")).groupBy("id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select("id", F.transform("v", lambda e: e["x"]).alias("v"))
    return mean.select("id", normalized(F.col("v")).alias("vec"))
