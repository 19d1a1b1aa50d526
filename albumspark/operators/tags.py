"""Tags: index, search, change, mapping under caps, and which pipelines a file still needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumspark.functions.text import any_prefix, leaf, piped

# The margin over a class's threshold, and how many tags a category may have.
THRESHOLD_MARGIN = 1.10
CATEGORY_CAPS = {"Objects": 8, "Scenes": 6}
# The fields that a location part is written to.
LOCATION_FIELDS = {
    "Country": ("XMP-photoshop:Country", "IPTC:Country-PrimaryLocationName"),
    "CountryCode": ("XMP-iptcCore:CountryCode", "IPTC:Country-PrimaryLocationCode"),
    "State": ("XMP-photoshop:State", "IPTC:Province-State"),
    "City": ("XMP-photoshop:City", "IPTC:City"),
    "Sublocation": ("XMP-iptcCore:Location", "IPTC:Sub-location"),
}


def tag_index(rows: DataFrame, unique: bool = False) -> DataFrame:
    """rows (path, tags) -> tag, path: lower-case leaves, each once a file. With unique, no path stands in two rows, and
    nothing is shuffled."""
    own = F.array_distinct(F.transform("tags", lambda t: F.lower(leaf(t))))
    index = rows.select(F.explode(own).alias("tag"), "path")
    return index if unique else index.distinct()


def tag_counts(index: DataFrame) -> DataFrame:
    """tag, n_files; most files first, then by tag."""
    return index.groupBy("tag").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "tag")


def index_summary(index: DataFrame) -> DataFrame:
    return index.agg(F.countDistinct("tag").alias("n_tags"), F.countDistinct("path").alias("n_files"), F.count("*").alias("n_uses"))


def search(index: DataFrame, query: str) -> DataFrame:
    """Files that have exactly this leaf, in any case."""
    return index.filter(F.col("tag") == query.strip().lower()).select("path").distinct()


def matching(index: DataFrame, pattern: str) -> DataFrame:
    """Uses of tags that match the pattern as a whole."""
    return index.filter(F.col("tag").rlike(f"^(?:{pattern})$"))


def without(tags: Column, *gone: str) -> Column:
    """Tags without these paths and leaves."""
    names = [x for g in gone for x in dict.fromkeys((g, g.rsplit("/", 1)[-1]))]
    return F.filter(tags, lambda t: ~F.coalesce(t.isin(*names), F.lit(False)))


def renamed(tags: Column, old: str, new: str) -> Column:
    """Where the old tag or leaf stands, it goes and the new tag comes last."""
    left = without(tags, old)
    added = F.when(F.array_contains(left, new), left).otherwise(F.array_append(left, F.lit(new)))
    return F.when(F.size(left) < F.size(tags), added).otherwise(tags)


def changes_of(t: Column, op: str = "+=") -> Column:
    """Of a tag, an array of field, op, value: four fields, five for people."""
    fields = [("IPTC:Keywords", leaf(t)), ("XMP-dc:Subject", leaf(t)), ("XMP-digiKam:TagsList", t), ("XMP-lr:HierarchicalSubject", piped(t))]
    change = lambda f, v: F.struct(F.lit(f).alias("field"), F.lit(op).alias("op"), v.alias("value"))
    person = F.when(t.startswith("People/"), change("XMP-iptcExt:PersonInImage", leaf(t)))
    return F.array_compact(F.array(*[change(f, v) for f, v in fields], person))


def fan_out(rows: DataFrame, op: str = "+=") -> DataFrame:
    """rows (path, tag) -> mutations path, field, op, value: four fields a tag, five for people."""
    return rows.select("path", F.inline(changes_of(F.col("tag"), op)))


def location_changes(parts: Column) -> Column:
    """Of a place's parts (map<string,string>), an array of field, op, value; unknown parts are passed over."""
    made = []
    for part, fields in LOCATION_FIELDS.items():
        value = F.try_element_at(parts, F.lit(part))
        each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit("=").alias("op"), value.alias("value")) for f in fields])
        made.append(F.when(F.map_contains_key(parts, part), each).otherwise(F.slice(each, 1, 0)))
    return F.concat(*made)


def location_fan_out(rows: DataFrame) -> DataFrame:
    """rows (path, parts map<string,string>) -> mutations; unknown parts are passed over."""
    return rows.select("path", F.inline(location_changes(F.col("parts"))))


def place_path(rows: DataFrame) -> DataFrame:
    """rows (path, address map<string,string>) with place, country_code and parts; missing levels close up."""
    from albumspark.functions.text import title

    a = lambda k: F.nullif(F.try_element_at("address", F.lit(k)), F.lit(""))
    levels = {
        "Country": F.coalesce(a("country")),
        "State": F.coalesce(a("state"), a("region"), a("province"), a("county")),
        "City": F.coalesce(a("city"), a("town"), a("village"), a("municipality")),
        "Sublocation": F.coalesce(a("suburb"), a("neighbourhood"), a("quarter"), a("district")),
    }
    titled = {k: title(v) for k, v in levels.items()} | {"CountryCode": F.upper(a("country_code"))}
    segments = F.array_compact(F.array(*[titled[k] for k in levels]))
    place = F.when(F.size(segments) > 0, F.concat(F.lit("Places/"), F.array_join(segments, "/")))
    parts = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in titled.items()]), lambda p: p["v"].isNotNull()))
    return rows.withColumns({"place": place, "country_code": titled["CountryCode"], "parts": parts})


def mapped_tags(predictions: DataFrame, mapping: DataFrame, thresholds: DataFrame | None = None, caps: dict[str, int] = CATEGORY_CAPS) -> DataFrame:
    """predictions (path, raw_tag, score, raw_ord) -> path, category, tag, score, category_rank, category_ord.

    A prediction counts from margin times its class's threshold on; a class without threshold passes. Raw tags without
    mapping, or of a category without cap, go. Of raw tags with one tag the best counts; then the best of a category up
    to its cap; categories in the order in which they first come by score.
    """
    kept = predictions
    if thresholds is not None:
        kept = kept.join(thresholds, "raw_tag", "left").withColumn("class_threshold", F.coalesce("class_threshold", F.lit(0.0)))
    kept = kept.filter(F.col("score") >= F.col("class_threshold") * F.lit(THRESHOLD_MARGIN))
    rows = kept.join(mapping.filter(F.col("tag").isNotNull() & F.col("category").isin(*caps)), "raw_tag")
    order = [F.desc("score"), "raw_ord"]
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("path", "category", "tag").orderBy(*order))).filter("_n = 1").drop("_n")
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("category"))
    ranked = once.withColumn("category_rank", F.row_number().over(Window.partitionBy("path", "category").orderBy(*order)))
    firsts = ranked.withColumn("_first", F.first(F.struct(-F.col("score"), "raw_ord")).over(Window.partitionBy("path", "category").orderBy(*order)))
    firsts = firsts.withColumn("category_ord", F.dense_rank().over(Window.partitionBy("path").orderBy("_first", "category")))
    return firsts.filter(F.col("category_rank") <= cap).select("path", "category", "tag", "score", "category_rank", "category_ord")


def fix_plan(rows: DataFrame, landmarks: bool = True, consider: tuple[str, ...] = ("gps", "ram", "landmarks", "ocr")) -> DataFrame:
    """rows (path, keywords, ocr_ran, has_coords, has_fallback) with run_gps, run_ram, run_landmarks, run_ocr.

    Geocoding needs a file's own coordinates; landmarks may use inferred ones and need a landmark table.
    """
    kw = F.coalesce("keywords", F.array().cast("array<string>"))
    on = {c: F.lit(c in consider) for c in ("gps", "ram", "landmarks", "ocr")}
    return rows.withColumns({
        "run_gps": on["gps"] & F.col("has_coords") & ~any_prefix(kw, "Places/"),
        "run_ram": on["ram"] & ~any_prefix(kw, "Objects/", "Scenes/"),
        "run_landmarks": on["landmarks"] & F.lit(landmarks) & (F.col("has_coords") | F.col("has_fallback")) & ~any_prefix(kw, "Landmarks/"),
        "run_ocr": on["ocr"] & ~F.coalesce("ocr_ran", F.lit(False)),
    })


def fix_workload(plan: DataFrame) -> DataFrame:
    """Files with work, and how many for each pipeline."""
    runs = ("run_gps", "run_ram", "run_landmarks", "run_ocr")
    any_ = F.col(runs[0]) | F.col(runs[1]) | F.col(runs[2]) | F.col(runs[3])
    return plan.agg(F.count_if(any_).alias("n_files"), *[F.count_if(F.col(r)).alias(r) for r in runs])


def to_process(files: DataFrame, versions: DataFrame, version: str, force: bool = False) -> DataFrame:
    """Files whose stored version is not the current one; all of them with force."""
    if force:
        return files
    return files.join(versions.filter(F.col("version") == version).select("path").distinct(), "path", "left_anti")


def taxonomy_stats(mapping: DataFrame) -> DataFrame:
    """mapping (category, tag) -> category, n_paths, flat: distinct paths of each category, and those without a slash."""
    rows = mapping.filter(F.col("tag").isNotNull())
    flat = F.sort_array(F.collect_set(F.when(~F.contains("tag", F.lit("/")), F.col("tag"))))
    return rows.groupBy("category").agg(F.count_distinct("tag").alias("n_paths"), flat.alias("flat"))


def foreign(existing_leaves: Column, tags: Column) -> Column:
    """Existing leaves that none of our tags has."""
    from albumspark.functions.text import leaves, owned

    return F.array_except(existing_leaves, leaves(F.filter(tags, owned)))


def viewed(rows: DataFrame) -> DataFrame:
    """rows (path, coords struct<lat,lon>, taken timestamp, keywords) -> path, gps, taken_at, landmarks, tags, as shown."""
    dash, kw = F.lit("—"), F.coalesce("keywords", F.array().cast("array<string>"))
    gps = F.when(F.col("coords").isNotNull(), F.format_string("%.6f, %.6f", "coords.lat", "coords.lon")).otherwise(dash)
    mark = lambda t: t.startswith("Landmarks/")
    return rows.select(
        "path", gps.alias("gps"), F.coalesce(F.date_format("taken", "yyyy-MM-dd HH:mm"), dash).alias("taken_at"),
        F.array_sort(F.filter(kw, mark)).alias("landmarks"), F.array_sort(F.filter(kw, lambda t: ~mark(t))).alias("tags"),
    )


def taxonomy(paths: DataFrame) -> DataFrame:
    """paths (path) -> every prefix as a node: node, depth, is_leaf, line; indented, inner nodes end in /."""
    parts = F.split("path", "/")
    nodes = paths.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("i", "node"), (F.size(parts) - 1).alias("last"))
    nodes = nodes.groupBy("node").agg(F.max("i").alias("depth"), F.min(F.col("i") == F.col("last")).alias("is_leaf"))
    name = F.concat(F.repeat(F.lit("  "), F.col("depth")), leaf(F.col("node")), F.when(F.col("is_leaf"), "").otherwise("/"))
    return nodes.withColumn("line", name)
