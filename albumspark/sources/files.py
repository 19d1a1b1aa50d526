"""Files, metadata dumps, manifests, landmarks and mappings as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from albumspark.operators.components import checkpointed
from albumspark.sources import journal, ranges
from albumspark.sources.tree import scan  # noqa: F401  (one of this module's sources)

METADATA = T.StructType([
    T.StructField(n, T.StringType())
    for n in (
        "SourceFile GPSLatitude GPSLongitude GPSLatitudeRef GPSLongitudeRef Make Model DateTimeOriginal CreateDate ImageWidth ImageHeight "
        "FileImageWidth FileImageHeight ImageRegion TaggerVersion OCRRan CountryCode ClipModel ClipEmbedding Keywords Subject TagsList OCRText"
    ).split()
])
REGIONS = "array<struct<Name:string,Type:string,Description:string,RRole:array<struct<Identifier:array<string>,Name:string>>,RegionBoundary:struct<RbX:double,RbY:double,RbW:double,RbH:double>>>"
LISTS = "Keywords Subject TagsList OCRText".split()
MANIFEST = "original string, moved_to string, ts timestamp"
LANDMARK = "name string, wikidata_id string, lat double, lon double, embedding array<float>"


def to_compare(files: DataFrame) -> DataFrame:
    """files (path): pictures, but for those under a folder named _duplicates."""
    from albumspark.functions.files import IMAGES, extension

    return files.filter(extension(F.col("path")).isin(*IMAGES) & ~F.array_contains(F.split("path", "/"), "_duplicates"))


def motion_companions(files: DataFrame) -> DataFrame:
    """files (path): the film halves of live photos."""
    from albumspark.functions.files import motion_companion

    return files.filter(motion_companion(F.col("path")))


def metadata(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A dump of metadata objects, an array a file, or with lines one object a line, which large dumps should have: such
    files are split. List fields may be bare texts and become arrays. A file that is no JSON gives no row."""
    rows = spark.read.schema(METADATA).option("multiLine", str(not lines).lower()).json(path).filter("SourceFile IS NOT NULL")
    arrays = {c: F.when(F.col(c).startswith("["), F.from_json(c, "array<string>")).when(F.col(c).isNotNull(), F.array(c)) for c in LISTS}
    return rows.withColumns(arrays).withColumnRenamed("SourceFile", "path")


def versions(meta: DataFrame) -> DataFrame:
    """path, version of files that have one."""
    return meta.select("path", F.nullif(F.col("TaggerVersion"), F.lit("")).alias("version")).filter("version IS NOT NULL")


def fields(meta: DataFrame) -> DataFrame:
    """The fields of a single file's read, with numbers and regions as such."""
    from albumspark.functions.geo import coordinates

    whole = lambda c: F.col(c).try_cast("int").alias(c)
    coords = coordinates(*map(F.col, ("GPSLatitude", "GPSLongitude", "GPSLatitudeRef", "GPSLongitudeRef")))
    return meta.select(
        "path", coords.alias("coords"), "Make", "Model", "DateTimeOriginal", "CreateDate", *map(whole, ("ImageWidth", "ImageHeight", "FileImageWidth", "FileImageHeight")),
        "Keywords", "Subject", "TagsList", "TaggerVersion", F.from_json("ImageRegion", REGIONS).alias("ImageRegion"),
    )


def keyword_leaves(meta: DataFrame) -> DataFrame:
    """path, leaves: the lower-case leaves of the three keyword fields."""
    from albumspark.functions.text import leaves, union_in_order

    return meta.select("path", F.array_sort(leaves(union_in_order(F.col("TagsList"), F.col("Subject"), F.col("Keywords")))).alias("leaves"))


def dates(meta: DataFrame) -> DataFrame:
    """path, original, created."""
    return meta.select("path", F.col("DateTimeOriginal").alias("original"), F.col("CreateDate").alias("created"))


def image_claims(spark: SparkSession, path: str) -> DataFrame:
    """wikidata_id, prop, claim_ord, filename of image claims, from a dump with an entity reply a line
    ({"entities": {id: {"claims": {prop: [...]}}}}); claims without a file name, and replies that are none, go."""
    claim = "struct<mainsnak:struct<datavalue:struct<value:string>>>"
    reply = F.from_json("value", f"entities map<string,struct<claims:map<string,array<{claim}>>>>")
    rows = spark.read.text(path).select(F.explode(reply["entities"]).alias("wikidata_id", "e"))
    rows = rows.select("wikidata_id", F.explode("e.claims").alias("prop", "c")).select("wikidata_id", "prop", F.posexplode("c").alias("claim_ord", "c"))
    return rows.select("wikidata_id", "prop", "claim_ord", F.col("c.mainsnak.datavalue.value").alias("filename")).filter("filename IS NOT NULL")


def cached_embeddings(meta: DataFrame, model: str) -> DataFrame:
    """path, vec of files whose stored model is this one and whose vector decodes."""
    from albumspark.functions.vectors import decoded

    rows = meta.filter((F.col("ClipModel") == model) & (F.coalesce("ClipEmbedding", F.lit("")) != ""))
    return rows.select("path", decoded("ClipEmbedding").alias("vec")).filter("vec IS NOT NULL")


def people_tags(meta: DataFrame) -> DataFrame:
    """path, tags below People/, of files that have any."""
    tags = F.filter("TagsList", lambda t: t.startswith("People/"))
    return meta.select("path", tags.alias("tags")).filter(F.size("tags") > 0)


def viewer_inputs(meta: DataFrame) -> DataFrame:
    """path, keywords, coords, taken: what a viewer shows, in one pass."""
    from albumspark.functions.geo import coordinates
    from albumspark.functions.temporal import exif_datetime
    from albumspark.functions.text import union_in_order

    coords = coordinates(*map(F.col, ("GPSLatitude", "GPSLongitude", "GPSLatitudeRef", "GPSLongitudeRef")))
    keywords = union_in_order(F.col("TagsList"), F.col("Subject"), F.col("Keywords"))
    return meta.select("path", keywords.alias("keywords"), coords.alias("coords"), exif_datetime(F.col("DateTimeOriginal"), F.col("CreateDate")).alias("taken"))


def fix_inputs(meta: DataFrame) -> DataFrame:
    """path, keywords (three fields united), ocr_ran, coords."""
    from albumspark.functions.geo import coordinates
    from albumspark.functions.text import union_in_order

    ran = ~F.coalesce(F.lower("OCRRan"), F.lit("")).isin("", "0", "false")
    coords = coordinates(*map(F.col, ("GPSLatitude", "GPSLongitude", "GPSLatitudeRef", "GPSLongitudeRef")))
    return meta.select("path", union_in_order(F.col("TagsList"), F.col("Subject"), F.col("Keywords")).alias("keywords"), ran.alias("ocr_ran"), coords.alias("coords"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """original, moved_to, ts, line_no of a log of moves: one of commits, or JSON-lines files, in which blank and malformed
    lines go. line_no compares as the log is ordered; files are ordered by time, then name."""
    if journal.is_log(spark, path):
        return journal.read(spark, path)
    order = ("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")
    rows = spark.read.text(path).select("value", *[F.col(c) for c in order], F.monotonically_increasing_id().alias("line"))  # ascends in a block
    rows = rows.withColumn("r", F.from_json("value", MANIFEST)).filter("r.original IS NOT NULL AND r.moved_to IS NOT NULL")
    return rows.select("r.*", F.struct("file_modification_time", "file_path", "file_block_start", "line").alias("line_no"))


def landmarks(spark: SparkSession, path: str, size: int = ranges.RANGE) -> DataFrame:
    """ord, name, wikidata_id, lat, lon, embedding, model of a landmark file, or of several in order of their names; files are
    read in byte ranges of this size."""
    found = ranges.elements(spark, path, "landmarks", size).select("path", "ord", F.from_json("value", LANDMARK).alias("l"))
    model = ranges.member(spark, path, "model", size).select(F.col("path").alias("p"), F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"].alias("model"))
    counts = found.groupBy("path").agg(F.count("*").alias("n"))  # a row a file
    counts = counts.select("path", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    rows = found.join(F.broadcast(checkpointed(counts)), "path").join(model, F.col("path") == F.col("p"), "left")
    return rows.select((F.col("first") + F.col("ord")).cast("int").alias("ord"), "l.*", "model")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a query dump (id as URI, numbers as text); rows whose numbers do not parse go."""
    rows = spark.read.schema("item string, label string, lat string, lon string, image string, sitelinks string").json(path)
    out = rows.select(F.substring_index("item", "/", -1).alias("wikidata_id"), F.col("label").alias("name"), F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), F.col("image").alias("image_url"), F.col("sitelinks").try_cast("int").alias("sitelinks"))
    return out.filter("lat IS NOT NULL AND lon IS NOT NULL AND sitelinks IS NOT NULL")


def url_cache(spark: SparkSession, path: str, size: int = ranges.RANGE) -> DataFrame:
    """wikidata_id, urls array<struct<url,source>> of a JSON object, in its present shape (an object with images) or the two
    before it (a list of objects, or of URLs, whose source is unknown); it is read in byte ranges of this size."""
    text = F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"]  # a bare text without its quotes
    rows = ranges.elements(spark, path, None, size).select(F.col("key").alias("wikidata_id"), text.alias("v")).filter("wikidata_id IS NOT NULL")
    now = F.from_json("v", "array<struct<url:string,source:string>>")
    unknown = lambda u: F.struct(u.alias("url"), F.lit("unknown").alias("source"))
    present = F.from_json("v", "images array<struct<url:string,source:string>>")["images"]
    plain = F.transform(F.from_json("v", "array<string>"), unknown)
    return rows.select("wikidata_id", F.when(F.col("v").startswith("{"), present).when(F.get(now, F.lit(0))["url"].isNotNull(), now).when(F.col("v").startswith("["), plain).otherwise(F.array(unknown(F.col("v")))).alias("urls"))


# A key, then a value: each in quotes, or bare; a comment has white space before it.
_ENTRY = "^\\s*(?:\"([^\"]*)\"|'([^']*)'|([^:#\"'][^:]*?))\\s*:(?:\\s+(?:\"([^\"]*)\"|'([^']*)'|(.*?)))?\\s*(?:\\s#.*)?$"


def tag_mapping(spark: SparkSession, path: str) -> DataFrame:
    """raw_tag, category, tag of a mapping of `raw tag: Category/Path` lines; null and ~ mean: no tag."""
    part = lambda k: F.regexp_extract("value", _ENTRY, k)
    rows = spark.read.text(path).select(F.concat(part(1), part(2), part(3)).alias("raw_tag"), F.concat(part(4), part(5), part(6)).alias("tag")).filter("raw_tag <> ''")
    tag = F.when(~F.col("tag").isin("", "~", "null"), F.col("tag"))
    return rows.select("raw_tag", F.substring_index(tag, "/", 1).alias("category"), tag.alias("tag"))


def tag_mapping_of(spark: SparkSession, mapping: dict) -> DataFrame:
    """As tag_mapping(), of a parsed mapping, some thousand entries: raw tag to null, to Category/Path, or to an object of
    category and tag."""
    rows = []
    for raw, value in mapping.items():
        if isinstance(value, dict):
            rows.append((str(raw), value["category"], value["tag"]))
        else:
            rows.append((str(raw), value.split("/", 1)[0] if value else None, value or None))
    return spark.createDataFrame(rows, "raw_tag string, category string, tag string")


def merged_config(defaults: dict, overlay: dict | str | None) -> dict:
    """Defaults with the overlay's leaves on top; an overlay file that is missing changes nothing."""
    if isinstance(overlay, str):
        try:
            with open(overlay) as f:  # a file beside the driver
                overlay = json.load(f)
        except FileNotFoundError:
            overlay = None
    out = dict(defaults)
    for k, v in (overlay or {}).items():
        out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
