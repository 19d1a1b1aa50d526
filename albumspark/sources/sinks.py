"""Proposed changes as one table of mutations, and how it is written and applied.

A mutation is path, field, op (=, += or -=) and value, with target, the physical file, and op_seq, its place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumspark.functions.text import sidecar
from albumspark.sources import files, journal

# Groups that a sidecar cannot hold, and the fields that clearing empties.
NOT_XMP = ("IPTC:", "EXIF:", "QuickTime:", "MakerNotes:", "File:")
KEYWORD_FIELDS = ("IPTC:Keywords", "XMP-dc:Subject", "XMP-digiKam:TagsList", "XMP-lr:HierarchicalSubject", "XMP-iptcExt:PersonInImage")
TAG_FIELDS = (*KEYWORD_FIELDS, "MicrosoftPhoto:LastKeywordXMP", "MediaPro:CatalogSets", "MicrosoftPhoto:CategorySet", "XMP-album:all")


def targets(mutations: DataFrame, sidecars: bool = False, is_video: str = "is_video") -> DataFrame:
    """With target: the file alone; with sidecars, a picture and its sidecar, or a film's sidecar alone. Fields of
    groups that are not XMP are left out of sidecars."""
    if not sidecars:
        return mutations.withColumn("target", F.col("path"))
    side = sidecar(F.col("path"))
    rows = mutations.withColumn("target", F.explode(F.when(F.col(is_video), F.array(side)).otherwise(F.array(F.col("path"), side))))
    return rows.filter(~(F.col("target").endswith(".xmp") & F.col("field").rlike("^(" + "|".join(NOT_XMP) + ")")))


def removals(rows: DataFrame) -> DataFrame:
    """rows (path, tag): a tag leaves the fields that it is written to, in the form that it has in each."""
    from albumspark.operators.tags import fan_out

    return fan_out(rows, "-=")


def on_existing(mutations: DataFrame, existing: DataFrame) -> DataFrame:
    """mutations (target, ...) without those of sidecars that are not there: removing creates none."""
    have = existing.select(F.col("path").alias("target")).distinct()
    side = F.lower("target").endswith(".xmp")
    return mutations.filter(~side).unionByName(mutations.filter(side).join(have, "target", "left_semi").select(*mutations.columns))


def clear_keywords(paths: DataFrame) -> DataFrame:
    return paths.select("path", F.explode(F.array(*map(F.lit, KEYWORD_FIELDS))).alias("field"), F.lit("=").alias("op"), F.lit("").alias("value"))


def clear_all(paths: DataFrame, people: DataFrame) -> DataFrame:
    """All tag fields and the tagger's own namespace empty, then each file's People tags again; op_seq orders the two."""
    from albumspark.operators.tags import fan_out

    empty = F.explode(F.array(*map(F.lit, TAG_FIELDS))).alias("field")
    cleared = paths.select("path", empty, F.lit("=").alias("op"), F.lit("").alias("value")).withColumn("op_seq", F.lit(0))
    again = fan_out(people.join(paths.select("path").distinct(), "path", "left_semi").select("path", F.explode("tags").alias("tag"))).withColumn("op_seq", F.lit(1))
    return cleared.unionByName(again)


def sentinel(paths: DataFrame, version: str) -> DataFrame:
    """The version and time of tagging, replaced."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pair = F.array(F.struct(F.lit("XMP-album:TaggerVersion").alias("field"), F.lit(version).alias("value")), F.struct(F.lit("XMP-album:TaggedAt").alias("field"), now.alias("value")))
    return paths.select("path", F.explode(pair).alias("m")).select("path", "m.field", F.lit("=").alias("op"), "m.value")


def embeddings(rows: DataFrame, model: str) -> DataFrame:
    """rows (path, vec): the vector as base64 of 32-bit floats, and its model."""
    from albumspark.functions.vectors import encoded

    pair = F.array(F.struct(F.lit("XMP-album:ClipEmbedding").alias("field"), encoded("vec").alias("value")), F.struct(F.lit("XMP-album:ClipModel").alias("field"), F.lit(model).alias("value")))
    return rows.select("path", F.explode(pair).alias("m")).select("path", "m.field", F.lit("=").alias("op"), "m.value")


def applied(lists: DataFrame, mutations: DataFrame) -> DataFrame:
    """lists (path, field, values) after mutations, in the order of op_seq: = replaces, and values of one run of it stand
    together; -= removes; += appends what is not there. Mutations of one op_seq, or without any, go in the order =, -=,
    +=, each by value. An empty = leaves nothing."""
    seq = F.col("op_seq") if "op_seq" in mutations.columns else F.lit(0)
    rank = F.when(F.col("op") == "=", 0).when(F.col("op") == "-=", 1).otherwise(2)
    steps = F.array_sort(F.collect_list(F.struct(seq.alias("seq"), rank.alias("rank"), "op", "value")))
    by = mutations.groupBy("path", "field").agg(steps.alias("_steps"))
    none = F.array().cast("array<string>")
    start = F.struct(F.coalesce("values", none).alias("v"), F.lit("").alias("op"))

    def step(state, m):
        new = F.when(m["value"] == "", none).otherwise(F.array(m["value"]))
        v = (
            F.when((m["op"] == "=") & (state["op"] == "="), F.concat(state["v"], new))
            .when(m["op"] == "=", new)
            .when(m["op"] == "-=", F.filter(state["v"], lambda x: x != m["value"]))
            .when(F.array_contains(state["v"], m["value"]), state["v"])
            .otherwise(F.concat(state["v"], new))
        )
        return F.struct(v.alias("v"), m["op"].alias("op"))

    joined = lists.join(by, ["path", "field"], "full").withColumn("_steps", F.coalesce("_steps", F.filter(F.array(F.struct(F.lit(0).alias("seq"), F.lit(0).alias("rank"), F.lit("").alias("op"), F.lit("").alias("value"))), lambda x: F.lit(False))))
    return joined.select("path", "field", F.aggregate("_steps", start, step, lambda s: s["v"]).alias("values"))


def consolidated(rows: DataFrame, version: str, model: str = "") -> DataFrame:
    """All that is written to a file at once: path, field, op, value, op_seq; files with nothing to write have no row.

    rows: path and any of tags (array), location (map), people (array; replaces, also when empty), ocr_text (array;
    replaces), ocr_regions (array of text and a box), fields (map of the tagger's own), ocr_ran (boolean), vec (array).
    Whatever is written, the version and the time are written too.
    """
    from albumspark.functions.vectors import encoded
    from albumspark.operators.ocr import OCR_ROLE, rounded
    from albumspark.operators.tags import changes_of, location_changes

    have, none = set(rows.columns), F.array().cast("array<string>")
    filled = {c: F.size(F.coalesce(F.col(c), none)) > 0 for c in ("tags", "ocr_text") if c in have}
    filled |= {c: F.coalesce(F.size(c) > 0, F.lit(False)) for c in ("location", "fields", "ocr_regions") if c in have}
    filled |= {c: F.col(c).isNotNull() for c in ("people", "vec") if c in have} | {c: F.coalesce(c, F.lit(False)) for c in ("ocr_ran",) if c in have}
    something = F.lit(False)
    for c in filled.values():
        something = something | c
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    change = lambda field, op, value: F.struct(field.alias("field"), F.lit(op).alias("op"), value.cast("string").alias("value"))
    parts: list[Column] = []

    def put(at: int, made: Column, where: Column | None = None) -> None:
        """Changes (field, op, value) at a place in the order, of rows where something is filled."""
        made = F.transform(made, lambda m: F.struct(m["field"].alias("field"), m["op"].alias("op"), m["value"].alias("value"), F.lit(at).alias("op_seq")))
        parts.append(made if where is None else F.when(where, made).otherwise(F.slice(made, 1, 0)))

    def one(at: int, field: str, value: Column, where: Column | None = None) -> None:
        put(at, F.array(change(F.lit(field), "=", value)), where)

    def each(at: int, column: str, field: str) -> None:
        put(at, F.transform(F.coalesce(F.col(column), none), lambda v: change(F.lit(field), "+=", v)))

    if "tags" in have:
        put(0, F.flatten(F.transform(F.coalesce(F.col("tags"), none), lambda t: changes_of(t))))
    if "location" in have:
        put(1, location_changes(F.coalesce(F.col("location"), F.create_map().cast("map<string,string>"))))
    if "people" in have:
        one(2, "XMP-iptcExt:PersonInImage", F.lit(""), filled["people"])
        each(3, "people", "XMP-iptcExt:PersonInImage")
    one(4, "XMP-album:TaggerVersion", F.lit(version))
    one(4, "XMP-album:TaggedAt", now)
    if "fields" in have:
        entries = F.map_entries(F.coalesce(F.col("fields"), F.create_map().cast("map<string,string>")))
        put(5, F.transform(entries, lambda e: change(F.concat(F.lit("XMP-album:"), e["key"]), "=", e["value"])))
    if "ocr_ran" in have:
        one(6, "XMP-album:OCRRan", now, filled["ocr_ran"])
    if "vec" in have:
        rows = rows.withColumn("vec", encoded(F.col("vec")))
        one(7, "XMP-album:ClipEmbedding", F.col("vec"), filled["vec"])
        if model:
            one(7, "XMP-album:ClipModel", F.lit(model), filled["vec"])
    if "ocr_text" in have:
        one(8, "XMP-album:OCRText", F.lit(""), filled["ocr_text"])
        each(9, "ocr_text", "XMP-album:OCRText")
    if "ocr_regions" in have:

        def region(r: Column) -> Column:
            box = rounded(r)
            whole = F.struct(
                r["text"].alias("Name"), F.array(F.struct(F.array(F.lit(OCR_ROLE)).alias("Identifier"), F.lit("annotated text").alias("Name"))).alias("RRole"),
                F.struct(F.lit("rectangle").alias("RbShape"), F.lit("relative").alias("RbUnit"), *[box[c].alias(f"Rb{c.upper()}") for c in "xywh"]).alias("RegionBoundary"),
            )
            return change(F.lit("XMP-iptcExt:ImageRegion"), "+=", F.to_json(whole))

        own = F.transform(F.col("ocr_regions"), region)
        put(10, F.coalesce(own, F.slice(F.array(change(F.lit(""), "", F.lit(""))), 1, 0)))
    return rows.filter(something).select("path", F.inline(F.concat(*parts)))


def save_landmarks(landmarks: DataFrame, path: str) -> None:
    """The whole table of landmarks (name, wikidata_id, lat, lon, embedding, model), written anew."""
    landmarks.write.mode("overwrite").parquet(path)


def write(mutations: DataFrame, path: str) -> None:
    mutations.write.mode("overwrite").parquet(path)


def append_manifest(moves: DataFrame, path: str) -> None:
    """Add moves (original, moved_to, ts) to the log, as one commit. A log of plain files becomes one of commits first."""
    spark = moves.sparkSession
    if not journal.is_log(spark, path) and journal.exists(spark, path):
        journal.append(files.manifest(spark, path).orderBy("line_no"), path)
    journal.append(moves, path)


def remove_entries(spark: SparkSession, path: str, originals: DataFrame) -> None:
    """Drop the entries of these originals from the log; a log without entries goes."""
    journal.without(spark, path, originals)
