"""python -m albumspark.cli COMMAND: the commands over metadata dumps and tables, with results as JSON lines.

tags list|search|delete|rename|clear|inspect META, dates backfill META, duplicates EMBEDDINGS, landmarks query PHOTOS
LANDMARKS, landmarks generate-db ITEMS, tag plan META, tag write META PREDICTIONS MAPPING, tag watch DIRECTORY, taxonomy
MAPPING, strip motion META, strip regions META. Changes are proposed as mutations under --out; nothing is written into
pictures. With --files, META is a folder of files, whose own metadata is read in place of a dump.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _meta(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A dump, or with --files what the files of a folder hold themselves, their sidecars' fields added to theirs."""
    from albumspark.operators.merge import with_sidecars
    from albumspark.sources import embedded, files, tree

    if not a.files:
        return files.metadata(spark, a.path)
    every = with_sidecars(files.scan(spark, a.path).select("path"), tree.listed(spark, a.path).select("path"))
    return embedded.merged_files(every)


def _index(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from albumspark.functions.text import union_in_order
    from albumspark.operators.tags import tag_index

    return tag_index(_meta(spark, a).select("path", union_in_order(F.col("TagsList"), F.col("Subject"), F.col("Keywords")).alias("tags")))


def tags_list(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from albumspark.operators.tags import tag_counts

    return tag_counts(_index(spark, a))


def tags_search(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from albumspark.operators.tags import search

    return search(_index(spark, a), a.tag)


def tags_delete(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from albumspark.operators.tags import matching
    from albumspark.sources.sinks import removals

    found = matching(_index(spark, a), a.tag) if a.pattern else _index(spark, a).filter(F.col("tag") == a.tag.lower())
    return removals(found)


def tags_rename(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from albumspark.operators.tags import fan_out
    from albumspark.sources.sinks import removals

    found = _index(spark, a).filter(F.col("tag") == a.tag.lower())
    return removals(found).unionByName(fan_out(found.select("path", F.lit(a.new.lower()).alias("tag"))))


def tags_clear(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """All tags of all files; people come back."""
    from albumspark.sources.files import people_tags
    from albumspark.sources.sinks import clear_all

    meta = _meta(spark, a)
    return clear_all(meta.select("path"), people_tags(meta))


def tags_inspect(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from albumspark.operators.tags import viewed
    from albumspark.sources.files import viewer_inputs

    return viewed(viewer_inputs(_meta(spark, a)))


def strip_motion(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """All tags of the film halves of live photos."""
    from albumspark.sources.files import motion_companions, people_tags
    from albumspark.sources.sinks import clear_all

    meta = motion_companions(_meta(spark, a))
    return clear_all(meta.select("path"), people_tags(meta))


def strip_regions(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """What is left of the regions once those of a type and description are gone."""
    from albumspark.operators.ocr import region_cleanup
    from albumspark.sources.files import fields

    rows = fields(_meta(spark, a)).select("path", F.col("ImageRegion").alias("regions")).filter("regions IS NOT NULL")
    return region_cleanup(rows, a.description, a.kind).select("path", "action", "keep")


def taxonomy(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The tree of a mapping's tags, or, with --flat, paths and flat tags by category."""
    from albumspark.operators import tags
    from albumspark.sources.files import tag_mapping

    rows = tag_mapping(spark, a.path).filter("tag IS NOT NULL")
    rows = rows if a.category is None else rows.filter(F.col("category") == a.category)
    if a.flat:
        return tags.taxonomy_stats(rows)
    return tags.taxonomy(rows.select(F.col("tag").alias("path")).distinct()).orderBy("node")


def dates_backfill(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from albumspark.functions.files import VIDEOS, extension
    from albumspark.operators.dates import backfill, date_mutations

    rows = _meta(spark, a).select("path", F.substring_index("path", "/", -1).alias("name"), F.lit(None).cast("timestamp").alias("mtime"), F.col("DateTimeOriginal").alias("original"), F.col("CreateDate").alias("created"))
    return date_mutations(backfill(rows, a.source.split(","), a.force).withColumn("is_video", extension(F.col("path")).isin(*VIDEOS)))


def duplicates(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A Parquet table of id, size, vec."""
    from albumspark.operators.cluster import refined

    return refined(spark.read.parquet(a.path), a.threshold, a.max_cluster_size)


def landmarks_query(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A Parquet table of id, lat, lon, vec, and a landmark file."""
    from albumspark.operators.radius import ranked_in_radius
    from albumspark.sources.files import landmarks

    places = landmarks(spark, a.landmarks).select("ord", "name", F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"), F.col("embedding").alias("place_vec"))
    return ranked_in_radius(spark.read.parquet(a.path), places, min(a.top_k, 5), a.radius_km)


def landmarks_generate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A Parquet table of items (wikidata_id, name, lat, lon, sitelinks, type): the pool of both passes, under the caps."""
    from albumspark.functions.geo import region
    from albumspark.operators.select import BOXES, BOX_TYPES, TYPES, by_region_cap, candidate_pool

    pool = candidate_pool(spark.read.parquet(a.path), list(TYPES.items()), list(BOXES.values()), list(BOX_TYPES.items()))
    ranked = pool.withColumn("region", region()).withColumn("ord", F.col("query_ord").cast("long") * 1_000_000 + F.col("ord"))
    return by_region_cap(ranked, a.limit, len(TYPES)).drop("ord", "query_ord")


def tag_write(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Tags from a Parquet table of predictions (path, raw_tag, score, raw_ord, class_threshold) under a mapping, as
    consolidated writes; files at this version are passed over unless forced."""
    from albumspark.operators.tags import mapped_tags, to_process
    from albumspark.sources.files import tag_mapping, versions
    from albumspark.sources.sinks import consolidated

    meta = _meta(spark, a)
    todo = to_process(meta.select("path"), versions(meta), a.version, a.force)
    found = mapped_tags(spark.read.parquet(a.predictions).join(todo, "path", "left_semi"), tag_mapping(spark, a.mapping))
    own = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("category_ord", "category_rank", "tag"))).alias("t"))
    return consolidated(own.select("path", F.transform("t", lambda t: t["tag"]).alias("tags")), a.version)


def tag_watch(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """New files of one directory, as long as it runs, or once; they land under --out."""
    from albumspark.streaming.watch import watch

    if a.fix:
        raise SystemExit("--watch is not compatible with --fix")
    if not a.out:
        raise SystemExit("a watch needs --out")
    query = watch(spark, a.path, f"{a.out}-checkpoint", lambda rows, _: rows.write.mode("append").json(a.out), once=a.once)
    query.awaitTermination()
    return spark.read.schema("path string, name string, size long, mtime timestamp").json(a.out)


def tag_plan(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from albumspark.operators.tags import fix_plan
    from albumspark.sources.files import fix_inputs

    rows = fix_inputs(_meta(spark, a)).withColumns({"has_coords": F.col("coords").isNotNull(), "has_fallback": F.lit(False)}).drop("coords")
    return fix_plan(rows)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="albumspark", description=__doc__.splitlines()[0])
    groups = p.add_subparsers(required=True)

    def add(group, name: str, f, *positional: str, **flags):
        c = group.add_parser(name)
        for x in ("path", *positional):
            c.add_argument(x)
        for flag, options in flags.items():
            c.add_argument(f"--{flag.replace('_', '-')}", **options)
        c.add_argument("--out", help="a folder for JSON lines; else rows are printed")
        c.add_argument("--files", action="store_true", help="META is a folder of files, whose own metadata is read")
        c.set_defaults(f=f)

    t = groups.add_parser("tags").add_subparsers(required=True)
    add(t, "list", tags_list)
    add(t, "search", tags_search, "tag")
    add(t, "delete", tags_delete, "tag", pattern={"action": "store_true"})
    add(t, "rename", tags_rename, "tag", "new")
    add(t, "clear", tags_clear)
    add(t, "inspect", tags_inspect)
    add(groups.add_parser("dates").add_subparsers(required=True), "backfill", dates_backfill, source={"default": "filename"}, force={"action": "store_true"})
    add(groups, "duplicates", duplicates, threshold={"type": float, "default": 0.90}, max_cluster_size={"type": int, "default": 16})
    marks = groups.add_parser("landmarks").add_subparsers(required=True)
    add(marks, "query", landmarks_query, "landmarks", top_k={"type": int, "default": 10}, radius_km={"type": float, "default": 5.0})
    add(marks, "generate-db", landmarks_generate, limit={"type": int, "default": 20000})
    tag = groups.add_parser("tag").add_subparsers(required=True)
    add(tag, "plan", tag_plan)
    add(tag, "write", tag_write, "predictions", "mapping", version={"default": "1"}, force={"action": "store_true"})
    add(tag, "watch", tag_watch, once={"action": "store_true"}, fix={"action": "store_true"})
    add(groups, "taxonomy", taxonomy, category={"choices": ["Objects", "Scenes"]}, flat={"action": "store_true"})
    strip = groups.add_parser("strip").add_subparsers(required=True)
    add(strip, "motion", strip_motion)
    add(strip, "regions", strip_regions, "description", kind={"default": "BarCode"})
    return p


def main(argv: list[str] | None = None) -> None:
    from albumspark.session import session

    a = parser().parse_args(argv)
    out = a.f(session(), a)
    if a.f is tag_watch:  # its batches are written as they come
        return
    if a.out:
        out.write.mode("overwrite").json(a.out)
    else:
        for row in out.toJSON().toLocalIterator():
            print(row)


if __name__ == "__main__":
    main()
