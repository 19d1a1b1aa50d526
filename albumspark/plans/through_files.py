"""Queries of sources and sinks: a projection of a driver's table is written in a source's form and read back through it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumspark.functions import files as kinds
from albumspark.functions import text, vectors
from albumspark.operators import classify, cluster, dates, moves, ocr, radius, select, tags
from albumspark.operators.components import checkpointed
from albumspark.plans import pictures, registry
from albumspark.plans.registry import query
from albumspark.session import checkpoint_dir, table
from albumspark.sources import embedded, files, plugins, sidecars, sinks, tree, xmp
from albumspark.streaming import watch


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _put_folder(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def _put_folders(folders: DataFrame) -> None:
    """Folders (folder), made by tasks."""
    import os

    import pyarrow as pa

    def run(batches):
        for b in batches:
            for f in b.column("folder").to_pylist():
                os.makedirs(f, exist_ok=True)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    folders.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _written(lines: DataFrame, name: str) -> str:
    """A folder with the texts of a column, one a line."""
    at = _folder(lines.sparkSession, name)
    lines.write.text(at)
    return at


def _objects(rows: DataFrame, name: str, head: str, tail: str, each: int = 64) -> str:
    """rows (k, value): a folder of files, each one JSON text of the values of `each` keys in a row, in their order; names
    ascend with the keys. Each is written by a task, value by value."""
    import os

    import pyarrow as pa

    at = _folder(rows.sparkSession, name)
    root = tree.Place(at).inside(at)

    def run(batches):
        os.makedirs(root, exist_ok=True)
        name, out, n = None, None, 0
        for row in (r for b in batches for r in b.to_pylist()):
            if row["file"] != name:
                if out:
                    out.write(tail)
                    out.close()
                name, n = row["file"], n + 1
                out = open(f"{root}/{name:012d}.json", "w")
                out.write(head)
            else:
                out.write(",\n ")
            out.write(row["value"])
        if out:
            out.write(tail)
            out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    dealt = rows.withColumn("file", F.floor(F.col("k") / each)).repartition("file").sortWithinPartitions("file", "k")
    dealt.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return at


# Files ----------------------------------------------------------------------------------------------------------------

_FOLDERS, _STARTS, _ENDS = ("a", "a/sub", "_duplicates", ".old/x"), ("f", "_DSC", ".f"), (".jpg", ".HEIC.MOV", ".txt", ".PNG", ".mp4")
_FILM = "\0\0\0\x18ftypisom"
_TREE = f"""
SELECT o_orderkey AS k, (['a', 'a/sub', '_duplicates', '.old/x'])[o_orderkey % 4 + 1] AS folder,
       (['f', '_DSC', '.f'])[o_orderkey % 3 + 1] || o_orderkey || (['.jpg', '.HEIC.MOV', '.txt', '.PNG', '.mp4'])[o_orderkey % 5 + 1] AS name,
       (CASE o_orderkey % 7 WHEN 0 THEN {len(_FILM)} ELSE 1 END + o_orderkey % 50)::BIGINT AS size, to_timestamp(o_orderkey * 60) AT TIME ZONE 'UTC' AS mtime, o_orderkey % 7 = 0 AS film
FROM orders
"""


#: Names of one stored content; files of a tree that are there at a time, where each has its own time.
NAMES, AT_A_TIME = 30_000, 400_000
#: Sidecars of a folder. One folder for all would have tasks wait for each other at each file that is made or renamed.
IN_A_FOLDER = 1000


def _tree_name(k: int) -> str:
    return f"{_FOLDERS[k % 4]}/{_STARTS[k % 3]}{k}{_ENDS[k % 5]}"


def _tree(spark: SparkSession, sf_dir: str, where: str = "true", at: str | None = None, times: bool = False) -> str:
    """A small file for each order, in four folders, written by tasks; times are long past, every seventh begins as a film.

    Files of one content are names of one stored file, since a block of the disk for each would be many times the table.
    With times, each file has its own time and is stored by itself.
    """
    import os

    import pyarrow as pa

    at = at or _folder(spark, "tree")
    root = tree.Place(at).inside(at)

    def stored(k: int, name: str) -> None:
        with open(name, "w") as out:
            out.write((_FILM if k % 7 == 0 else "x") + "x" * (k % 50))
        os.utime(name, (k * 60, k * 60))

    def run(batches):
        have: dict[tuple[bool, int], list] = {}  # content: a file that has it, and how many names that may still get
        for f in _FOLDERS:
            os.makedirs(f"{root}/{f}", exist_ok=True)
        for b in batches:
            keys = b.column("k").to_pylist()
            for k in keys:
                name, content = f"{root}/{_tree_name(k)}", (k % 7 == 0, k % 50)
                first = have.get(content)
                if times or not first or not first[1]:
                    stored(k, name)
                    have[content] = [name, NAMES]
                    continue
                try:
                    os.link(first[0], name)
                except FileExistsError:  # of a task that was lost
                    pass
                first[1] -= 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(keys)], pa.int64())})

    rows = table(spark, sf_dir, "orders").filter(where).select(F.col("o_orderkey").alias("k"))
    rows.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return at


def _felled(spark: SparkSession, sf_dir: str, where: str, at: str) -> None:
    """Remove a tree of these orders, by tasks."""
    import contextlib
    import os

    import pyarrow as pa

    root = tree.Place(at).inside(at)

    def run(batches):
        for b in batches:
            for k in b.column("k").to_pylist():
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(f"{root}/{_tree_name(k)}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    rows = table(spark, sf_dir, "orders").filter(where).select(F.col("o_orderkey").alias("k"))
    rows.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "n long").agg(F.sum("n")).collect()
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _below(root: str, path: str = "path") -> Column:
    """The path below the root, which is new in each run."""
    return F.substring_index(path, root.rsplit("/", 1)[-1] + "/", -1)


_MOVIE = "(film OR lower(name) LIKE '%.mov' OR name LIKE '%.mp4')"


@query(f"""
SELECT folder || '/' || name AS path, name, size, mtime, CASE WHEN folder = 'a/sub' THEN 0 ELSE 1 END::INT AS root_ord, {_MOVIE} AS film FROM ({_TREE}) WHERE name NOT LIKE '%.txt'
""")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two roots, of which one is inside the other; folders and files whose names begin with _ or a dot among them.

    Each file has its own time, so each takes a block of the disk: trees of a bounded number of files are written, scanned
    and removed one after another.
    """
    out, n = _folder(spark, "scanned"), table(spark, sf_dir, "orders").count()
    rounds = max(1, -(-n // AT_A_TIME))
    for k in range(rounds):
        own = f"pmod(o_orderkey div 420, {rounds}) = {k}"  # all folders, names and contents in each
        at = _tree(spark, sf_dir, own, times=True)
        rows = files.scan(spark, f"{at}/a/sub", at, with_header=True)
        rows = rows.select(_below(at).alias("path"), "name", "size", F.col("mtime").cast("timestamp_ntz").alias("mtime"), "root_ord", kinds.is_video(F.col("path"), F.col("header")).alias("film"))
        rows.write.mode("append").parquet(out)
        _felled(spark, sf_dir, own, at)
    return spark.read.parquet(out)


@query(f"SELECT folder || '/' || name AS path FROM ({_TREE}) WHERE film AND (name LIKE '%.jpg' OR name LIKE '%.PNG')")
def mislabeled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called pictures, but films by their first bytes."""
    at = _tree(spark, sf_dir)
    rows = files.scan(spark, at, with_header=True)
    return rows.filter(kinds.mislabeled(F.col("path"), F.col("header"))).select(_below(at).alias("path"))


@query("""
SELECT path FROM (SELECT '/a/' || (['_duplicates/x', 'my_duplicates', '_duplicates', 'x'])[o_orderkey % 4 + 1] || '/f' || o_orderkey || (['.jpg', '.MOV', '.PNG'])[o_orderkey % 3 + 1] AS path FROM orders)
WHERE lower(path) NOT LIKE '%.mov' AND path NOT LIKE '%/_duplicates/%' ESCAPE '!'
""".replace("/_dup", "/!_dup"))
def files_to_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    folder, end = pick(("_duplicates/x", "my_duplicates", "_duplicates", "x"), 4), pick((".jpg", ".MOV", ".PNG"), 3)
    return files.to_compare(table(spark, sf_dir, "orders").select(F.concat(F.lit("/a/"), folder, F.lit("/f"), k.cast("string"), end).alias("path")))


@query(f"SELECT folder || '/' || name AS path FROM ({_TREE}) WHERE name LIKE '%.HEIC.MOV'")
def motion_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _tree(spark, sf_dir)
    return files.motion_companions(files.scan(spark, at)).select(_below(at).alias("path"))


@query(f"""
SELECT folder || '/' || name AS path, size, CASE WHEN k % 4 IN (0, 3) THEN 0 ELSE 1 END::INT AS run FROM ({_TREE}) WHERE name LIKE '%.jpg' AND k % 2 = 0 OR name LIKE '%.PNG' OR name LIKE '%.mp4'
""")
def watch_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs of a watch give their batch function: files that are there, then those that came since, whose times are
    long past; files at the current version are left out."""
    at, out, checkpoint = _folder(spark, "tree"), _folder(spark, "seen"), _folder(spark, "watch")

    def versions(s: SparkSession) -> DataFrame:
        found = files.scan(s, at).select("path")
        odd = F.regexp_extract("path", "(\\d+)\\.jpg$", 1).try_cast("int") % 2 == 1
        return found.select("path", F.when(odd, "1").otherwise("0").alias("version"))

    for run, where in enumerate(("o_orderkey % 4 IN (0, 3)", "o_orderkey % 4 IN (1, 2)")):
        _tree(spark, sf_dir, where, at)
        seen = lambda rows, _, run=run: rows.withColumn("run", F.lit(run)).write.mode("append").parquet(out)
        watch.watch(spark, at, checkpoint, seen, versions, "1", once=True).awaitTermination()
    return spark.read.parquet(out).select(_below(at).alias("path"), "size", "run")


# Metadata -------------------------------------------------------------------------------------------------------------


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump with an object a line for each customer; list fields are arrays, bare texts or missing."""
    k = F.col("c_custkey")
    n = k.cast("string")
    plain = [
        F.concat(F.lit("/p/c"), n, F.lit(".jpg")).alias("SourceFile"), F.concat(F.lit("Kw"), (k % 4).cast("string")).alias("Keywords"),
        F.when(k % 4 > 0, F.element_at(F.array(*map(F.lit, ("", "1", "2"))), (k % 4).cast("int"))).alias("TaggerVersion"),
        F.when(k % 2 == 0, F.lit("2020:01:02 03:04:05")).alias("DateTimeOriginal"), F.when(k % 3 == 0, F.lit("2021:01:01 00:00:00")).alias("CreateDate"),
        F.when(k % 5 < 3, k % 90).alias("GPSLatitude"), F.when(k % 5 < 3, (k % 180).cast("string")).alias("GPSLongitude"), F.when(k % 5 == 1, "S").alias("GPSLatitudeRef"),
        F.lit("ACME").alias("Make"), F.concat(F.lit("M"), (k % 7).cast("string")).alias("Model"), (k % 4000).alias("ImageWidth"), F.when(k % 2 == 0, "x").alias("ImageHeight"),
        (k % 3 == 0).alias("OCRRan"),
        F.when(k % 6 == 0, F.array(F.struct(F.lit("r").alias("Name"), F.array(F.struct(F.array(F.lit("u/annotatedText")).alias("Identifier"))).alias("RRole")), F.struct(F.lit("s").alias("Name"), F.lit(None).cast("array<struct<Identifier:array<string>>>").alias("RRole")))).alias("ImageRegion"),
    ]
    listed = F.to_json(F.struct(*plain, F.array(F.concat(F.lit("Places/X"), (k % 7).cast("string")), F.concat(F.lit("People/P"), (k % 5).cast("string"))).alias("TagsList")))
    bare = F.to_json(F.struct(*plain, F.lit("Objects/Cat").alias("TagsList")))
    lines = table(spark, sf_dir, "customer").select(F.when(k % 3 == 0, listed).when(k % 3 == 1, bare).otherwise(F.to_json(F.struct(*plain))).alias("value"))
    return files.metadata(spark, _written(lines, "meta"), lines=True)


_P = "'/p/c' || c_custkey || '.jpg' AS path"


@query(f"SELECT {_P}, (c_custkey % 4 - 1)::VARCHAR AS version FROM customer WHERE c_custkey % 4 > 1")
def meta_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.versions(_meta(spark, sf_dir))


@query(f"SELECT {_P}, 'People/P' || (c_custkey % 5) AS tags FROM customer WHERE c_custkey % 3 = 0")
def meta_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.people_tags(_meta(spark, sf_dir)).select("path", F.array_join("tags", "|").alias("tags"))


@query(f"""
SELECT {_P}, CASE c_custkey % 3 WHEN 0 THEN array_to_string(list_sort(['x' || (c_custkey % 7), 'p' || (c_custkey % 5), 'kw' || (c_custkey % 4)]), '|')
  WHEN 1 THEN 'cat|kw' || (c_custkey % 4) ELSE 'kw' || (c_custkey % 4) END AS leaves FROM customer
""")
def meta_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.keyword_leaves(_meta(spark, sf_dir)).select("path", F.array_join("leaves", "|").alias("leaves"))


@query(f"SELECT {_P}, CASE WHEN c_custkey % 2 = 0 THEN '2020:01:02 03:04:05' END AS original, CASE WHEN c_custkey % 3 = 0 THEN '2021:01:01 00:00:00' END AS created FROM customer")
def meta_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.dates(_meta(spark, sf_dir))


@query(f"""
SELECT {_P}, CASE WHEN c_custkey % 5 < 3 AND c_custkey % 180 <= 180 THEN CASE WHEN c_custkey % 5 = 1 AND c_custkey % 90 > 0 THEN -(c_custkey % 90) ELSE c_custkey % 90 END END::DOUBLE AS lat,
  CASE WHEN c_custkey % 5 < 3 THEN c_custkey % 180 END::DOUBLE AS lon, 'ACME' AS make, 'M' || (c_custkey % 7) AS model, (c_custkey % 4000)::INT AS width, NULL::INT AS height,
  CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END::INT AS n_tags, CASE WHEN c_custkey % 6 = 0 THEN 's' ELSE '' END AS other_regions FROM customer
""")
def meta_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read of a single file's fields, over all files; of its regions, those that OCR did not write."""
    rows = files.fields(_meta(spark, sf_dir))
    names = F.array_join(F.transform(ocr.not_ocr(F.col("ImageRegion")), lambda r: r["Name"]), "|")
    return rows.select("path", "coords.lat", "coords.lon", F.col("Make").alias("make"), F.col("Model").alias("model"), F.col("ImageWidth").alias("width"), F.col("ImageHeight").alias("height"), F.when(F.col("TagsList").isNotNull(), F.size("TagsList")).alias("n_tags"), names.alias("other_regions"))


@query(f"""
SELECT {_P}, CASE c_custkey % 3 WHEN 0 THEN 'Places/X' || (c_custkey % 7) || '|People/P' || (c_custkey % 5) || '|' WHEN 1 THEN 'Objects/Cat|' ELSE '' END || 'Kw' || (c_custkey % 4) AS keywords,
  c_custkey % 3 = 0 AS ocr_ran, c_custkey % 5 < 3 AS has_coords FROM customer
""")
def meta_fix_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.fix_inputs(_meta(spark, sf_dir))
    return rows.select("path", F.array_join("keywords", "|").alias("keywords"), "ocr_ran", F.col("coords").isNotNull().alias("has_coords"))


@query(f"""
SELECT {_P}, CASE WHEN c_custkey % 5 < 3 THEN printf('%.6f, %.6f', CASE WHEN c_custkey % 5 = 1 AND c_custkey % 90 > 0 THEN -(c_custkey % 90) ELSE c_custkey % 90 END::DOUBLE, (c_custkey % 180)::DOUBLE) ELSE '—' END AS gps,
  CASE WHEN c_custkey % 2 = 0 THEN '2020-01-02 03:04' WHEN c_custkey % 3 = 0 THEN '2021-01-01 00:00' ELSE '—' END AS taken_at, '' AS landmarks,
  CASE c_custkey % 3 WHEN 0 THEN 'Kw' || (c_custkey % 4) || '|People/P' || (c_custkey % 5) || '|Places/X' || (c_custkey % 7) WHEN 1 THEN 'Kw' || (c_custkey % 4) || '|Objects/Cat' ELSE 'Kw' || (c_custkey % 4) END AS tags FROM customer
""")
def viewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the viewer shows of each file."""
    shown = tags.viewed(files.viewer_inputs(_meta(spark, sf_dir)))
    return shown.select("path", "gps", "taken_at", F.array_join("landmarks", "|").alias("landmarks"), F.array_join("tags", "|").alias("tags"))


@query("SELECT '/v' || vec_id AS path, (unnest(range(len(embedding))))::INT AS pos, unnest(embedding) AS x FROM embeddings WHERE vec_id % 3 <> 0")
def meta_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors kept in the metadata, of this model, whose text decodes."""
    k = F.col("vec_id")
    code = F.when(k % 3 == 0, "no vector").otherwise(vectors.encoded("embedding"))
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("/v"), k.cast("string")).alias("SourceFile"), F.lit("m").alias("ClipModel"), code.alias("ClipEmbedding"))
    other = e.withColumns({"SourceFile": F.concat("SourceFile", F.lit("x")), "ClipModel": F.lit("other")})
    meta = files.metadata(spark, _written(e.union(other).select(F.to_json(F.struct("*")).alias("value")), "vectors"), lines=True)
    return files.cached_embeddings(meta, "m").select("path", F.posexplode("vec").alias("pos", "x"))


# Metadata in files ----------------------------------------------------------------------------------------------------


def _pictures(spark: SparkSession, sf_dir: str) -> str:
    """A picture with metadata for each customer, of four kinds, written by tasks; some are cut off in the middle."""
    import os

    import pyarrow as pa

    at = _folder(spark, "pictures")
    root = tree.Place(at).inside(at)

    def picture(k: int) -> tuple[str, bytes]:
        order = "<>"[k % 2]
        exif = {0x9003: "2020:01:02 03:04:05"} if k % 4 else {0x9004: f"2021:01:01 00:00:{k % 60:02d}"}
        gps = {1: "NS"[k % 2], 2: pictures.rationals(k % 90 + 0.25), 3: "E", 4: pictures.rationals(k % 180 + 0.5)} if k % 5 else {}
        main = {0x010F: "ACME", 0x0110: f"M{k % 7}", 0x0100: k % 4000 + 1, 0x0101: 30}
        found = {"XMP-dc:Subject": [f"s{k % 3}", "é<&>"], "XMP-digiKam:TagsList": [f"Places/X{k % 7}"][: k % 3], "XMP-album:TaggerVersion": [str(k % 4)], "XMP-iptcExt:ImageRegion": [json.dumps({"Name": "r", "RRole": [{"Identifier": ["annotatedText"]}]}), '{"Name":"s"}'][: k % 3]}
        packet = xmp.changed(None, found)
        kind = k % 4
        if kind == 0:
            return "jpg", pictures.jpeg(k % 900 + 1, 7, pictures.tiff(main, exif, gps, order), packet, [f"kw{k % 5}", "b"])
        if kind == 1:
            return "png", pictures.png(k % 900 + 1, 7, pictures.tiff(main, exif, gps, order), packet)
        if kind == 2:
            return "webp", pictures.webp(k % 900 + 1, 7, pictures.tiff(main, exif, gps, order), packet)
        return "tif", pictures.tiff(main | {0x02BC: packet, 0x83BB: pictures.iptc([f"kw{k % 5}", "b"])}, exif, gps, order)

    def run(batches):
        os.makedirs(root, exist_ok=True)
        for b in batches:
            for k in b.column("c_custkey").to_pylist():
                end, data = picture(k)
                with open(f"{root}/c{k}.{end}", "wb") as out:
                    out.write(data if k % 13 else data[:14])
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    table(spark, sf_dir, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return at


@query("""
WITH c AS (SELECT c_custkey AS k, c_custkey % 13 = 0 AS broken, c_custkey % 4 AS kind FROM customer)
SELECT k, broken, CASE WHEN NOT broken AND k % 5 > 0 THEN CASE WHEN k % 2 = 1 THEN -(k % 90 + 0.25) ELSE k % 90 + 0.25 END END::DOUBLE AS lat, CASE WHEN NOT broken AND k % 5 > 0 THEN k % 180 + 0.5 END::DOUBLE AS lon,
  CASE WHEN NOT broken THEN 'ACME' END AS make, CASE WHEN NOT broken THEN 'M' || (k % 7) END AS model, CASE WHEN NOT broken AND k % 4 > 0 THEN '2020:01:02 03:04:05' END AS original,
  CASE WHEN NOT broken AND k % 4 = 0 THEN '2021:01:01 00:00:' || lpad((k % 60)::VARCHAR, 2, '0') END AS created, CASE WHEN NOT broken THEN k % 4000 + 1 END::INT AS width, CASE WHEN NOT broken THEN 30 END::INT AS height,
  CASE WHEN NOT broken AND kind <> 3 THEN k % 900 + 1 END::INT AS file_width, CASE WHEN NOT broken AND kind <> 3 THEN 7 END::INT AS file_height,
  CASE WHEN NOT broken AND kind IN (0, 3) THEN 'kw' || (k % 5) || '|b' END AS keywords, CASE WHEN NOT broken THEN 's' || (k % 3) || '|é<&>' END AS subject,
  CASE WHEN NOT broken AND k % 3 > 0 THEN 'Places/X' || (k % 7) END AS tags, CASE WHEN NOT broken THEN (k % 4)::VARCHAR END AS version,
  CASE WHEN NOT broken AND k % 3 = 2 THEN 's' ELSE '' END AS other_regions FROM c
""")
def embedded_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of a file's read, from the files themselves; damaged files have a row."""
    at = _pictures(spark, sf_dir)
    found = embedded.embedded(files.scan(spark, at))
    rows = files.fields(found).join(found.select("path", F.col("error").isNotNull().alias("broken")), "path")
    names = F.array_join(F.transform(ocr.not_ocr(F.col("ImageRegion")), lambda r: r["Name"]), "|")
    listed = lambda c, name: F.when(F.col(c).isNotNull(), F.array_join(c, "|")).alias(name)
    return rows.select(
        F.regexp_extract("path", "c(\\d+)\\.\\w+$", 1).cast("long").alias("k"), "broken", "coords.lat", "coords.lon", F.col("Make").alias("make"), F.col("Model").alias("model"),
        F.col("DateTimeOriginal").alias("original"), F.col("CreateDate").alias("created"), F.col("ImageWidth").alias("width"), F.col("ImageHeight").alias("height"),
        F.col("FileImageWidth").alias("file_width"), F.col("FileImageHeight").alias("file_height"), listed("Keywords", "keywords"), listed("Subject", "subject"), listed("TagsList", "tags"),
        F.col("TaggerVersion").alias("version"), names.alias("other_regions"),
    )


@query("""
WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k, 'XMP-dc:Subject' AS field, CASE WHEN k % 3 = 0 THEN 'Rome' WHEN k % 3 = 1 THEN 'Cat|Rome' ELSE 'Cat' END AS values FROM c
UNION ALL SELECT k, 'XMP-digiKam:TagsList', CASE WHEN k % 2 = 0 THEN 'Places/Rome|Objects/Cat' ELSE 'Objects/Cat' END FROM c
UNION ALL SELECT k, 'XMP-album:TaggerVersion', '9' FROM c WHERE k % 2 = 0
UNION ALL SELECT k, 'XMP-photoshop:City', 'Nice' FROM c WHERE k % 5 = 0
""")
def sidecars_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars made by one job, changed by a second, read back; a third is given up and changes nothing."""
    at, k = _folder(spark, "sidecars"), F.col("c_custkey")
    root = tree.Place(at).inside(at)
    folder = F.concat(F.lit(f"{root}/"), F.floor(k / IN_A_FOLDER).cast("string"))
    c = table(spark, sf_dir, "customer").select(k, F.concat(folder, F.lit("/c"), k.cast("string"), F.lit(".jpg.xmp")).alias("target"))
    _put_folders(table(spark, sf_dir, "customer").select(folder.alias("folder")).distinct())
    change = lambda rows, field, op, value, seq: rows.select("target", F.lit(field).alias("field"), F.lit(op).alias("op"), F.lit(value).alias("value"), F.lit(seq).alias("op_seq"))
    first = change(c, "XMP-dc:Subject", "+=", "Cat", 0).union(change(c.filter(k % 2 == 0), "XMP-digiKam:TagsList", "+=", "Places/Rome", 0)).union(change(c.filter(k % 5 == 0), "XMP-photoshop:City", "=", "Nice", 0))
    first = first.union(change(c, "IPTC:City", "=", "left out", 0))
    sidecars.write(first, _folder(spark, "job"))
    second = change(c.filter(k % 3 < 2), "XMP-dc:Subject", "+=", "Rome", 1).union(change(c.filter(k % 3 == 0), "XMP-dc:Subject", "-=", "Cat", 2)).union(change(c, "XMP-digiKam:TagsList", "+=", "Objects/Cat", 0))
    second = second.union(change(c.filter(k % 2 == 0), "XMP-album:TaggerVersion", "=", "9", 0)).union(change(c.filter(k % 2 == 1), "XMP-album:TaggerVersion", "=", "", 0))
    sidecars.write(second, _folder(spark, "job"))
    third = _folder(spark, "job")
    sidecars.stage(change(c, "XMP-dc:Subject", "=", "gone", 0), third)
    sidecars.give_up(spark, third)
    found = sidecars.read(c.select(F.col("target").alias("path")))
    return found.select(F.regexp_extract("path", "c(\\d+)\\.jpg", 1).cast("long").alias("k"), "field", F.array_join("values", "|").alias("values"))


# Manifests and moves --------------------------------------------------------------------------------------------------


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of all orders with blank and broken lines in it, appended to once."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    row = F.to_json(F.struct(F.concat(F.lit("/a/"), n).alias("original"), F.concat(F.lit("/d/"), n).alias("moved_to"), F.lit("2024-01-01T00:00:00Z").alias("ts")))
    at = _written(table(spark, sf_dir, "orders").select(F.when(k % 10 == 0, "").when(k % 10 == 1, "{broken").otherwise(row).alias("value")), "manifest")
    sinks.append_manifest(spark.createDataFrame([("/a/x", "/d/x")], "original string, moved_to string").withColumn("ts", F.current_timestamp()), at)
    return files.manifest(spark, at)


@query("SELECT '/a/' || o_orderkey AS original, '/d/' || o_orderkey AS moved_to FROM orders WHERE o_orderkey % 10 > 1 UNION ALL SELECT '/a/x', '/d/x'")
def manifest_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir).select("original", "moved_to")


@query("SELECT '/a/' || o_orderkey AS original FROM orders WHERE o_orderkey % 10 > 1 AND o_orderkey % 4 <> 0")
def manifest_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of restored files go, and what is left is published in place of the log and read."""
    gone = table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").select(F.concat(F.lit("/a/"), F.col("o_orderkey").cast("string")).alias("original"))
    at = _folder(spark, "manifest")
    sinks.append_manifest(_manifest(spark, sf_dir), at)
    sinks.remove_entries(spark, at, gone.union(spark.createDataFrame([("/a/x",)], "original string")))
    return files.manifest(spark, at).select("original")


@query("""
SELECT o_orderkey AS original, CASE WHEN o_orderkey % 7 = 0 THEN 'last' WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END || o_orderkey AS moved_to
FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 2 = 0
""")
def manifest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where files went last: of a small, a larger and again a smaller append, the last that moved a file, and there its last
    line."""
    at, k = _folder(spark, "manifest"), F.col("o_orderkey")
    for n, target in ((3, "old"), (2, "new"), (7, "first then last")):
        own = table(spark, sf_dir, "orders").filter(k % n == 0).select(k.cast("string").alias("original"), F.posexplode(F.split(F.lit(target), " then ")).alias("pos", "to"), k)
        own = own.select("original", F.concat("to", "original").alias("moved_to"), F.current_timestamp().alias("ts"), "pos", "o_orderkey")
        sinks.append_manifest(own.orderBy("pos", "o_orderkey"), at)
    return moves.latest_moves(files.manifest(spark, at)).select(F.col("original").cast("long").alias("original"), "moved_to")


@query("""
SELECT o_orderkey AS original, CASE WHEN o_orderkey % 3 = 0 THEN 'original exists' WHEN o_orderkey % 5 = 0 THEN 'moved file is gone' END AS refused FROM orders
""")
def undo_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    have = o.filter("o_orderkey % 3 = 0").select(k.alias("path")).union(o.filter("o_orderkey % 5 <> 0").select(-k - 1))
    return moves.undone(o.select(k.alias("original"), (-k - 1).alias("moved_to")), have).select("original", "refused")


@query("""
WITH f AS (SELECT o_orderkey AS path, o_custkey AS cluster, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, (['present', 'moved', 'missing', 'present'])[o_orderkey % 4 + 1] AS status FROM orders),
p AS (SELECT cluster, min(pos) FILTER (WHERE status = 'present') AS first, bool_or(pos = 2 AND status = 'present') AS second FROM f GROUP BY cluster)
SELECT path, 'first' AS policy FROM f JOIN p USING (cluster) WHERE status = 'present' AND pos <> first
UNION ALL SELECT path, 'only' FROM f JOIN p USING (cluster) WHERE status = 'present' AND CASE WHEN second THEN pos <> 2 ELSE path % 2 = 0 END
UNION ALL SELECT path, 'none' FROM f WHERE status = 'present'
""")
def moves_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy of keeping moves; with all, nothing goes."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("present", "moved", "missing", "present"))), (k % 4 + 1).cast("int"))
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(k.alias("path"), F.col("o_custkey").alias("cluster"), pos.alias("pos"), status.alias("status"), F.lit(2).alias("cursor"), (k % 2 == 1).alias("keep"))
    out = None
    for policy in ("first", "only", "none", "all"):
        part = moves.to_move(rows.withColumn("keep", moves.kept(rows, policy))).select("path", F.lit(policy).alias("policy"))
        out = part if out is None else out.union(part)
    return out


# Landmarks ------------------------------------------------------------------------------------------------------------


@query("SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::INT AS ord, s_name AS name, 'Q' || s_suppkey AS wikidata_id, (s_suppkey % 90)::DOUBLE AS lat, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 2 END::INT AS n, 'm/p' AS model FROM supplier")
def landmark_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of landmarks, each one JSON object, read in small ranges, saved as a table and read again."""
    k = F.col("s_suppkey")
    one = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("Q"), k.cast("string")).alias("wikidata_id"), (k % 90).cast("double").alias("lat"), F.lit(1.0).alias("lon"), F.when(k % 4 != 0, F.array(F.lit(1.0), F.lit(2.0))).alias("embedding"))
    at = _objects(table(spark, sf_dir, "supplier").select(k.alias("k"), F.to_json(one).alias("value")), "landmarks", '{"model": "m/p", "landmarks": [', "]}")
    to = _folder(spark, "landmarks")
    sinks.save_landmarks(files.landmarks(spark, at, 1000), to)
    rows = spark.read.parquet(to)
    return rows.select("ord", "name", "wikidata_id", "lat", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n"), "model")


@query("""
SELECT p_type || ': ' || p_brand AS raw_tag, any_value(CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'Objects' END) AS category, any_value(CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'Objects/' || p_brand END) AS tag
FROM (SELECT p_type, p_brand, min(p_size) AS p_size FROM part GROUP BY ALL) GROUP BY 1
""")
def tag_mapping_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping with quoted keys, comments, null and ~."""
    part = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.min("p_size").alias("s"))
    value = F.when(F.col("s") % 6 == 0, "~").when(F.col("s") % 3 == 0, "null").when(F.col("s") % 2 == 0, F.concat(F.lit("'Objects/"), "p_brand", F.lit("'"))).otherwise(F.concat(F.lit('"Objects/'), "p_brand", F.lit('"  # note')))
    lines = part.select(F.concat(F.lit('"'), "p_type", F.lit(": "), "p_brand", F.lit('": '), value).alias("value"))
    return files.tag_mapping(spark, _written(lines.union(spark.createDataFrame([("# a comment",), ("",)], "value string")), "mapping"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of items, with numbers as text and some that do not parse, read back; types and places from the parts."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    row = F.struct(
        F.concat(F.lit("http://e/Q"), n).alias("item"), F.col("p_name").alias("label"), F.when(k % 50 == 0, "north").otherwise((k * 7 % 180 - 90).cast("string")).alias("lat"),
        (k * 11 % 360 - 180).cast("string").alias("lon"), F.lit("i").alias("image"), F.when(k % 70 == 0, "many").otherwise((k % 97).cast("string")).alias("sitelinks"),
    )
    found = files.candidates(spark, _written(table(spark, sf_dir, "part").select(F.to_json(row).alias("value")), "items"))
    types = table(spark, sf_dir, "part").select(F.concat(F.lit("Q"), n).alias("wikidata_id"), F.col("p_type").alias("type"))
    return found.join(types, "wikidata_id")


_ITEMS = """
SELECT 'Q' || p_partkey AS wikidata_id, p_name AS name, (p_partkey * 7 % 180 - 90)::DOUBLE AS lat, (p_partkey * 11 % 360 - 180)::DOUBLE AS lon, (p_partkey % 97)::INT AS sitelinks, p_type AS type
FROM part WHERE p_partkey % 50 <> 0 AND p_partkey % 70 <> 0
"""


@query(f"SELECT * FROM ({_ITEMS})")
def candidate_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("wikidata_id", "name", "lat", "lon", "sitelinks", "type")


_TYPES = "(SELECT DISTINCT p_type AS type FROM part ORDER BY 1 LIMIT 3)"


@query(f"""
WITH i AS ({_ITEMS}), t AS (SELECT type, row_number() OVER (ORDER BY type) - 1 AS k FROM {_TYPES}),
q AS (SELECT k AS query_ord, type, 40 AS most, -90 AS a, 90 AS b, -180 AS c, 180 AS d FROM t
  UNION ALL SELECT 3 + 2 * r + k, type, 30, a, b, c, d FROM t, (VALUES (0, 5, 72, 35, 150), (1, -55, 15, -85, -35)) v(r, a, b, c, d) WHERE k < 2),
h AS (SELECT i.*, query_ord, most, row_number() OVER (PARTITION BY query_ord ORDER BY sitelinks DESC, wikidata_id) AS ord FROM i JOIN q ON i.type = q.type AND lat BETWEEN a AND b AND lon BETWEEN c AND d)
SELECT wikidata_id, query_ord::INT AS query_ord, ord::INT AS ord FROM (SELECT *, row_number() OVER (PARTITION BY wikidata_id ORDER BY query_ord, ord) AS n FROM h WHERE ord <= most) WHERE n = 1
""")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three types everywhere, then two of them in each of two boxes."""
    types = [r[0] for r in table(spark, sf_dir, "part").select("p_type").distinct().orderBy("p_type").limit(3).collect()]
    pool = select.candidate_pool(_items(spark, sf_dir), [(t, 40) for t in types], [(5, 72, 35, 150), (-55, 15, -85, -35)], [(t, 30) for t in types[:2]])
    return pool.select("wikidata_id", "query_ord", "ord")


@query(f"SELECT wikidata_id, sitelinks FROM ({_ITEMS}) WHERE type = (SELECT min(p_type) FROM part) AND lat BETWEEN -35 AND 35 AND lon BETWEEN -20 AND 95 ORDER BY sitelinks DESC, wikidata_id LIMIT 25")
def typed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "part").agg(F.min("p_type")).first()[0]
    return select.typed_query(_items(spark, sf_dir), first, 25, (-35, 35, -20, 95)).select("wikidata_id", "sitelinks")


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image URLs of suppliers in all three shapes of the cache."""
    k, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    url = F.concat(F.lit("http://h/a%20"), n, F.lit(".tif"))
    entry = F.array(F.struct(url.alias("url"), F.lit("s").alias("source")), F.struct(F.concat(F.lit("http://h/b"), n, F.lit(".PNG")).alias("url"), F.lit("t").alias("source")))
    shape = F.when(k % 3 == 0, F.to_json(F.struct(F.lit("n").alias("name"), entry.alias("images")))).when(k % 3 == 1, F.to_json(entry)).otherwise(F.to_json(F.array(url)))
    pairs = F.concat(F.lit('"Q'), n, F.lit('": '), shape)
    at = _objects(table(spark, sf_dir, "supplier").filter("s_suppkey % 5 <> 0").select(k.alias("k"), pairs.alias("value")), "urls", "{", "}")
    return files.url_cache(spark, at, 700)


@query("""
SELECT 'Q' || s_suppkey AS wikidata_id, idx::INT AS idx, CASE idx WHEN 0 THEN 'http://h/a%20' || s_suppkey || '.tif' ELSE 'http://h/b' || s_suppkey || '.PNG' END AS url,
  CASE WHEN s_suppkey % 3 = 2 THEN 'unknown' WHEN idx = 0 THEN 's' ELSE 't' END AS source FROM supplier, range(2) t(idx) WHERE s_suppkey % 5 <> 0 AND (idx = 0 OR s_suppkey % 3 <> 2)
""")
def url_cache_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("wikidata_id", F.posexplode("urls").alias("idx", "u")).select("wikidata_id", "idx", "u.*")


@query("SELECT 'Q' || s_suppkey AS wikidata_id, s_suppkey % 5 = 0 AS to_fetch FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey % 4 = 2")
def landmarks_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resume: landmarks that are not there with an embedding, and of these the ones without kept URLs."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Q"), k.cast("string")).alias("wikidata_id"), k)
    existing = s.filter("s_suppkey % 2 = 0").withColumn("embedding", F.when(k % 4 == 0, F.array(F.lit(1.0))).when(k % 8 == 2, F.array().cast("array<double>")))
    todo = select.to_embed(s, existing)
    fetch = select.to_fetch(todo, _urls(spark, sf_dir)).select("wikidata_id", F.lit(True).alias("f"))
    return todo.join(fetch, "wikidata_id", "left").select("wikidata_id", F.coalesce("f", F.lit(False)).alias("to_fetch"))


@query("""
SELECT 'Q' || s_suppkey AS wikidata_id, idx::INT AS idx FROM supplier, range(2) t(idx)
WHERE s_suppkey % 5 <> 0 AND (idx = 0 OR s_suppkey % 3 <> 2) AND NOT (idx = 0 AND s_suppkey % 7 = 1 OR idx = 1 AND s_suppkey % 4 = 0 AND s_suppkey % 8 = 0)
""")
def images_to_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of which no file that is large enough is kept under its name."""
    images = _urls(spark, sf_dir).select("wikidata_id", F.posexplode("urls").alias("idx", "u")).select("wikidata_id", "idx", "u.url")
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    kept = s.filter("s_suppkey % 7 = 1").select(F.concat(F.lit("Q"), n, F.lit("_0.jpg")).alias("name"), F.lit(5000).alias("size"))
    kept = kept.union(s.filter("s_suppkey % 4 = 0").select(F.concat(F.lit("Q"), n, F.lit("_1.png")), F.when(F.col("s_suppkey") % 8 == 0, 5000).otherwise(10)))
    return select.to_download(images, kept, 1000).select("wikidata_id", "idx")


@query("""
SELECT 'Q' || o_custkey AS wikidata_id, prop, claim_ord::INT AS claim_ord, 'F ' || o_custkey || '_' || prop || '_' || claim_ord || '.jpg' AS filename
FROM (SELECT DISTINCT o_custkey FROM orders), (VALUES ('P18', 0), ('P18', 2), ('P8517', 0)) v(prop, claim_ord)
""")
def image_claims_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity replies with claims that have no value among them."""
    n = F.col("o_custkey").cast("string")
    claim = lambda p, k: F.concat(F.lit('{"mainsnak": {"datavalue": {"value": "F '), n, F.lit(f'_{p}_{k}.jpg"}}}}}}'))
    reply = F.concat(F.lit('{"entities": {"Q'), n, F.lit('": {"claims": {"P18": ['), claim("P18", 0), F.lit(', {"mainsnak": {}}, '), claim("P18", 2), F.lit('], "P8517": ['), claim("P8517", 0), F.lit("]}}}}"))
    lines = table(spark, sf_dir, "orders").select("o_custkey").distinct().select(reply.alias("value"))
    return files.image_claims(spark, _written(lines.union(spark.createDataFrame([("no reply",)], "value string")), "claims"))


@query("SELECT p_partkey, 'https://commons.wikimedia.org/wiki/Special:FilePath/' || replace(replace(p_name, ' ', '_'), '#', '%23') || '~/%2A%C3%A9.jpg' AS url, 'Q' || p_partkey || '_' || (p_partkey % 4) || (['.jpg', '.png', '.jpg', '.jpg'])[p_partkey % 4 + 1] AS kept FROM part")
def commons_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where Commons serves a name, and under which name a download is kept."""
    k = F.col("p_partkey")
    ends = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", "", ".tiff"))), (k % 4 + 1).cast("int"))
    kept = text.cache_name(F.concat(F.lit("Q"), k.cast("string")), k % 4, F.concat(F.lit("http://h/x%20y"), ends))
    return table(spark, sf_dir, "part").select("p_partkey", text.commons_url(F.concat("p_name", F.lit("~/*é.jpg"))).alias("url"), kept.alias("kept"))


# Writes ---------------------------------------------------------------------------------------------------------------


@query("""
WITH f AS (SELECT c_custkey AS path, c_custkey % 4 > 0 AS busy FROM customer),
w AS (
  SELECT path, unnest(['IPTC:Keywords', 'XMP-dc:Subject', 'XMP-digiKam:TagsList', 'XMP-lr:HierarchicalSubject']) AS field, '+=' AS op, unnest(['K' || path, 'K' || path, 'Objects/K' || path, 'Objects|K' || path]) AS value, 0 AS op_seq FROM f WHERE path % 4 = 1
  UNION ALL SELECT path, unnest(['XMP-photoshop:City', 'IPTC:City']), '=', 'Rome', 1 FROM f WHERE path % 4 = 2
  UNION ALL SELECT path, 'XMP-iptcExt:PersonInImage', '=', '', 2 FROM f WHERE path % 4 = 3
  UNION ALL SELECT path, 'XMP-iptcExt:PersonInImage', '+=', 'Al', 3 FROM f WHERE path % 8 = 3
  UNION ALL SELECT path, 'XMP-album:TaggerVersion', '=', '9', 4 FROM f WHERE busy UNION ALL SELECT path, 'XMP-album:TaggedAt', '=', NULL, 4 FROM f WHERE busy
  UNION ALL SELECT path, 'XMP-album:CountryCode', '=', 'IT', 5 FROM f WHERE path % 4 = 2
  UNION ALL SELECT path, 'XMP-album:OCRRan', '=', NULL, 6 FROM f WHERE path % 4 = 1
  UNION ALL SELECT path, 'XMP-album:OCRText', '=', '', 8 FROM f WHERE path % 4 = 1 UNION ALL SELECT path, 'XMP-album:OCRText', '+=', 'a b', 9 FROM f WHERE path % 4 = 1
  UNION ALL SELECT path, 'XMP-iptcExt:ImageRegion', '+=', '{"Name":"t","RRole":[{"Identifier":["annotatedText"],"Name":"annotated text"}],"RegionBoundary":{"RbShape":"rectangle","RbUnit":"relative","RbX":0.12346,"RbY":0.5,"RbW":0.25,"RbH":0.0}}', 10 FROM f WHERE path % 4 = 3)
SELECT path, field, op, value, op_seq FROM w
""")
def consolidated_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All writes of a file at once; a fourth of the files have none. Times are left out."""
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    box = F.struct(F.lit("t").alias("text"), F.lit(0.123456).alias("x"), F.lit(0.5).alias("y"), F.lit(0.25).alias("w"), F.lit(0.0).alias("h"))
    rows = table(spark, sf_dir, "customer").select(
        k.alias("path"), F.when(k % 4 == 1, F.array(F.concat(F.lit("Objects/K"), k.cast("string")))).otherwise(none).alias("tags"),
        F.when(k % 4 == 2, F.create_map(F.lit("City"), F.lit("Rome"))).alias("location"), F.when(k % 8 == 3, F.array(F.lit("Al"))).when(k % 4 == 3, none).alias("people"),
        F.when(k % 4 == 2, F.create_map(F.lit("CountryCode"), F.lit("IT"))).alias("fields"), (k % 4 == 1).alias("ocr_ran"), F.when(k % 4 == 1, F.array(F.lit("a b"))).alias("ocr_text"),
        F.when(k % 4 == 3, F.array(box)).alias("ocr_regions"),
    )
    made = sinks.consolidated(rows, "9")
    return made.withColumn("value", F.when(~F.col("field").isin("XMP-album:TaggedAt", "XMP-album:OCRRan"), F.col("value"))).select("path", "field", "op", "value", "op_seq")


@query("""
WITH f AS (SELECT event_id AS path, event_id % 3 = 0 AS film, strftime(ts, '%Y:%m:%d %H:%M:%S') AS stamp FROM events WHERE event_id % 5 <> 0),
m AS (SELECT path, film, stamp, unnest(['EXIF:DateTimeOriginal', 'EXIF:CreateDate', 'EXIF:ModifyDate', 'XMP-photoshop:DateCreated', 'XMP-xmp:CreateDate', 'XMP-album:DateSource']) AS field FROM f)
SELECT path, field, CASE field WHEN 'XMP-album:DateSource' THEN 'mtime' ELSE stamp END AS value FROM m WHERE NOT film OR field IN ('XMP-xmp:CreateDate', 'XMP-album:DateSource')
""")
def dates_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates from names or else from times, and what is written for them; dated files are passed over."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(k.alias("path"), F.lit("holiday.jpg").alias("name"), F.col("ts").alias("mtime"), F.when(k % 5 == 0, "2020:01:01 00:00:00").alias("original"), F.lit("").alias("created"))
    found = dates.backfill(rows, ["filename", "mtime"]).withColumn("is_video", F.col("path") % 3 == 0)
    return dates.date_mutations(found).select("path", "field", "value")


# Texts and tags -------------------------------------------------------------------------------------------------------


@query("""
WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'the ' || p_name || ' of the iv' WHEN 2 THEN '  o''brien-' || p_name || ' VAN ' ELSE p_name END AS raw, string_split(p_name, ' ') AS w FROM part),
t AS (SELECT p_partkey, raw, array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), ' ') AS up, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), ' ') AS cap FROM n)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN up WHEN 1 THEN 'The ' || cap || ' of the IV' WHEN 2 THEN 'O''brien-' || cap || ' VAN' ELSE cap END AS titled FROM t
""")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_name")
    raw = F.when(k % 4 == 0, F.upper(n)).when(k % 4 == 1, F.concat(F.lit("the "), n, F.lit(" of the iv"))).when(k % 4 == 2, F.concat(F.lit("  o'brien-"), n, F.lit(" VAN "))).otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", text.title(raw).alias("titled"))


@query("""
SELECT p_partkey, array_to_string(list_filter([lower(p_brand), 'x', lower(p_name)], lambda t: t <> lower(p_brand)), '|') AS left_over FROM part
""")
def foreign_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing leaves without those of our own tags."""
    existing = F.array(F.lower("p_brand"), F.lit("x"), F.lower("p_name"))
    own = F.array(F.concat(F.lit("Objects/"), "p_brand"), F.concat(F.lit("People/"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tags.foreign(existing, own), "|").alias("left_over"))


@query("""
SELECT category, count(DISTINCT tag) AS n_paths, coalesce(array_to_string(list_sort(list(DISTINCT tag) FILTER (WHERE tag NOT LIKE '%/%')), '|'), '') AS flat
FROM (SELECT CASE WHEN p_size < 25 THEN 'Objects' ELSE 'Scenes' END AS category, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN p_brand ELSE p_type || '/' || p_brand END AS tag FROM part) WHERE tag IS NOT NULL GROUP BY category
""")
def taxonomy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") % 5
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_size") < 25, "Objects").otherwise("Scenes").alias("category"), F.when(s == 1, F.col("p_brand")).when(s > 1, F.concat_ws("/", "p_type", "p_brand")).alias("tag"))
    return tags.taxonomy_stats(rows).withColumn("flat", F.array_join("flat", "|"))


@query("""
WITH p AS (SELECT l_orderkey AS path, p_brand AS raw_tag, (l_quantity / 50)::DOUBLE AS score, l_linenumber * 1000000 + l_partkey AS raw_ord FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT DISTINCT p_brand AS raw_tag, 0.5::DOUBLE AS thr FROM part WHERE p_brand < 'Brand#3'),
r AS (SELECT p.*, row_number() OVER (PARTITION BY path, raw_tag ORDER BY score DESC, raw_ord) AS n FROM p LEFT JOIN t USING (raw_tag) WHERE score >= coalesce(thr, 0.0::DOUBLE) * 1.10::DOUBLE),
k AS (SELECT *, (row_number() OVER (PARTITION BY path ORDER BY score DESC, raw_ord))::INT AS category_rank FROM r WHERE n = 1)
SELECT path, raw_tag AS tag, score, category_rank FROM k WHERE category_rank <= 8
""")
def threshold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of a class by name; a class without one passes."""
    part = table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("path"), F.col("p_brand").alias("raw_tag"), (F.col("l_quantity") / 50).alias("score"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("raw_ord"))
    brands = part.select(F.col("p_brand").alias("raw_tag")).distinct()
    mapping = brands.select("raw_tag", F.lit("Objects").alias("category"), F.col("raw_tag").alias("tag"))
    found = tags.mapped_tags(rows, mapping, brands.filter("raw_tag < 'Brand#3'").withColumn("class_threshold", F.lit(0.5)))
    return found.select("path", "tag", "score", "category_rank")


@query("""
WITH s AS (SELECT doc_id AS path, string_split_regex(lower(text), '[.!?,\\n]+') AS parts FROM documents),
l AS (SELECT path, trim(regexp_replace(regexp_replace(unnest(parts), '[^a-z ]', '', 'g'), ' +', ' ', 'g'), ' ') AS line, unnest(range(len(parts))) AS k FROM s),
g AS (SELECT path, k // 4 AS page, k % 4 AS det, line FROM l WHERE line LIKE '% %' AND NOT regexp_matches(line, '(^| )(q|[^aeiouy ]+)( |$)|(^| )[^aeiouy ]{2}')),
d AS (SELECT *, row_number() OVER (PARTITION BY path, line ORDER BY page, det) AS dup FROM g),
p AS (SELECT path, page, det, line, row_number() OVER (PARTITION BY path, page ORDER BY det) AS i, row_number() OVER (PARTITION BY path ORDER BY page, det) AS a, dense_rank() OVER (PARTITION BY path ORDER BY page) AS pg FROM d WHERE dup = 1),
z AS (SELECT *, max(CASE WHEN a - i < 3 THEN pg END) OVER (PARTITION BY path) AS last FROM p)
SELECT path, page::INT AS page_idx, line AS phrase, (CASE WHEN a - i < 3 THEN a ELSE 3 + pg - last END)::INT AS n FROM z WHERE CASE WHEN a - i < 3 THEN a <= 3 ELSE i = 1 END
""")
def phrase_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three phrases a file, and one more from each later page of four phrases; phrases of plain words alone."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split(F.lower("text"), "[.!?,\\n]+")).alias("k", "raw"))
    lines = lines.select("path", "k", F.trim(F.regexp_replace(F.regexp_replace("raw", "[^a-z ]", ""), " +", " ")).alias("text"))
    lines = lines.filter(F.contains("text", F.lit(" ")) & ~F.col("text").rlike("(^| )(q|[^aeiouy ]+)( |$)|(^| )[^aeiouy ]{2}"))
    rows = lines.select("path", F.floor(F.col("k") / 4).cast("int").alias("page_idx"), (F.col("k") % 4).alias("det_idx"), "text", F.lit(0.9).alias("score"))
    return ocr.phrases(rows, min_length=1, max_tags=3).select("path", "page_idx", "phrase", F.col("n").cast("int").alias("n"))


# Models ---------------------------------------------------------------------------------------------------------------


class _Shares:
    """An embedder that reads its files: the share of one byte, and the size; what it cannot take has none."""

    def embed(self, paths):
        out = []
        for p in paths:
            with open(tree.Place(p).inside(p), "rb") as f:
                data = f.read()
            out.append(None if len(data) % 10 == 7 else [data.count(b"x") / len(data), float(len(data))])
        return out


@query(f"""
SELECT folder || '/' || name AS path, CASE WHEN k % 4 = 0 THEN -1 ELSE round(CASE WHEN film THEN (k % 50)::DOUBLE / size ELSE 1 END, 5) END::DOUBLE AS x, k % 4 = 0 AS cached
FROM ({_TREE}) WHERE name NOT LIKE '%.txt' AND (k % 4 = 0 OR size % 10 <> 7)
""")
def model_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept vectors, and for the other files what the model makes of their bytes; those that fail are left out."""
    at = _tree(spark, sf_dir)
    paths = files.scan(spark, at).select("path")
    kept = paths.filter(F.regexp_extract("path", "(\\d+)\\.[A-Za-z0-9.]+$", 1).cast("long") % 4 == 0).withColumn("vec", F.array(F.lit(-1.0).cast("float")))
    made = plugins.embeddings(paths, kept, _Shares, model=f"shares-{at}")
    return made.select(_below(at).alias("path"), F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("x"), "cached")


@query("""
WITH v AS (SELECT vec_id, label::VARCHAR AS raw_tag, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT raw_tag, unnest(v) AS x, unnest(range(len(v))) AS pos FROM v WHERE vec_id % 5 <> 0),
m AS (SELECT raw_tag, pos, avg(x) AS x FROM x GROUP BY ALL), n AS (SELECT raw_tag, sqrt(sum(x * x)) AS n FROM m GROUP BY raw_tag),
d AS (SELECT raw_tag, list(x / n ORDER BY pos) AS d FROM m JOIN n USING (raw_tag) GROUP BY raw_tag),
t AS (SELECT raw_tag, avg(list_dot_product(v, d)) AS thr FROM v JOIN d USING (raw_tag) WHERE vec_id % 5 <> 0 GROUP BY raw_tag),
s AS (SELECT vec_id AS path, d.raw_tag, list_dot_product(v.v, d.d) AS score, thr FROM v, d JOIN t USING (raw_tag))
SELECT path, raw_tag, round(score, 6) AS score, round(thr, 6) AS class_threshold, row_number() OVER (PARTITION BY path ORDER BY score DESC, raw_tag) - 1 AS raw_ord FROM s
""")
def model_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by directions that are learned from four fifths of the vectors, of all vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), "label", F.col("embedding").alias("vec"))
    found = classify.predicted(e, classify.directions(e.filter("path % 5 <> 0")))
    rows = plugins.predictions(e.select("path"), found)
    return rows.select("path", "raw_tag", F.round("score", 6).alias("score"), F.round("class_threshold", 6).alias("class_threshold"), "raw_ord")


class _Lines:
    """An engine for files of text: a page a form feed, a detection a line that is not blank, with its place."""

    def read(self, path):
        with open(tree.Place(path).inside(path), newline="") as f:
            pages = f.read().split("\f")
        out = []
        for page in pages:
            lines = [(k, t) for k, t in enumerate(page.split("\n")) if t.strip(" \t\r\v")]
            out.append([([[0.0, k], [len(t), k], [len(t), k + 1], [0.0, k + 1]], t, sum(c.isascii() and c.isalpha() for c in t) / len(t)) for k, t in lines])
        return out


@query("""
WITH l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS det_idx FROM l WHERE NOT regexp_full_match(t, '[ \t\r\v]*'))
SELECT path, 0 AS page_idx, det_idx::INT AS det_idx, md5(t) AS text_md5, round(length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::DOUBLE / length(t), 6) AS score, length(t)::DOUBLE AS width, k::DOUBLE AS top FROM d
""")
def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as files, and what an engine reads in them, line by line."""
    import os

    import pyarrow as pa

    at = _folder(spark, "texts")
    root = tree.Place(at).inside(at)

    def run(batches):
        os.makedirs(root, exist_ok=True)
        for b in batches:
            for k, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                with open(f"{root}/{k}.txt", "w", newline="") as out:
                    out.write(t)
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"{root}/{k}.txt" for k in b.column("doc_id").to_pylist()], pa.string())})

    paths = checkpointed(table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "path string"))
    found = plugins.detections(paths.repartition(spark.sparkContext.defaultParallelism), load=_Lines)
    corner = F.get(F.get("poly", F.lit(1)), F.lit(0))
    return found.select(
        F.regexp_extract("path", "(-?\\d+)\\.txt$", 1).cast("long").alias("path"), "page_idx", "det_idx", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.round("score", 6).alias("score"),
        corner.alias("width"), F.get(F.get("poly", F.lit(1)), F.lit(1)).alias("top"),
    )


@query(f"""
WITH l AS ({registry._LEADERS}), p AS (SELECT id, ord, {registry._KM} AS km FROM (SELECT id, ord, {registry._H} FROM ({registry._C}), ({registry._S}) WHERE id IN (SELECT leader FROM l))),
n AS (SELECT id, ord, row_number() OVER (PARTITION BY id ORDER BY km, ord) AS r FROM p WHERE km <= 800)
SELECT l.seq, n.ord AS place FROM l LEFT JOIN n ON n.id = l.leader AND r = 1
""")
def model_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's leader is looked up: the nearest of the suppliers' places is its address."""
    points = registry._points(spark, sf_dir)
    places = registry._spots(spark, sf_dir)
    near = radius.nearest_place(points, places, 800.0)
    known = near.select(F.col("id").alias("seq"), F.create_map(F.lit("place"), F.col("ord").cast("string")).alias("address"))
    found = plugins.addresses(points.withColumnRenamed("id", "seq"), known, radius_km=500.0)
    return found.select("seq", F.try_element_at("address", F.lit("place")).cast("long").alias("place"))


@query("SELECT event_id AS path, event_type AS raw_tag, round(1 / (1 + exp(-(value - 10))), 9) AS score FROM events")
def sigmoid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = table(spark, sf_dir, "events").select(F.col("event_id").alias("path"), F.col("event_type").alias("raw_tag"), (F.col("value") - 10).alias("logit"))
    return plugins.scored(logits).select("path", "raw_tag", F.round("score", 9).alias("score"))


@query("""
WITH o AS (SELECT o_orderkey, (o_orderkey % 5000 + 1)::INT AS w, (o_custkey % 3000 + 1)::INT AS h FROM orders)
SELECT o_orderkey, greatest(round(w * least(1.0::DOUBLE, 1024.0::DOUBLE / greatest(w, h)))::INT, 1) AS width, greatest(round(h * least(1.0::DOUBLE, 1024.0::DOUBLE / greatest(w, h)))::INT, 1) AS height,
  (['', 'hflip', 'hflip,vflip', 'vflip', 'transpose=0', 'transpose=1', 'transpose=3', 'transpose=2', ''])[o_orderkey % 9 + 1] AS turn FROM o
""")
def picture_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a prepared picture, and what brings it upright."""
    k = F.col("o_orderkey")
    size = plugins.shrunk((k % 5000 + 1).cast("int"), (F.col("o_custkey") % 3000 + 1).cast("int"), 1024)
    return table(spark, sf_dir, "orders").select(k, size.alias("s"), plugins.upright(k % 9 + 1).alias("turn")).select("o_orderkey", "s.width", "s.height", "turn")


# Clusters -------------------------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id AND list_dot_product(a.v, b.v) >= 0.42),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
l AS (SELECT id, min(c) AS cluster FROM r GROUP BY id),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id * 7919 % 1000 DESC, id) AS pos FROM l)
SELECT k.id, round(max(list_dot_product(x.v, y.v)), 6) AS sim_before FROM k JOIN v x ON x.id = k.id LEFT JOIN k b ON b.cluster = k.cluster AND b.pos < k.pos LEFT JOIN v y ON y.id = b.id GROUP BY k.id
""")
def similarity_to_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") * 7919 % 1000).alias("size"), F.col("embedding").alias("vec"))
    found = cluster.similarity_to_earlier(cluster.clusters(e, 0.42), e)
    return found.select("id", F.round("sim_before", 6).alias("sim_before"))
