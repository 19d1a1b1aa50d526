"""Moves of duplicates: where files are now, what goes where, and the log of it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumspark.functions.text import stem
from albumspark.operators.components import checkpointed


def latest_moves(manifest: DataFrame) -> DataFrame:
    """manifest (original, moved_to, line_no) -> original, moved_to of the last line."""
    return manifest.groupBy("original").agg(F.max_by("moved_to", "line_no").alias("moved_to"))


def statuses(files: DataFrame, existing: DataFrame, moves: DataFrame) -> DataFrame:
    """files (path) with status: present, moved (its last move's target is there) or missing; and moved_to."""
    have = existing.select("path").distinct().withColumn("_here", F.lit(True))
    joined = files.join(moves.withColumnRenamed("original", "path"), "path", "left").join(have, "path", "left")
    joined = joined.join(have.toDF("moved_to", "_there"), "moved_to", "left")
    status = F.when(F.col("_here"), "present").when(F.col("_there"), "moved").otherwise("missing")
    return joined.withColumn("status", status).select(*files.columns, "moved_to", "status")


def kept(rows: DataFrame, policy: str = "first") -> Column:
    """Which files of a cluster stay: all; first, the first present by pos; only, the one under the cursor (column cursor,
    its pos), if it is present, else what was kept before (column keep); or none."""
    if policy == "all":
        return F.lit(True)
    if policy == "none":
        return F.lit(False)
    own = Window.partitionBy("cluster")
    if policy == "only":
        there = F.max(F.col("pos").eqNullSafe(F.col("cursor")) & (F.col("status") == "present")).over(own)
        return F.when(there, F.col("pos") == F.col("cursor")).otherwise(F.col("keep"))
    present = F.when(F.col("status") == "present", F.col("pos"))
    return F.coalesce(F.col("pos") == F.min(present).over(own), F.lit(False))


def to_move(rows: DataFrame) -> DataFrame:
    """rows (path, status, keep): the present ones that are not kept."""
    return rows.filter((F.col("status") == "present") & ~F.col("keep"))


def undone(moves: DataFrame, existing: DataFrame) -> DataFrame:
    """moves (original, moved_to) with refused: why a move cannot be undone (the original is there again, or the moved file
    is gone), or null where moved_to may go back to original."""
    have = existing.select("path").distinct()
    rows = moves.join(have.select(F.col("path").alias("original"), F.lit(True).alias("_here")), "original", "left")
    rows = rows.join(have.select(F.col("path").alias("moved_to"), F.lit(True).alias("_there")), "moved_to", "left")
    refused = F.when(F.col("_here"), "original exists").when(F.col("_there").isNull(), "moved file is gone")
    return rows.withColumn("refused", refused).select(*moves.columns, "refused")


# A number as a suffix has it: from 2 on, without leading zeros.
_NUMBERED = "^(.+)_([2-9]|[1-9][0-9]+)$"


def planned_names(files: DataFrame, dest: str, taken: DataFrame) -> DataFrame:
    """files (path, ord) -> path, moved_to under dest, in the order of ord, then path: the file's name, or name_2, name_3
    and so on, the first that neither dest nor an earlier file has. taken (name): what is in dest.

    A name that no other name can reach takes its free numbers by rank. Where a file's own name looks like a suffixed
    one of another that is moved (a.jpg and a_2.jpg), all names of that family go through in order, a family a task.
    """
    name = F.substring_index("path", "/", -1)
    ext = lambda c: F.regexp_extract(c, "^.+?(\\.[^.]+)$", 1)
    rows = files.select("path", "ord", name.alias("name")).withColumns({"_stem": stem(F.col("name")), "_ext": ext("name")})
    have = taken.select("name").distinct().withColumns({"_stem": stem(F.col("name")), "_ext": ext("name")})
    base, number = F.regexp_extract("_stem", _NUMBERED, 1), F.regexp_extract("_stem", _NUMBERED, 2).try_cast("long")
    suffixed = have.filter(number.isNotNull()).select(base.alias("_stem"), "_ext", number.alias("_no"))
    used = have.select("_stem", "_ext", F.lit(1).cast("long").alias("_no")).unionByName(suffixed)
    used = used.groupBy("_stem", "_ext").agg(F.sort_array(F.collect_set("_no")).alias("_used"))
    # Families: a name belongs to that of the name without its last number, if a file has that.
    names = rows.groupBy("_stem", "_ext").count().drop("count")
    root = checkpointed(names.select("_stem", "_ext", F.col("_stem").alias("_root"), F.lit(False).alias("_linked")))
    links = names.filter(number.isNotNull()).select("_stem", "_ext", base.alias("_up"))
    links = checkpointed(links.join(names.withColumnRenamed("_stem", "_up"), ["_up", "_ext"]))
    while not links.isEmpty():  # as often as the longest chain of numbers in a name
        up = links.join(root.select(F.col("_stem").alias("_up"), "_ext", F.col("_root").alias("_far")), ["_up", "_ext"]).select("_stem", "_ext", "_far")
        new = root.join(up, ["_stem", "_ext"], "left").select("_stem", "_ext", F.coalesce("_far", "_root").alias("_root"), F.col("_far").isNotNull().alias("_linked"), (F.coalesce("_far", "_root") != F.col("_root")).alias("_new"))
        new = checkpointed(new)
        root = new.drop("_new")
        if new.filter("_new").isEmpty():
            break
    many = checkpointed(root.filter("_linked").select("_root", "_ext").distinct())
    linked = many.select(F.col("_root").alias("_r"), F.col("_ext").alias("_e"), F.lit(True).alias("_many"))
    family = root.join(linked, (F.col("_root") == F.col("_r")) & (F.col("_ext") == F.col("_e")), "left")
    family = checkpointed(family.select("_stem", "_ext", "_root", F.coalesce("_many", F.lit(False)).alias("_many")))
    rows = rows.join(family, ["_stem", "_ext"])
    prefix = F.lit(dest.rstrip("/") + "/")

    one = rows.filter("NOT _many").join(used, ["_stem", "_ext"], "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<bigint>")))
    one = one.withColumn("_k", F.row_number().over(Window.partitionBy("_stem", "_ext").orderBy("ord", "path")).cast("long"))
    no = F.aggregate("_used", F.col("_k"), lambda n, u: F.when(u <= n, n + 1).otherwise(n))  # the k-th number that is free
    made = F.when(no == 1, F.col("name")).otherwise(F.concat("_stem", F.lit("_"), no.cast("string"), "_ext"))
    one = one.select("path", F.concat(prefix, made).alias("moved_to"))
    if many.isEmpty():
        return one

    def through(asked: pa.Table, held: pa.Table) -> pa.Table:
        taken, following, out = set(held.column("name").to_pylist()), {}, []
        for name, stem, ext in zip(*(asked.column(c).to_pylist() for c in ("name", "_stem", "_ext")), strict=True):
            new, n = name, following.get(name, 2)
            while new in taken:
                new, n = f"{stem}_{n}{ext}", n + 1
            following[name] = n
            taken.add(new)
            out.append(new)
        return pa.table({"path": asked.column("path"), "new": pa.array(out, pa.string())})

    asked = rows.filter("_many").select("path", "name", "_stem", "_ext", "_root", F.row_number().over(Window.partitionBy("_root", "_ext").orderBy("ord", "path")).alias("_k"))
    # What dest has of a family: its files' names, and these with numbers.
    own = family.filter("_many").select("_stem", "_ext", "_root")
    met = have.join(own, ["_stem", "_ext"]).select("name", "_root", "_ext").union(
        have.filter(number.isNotNull()).select("name", base.alias("_stem"), "_ext").join(own, ["_stem", "_ext"]).select("name", "_root", "_ext")
    ).distinct()
    kind = asked.schema["path"].dataType.simpleString()
    ordered = lambda asked, held: through(asked.sort_by("_k"), held)
    rest = asked.groupBy("_root", "_ext").cogroup(met.groupBy("_root", "_ext")).applyInArrow(ordered, f"path {kind}, new string")
    return one.unionByName(rest.select("path", F.concat(prefix, "new").alias("moved_to")))


def common_ancestor(paths: DataFrame, order: str = "path", *by: str) -> DataFrame:
    """ancestor, of all paths or for each value of the columns `by`: the directory of the first path, shortened folder by folder until it is a prefix of all paths' directories,
    as text: /a/b is one of /a/bc, and which path is first decides between them.

    The longest common text of all directories is that of the least and the greatest.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    ends = paths.groupBy(*by).agg(F.min(folder).alias("a"), F.max(folder).alias("b"), F.min_by(folder, F.struct(order, "path") if order != "path" else F.col("path")).alias("first"))
    n = F.least(F.length("a"), F.length("b"))
    same = F.coalesce(F.array_position(F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(F.col("a"), F.lit(1), k) == F.substring(F.col("b"), F.lit(1), k)), False) - 1, F.lit(-1))
    shared = F.when(same < 0, F.substring(F.col("a"), F.lit(1), n)).otherwise(F.substring(F.col("a"), F.lit(1), same.cast("int")))
    whole = (F.col("first") == shared) | F.startswith(F.substring(F.col("first"), F.length(shared) + 1, F.lit(1000000)), F.lit("/"))
    return ends.select(*by, F.when(whole, shared).otherwise(F.regexp_replace(shared, "/[^/]*$", "")).alias("ancestor"))
