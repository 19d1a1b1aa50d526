"""Operators against worked cases and plain Python."""

import datetime as dt
import math
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from albumspark.operators import asof, cluster, components, dates, merge, moves, ocr, radius, select, steps, tags


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=minute, seconds=second)


def nearest_plain(rows, tolerance):
    anchors = sorted((r for r in rows if r[1] and r[2] is not None), key=lambda r: r[1])
    out = {}
    for seq, ts, lat, _ in rows:
        if lat is not None or ts is None:
            out[seq] = lat
            continue
        before = [a for a in anchors if a[1] < ts]
        after = [a for a in anchors if a[1] >= ts]
        b = before[-1] if before else None
        a = after[0] if after else None
        pick = min([(abs((x[1] - ts).total_seconds()), k, x) for k, x in enumerate((b, a)) if x], default=None, key=lambda t: t[:2])
        out[seq] = pick[2][2] if pick and pick[0] <= tolerance else None
    return out


def test_nearest_edges(spark):
    rows = [
        (1, at(0), 1.0, 1.0), (2, at(30), None, None), (3, at(200), 3.0, 3.0), (4, at(231), None, None), (5, at(300), 5.0, 5.0), (6, at(310), None, None), (7, at(320), 7.0, 7.0),
        (8, at(400), 8.0, 8.0), (9, at(400), 9.0, 9.0), (10, at(405), None, None), (11, at(395), None, None), (12, None, None, None), (13, at(400), None, None),
    ]
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, lat double, lon double")
    got = {r.seq: r.near_lat for r in asof.nearest(df, 1800).collect()}
    assert (got[2], got[4], got[6], got[10], got[11], got[12], got[13]) == (1.0, None, 5.0, 9.0, 8.0, None, 8.0)
    assert got == nearest_plain(rows, 1800)


def test_nearest_random(spark):
    rnd = random.Random(1)
    rows = [(k, at(rnd.randrange(600)), *([float(k)] * 2 if rnd.random() < 0.3 else [None, None])) for k in range(300)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, lat double, lon double")
    assert {r.seq: r.near_lat for r in asof.nearest(df, 240).collect()} == nearest_plain(rows, 240)


def km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


@pytest.mark.parametrize("r", [5.0, 300.0, 2500.0])
def test_radius_join(spark, r):
    rnd = random.Random(2)
    near = lambda: (rnd.choice([0.0, 45.0, 89.5, -89.9]) + rnd.uniform(-0.1, 0.1) * r / 30, rnd.choice([0.0, 179.9, -179.9]) + rnd.uniform(-0.2, 0.2) * r / 30)
    fold = lambda p: (max(-90.0, min(90.0, p[0])), (p[1] + 180) % 360 - 180)
    points, places = [fold(near()) for _ in range(60)], [fold(near()) for _ in range(60)]
    a = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "id int, lat double, lon double")
    b = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "ord int, place_lat double, place_lon double")
    got = sorted((x.id, x.ord) for x in radius.radius_join(a, b, r).collect())
    assert got == sorted((i, j) for i, p in enumerate(points) for j, q in enumerate(places) if km(*p, *q) <= r)


def test_leaders(spark):
    rows = [(1, 0.0, 0.0), (2, 0.004, 0.0), (3, 0.008, 0.0), (4, 0.0044, 0.0), (5, None, 0.0)]
    df = spark.createDataFrame(rows, "seq long, lat double, lon double")
    assert {r.seq: r.leader for r in radius.leader_cache(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: None}


def unit(*x):
    n = math.sqrt(sum(v * v for v in x))
    return [v / n for v in x]


def test_clusters(spark):
    angle = lambda d: unit(math.cos(math.radians(d)), math.sin(math.radians(d)))
    rows = [(1, 10, angle(0)), (2, 30, angle(20)), (3, 20, angle(40)), (4, 5, angle(120)), (5, 7, angle(125)), (6, 1, angle(250))]
    df = spark.createDataFrame(rows, "id long, size long, vec array<double>")
    got = cluster.clusters(df, 0.9).orderBy("cluster_rank", "pos").collect()
    assert [(r.cluster, r.id, r.pos, r.n) for r in got] == [(4, 5, 1, 2), (4, 4, 2, 2), (1, 2, 1, 3), (1, 3, 2, 3), (1, 1, 3, 3)]
    before = {r.id: r.sim_before for r in cluster.similarity_to_earlier(cluster.clusters(df, 0.9), df).collect()}
    assert before[2] is None and before[3] == pytest.approx(math.cos(math.radians(20)))


def test_refined(spark):
    angle = lambda d: unit(math.cos(math.radians(d)), math.sin(math.radians(d)))
    rows = [(k, 100 - k, angle(d)) for k, d in enumerate([0, 5, 24, 29, 180, 180, 180])]
    df = spark.createDataFrame(rows, "id long, size long, vec array<double>")
    got = sorted((r.cluster, r.id) for r in cluster.refined(df, 0.90, most=2).collect())
    assert got == [(0, 0), (0, 1), (2, 2), (2, 3), (4, 4), (4, 5)]


def test_merge(spark):
    rows = [("p", 0, ["Rome", "Italy"], "2025.1", "IT", 0), ("p", 1, ["Italy", "Cat"], "2026.3", "", None), ("q", 0, None, None, None, 5), ("q", 1, ["x"], "", None, 0)]
    df = spark.createDataFrame(rows, "path string, rank int, kw array<string>, v string, c string, n int")
    got = {r.path: (r.kw, r.v, r.c, r.n) for r in merge.merged(df, ["path"], ["kw"], ["v", "c", "n"]).collect()}
    assert got == {"p": (["Rome", "Italy", "Cat"], "2026.3", "IT", 0), "q": (["x"], None, None, 0)}


def test_sidecars(spark):
    files = spark.createDataFrame([("/a.jpg",), ("/b.jpg",), ("/c.jpg",)], "path string")
    have = spark.createDataFrame([("/a.jpg.xmp",), ("/a.xmp",), ("/b.xmp",)], "path string")
    got = sorted((r.path, r.physical) for r in merge.with_sidecars(files, have).filter("source = 'sidecar'").collect())
    assert got == [("/a.jpg", "/a.jpg.xmp"), ("/b.jpg", "/b.xmp")]


def test_fan_out_and_places(spark):
    df = spark.createDataFrame([("p", "Places/Italy/Rome"), ("q", "People/Alice")], "path string, tag string")
    got = sorted((r.path, r.field, r.value) for r in tags.fan_out(df).collect())
    assert len(got) == 9 and ("p", "XMP-lr:HierarchicalSubject", "Places|Italy|Rome") in got and ("q", "XMP-iptcExt:PersonInImage", "Alice") in got
    rows = [
        ("a", {"country": "italy", "state": "lazio", "city": "rome", "suburb": "municipio roma i", "country_code": "it"}), ("b", {"country": "France", "country_code": "fr"}),
        ("c", {"country": "Germany", "town": "freiburg"}), ("d", {}),
    ]
    got = {r.path: (r.place, r.country_code) for r in tags.place_path(spark.createDataFrame(rows, "path string, address map<string,string>")).collect()}
    assert got == {"a": ("Places/Italy/Lazio/Rome/Municipio Roma I", "IT"), "b": ("Places/France", "FR"), "c": ("Places/Germany/Freiburg", None), "d": (None, None)}


def test_location_fan_out(spark):
    df = spark.createDataFrame([("p", {"Country": "Italy", "Nope": "x", "City": "Rome"})], "path string, parts map<string,string>")
    assert tags.location_fan_out(df).count() == 4


def test_fix_plan(spark):
    rows = [
        ("none", [], False, True, False), ("all", ["Places/x", "Objects/x", "Landmarks/x"], True, True, False), ("fallback", [], True, False, True), ("scenes", ["Scenes/x"], True, False, False), ("null", None, None, False, False),
    ]
    df = spark.createDataFrame(rows, "path string, keywords array<string>, ocr_ran boolean, has_coords boolean, has_fallback boolean")
    plan = tags.fix_plan(df)
    got = {r.path: (r.run_gps, r.run_ram, r.run_landmarks, r.run_ocr) for r in plan.collect()}
    T, N = True, False  # noqa: N806
    assert got == {"none": (T, T, T, T), "all": (N, N, N, N), "fallback": (N, T, T, N), "scenes": (N, N, N, N), "null": (N, T, N, T)}
    assert tuple(tags.fix_workload(plan).first()) == (3, 1, 3, 2, 2)
    assert not tags.fix_plan(df, landmarks=False).filter("run_landmarks").count()


def test_mapped_tags(spark):
    pred = [("p", "a", 1.2, 0, 1.0), ("p", "b", 1.0, 1, 1.0), ("p", "c", 0.1, 2, 0.0), ("p", "d", 5.0, 3, 1.0), ("p", "e", 4.0, 4, 1.0)]
    df = spark.createDataFrame(pred, "path string, raw_tag string, score double, raw_ord int, class_threshold double")
    mapping = spark.createDataFrame([("a", "Objects", "Objects/X"), ("b", "Objects", "Objects/Y"), ("c", "Scenes", "Scenes/Z"), ("d", "Objects", None), ("e", "Objects", "Objects/X")], "raw_tag string, category string, tag string")
    got = [(r.tag, r.score, r.category_ord) for r in tags.mapped_tags(df, mapping).orderBy("category_ord", "category_rank").collect()]
    assert got == [("Objects/X", 4.0, 1), ("Scenes/Z", 0.1, 2)]


def test_tag_index(spark):
    df = spark.createDataFrame([("p", ["Objects/Cat", "Places/cat"]), ("q", ["Dog", "CAT"])], "path string, tags array<string>")
    index = tags.tag_index(df)
    assert [tuple(r) for r in tags.tag_counts(index).collect()] == [("cat", 2), ("dog", 1)]
    assert tags.matching(index, "do").count() == 0 and tags.matching(index, "d.g").count() == 1
    assert sorted(r.path for r in tags.search(index, "Cat").collect()) == ["p", "q"]


def test_ocr(spark):
    poly = [[0.0, 0.0], [50.0, 0.0], [50.0, 20.0], [0.0, 20.0]]
    rows = [("p", 0, 0, "hello world", 0.7, poly, 100, 100), ("p", 0, 1, "HELLO World", 0.9, poly, 100, 100), ("p", 0, 2, "single", 0.79, poly, 100, 100), ("p", 0, 3, "single", 0.80, poly, 100, 100), ("p", 0, 4, "hello", 0.95, poly, 100, 100), ("p", 0, 5, "bczs", 0.99, poly, 100, 100), ("p", 0, 6, "hello there", 0.5, poly, 100, 100)]
    rows += [("m", page, k, f"word number {'abcdefghijkl'[page * 6 + k]}a", 0.9, poly, 100, 100) for page in range(2) for k in range(6)]
    df = spark.createDataFrame(rows, "path string, page_idx int, det_idx int, text string, score double, poly array<array<double>>, img_w int, img_h int")
    got = ocr.phrases(df).filter("path = 'p'").orderBy("n").select("phrase", "tag", ocr.box(F.col("poly"), F.col("img_w"), F.col("img_h")).alias("b")).collect()
    assert [(r.phrase, r.tag) for r in got] == [("hello world", "Hello World"), ("single", "Single")] and tuple(got[0].b) == (0.0, 0.0, 0.5, 0.2)
    # Three at most: the first page stops at three, the second adds one.
    assert [(r.page_idx, r.n) for r in ocr.phrases(df, max_tags=3).filter("path = 'm'").orderBy("n").collect()] == [(0, 1), (0, 2), (0, 3), (1, 4)]


def test_regions(spark):
    kind = "path string, regions array<struct<Name:string,Type:string,Description:string,RRole:array<struct<Identifier:array<string>,Name:string>>>>"
    mine, face = ("a", "BarCode", "text", [(["x/annotatedText"], "r")]), ("b", "Face", None, None)
    df = spark.createDataFrame([("p", [mine, face]), ("q", [mine]), ("r", [face]), ("s", [("c", "BarCode", "other", [(None, None)])])], kind)
    got = {r.path: r.action for r in ocr.region_cleanup(df, "text").collect()}
    assert got == {"p": "rewrite", "q": "delete"}
    assert [r.n for r in df.orderBy("path").select(F.size(ocr.not_ocr(F.col("regions"))).alias("n")).collect()] == [1, 0, 1, 1]


def test_region_cap(spark):
    rows = [(k, "Europe" if k % 2 else "Mars", f"t{k % 3}", k) for k in range(40)]
    df = spark.createDataFrame(rows, "ord int, region string, type string, sitelinks int")
    got = select.by_region_cap(df, 20, n_types=3).orderBy("place").collect()
    assert sum(r.region == "Europe" for r in got) == 8 and sum(r.region == "Mars" for r in got) == 1
    assert [r.sitelinks for r in got] == sorted((r.sitelinks for r in got), reverse=True)


def test_images(spark):
    rows = [("w", "P8517", 0, "B.jpg"), ("w", "P18", 0, "A b.jpg"), ("w", "P18", 1, "a_B.JPG"), ("w", "P18", 2, "c.svg"), ("w", "P9", 0, "z.jpg"), ("w", "P3451", 0, "D.jpg")]
    got = select.images(spark.createDataFrame(rows, "wikidata_id string, prop string, claim_ord int, filename string"), 2)
    assert [(r.filename, r.source) for r in got.orderBy("place").collect()] == [("A b.jpg", "wikidata:P18"), ("D.jpg", "wikidata:P3451")]


def test_moves(spark):
    files = spark.createDataFrame([("/x/a.jpg", 1), ("/y/a.jpg", 2), ("/z/a.jpg", 3), ("/z/b", 4)], "path string, ord int")
    taken = spark.createDataFrame([("a.jpg",), ("a_3.jpg",)], "name string")
    got = {r.path: r.moved_to for r in moves.planned_names(files, "/d", taken).collect()}
    assert got == {"/x/a.jpg": "/d/a_2.jpg", "/y/a.jpg": "/d/a_4.jpg", "/z/a.jpg": "/d/a_5.jpg", "/z/b": "/d/b"}
    log = spark.createDataFrame([("/x/a.jpg", "/d/old.jpg", 1), ("/x/a.jpg", "/d/a.jpg", 2), ("/y/a.jpg", "/d/gone.jpg", 3)], "original string, moved_to string, line_no long")
    have = spark.createDataFrame([("/d/a.jpg",), ("/z/b",)], "path string")
    got = {r.path: r.status for r in moves.statuses(files, have, moves.latest_moves(log)).collect()}
    assert got == {"/x/a.jpg": "moved", "/y/a.jpg": "missing", "/z/a.jpg": "missing", "/z/b": "present"}


@pytest.mark.parametrize(("paths", "want"), [(["/a/b/x.jpg", "/a/b/c/y.jpg"], "/a/b"), (["/a/b/x.jpg", "/a/c/y.jpg"], "/a"), (["/a/b/x.jpg"], "/a/b")])
def test_common_ancestor(spark, paths, want):
    assert moves.common_ancestor(spark.createDataFrame([(p,) for p in paths], "path string")).first()[0] == want


def test_backfill(spark):
    rows = [("/a/IMG-20230515-WA0001.jpg", None, None, None), ("/a/PXL_20230515_123456.jpg", None, "2020:01:01 00:00:00", None), ("/a/x.jpg", at(0), "", None)]
    df = spark.createDataFrame(rows, "path string, mtime timestamp_ntz, original string, created string").withColumn("name", F.substring_index("path", "/", -1))
    found = dates.backfill(df, ["filename", "mtime"])
    assert {r.label: r.n for r in dates.backfill_counts(found).collect()} == {"filename:whatsapp": 1, "mtime": 1}
    assert dates.date_mutations(found.withColumn("is_video", F.lit(False))).count() == 12


RETRIED = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from albumspark.operators import steps
spark = SparkSession.builder.master("local[2, 3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def work(row, own):
    own.run("gps", lambda: 1 / (row["path"] % 4), queries=2)
    own.run("ocr", lambda: row["path"] % 3 != 0)
    own.add("cache", hits=1)
    if row["path"] % 50 == 49 and TaskContext.get().attemptNumber() == 0:
        os._exit(1)  # the task dies with what it has recorded

log, seen = steps.watched(steps.recorded(spark.range(100).withColumnRenamed("id", "path"), work), "gps", "ocr")
log.write.parquet({out!r})
log = spark.read.parquet({out!r})
print([tuple(r) for r in steps.summary(log).select("step", "runs", "ok", "errors").orderBy("step").collect()], sorted(tuple(r) for r in steps.extras(log).collect()), {{k: v for k, v in seen.get.items() if not k.endswith("_s")}}, seen.get["gps_s"] > 0)
"""


def test_steps_of_retried_tasks_count_once(tmp_path):
    code = RETRIED.format(repo=str(Path(__file__).resolve().parents[1]), out=str(tmp_path / "log"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200)
    want = ([("gps", 100, 75, 25), ("ocr", 100, 66, 34)], [("cache", "hits", 100.0), ("gps", "queries", 200.0)], {"gps_runs": 100, "gps_errors": 25, "ocr_runs": 100, "ocr_errors": 34}, True)
    assert done.stdout.strip().splitlines()[-1] == " ".join(map(str, want)), done.stderr[-2000:]


def test_steps(spark):
    log = spark.createDataFrame([("a", True, 1.0), ("a", False, 3.0)], "step string, ok boolean, elapsed double")
    assert tuple(steps.summary(log).first()) == ("a", 2, 1, 1, 4.0, 2.0)


def test_taxonomy(spark):
    got = tags.taxonomy(spark.createDataFrame([("a/b",), ("a/c/d",)], "path string")).orderBy("node").collect()
    assert [r.line for r in got] == ["a/", "  b", "  c/", "    d"]


def plain_names(files_, taken):
    """In order, one after another, as a folder is filled."""
    taken, out = set(taken), {}
    for path, _ in sorted(files_, key=lambda f: (f[1], f[0])):
        name = path.rsplit("/", 1)[-1]
        stem, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
        new, n = name, 2
        while new in taken:
            new, n = f"{stem}_{n}{dot}{ext}", n + 1
        taken.add(new)
        out[path] = f"/d/{new}"
    return out


def test_names_that_look_like_suffixed_ones(spark):
    rnd = random.Random(5)
    stems = ["a", "a_2", "a_2_2", "a_3", "a_02", "b_2", "c", "IMG_0001", "IMG_0002", ".h", "x_9"]
    files_ = [(f"/{k}/{rnd.choice(stems)}{rnd.choice(['.jpg', '.jpg', '', '.JPG'])}", k) for k in range(160)]
    taken = ["a.jpg", "a_4.jpg", "c_2.jpg", "b_2", "IMG_0001.jpg", "a_2_3.jpg", "x_9_2.jpg", "x_9_3.jpg"]
    df = spark.createDataFrame(files_, "path string, ord int")
    got = {r.path: r.moved_to for r in moves.planned_names(df, "/d", spark.createDataFrame([(t,) for t in taken], "name string")).collect()}
    assert got == plain_names(files_, taken) and len(set(got.values())) == len(got)
    three = spark.createDataFrame([("a/a.jpg", 1), ("b/a.jpg", 2), ("c/a_2.jpg", 3)], "path string, ord int")
    none = spark.createDataFrame([], "name string")
    assert [r.moved_to for r in moves.planned_names(three, "/d", none).orderBy("path").collect()] == ["/d/a.jpg", "/d/a_2.jpg", "/d/a_2_2.jpg"]
    assert moves.planned_names(three.limit(0), "/d", none).count() == 0


def plain_leaders(rows, r):
    leaders, want = [], {}
    for seq, lat, lon in sorted(rows):
        near = [s for s, a, b in leaders if km(a, b, lat, lon) < r]
        want[seq] = near[0] if near else seq
        if not near:
            leaders.append((seq, lat, lon))
    return want


def spots(r):
    rnd = random.Random(6)
    for k in range(300):
        lat, lon = rnd.choice([(0.0, 0.0), (45.0, 179.999), (89.99, 10.0), (-33.0, 151.0)])
        yield k * 3, max(-90.0, min(90.0, lat + rnd.uniform(-2, 2) * r / 111)), (lon + rnd.uniform(-3, 3) * r / 111 + 180) % 360 - 180


def chain(r):
    """A track: each point is covered by the one before, if that leads."""
    for k in range(240):
        yield k, 10 + k * 0.6 * r / 111.2, 20.0


def city(r):
    """Many points in a few cells, copies among them, and a track through them."""
    rnd = random.Random(7)
    for k in range(700):
        yield (k, 45.0, 7.0) if k % 5 == 0 else (k, 45 + rnd.uniform(-1, 1) * 2 * r / 111, 7 + rnd.uniform(-1, 1) * 2 * r / 111)
    for k in range(40):
        yield 1000 - k, 45 + (k - 20) * 0.3 * r / 111, 7.0


@pytest.mark.parametrize(("rows", "r", "listed", "tile"), [(spots, 0.5, 16, 32), (spots, 400.0, 2, 2), (chain, 0.5, 16, 32), (chain, 0.5, 4, 8), (city, 0.5, 16, 32), (city, 0.5, 2, 2), (city, 300.0, 3, 1)])
def test_leaders_are_exact(spark, rows, r, listed, tile):
    """Spots, the poles and the date line, tracks and cities, against one point after another."""
    rows = list(rows(r))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "seq long, lat double, lon double").repartition(5)
    want = plain_leaders(rows, r)
    found, rounds = radius.leaders(df, r, listed, tile)
    assert {x.seq for x in found.collect()} == {k for k, v in want.items() if k == v}
    assert rounds <= 60
    if (listed, tile) == (16, 32):
        assert {x.seq: x.leader for x in radius.leader_cache(df, r).collect()} == want


def test_leaders_take_few_rounds(spark):
    """A track over many tiles takes a round a tile, not one a point; without a radius all points lead."""
    rows = list(chain(0.5))
    assert radius.leaders(spark.createDataFrame(rows, "seq long, lat double, lon double"), 0.5)[1] <= 8
    none = radius.leader_cache(spark.createDataFrame([*rows[:2], (9, None, 1.0)], "seq long, lat double, lon double"), 0)
    assert {x.seq: x.leader for x in none.collect()} == {0: 0, 1: 1, 9: None}
    assert radius.leader_cache(none.limit(0).selectExpr("seq", "0.0D lat", "0.0D lon")).collect() == []


def plain_pairs(rows, threshold):
    out = {}
    for i, (a, _, u) in enumerate(rows):
        for b, _, v in rows[:i]:
            if u and v and len(u) == len(v):
                s = 0.0
                for x, y in zip(u, v, strict=True):
                    s += x * y
                if s >= threshold:
                    out[min(a, b), max(a, b)] = s
    return out


def plain_clusters(ids, pairs, threshold):
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), s in pairs.items():
        if s >= threshold and a in root and b in root:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    out = {}
    for k in ids:
        out.setdefault(find(k), []).append(k)
    return {k: v for k, v in out.items() if len(v) > 1}


def plain_refined(rows, threshold, most, step=0.02, top=0.99):
    size, pairs = {k: s for k, s, _ in rows}, plain_pairs(rows, threshold)
    out = []

    def split(members, t, name):
        first = sorted(members, key=lambda k: (-size[k], k))[:most]
        if len(members) <= most:
            out.extend((k, t, name) for k in members)
            return
        following = round(t + step, 4)
        inner = plain_clusters(members, pairs, following) if following < top else {}
        if not inner:
            out.extend((k, t, name) for k in first)
        for name_, own in inner.items():
            split(own, following, name_)

    for name, own in plain_clusters([r[0] for r in rows], pairs, threshold).items():
        split(own, threshold, name)
    return sorted(out)


def vectors(kind, seed=3, n=160):
    """Vectors around a few directions, with copies, of unequal lengths and norms, null and empty ones, zeros and numbers
    that are not finite."""
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        d = 6 if kind != "mixed" or rnd.random() < 0.7 else rnd.choice([2, 3])
        way = [math.cos((k % 5) * 1.3 + j) for j in range(d)]
        v = [x + rnd.gauss(0, 0.12) for x in way]
        if kind != "norms":
            v = unit(*v)
        if out and rnd.random() < 0.25:
            v = rnd.choice(out)[2]
        out.append((k * 7 + 1, rnd.randrange(9), v))
    if kind == "mixed":
        out += [(5000, 1, None), (5001, 1, []), (5002, 2, [0.0] * 6), (5003, 2, [math.nan] + [1.0] * 5), (5004, 2, [math.inf] * 6), (5005, 3, [1.0, 0.0]), (5006, 3, [1.0, 0.0]), (5007, 3, [1.0, 0.0, 0.0])]
    rnd.shuffle(out)
    return out


VECTORS = "id long, size long, vec array<double>"


@pytest.mark.parametrize("kind", ["unit", "mixed", "norms"])
@pytest.mark.parametrize("block", [2048, 16])
def test_similar_pairs_are_exact(spark, kind, block, monkeypatch):
    monkeypatch.setattr(cluster, "SUMMARIES", 4)
    rows = vectors(kind)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    finite = [r for r in rows if r[2] and all(map(math.isfinite, r[2]))]
    for threshold in (0.9, 0.2, -0.3):
        want = plain_pairs(finite, threshold)
        got = cluster._met(cluster.packed(df, block), threshold, False).collect()
        assert {(r.a, r.b): r.sim for r in got} == want and len(got) == len(want)


def test_block_pairs_are_skipped(spark):
    rnd = random.Random(5)
    ways = [unit(*[rnd.gauss(0, 1) for _ in range(16)]) for _ in range(12)]
    df = spark.createDataFrame([(k, 1, unit(*[x + rnd.gauss(0, 0.02) for x in ways[k % 12]])) for k in range(1200)], VECTORS)
    met, every = cluster.skipped(df, 0.9, block=50)
    assert met > 0.5 * every > 100
    blind, every = cluster.skipped(df, -0.9, block=50)
    assert blind < 0.2 * every


@pytest.mark.parametrize(("kind", "small"), [("unit", 10**6), ("mixed", 10**6), ("norms", 10**6), ("mixed", 30)])
def test_clusters_are_exact(spark, kind, small):
    rows = [r for r in vectors(kind, 4) if not (r[2] and not all(map(math.isfinite, r[2])))]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    pairs = plain_pairs(rows, 0.93)
    got = cluster.clusters(df, 0.93, small).collect()
    want = plain_clusters([r[0] for r in rows], pairs, 0.93)
    assert {c: sorted(r.id for r in got if r.cluster == c) for c in {r.cluster for r in got}} == {k: sorted(v) for k, v in want.items()}
    best = {c: max(s for (a, b), s in pairs.items() if a in own) for c, own in want.items()}
    assert {r.cluster: r.max_sim for r in got} == best
    ranked = sorted(best, key=lambda c: (-best[c], c))
    assert all(r.cluster_rank == ranked.index(r.cluster) + 1 and r.n == len(want[r.cluster]) for r in got)


@pytest.mark.parametrize(("kind", "most", "small"), [("unit", 3, 10**6), ("norms", 4, 10**6), ("mixed", 2, 10**6), ("unit", 2, 25)])
def test_refined_is_exact(spark, kind, most, small):
    rows = [r for r in vectors(kind, 8) if not (r[2] and not all(map(math.isfinite, r[2])))]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted((r.id, r.threshold, r.cluster) for r in cluster.refined(df, 0.8, most, small=small).collect())
    assert got == plain_refined(rows, 0.8, most)


def test_many_copies(spark):
    """100,000 copies have a link each, not one a pair."""
    df = spark.range(100_000).select("id", (F.col("id") % 10).alias("size"), F.array(F.lit(0.6), F.lit(0.8)).alias("vec"))
    assert cluster.links(df, 0.9).count() == 99_999
    got = cluster.refined(df, 0.9, most=3).collect()
    assert sorted((r.id, r.cluster, round(r.threshold, 2)) for r in got) == [(9, 0, 0.98), (19, 0, 0.98), (29, 0, 0.98)]


@pytest.mark.parametrize("kind", ["unit", "mixed"])
def test_similarity_to_earlier_by_tiles(spark, kind, monkeypatch):
    monkeypatch.setattr(cluster, "FEW", 10)
    monkeypatch.setattr(cluster, "TILE", 7)
    rows = [r for r in vectors(kind, 2) if r[2] and all(map(math.isfinite, r[2]))]
    place, ranked, want = {}, [], {}
    for k, (i, _, _) in enumerate(rows):
        c = "small" if k % 20 == 0 else f"c{k % 2}"
        place[c] = place.get(c, 0) + 1
        ranked.append((c, i, place[c]))
    vec = {i: v for i, _, v in rows}
    for c, i, p in ranked:
        sims = [sum(x * y for x, y in zip(vec[i], vec[j], strict=True)) for d, j, q in ranked if d == c and q < p and len(vec[j]) == len(vec[i])]
        want[i] = max(sims, default=None)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = cluster.similarity_to_earlier(spark.createDataFrame(ranked, "cluster string, id long, pos int"), df).collect()
    assert {r.id: r.sim_before and round(r.sim_before, 9) for r in got} == {k: v and round(v, 9) for k, v in want.items()}


def test_keeping_and_undoing(spark):
    rows = [(1, 1, "missing", 3, True), (1, 2, "present", 3, True), (1, 3, "present", 3, False), (2, 1, "present", 2, True), (2, 2, "moved", 2, False), (3, 1, "moved", 1, True)]
    df = spark.createDataFrame(rows, "cluster int, pos int, status string, cursor int, keep boolean")
    kept = lambda p: [r.k for r in df.withColumn("k", moves.kept(df, p)).orderBy("cluster", "pos").collect()]
    assert kept("first") == [False, True, False, True, False, False] and kept("only") == [False, False, True, True, False, True]
    assert kept("all") == [True] * 6 and kept("none") == [False] * 6
    log = spark.createDataFrame([("/a", "/d/a"), ("/b", "/d/b"), ("/c", "/d/c")], "original string, moved_to string")
    have = spark.createDataFrame([("/a",), ("/d/a",), ("/d/b",)], "path string")
    assert [r.refused for r in moves.undone(log, have).orderBy("original").collect()] == ["original exists", None, "moved file is gone"]


@pytest.mark.parametrize("hubs", [100_000, 1])
def test_components_with_hubs(spark, hubs, monkeypatch):
    """Two stars of many leaves, joined by a long path, and a few others; also where hubs are too many to broadcast."""
    monkeypatch.setattr(components, "HUBS", hubs)
    edges = [(5000, k) for k in range(600, 1400)] + [(k, 9000) for k in range(2000, 2700)] + [(k, k + 1) for k in range(3000, 3300)] + [(1399, 3300), (3000, 2001), (1, 2), (2, 1), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: 1 if x < 3 else 600 for x in nodes}
