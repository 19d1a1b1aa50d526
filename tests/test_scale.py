"""Operators in parts, tiles and rounds, as large tables have them, against plain ways."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from albumspark.functions.vectors import dot
from albumspark.llm import simhash
from albumspark.operators import cluster, components, radius
from albumspark.plans import registry, through_files


def test_ranked_in_radius_holds_parts_of_a_cell(spark):
    """Points of one cell in many parts, places that go by in tiles; vectors that are null, hold nulls or NaN, or are shorter."""
    rnd = random.Random(11)
    vec = lambda: rnd.choice([None, [1.0, None], [2.0], [float("nan"), 1.0], [float("inf"), 0.0]]) if rnd.random() < 0.2 else [float(rnd.randrange(-2, 3)), float(rnd.randrange(-2, 3))]
    spot = lambda: (48 + rnd.random() / 10, 2 + rnd.random() / 10)
    points = spark.createDataFrame([(k, *spot(), vec()) for k in range(150)] + [(150, None, 2.0, [1.0, 1.0])], "id long, lat double, lon double, vec array<double>")
    places = spark.createDataFrame([(k, f"n{k}", *spot(), vec()) for k in range(120)], "ord long, name string, place_lat double, place_lon double, place_vec array<double>")
    pairs = radius.radius_join(points, places, 3.0).withColumn("score", dot(F.col("vec"), F.col("place_vec")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "ord"))
    want = sorted(map(str, pairs.withColumn("rank", rank).filter("rank <= 4").select("id", "rank", "ord", "name", "score").collect()))
    got = radius.ranked_in_radius(points, places, 4, 3.0, held=10)
    assert sorted(map(str, got.select("id", "rank", "ord", "name", "score").collect())) == want and len(want) > 500
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "ATAN2" not in plan.upper()  # pairs are worked out in tasks and are no rows of a join


def test_tree_stores_equal_contents_once(spark):
    at = through_files._tree(spark, "/root/testdata/sf0.001")
    found = [p for p in Path(at.removeprefix("file:")).rglob("*") if p.is_file()]
    assert len(found) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert len({p.stat().st_ino for p in found}) <= 100 * spark.sparkContext.defaultParallelism < len(found)
    for p in found:
        k = int(re.search(r"\d+", p.name)[0])
        assert p.read_text() == (through_files._FILM if k % 7 == 0 else "x") + "x" * (k % 50)


def test_scan_files_in_rounds(spark, monkeypatch):
    whole = sorted(map(str, through_files.scan_files(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(through_files, "AT_A_TIME", 400)
    grown, felled = [], []
    grow, fell = through_files._tree, through_files._felled
    monkeypatch.setattr(through_files, "_tree", lambda *a, **b: grown.append(grow(*a, **b)) or grown[-1])
    monkeypatch.setattr(through_files, "_felled", lambda *a: felled.append(len(list(Path(a[-1].removeprefix("file:")).rglob("*")))) or fell(*a))
    assert sorted(map(str, through_files.scan_files(spark, "/root/testdata/sf0.001").collect())) == whole
    assert len(grown) == 4 and max(felled) < 900 and not any(Path(at.removeprefix("file:")).exists() for at in grown)


def test_rows_at_one_place_stand_together(spark):
    rows = spark.createDataFrame([(k, None if k % 7 == 0 else float(k % 2), "x") for k in range(300)], "id long, lat double, n string")
    got = radius.by_place(rows, ["lat"], "ids", together=10).collect()
    assert len(got) > 20 and max(len(r.ids) for r in got) < 40
    assert sorted((x.id, r.lat is None, r.lat or 0, x.n) for r in got for x in r.ids) == sorted((k, k % 7 == 0, float(k % 2) if k % 7 else 0, "x") for k in range(300))


def test_distances_are_worked_out_once_a_place(spark, tmp_path):
    """Copies of customers and suppliers, so that many stand at one place."""
    sf = "/root/testdata/sf0.001"
    for t, key, n in (("customer", "c_custkey", 3600), ("supplier", "s_suppkey", 3600)):
        own = spark.read.parquet(f"{sf}/{t}.parquet").withColumn("r", F.explode(F.array(*map(F.lit, range(4)))))
        own.withColumn(key, F.col(key) + F.col("r") * n).drop("r").write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in ("haversine", "radius_join"):
        whole, own = (getattr(registry, name)(spark, at) for at in (str(tmp_path), sf))
        assert whole.count() == 16 * own.count() > 0
        assert whole.select(F.col("id") % 3600, F.col("ord") % 3600, "km").distinct().count() == own.count()
        plan = whole._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("ATAN2")  # rows are made of what was worked out


def test_nearest_place_by_place(spark):
    rnd = random.Random(3)
    points = spark.createDataFrame([(k, rnd.randrange(4) / 100, rnd.randrange(4) / 100) for k in range(200)], "id long, lat double, lon double")
    places = spark.createDataFrame([(k, rnd.randrange(5) / 100, rnd.randrange(5) / 100) for k in range(60)], "ord long, place_lat double, place_lon double")
    pairs = radius.radius_join(points, places, 2.0)
    want = pairs.groupBy("id").agg(F.min(F.struct("distance_km", "ord")).alias("b")).select("id", "b.ord", "b.distance_km")
    got = radius.nearest_place(points, places, 2.0)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "id#" not in got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1].split("Project")[0]


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_blocks_are_sent_once_a_group(spark, monkeypatch, kind):
    rnd = random.Random(8)
    df = spark.createDataFrame([(k, [rnd.gauss(0, 1) for _ in range(3)]) for k in range(300)], "id long, vec array<double>").withColumn("vec", F.col("vec").cast(kind))
    vec = {r.id: r.vec for r in df.collect()}
    blocks = cluster.packed(df, 20)
    n = blocks.count()
    size = (8 if kind == "array<double>" else 4) * 3 * 20
    want = {(a, b) for a in vec for b in vec if a < b and sum(x * y for x, y in zip(vec[a], vec[b], strict=True)) >= 1.5}
    for together in (1, 4 * size, 1 << 20):
        assert {(r.a, r.b) for r in cluster._met(blocks, 1.5, False, together).collect()} == want
    forest = [(r.a, r.b) for r in cluster._met(blocks, 1.5, True, 1 << 20).collect()]
    assert len(forest) == len(set(forest)) and set(forest) < want
    assert sorted(map(str, components.components(spark.createDataFrame(forest, "a long, b long")).collect())) == sorted(map(str, components.components(spark.createDataFrame(sorted(want), "a long, b long")).collect()))
    assert cluster._groups(400, 1 << 19, 8, 16 << 20) == 32 and cluster._groups(n, size, 8, 16 << 20) < n


def test_similarity_to_earlier_by_groups_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(cluster, "TILE", 7)
    rnd = random.Random(9)
    ranked = [(c, 1000 * c + k, k + 1) for c in (1, 2) for k in range(90)]
    vec = {i: [rnd.gauss(0, 1) for _ in range(rnd.choice((2, 3)))] for _, i, _ in ranked}
    want = {}
    for c, i, p in ranked:
        own = [sum(x * y for x, y in zip(vec[i], vec[o], strict=True)) for d, o, q in ranked if d == c and q < p and len(vec[o]) == len(vec[i])]
        want[i] = max(own, default=None)
    rows = spark.createDataFrame([(c, i, p, vec[i], 90) for c, i, p in ranked], "cluster long, id long, pos long, vec array<double>, _n long")
    for together in (1, 500, 1 << 20):
        got = {r.id: r.sim_before for r in cluster._by_tiles(rows, "bigint", "bigint", together).collect()}
        assert got == {i: pytest.approx(x) for i, x in want.items() if x is not None}


def test_one_of_each_takes_pairs_of_near_simhashes(spark):
    """Fingerprints within two bits make pairs; of these, sets that are not similar do not make one document."""
    rnd = random.Random(4)
    base = "alpha beta gamma delta epsilon zeta eta " * 400
    docs = [(k, base + " ".join(f"x{rnd.randrange(10**9)}" for _ in range(30))) for k in range(4)] + [(k, base) for k in (7, 8)] + [(9, " ".join(f"y{k}" for k in range(50)))]
    prints = {k: simhash.fingerprint(t.encode(), 3) for k, t in docs}
    near = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2}
    assert {(a, b) for a in range(3) for b in range(a + 1, 4)} <= near and not any(9 in p for p in near)
    nodes = spark.createDataFrame(list(prints.items()), "uid long, fp long")
    links = [(r.a, r.b) for r in simhash._by_print(nodes, 2).collect()]
    assert {tuple(sorted(x)) for x in links} <= near
    joined = {frozenset(r.ids) for r in components.components(spark.createDataFrame(links, "a long, b long")).groupBy("component").agg(F.collect_set("node").alias("ids")).collect()}
    assert joined == {frozenset(range(4)) | {7, 8}}
    assert sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == [0, 1, 2, 3, 7, 9]
