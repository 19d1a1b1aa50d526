"""Similar pairs, clusters and their refinement.

Vectors are dealt to pivots, a bounded sample of them, and packed into blocks of one pivot and one length each, so a block
is narrow where vectors gather. Its middle direction, the widest angle from there and the least and greatest norm bound
every product with another block; pairs of blocks that cannot reach the threshold never meet. Those that meet are a task
each with a blocked matrix product.

Clusters need no list of all pairs. Equal vectors are one node with copies that hang on it by one link, and a meeting of
blocks returns a maximum spanning forest of its pairs, at most as many links as the blocks have rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumspark.functions.vectors import dot
from albumspark.operators.components import checkpointed, components
from albumspark.operators.forest import LINKS, SMALL, grown, heaviest, nested_components, spanning_forest

#: Rows of a block, pivots at most, block summaries that a task compares with as many others, pairs worked out at once.
BLOCK, PIVOTS, SUMMARIES, AT_ONCE = 2048, 512, 512, 1 << 20
#: Bytes of vectors of a group of blocks; links that a task holds before it makes a forest of them or hands them on.
TOGETHER, LINKS_HELD = 16 << 20, 1_000_000
#: Members of a cluster that a plain join compares, and members of a tile of larger ones.
FEW, TILE = 64, 2048


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _directions(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero stays zero) and norms."""
    norms = np.sqrt((m * m).sum(1))
    return m / np.where(norms > 0, norms, 1)[:, None], norms


def _kind(vectors: DataFrame) -> str:
    """Vectors of 32-bit floats stay so; all others become doubles."""
    kind = vectors.schema["vec"].dataType.simpleString()
    return kind if kind == "array<float>" else "array<double>"


def packed(vectors: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """vectors (id, vec) -> block, d, ids, m (rows of doubles or 32-bit floats), middle, angle, low, high (norms); checkpointed.

    Ids are distinct. Null and empty vectors are left out, and those with a null or a number that is not finite, which
    have no product with any other.
    """
    sound = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kind = _kind(vectors)
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast(kind).alias("vec")).filter(sound).withColumn("d", F.size("vec"))
    wanted = min(pivots, -(-rows.count() // block))
    sample = [r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()] if wanted > 1 else []
    known = {d: _directions(np.array([v for v in sample if len(v) == d]))[0] for d in {len(v) for v in sample}}

    def nearest(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            d, vec = b.column("d").to_numpy(), b.column("vec")
            pivot = np.zeros(len(d), np.int32)
            for n in np.unique(d).tolist():
                if n in known:
                    own = np.flatnonzero(d == n)
                    pivot[own] = (_directions(_matrix(vec.take(pa.array(own)), n).astype(float))[0] @ known[n].T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot)], names=["id", "vec", "d", "pivot"])

    dealt = rows.mapInArrow(nearest, f"id long, vec {kind}, d int, pivot int") if known else rows.withColumn("pivot", F.lit(0))
    cells = dealt.groupBy("d", "pivot").agg(F.ceil(F.count("*") / block).alias("parts"))  # a row a pivot and length
    cells = cells.withColumn("first", F.coalesce(F.sum("parts").over(Window.orderBy("d", "pivot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocked = dealt.join(F.broadcast(checkpointed(cells)), ["d", "pivot"]).select((F.col("first") + F.pmod(F.xxhash64("id"), "parts")).alias("block"), "d", "id", "vec")

    def pack(t: pa.Table) -> pa.Table:
        d = t.column("d")[0].as_py()
        m = _matrix(t.column("vec"), d)
        unit, norms = _directions(m.astype(float))
        middle = _directions(unit.sum(0, keepdims=True))[0]
        angle = float(np.arccos(np.clip(unit[norms > 0] @ middle[0], -1, 1)).max(initial=0.0)) if middle.any() else np.pi
        one = (t.column("block")[0].as_py(), d, t.column("id").to_numpy().tobytes(), m.tobytes(), middle.tobytes(), angle, float(norms.min()), float(norms.max()))
        return pa.table([pa.array([x], f.type) for x, f in zip(one, _PACKED, strict=True)], schema=_PACKED)

    return checkpointed(blocked.groupBy("block").applyInArrow(pack, "block long, d int, ids binary, m binary, middle binary, angle double, low double, high double"))


_PACKED = pa.schema([
    ("block", pa.int64()), ("d", pa.int32()), ("ids", pa.binary()), ("m", pa.binary()), ("middle", pa.binary()), ("angle", pa.float64()), ("low", pa.float64()), ("high", pa.float64()),
])


def meetings(blocks: DataFrame, threshold: float, summaries: int = SUMMARIES) -> DataFrame:
    """x, y: the pairs of blocks of one length, x <= y, whose vectors may have a product at or above the threshold.

    Vectors of two blocks are at least as far apart as the middles less both widest angles; the bound is the product of
    norms, the greatest or (where it is negative) the least, with the cosine of that.
    """
    n = blocks.count()
    groups = max(1, -(-n // summaries))
    rows = blocks.select("block", "d", "middle", "angle", "low", "high").withColumn("g", F.floor(F.col("block") / summaries))
    met = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).withColumns({"p": F.least("g", "o"), "q": F.greatest("g", "o")})

    def compare(t: pa.Table) -> pa.Table:
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        sides = {g: [r for r in t.to_pylist() if r["g"] == g] for g in (p, q)}
        x, y = [], []
        for d in {r["d"] for r in sides[p]} & {r["d"] for r in sides[q]}:
            a, b = ([r for r in sides[g] if r["d"] == d] for g in (p, q))
            middle = [np.frombuffer(b"".join(r["middle"] for r in s)).reshape(-1, d) for s in (a, b)]
            value = lambda s, c: np.array([r[c] for r in s])
            apart = np.arccos(np.clip(middle[0] @ middle[1].T, -1, 1)) - value(a, "angle")[:, None] - value(b, "angle") - 1e-7
            cosine = np.cos(np.maximum(apart, 0))
            bound = np.where(cosine > 0, np.outer(value(a, "high"), value(b, "high")), np.outer(value(a, "low"), value(b, "low"))) * cosine
            slack = 1e-9 * (1 + np.outer(value(a, "high"), value(b, "high")))
            i, j = np.nonzero(bound + slack >= threshold)
            i, j = value(a, "block")[i], value(b, "block")[j]
            own = i <= j if p == q else np.ones(len(i), bool)
            x.append(i[own])
            y.append(j[own])
        x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (x, y))
        return pa.table({"x": pa.array(np.minimum(x, y), pa.int64()), "y": pa.array(np.maximum(x, y), pa.int64())})

    return checkpointed(met.groupBy("p", "q").applyInArrow(compare, "x long, y long"))


def _products(m: np.ndarray, n: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of m and n, i < j where both are one, with a product at or above the threshold; products added from the left."""
    left, right = np.ascontiguousarray(m.T), np.ascontiguousarray(n.T)
    norms = float(np.sqrt((m * m).sum(1).max() * (n * n).sum(1).max()))
    first, across, least = m, right, threshold - 1e-9 * (1 + norms)
    if norms < 1e15:  # 32-bit floats tell most pairs that cannot reach it: some d rounding errors of the norms' product
        first, across = m.astype(np.float32), right.astype(np.float32)
        least = threshold - (m.shape[1] + 4) * 1.3e-7 * norms - 1e-6 * abs(threshold) - 1e-30
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(m), 512):
        i, j = np.nonzero(first[at : at + 512] @ across >= least)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), AT_ONCE):
            p, q = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
            sims = np.zeros(len(p))
            for x, y in zip(left, right, strict=True):
                sims += x[p] * y[q]
            own = sims >= threshold
            found.append((p[own], q[own], sims[own]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _matrix_of(row: dict) -> np.ndarray:
    """A packed block's rows, of 32-bit floats or doubles, as doubles."""
    n = len(row["ids"]) // 8
    return np.frombuffer(row["m"], "<f4" if len(row["m"]) == 4 * n * row["d"] else "<f8").astype(float).reshape(n, row["d"])


def _groups(blocks: int, largest: int, tasks: int, together: int) -> int:
    """Blocks of a group: as many as `together` bytes hold, and few enough that pairs of groups keep all tasks busy."""
    return max(1, min(together // max(1, largest), -(-blocks // math.isqrt(8 * tasks))))


def _met(blocks: DataFrame, threshold: float, forest: bool, together: int = TOGETHER) -> DataFrame:
    """a, b, sim: the similar pairs of all blocks that meet, or a forest of them a task.

    Blocks are dealt in groups. A task has the blocks of one group in memory and those of another go by, so a block is sent
    once for each group and not once for each block that it meets.
    """
    pairs, cores = meetings(blocks, threshold), blocks.sparkSession.sparkContext.defaultParallelism
    n, largest = blocks.agg(F.count("*"), F.max(F.length("m"))).first()
    each = _groups(n, largest or 0, cores, together)
    of = [F.floor(F.col("x") / each).alias("p"), F.floor(F.col("y") / each).alias("q")]
    held = pairs.groupBy(*of, F.col("x").alias("block")).agg(F.collect_set("y").alias("others")).withColumn("side", F.lit(0))
    passing = pairs.select(*of, F.col("y").alias("block")).distinct().withColumns({"others": F.lit(None).cast("array<long>"), "side": F.lit(1)})
    groups = -(-n // each)
    sides = held.unionByName(passing).join(blocks.select("block", "d", "ids", "m"), "block")
    dealt = sides.repartition(max(1, min(groups * (groups + 1) // 2, 10_000)), "p", "q").sortWithinPartitions("p", "q", "side", "block")

    def run(batches: Iterator[pa.RecordBatch]):
        now, own, found = None, {}, []

        def out() -> pa.RecordBatch:
            a, b, sim = (np.concatenate(c) for c in zip(*found, strict=True))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim)], names=["a", "b", "sim"])

        for row in (r for b in batches for r in b.to_pylist()):
            if now != (row["p"], row["q"]):
                now, own = (row["p"], row["q"]), {}
            if not row["side"]:
                own[row["block"]] = row | {"others": set(row["others"])}
                continue
            ids, right = np.frombuffer(row["ids"], np.int64), _matrix_of(row)
            for left in own.values():
                if row["block"] not in left["others"]:
                    continue
                found.append(_pairs(np.frombuffer(left["ids"], np.int64), _matrix_of(left), ids, right, threshold, left["block"] == row["block"], forest))
                if sum(len(c[0]) for c in found) > LINKS_HELD:
                    if forest:
                        found[:] = [heaviest(*(np.concatenate(c) for c in zip(*found, strict=True)))]
                    if not forest or len(found[0][0]) > LINKS_HELD // 2:
                        yield out()
        if found:
            if forest:
                found[:] = [heaviest(*(np.concatenate(c) for c in zip(*found, strict=True)))]
            yield out()

    return dealt.mapInArrow(run, LINKS)


def _pairs(ids: np.ndarray, m: np.ndarray, others: np.ndarray, n: np.ndarray, threshold: float, same: bool, forest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The similar pairs of two blocks, lesser id first, or if they are many a forest of them."""
    i, j, sims = _products(m, n, threshold, same)
    if forest and len(i) > len(m) + len(n):
        weights = np.full((len(m), len(n)), -np.inf)
        weights[i, j] = sims
        if same:
            weights[j, i] = sims
        i, j = grown(weights, same)
        sims = weights[i, j]
    a, b = ids[i], others[j]
    return np.minimum(a, b), np.maximum(a, b), sims


def similar_pairs(vectors: DataFrame, threshold: float = 0.90) -> DataFrame:
    """vectors (id, vec) -> a, b, sim: all pairs with a < b and inner product at or above the threshold; vectors of unequal
    length have none. Clusters do not need this list, which is as long as there are pairs."""
    return _met(packed(vectors), threshold, False)


def skipped(vectors: DataFrame, threshold: float = 0.90, block: int = BLOCK) -> tuple[int, int]:
    """Pairs of blocks that cannot reach the threshold and never meet, and all pairs of blocks of one length."""
    blocks = packed(vectors, block)
    every = blocks.groupBy("d").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n + 1) div 2"))).first()[0] or 0
    return every - meetings(blocks, threshold).count(), every


def links(vectors: DataFrame, threshold: float = 0.90, small: int = SMALL) -> DataFrame:
    """vectors (id, vec) -> a, b, sim: a forest that has, at every threshold from this one up, the components of all similar
    pairs, and the greatest similarity in each. Checkpointed.

    Of equal vectors the least id stands for all. A copy is linked at whatever is higher, its product with itself or its
    best with another, since it is as similar to that as the one that stands for it.
    """
    rows = vectors.filter("vec IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vec").cast(_kind(vectors)).alias("vec"))
    equal = checkpointed(rows.groupBy("vec").agg(F.min("id").alias("one"), F.count("*").alias("n")))
    found = checkpointed(spanning_forest(_met(packed(equal.select(F.col("one").alias("id"), "vec")), threshold, True), small))
    many = equal.filter("n > 1")
    if many.isEmpty():
        return found
    best = found.select(F.col("a").alias("one"), "sim").union(found.select("b", "sim")).groupBy("one").agg(F.max("sim").alias("best"))
    own = many.select("vec", "one", dot(F.col("vec"), F.col("vec")).alias("own")).join(best, "one", "left")
    weight = F.greatest("own", "best")  # of those that are not null
    hung = rows.join(own.withColumn("sim", weight).filter((F.col("sim") >= threshold) & (F.col("sim") < float("inf"))), "vec").filter("id <> one")
    return checkpointed(found.unionByName(hung.select(F.col("one").alias("a"), F.col("id").alias("b"), "sim")))


def clusters(vectors: DataFrame, threshold: float = 0.90, small: int = SMALL) -> DataFrame:
    """vectors (id, size, vec) -> cluster, id, pos, n, max_sim, cluster_rank.

    Members by size, largest first, then id. Clusters by their highest pair similarity, then id. Singletons go.
    """
    found = links(vectors, threshold, small)
    members = checkpointed(components(found.select("a", "b"), small=small).toDF("id", "cluster"))
    best = found.join(members.withColumnRenamed("id", "a"), "a").groupBy("cluster").agg(F.max("sim").alias("max_sim"))
    ranked = best.withColumn("cluster_rank", F.row_number().over(Window.orderBy(F.desc("max_sim"), "cluster")))
    rows = members.join(vectors.select("id", "size"), "id").join(ranked, "cluster")
    own = Window.partitionBy("cluster")
    return rows.withColumns({"pos": F.row_number().over(own.orderBy(F.desc("size"), "id")), "n": F.count("*").over(own)}).select("cluster", "id", "pos", "n", "max_sim", "cluster_rank")


def similarity_to_earlier(ranked: DataFrame, vectors: DataFrame) -> DataFrame:
    """ranked (cluster, id, pos from 1) with sim_before: the highest inner product with members before it; null for the
    first.

    Members of small clusters meet in a join. Those of larger ones are packed in tiles by their places, and tiles dealt in
    groups; a task has a group's tiles in memory while those of one group before it, or its own, go by, and of each member's
    greatest products the greatest stays.
    """
    rows = ranked.select("cluster", "id", F.col("pos").cast("long").alias("pos")).join(vectors.select("id", F.col("vec").cast(_kind(vectors)).alias("vec")), "id")
    counts = ranked.groupBy("cluster").agg(F.max("pos").cast("long").alias("_n"))
    large = checkpointed(counts.filter(F.col("_n") > FEW))
    few = rows.join(counts.filter(F.col("_n") <= FEW).select("cluster"), "cluster")
    before = few.select("cluster", F.col("pos").alias("p"), F.col("vec").alias("v"))
    sims = few.join(before, "cluster").filter("p < pos").groupBy("cluster", "id").agg(F.max(dot(F.col("vec"), F.col("v"))).alias("sim_before"))
    if not large.isEmpty():
        sims = sims.unionByName(_by_tiles(rows.join(large, "cluster"), rows.schema["cluster"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()))
    return ranked.join(sims, ["cluster", "id"], "left")


def _by_tiles(rows: DataFrame, cluster: str, id_: str, together: int = TOGETHER) -> DataFrame:
    """rows: cluster, id, pos, vec, _n (members of the cluster). Vectors of one length alone have products."""
    rows = rows.filter("vec IS NOT NULL").withColumns({"d": F.size("vec"), "tile": F.floor((F.col("pos") - 1) / TILE)})

    def pack(t: pa.Table) -> pa.Table:
        lists = lambda c: pa.array([t.column(c).combine_chunks().to_pylist()], pa.list_(t.schema.field(c).type))
        own = [t.column(c).slice(0, 1) for c in ("cluster", "d", "tile", "_n")]
        return pa.table([*own, lists("id"), lists("pos"), pa.array([_matrix(t.column("vec"), t.column("d")[0].as_py()).tobytes()])], names=["cluster", "d", "tile", "_n", "ids", "places", "m"])

    tiles = checkpointed(rows.groupBy("cluster", "d", "tile").applyInArrow(pack, f"cluster {cluster}, d int, tile long, _n long, ids array<{id_}>, places array<long>, m binary"))
    of = ["cluster", "d"]
    n, largest = tiles.agg(F.count("*"), F.max(F.length("m"))).first()
    each = _groups(n, largest or 0, rows.sparkSession.sparkContext.defaultParallelism, together)
    own, last = F.floor(F.col("tile") / each), F.floor(F.floor((F.col("_n") - 1) / TILE) / each)
    first = F.lit(0).cast("long")
    # A tile's own group holds it while those of the same and earlier groups go by; p is the earlier group, q the later.
    held = tiles.select("*", own.alias("q"), F.explode(F.sequence(first, own)).alias("p"), F.lit(0).alias("side"))
    passing = tiles.select("*", own.alias("p"), F.explode(F.sequence(own, last)).alias("q"), F.lit(1).alias("side"))
    dealt = held.unionByName(passing).repartition(max(1, min(-(-n // each) * (-(-n // each) + 1) // 2, 10_000)), *of, "p", "q").sortWithinPartitions(*of, "p", "q", "side", "tile")

    def run(batches: Iterator[pa.RecordBatch]):
        now, own, kinds = None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            for one in own:
                has = one["best"] > -np.inf
                ids = [k for k, h in zip(one["ids"], has.tolist(), strict=True) if h]
                yield pa.RecordBatch.from_arrays([pa.array([one["cluster"]] * len(ids), kinds[0]), pa.array(ids, kinds[1]), pa.array(one["best"][has])], names=["cluster", "id", "s"])

        for b in batches:
            kinds = b.schema.field("cluster").type, b.schema.field("ids").type.value_type
            for row in b.to_pylist():
                if now != (key := (row["cluster"], row["d"], row["p"], row["q"])):
                    yield from out()
                    now, own = key, []
                row["m"], row["places"] = np.frombuffer(row["m"], "<f4" if len(row["m"]) == 4 * len(row["ids"]) * row["d"] else "<f8").reshape(-1, row["d"]), np.array(row["places"])
                if not row["side"]:
                    own.append(row | {"best": np.full(len(row["ids"]), -np.inf)})
                    continue
                n = row["m"].astype(float).T
                for one in own:
                    if one["tile"] < row["tile"]:
                        continue
                    m, best = one["m"].astype(float), one["best"]
                    for at in range(0, len(m), 512):
                        sims = m[at : at + 512] @ n
                        sims[np.isnan(sims)] = -np.inf
                        if one["tile"] == row["tile"]:
                            sims[row["places"] >= one["places"][at : at + 512, None]] = -np.inf
                        np.maximum(best[at : at + 512], sims.max(1), out=best[at : at + 512])
        yield from out()

    found = dealt.mapInArrow(run, f"cluster {cluster}, id {id_}, s double")
    return found.groupBy("cluster", "id").agg(F.max("s").alias("sim_before"))


def refined(vectors: DataFrame, threshold: float = 0.90, most: int = 16, step: float = 0.02, top: float = 0.99, small: int = SMALL) -> DataFrame:
    """id, threshold, cluster: clusters of at most `most`; larger ones are clustered anew at a threshold higher by step, until
    none is larger.

    Where the next threshold would reach `top`, or nothing clusters any more, the first `most` members by size stay. One
    forest and one search for components serve all thresholds: a cluster's clusters at a higher threshold are the
    components of all vectors there, since these only ever fall apart.
    """
    thresholds = [threshold]
    while round(thresholds[-1] + step, 4) < top:
        thresholds.append(round(thresholds[-1] + step, 4))
    at = F.array(*[F.lit(float(t)) for t in thresholds])
    nested = checkpointed(nested_components(links(vectors, threshold, small), thresholds, small))
    last = nested.groupBy("id").agg(F.max("level").alias("last"))
    rows = nested.join(last, "id")
    of = ["level", "component"]
    found = checkpointed(rows.groupBy(*of).agg(F.count("*").alias("n"), F.min("id").alias("cluster"), F.max("last").alias("deepest")))
    fits = nested.join(found.filter(F.col("n") <= most), of).groupBy("id").agg(F.min(F.struct("level", "cluster")).alias("f"))
    fits = fits.select("id", F.col("f.level").alias("level"), F.col("f.cluster").alias("cluster"))
    # Clusters in which no pair is left at the next level keep their largest members.
    ends = found.filter((F.col("n") > most) & (F.col("deepest") == F.col("level")))
    cut = nested.join(ends, of).join(vectors.select(F.col("id").cast("long").alias("id"), "size"), "id")
    cut = cut.withColumn("pos", F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("size"), "id"))).filter(F.col("pos") <= most)
    return fits.unionByName(cut.select("id", "level", "cluster")).select("id", F.element_at(at, F.col("level") + 1).alias("threshold"), "cluster")
