"""Maximum spanning forests of weighted links, and the components of all thresholds at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumspark.operators.components import checkpointed, components

#: Links that one task takes at most; beyond, links are worked on in rounds.
SMALL = 1_000_000
LINKS = "a long, b long, sim double"


def grown(weights: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The links of a maximum spanning forest, as rows and columns of a matrix of weights in which -inf is no link.

    Rows and columns are the same nodes, of a symmetric matrix, or else nodes of their own. A tree grows by the heaviest
    link that leaves it (Prim).
    """
    rows, columns = weights.shape
    across = weights if same else np.ascontiguousarray(weights.T)
    n = rows if same else rows + columns
    linked = np.isfinite(weights).any(1) if same else np.append(np.isfinite(weights).any(1), np.isfinite(weights).any(0))
    left, best, came, free = linked.nonzero()[0].tolist(), np.full(n, -np.inf), np.zeros(n, np.int64), linked.copy()
    found, at = [], 0
    for _ in range(len(left)):
        u = int(best.argmax())
        if best[u] == -np.inf:
            while not free[left[at]]:
                at += 1
            u = left[at]
        else:
            found.append((came[u], u))
        free[u], best[u] = False, -np.inf
        if same:
            to, w = slice(0, n), weights[u]
        elif u < rows:
            to, w = slice(rows, n), weights[u]
        else:
            to, w = slice(0, rows), across[u - rows]
        better = (w > best[to]) & free[to]
        best[to][better], came[to][better] = w[better], u
    ends = np.array(found, np.int64).reshape(-1, 2)
    return (ends[:, 0], ends[:, 1]) if same else (ends.min(1), ends.max(1) - rows)


def _forest(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Which links x, y make a forest, heaviest first (Kruskal), of equal ones those with the greatest a and b."""
    order = np.lexsort((-b, -a, -sim))
    ends = np.unique(np.concatenate([x, y]), return_inverse=True)[1].reshape(2, -1).T[order].tolist()
    root, kept = list(range(2 * len(x))), []
    for k, (p, q) in enumerate(ends):
        while root[p] != p:
            root[p] = p = root[root[p]]
        while root[q] != q:
            root[q] = q = root[root[q]]
        if p != q:
            root[p] = q
            kept.append(k)
    return order[kept]


def heaviest(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A maximum spanning forest of some links."""
    own = _forest(a, b, a, b, sim)
    return a[own], b[own], sim[own]


def _heaviest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of all links."""
    t = pa.Table.from_batches(list(batches), pa.schema([("x", pa.int64()), ("y", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())]))
    x, y, a, b, sim = (t.column(c).to_numpy() for c in ("x", "y", "a", "b", "sim"))
    own = _forest(x, y, a, b, sim)
    yield pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(b[own]), pa.array(sim[own])], names=["a", "b", "sim"])


def spanning_forest(links: DataFrame, small: int = SMALL) -> DataFrame:
    """links (a, b, sim) -> the links of a maximum spanning forest: of all paths between two nodes, it holds one whose
    lightest link is the heaviest. So its links at or above a threshold have the components of all links there.

    In each round (Borůvka) every component takes its heaviest link, of equal ones that with the greatest ends, and what
    it joins becomes one; of parallel links the heaviest stays. Rounds go with the logarithm of the nodes. Once at most
    `small` links are left, one task ends it. A link stands in links once.
    """
    left = checkpointed(links.select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b", "sim"))
    found = None
    while left.count() > small:
        by = F.struct("sim", "a", "b")
        best = left.select("x", by.alias("l")).union(left.select("y", by)).groupBy("x").agg(F.max("l").alias("l"))
        best = checkpointed(best.select("l.a", "l.b", "l.sim").distinct())
        ends = left.join(best.select("a", "b"), ["a", "b"], "left_semi").select(F.col("x").alias("a"), F.col("y").alias("b"))
        own = checkpointed(components(ends, small=small))
        found = best if found is None else found.unionByName(best)
        for c in ("x", "y"):
            left = left.join(own.select(F.col("node").alias(c), F.col("component").alias("_c")), c).drop(c).withColumnRenamed("_c", c)
        left = left.filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), by.alias("l"))
        left = checkpointed(left.groupBy("x", "y").agg(F.max("l").alias("l")).select("x", "y", "l.*"))
    rest = left.select("x", "y", "a", "b", "sim").coalesce(1).mapInArrow(_heaviest, LINKS)
    return rest if found is None else found.select("a", "b", "sim").unionByName(rest)


#: Levels at most, of which a node's number leaves room.
LEVELS = 64


def nested_components(forest: DataFrame, thresholds: list[float], small: int = SMALL) -> DataFrame:
    """forest (a, b, sim) -> id, level, component (a number of its own) of every node that has a link at or above the
    level's threshold; thresholds ascend.

    A node is one node a level, linked there as the forest is, so one search finds the components of all thresholds, in
    as many rounds as one threshold takes.
    """
    if len(thresholds) > LEVELS:
        raise ValueError(f"at most {LEVELS} thresholds")
    level = F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col("sim"))) - 1
    links = checkpointed(forest.withColumn("level", level).filter("level >= 0").select("a", "b", "level"))
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    numbered = checkpointed(checkpointed(ids).withColumn("n", F.monotonically_increasing_id() * LEVELS))  # far below 2**63
    for c in ("a", "b"):
        links = links.join(numbered.select(F.col("id").alias(c), F.col("n").alias(f"n{c}")), c)
    every = links.select("na", "nb", F.explode(F.sequence(F.lit(0), "level")).alias("k")).select((F.col("na") + F.col("k")).alias("a"), (F.col("nb") + F.col("k")).alias("b"))
    found = components(every, small=small).select((F.col("node") - F.pmod("node", F.lit(LEVELS))).alias("n"), F.pmod("node", F.lit(LEVELS)).cast("int").alias("level"), "component")
    return found.join(numbered, "n").select("id", "level", "component")
