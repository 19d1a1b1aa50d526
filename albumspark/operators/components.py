"""Connected components by alternating large-star and small-star, on edge tables of any size."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumspark.session import checkpoint_dir

#: Edges of a partition, where there are few.
EDGES = 100_000


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder; lost executors cannot lose them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(spark: SparkSession) -> None:
    """Let Spark remove the shuffles and checkpoints of frames that are gone; else they stay until the driver happens to
    collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a"))


#: Links of a node from which it counts as a hub; hubs that are broadcast at most.
HUB, HUBS = 256, 100_000


def _linked(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs (node, other) with m, the node's least. Hubs, if they are not too many, meet their pairs where these lie, so
    no task gets all links of one node; else AQE splits what is skewed."""
    hubs = checkpointed(least.filter(F.col("n") > HUB).select("node", "m"))
    least = least.select("node", "m")
    if not 0 < hubs.count() <= HUBS:
        return pairs.join(least, "node")
    rest = pairs.join(F.broadcast(hubs.select("node")), "node", "left_anti").join(least, "node")
    return rest.unionByName(pairs.join(F.broadcast(hubs), "node"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least of its neighbours and itself."""
    pairs = _both(edges).toDF("node", "other")
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("m"), F.count("*").alias("n"))
    made = _linked(pairs, least).filter("other > node").select(F.col("other").alias("a"), F.col("m").alias("b"))
    return made.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node's smaller neighbours, and itself, to the least of them."""
    pairs = edges.toDF("node", "other")
    least = pairs.groupBy("node").agg(F.min("other").alias("m"))
    made = pairs.join(least, "node").select(F.col("other").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return made.filter("a <> b").distinct()


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these links, and the least node that each can reach."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in ends.reshape(2, -1).T.tolist():
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
    for k, x in enumerate(root):  # a root comes before what points at it
        root[k] = root[x]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        found = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if found:
            node, component = joined(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(component, pa.int64())], names=["node", "component"])

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, most: int = 50, small: int = 0) -> DataFrame:
    """edges (a, b), long -> node, component: the least node reachable. Self-links and repeats do no harm.

    Each round is cut by a checkpoint in the shared folder, and the one before it is let go. Few edges go into few
    partitions. It ends once the edges are stars on their least nodes, after some log^2 of the longest path in rounds at
    most, in practice fewer than log; over `most` rounds, which no table has taken, it raises an error. At most `small`
    edges, if there are no more, are joined in one task instead.
    """
    ordered = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    edges = checkpointed(edges.filter("a <> b").select(*ordered).distinct())
    n = edges.count()
    if n <= small:
        return _in_one_task(edges)
    parts = max(1, -(-n // EDGES))
    for _ in range(most):
        large = _large_star(edges).select(*ordered).distinct()
        new = checkpointed(_small_star(large).select(*ordered).distinct().coalesce(parts))
        # Stars: every node has one link, and no centre has a link of its own to a smaller node.
        marks = new.select(F.col("a").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(new.select("b", F.lit(0), F.lit(1)).distinct())
        odd = marks.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).filter("leaf > 1 OR leaf = 1 AND centre = 1")
        edges, done = new, odd.isEmpty()
        del large, marks, odd
        freed(edges.sparkSession)
        if done:
            break
    else:
        raise RuntimeError(f"components not done in {most} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
