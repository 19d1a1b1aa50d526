"""Exact top-k by inner product over impact-ordered indexes, a score at a time.

Vectors become integer rows, packed into blocks. A block's index holds, for each dimension, its rows by falling
quantised impact, cut into segments. A query takes the segments of all dimensions by falling bound, adds their
contributions, and knows by how much any row's sum can still move. It stops only once all rows but a few are proven
out; the few are rescored exactly. Query blocks meet runs of index blocks by key; a query carries its k-th best score from
one block to the next, so that a block with nothing better is left sooner. Of each meeting k rows a query are kept, and the
final ranking prunes again before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumspark.session import ship

from .common import checkpointed

#: Rows of an index block, of a query block, query blocks that meet an index block at once, impact levels a dimension.
#: An index is built once for QUERIES * TOGETHER queries, which costs little beside their search. Index blocks of a run.
ROWS, QUERIES, TOGETHER, LEVELS, RUN = 8192, 512, 16, 8, 16
#: What scores are at most, either way; sums that may be larger are made of whole numbers of any length, and cut off here.
TOP = (1 << 63) - 1
_OUT = "-4611686018427387904"  # below any score

_RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class ImpactIndex:
    """An index of integer rows m [n, d] with ids; rows by id, so the first of equal scores is the smallest id."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.m = ids[order], m[order].astype(np.int64)
        dim, first, last, most, later, rows, values = [], [], [], [], [], [], []
        at = 0
        for j in range(m.shape[1]):
            v = self.m[:, j]
            a = np.abs(v)
            level = a * LEVELS // (a.max() + 1)
            by = np.argsort(-level, kind="stable")
            cuts = np.flatnonzero(np.diff(level[by])) + 1
            starts = np.concatenate([[0], cuts])
            tops = np.maximum.reduceat(a[by], starts)
            dim += [j] * len(starts)
            first += (at + starts).tolist()
            last += (at + np.append(cuts, len(v))).tolist()
            most += tops.tolist()
            later += [*tops[1:].tolist(), 0]
            rows.append(by)
            values.append(v[by])
            at += len(v)
        self.dim, self.most, self.later = (np.array(x, np.int64) for x in (dim, most, later))
        self.first, self.last = first, last
        self.rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.values = np.concatenate(values) if values else np.zeros(0, np.int64)

    def search(self, q: np.ndarray, k: int, own: int | None = None, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best rows whose id is not own, best first, smaller ids first among equals; rows below
        `least` may be left out."""
        n, d = self.m.shape
        self.steps = 0
        if n and d and float(np.abs(q.astype(float)) @ np.abs(self.m.astype(float)).max(axis=0)) >= 2.0**61:
            possible = np.flatnonzero(self.ids != own)
            scores = [max(-TOP, min(TOP, sum(map(int.__mul__, row, q.tolist())))) for row in self.m[possible].tolist()]
            exact = np.array(scores, np.int64)
            best = np.lexsort((possible, -exact))[:k]
            return possible[best], exact[best]
        floor = int(_OUT) // 2 if least is None else least
        sums = np.zeros(n, np.int64)
        out = self.ids == own
        sums[out] = int(_OUT)
        if n - out.sum() > k and d:
            weight = np.abs(q)[self.dim]
            bound = weight * self.most
            drop = weight * (self.most - self.later)
            open_ = int((np.abs(q) * np.abs(self.m).max(axis=0)).sum())
            few = max(4 * k, 64)
            for step, s in enumerate(np.argsort(-bound, kind="stable").tolist()):
                if not bound[s]:
                    open_ = 0
                    break
                at = slice(self.first[s], self.last[s])
                sums[self.rows[at]] += q[self.dim[s]] * self.values[at]
                open_ -= int(drop[s])
                self.steps = step + 1
                if step % 32 == 31:  # a row is out if it cannot reach the k-th, of this block or of those before
                    kth = max(np.partition(sums, n - k)[n - k] - open_, floor)
                    if np.count_nonzero(sums >= kth - open_) <= few:
                        break
            kth = max(np.partition(sums, n - k)[n - k] - open_, floor)
            possible = np.flatnonzero((sums >= kth - open_) & ~out)
        else:
            possible = np.flatnonzero(~out)
        exact = self.m[possible] @ q
        best = np.lexsort((possible, -exact))[:k]
        return possible[best], exact[best]


def _narrow(m: np.ndarray) -> bytes:
    """The matrix in the least whole-number type that holds it, its type first."""
    for kind in ("<i2", "<i4", "<i8"):
        if not m.size or np.abs(m).max() <= np.iinfo(kind).max:
            return kind.encode() + m.astype(kind).tobytes()
    raise AssertionError


def _wide(b: bytes, n: int) -> np.ndarray:
    m = np.frombuffer(b, b[:3].decode(), offset=3).astype(np.int64)
    return m.reshape(n, len(m) // n if n else 0)


def _same_width(*ms: np.ndarray) -> list[np.ndarray]:
    d = max(m.shape[1] for m in ms)
    return [np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in ms]


def packed_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """vec_id, v (array<long>) -> block, n, ids, m: up to `rows` vectors in each; shorter ones are filled with zeros."""

    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        task, made, held, ids = TaskContext.get().partitionId(), 0, [], []

        def block():
            d = max(map(len, held))
            m = np.zeros((len(held), d), np.int64)
            for r, v in enumerate(held):
                m[r, : len(v)] = v
            return pa.RecordBatch.from_pydict({
                "block": pa.array([task << 32 | made], pa.int64()), "n": pa.array([len(ids)], pa.int32()),
                "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "m": pa.array([_narrow(m)], pa.binary()),
            })

        for b in batches:
            for vec_id, v in zip(b.column("vec_id").to_pylist(), b.column("v"), strict=True):
                ids.append(vec_id)
                held.append(v.values.to_numpy(zero_copy_only=False))
                if len(ids) == rows:
                    yield block()
                    made, held, ids = made + 1, [], []
        if ids:
            yield block()

    return vectors.mapInArrow(run, "block long, n int, ids binary, m binary")


def numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Blocks with dense numbers from 0, and how many; a number is made for each block, not each row."""
    blocks = checkpointed(blocks)
    numbers = blocks.select("block").withColumn("at", F.row_number().over(Window.orderBy("block")) - 1)
    return blocks.join(numbers, "block").drop("block"), blocks.count()


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    Both: vec_id and v, array<long> without nulls. Rows with the query's own vec_id are not its candidates. Of
    repeated query ids the least vector counts; repeated candidates count one by one. Vectors of unequal length are
    filled with zeros. With fewer than k candidates, all are ranked; with none, the query has no row. Scores beyond 64 bits
    count as the greatest or least that 63 bits hold.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    q, n_queries = numbered(packed_blocks(queries, QUERIES))
    c, n_blocks = numbered(packed_blocks(candidates, ROWS))
    groups = -(-n_queries // TOGETHER)
    if not groups or not n_blocks:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cores = queries.sparkSession.sparkContext.defaultParallelism
    runs = min(n_blocks, max(-(-n_blocks // RUN), -(-cores // groups)))  # shorter runs where there is little to do
    q = q.withColumn("group", F.floor(F.col("at") / TOGETHER).cast("int")).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    c = c.withColumn("run", F.pmod("at", F.lit(runs))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out, kth = [], {}
        asked = [(np.frombuffer(r["ids"], np.int64), _wide(r["m"], r["n"])) for r in left.to_pylist()]
        for row in right.to_pylist():
            m, *wide = _same_width(_wide(row["m"], row["n"]), *(v for _, v in asked))
            index = ImpactIndex(np.frombuffer(row["ids"], np.int64), m)
            for (query_ids, _), vectors in zip(asked, wide, strict=True):
                for query_id, v in zip(query_ids.tolist(), vectors, strict=True):
                    at, score = index.search(v, k, query_id, kth[query_id][0] if len(kth.get(query_id, ())) == k else None)
                    out.append((np.full(len(at), query_id), index.ids[at], score))
                    kth[query_id] = sorted([*kth.get(query_id, ()), *score.tolist()])[-k:]
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=_RESULT)

    met = q.groupBy("run", "group").cogroup(c.groupBy("run", "group")).applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v = floor(scale * x); vectors that are null, or hold a null or a value that is not finite, go."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v")
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 10
"""
