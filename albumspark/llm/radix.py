"""Sorted arrays of keys, merged over all blocks of a corpus and answered back to each block, in rows linear in the blocks.

A block cuts its keys by the lowest digit of a hash, base 64, into an array a shard. 64 arrays of a shard become one, of
64 blocks, which is cut by the next digit, and so on until one array of each shard stands for all blocks. An array thus
has the keys of a sixty-fourth of a block at most on every level, and a level has 64 rows a block at most, so that rows
grow with the blocks times the levels, the logarithm of the blocks: a corpus of 64 blocks has one level, of 4096 two.
Answers to the last arrays go back the same way: what is known of a merged array's keys is looked up by the arrays that
it was made of. Nothing is copied for each block, and no task holds more than 64 arrays and what they become.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, stored, tidied_cogroup, tidied_group

#: Arrays merged at once, which is also the number of shards of a block and the values of a digit.
FAN = 64


def shrink(x: np.ndarray) -> bytes:
    """Bytes of the values plane by plane, compressed; sorted keys and small counts take little."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def grow(b: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def cut_by(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    by = np.argsort(shard, kind="stable")
    own, first = np.unique(shard[by], return_index=True)
    if not len(own):
        return []
    return [(int(s), by[a:b]) for s, a, b in zip(own, first, [*first[1:], len(by)], strict=True)]


def digit(h: np.ndarray, level: int, fan: int = FAN) -> np.ndarray:
    """The shard of a hash on level 0, and what tells its shard on each further level from that below."""
    return (h // np.uint64(fan**level) % np.uint64(fan)).astype(np.int64)


#: (rows of arrays, whether these are all) to the distinct keys in order, and to the other columns of any of these keys.
Union = Callable[[Iterator[dict], bool], tuple[np.ndarray, Callable[[np.ndarray], tuple]]]


def merged(arrays: DataFrame, blocks: int, schema: pa.Schema, ddl: str, union: Union, hashed: Callable[[dict, np.ndarray], np.ndarray], fan: int = FAN) -> list[DataFrame]:
    """The arrays of each level, from the blocks' own to those, one a shard, of all blocks. All but the last are stored.

    arrays: any of (kind, shard), then block, keys and others, like `schema`. hashed: the hash that deals a row's keys.
    """
    by = [c for c in ("kind", "shard") if c in arrays.columns]
    levels = [arrays]
    while True:
        blocks = -(-blocks // fan)
        rows = levels[-1].withColumn("block", F.floor(F.col("block") / fan)).groupBy(*by, "block")
        made = rows.applyInArrow(tidied_group(_merger(len(levels), blocks <= 1, by, schema, union, hashed, fan)), ddl)
        if blocks <= 1:
            return [*levels, made]
        levels.append(stored(made))


def _merger(level: int, last: bool, by: list[str], schema: pa.Schema, union: Union, hashed: Callable[[dict, np.ndarray], np.ndarray], fan: int):
    def run(t: pa.Table) -> pa.Table:
        one = t.select([*by, "block"]).slice(0, 1).to_pylist()[0]
        keys, others = union((t.slice(k, 1).to_pylist()[0] for k in range(t.num_rows)), last)
        if last:
            parts = [(one["shard"], np.arange(len(keys)))]
        else:
            parts = [(one["shard"] + d * fan**level, at) for d, at in cut_by(digit(hashed(one, keys), level, fan))]
        rows = [({**one, "shard": s}, at) for s, at in parts]
        columns = [(*(row[c] for c in by), row["block"], shrink(keys[at]) if len(at) else b"", *others(at)) for row, at in rows]
        return pa.Table.from_batches([batch(schema, *zip(*columns, strict=True))] if columns else [], schema)

    return run


#: (rows of answers to arrays that cover some keys between them) to the answer to any array of these keys.
Look = Callable[[list[dict]], Callable[[np.ndarray], tuple]]


def answered(levels: list[DataFrame], top: DataFrame, schema: pa.Schema, ddl: str, look: Look, fan: int = FAN) -> DataFrame:
    """Answers to the arrays of the first level, without their keys, from those to the last, `top`, with theirs.

    Both have any of (kind, shard), then block, keys and the answer's own columns, like `schema`.
    """
    by = [c for c in ("kind", "shard") if c in top.columns]
    answers = top
    for level in range(len(levels) - 2, -1, -1):
        asked = levels[level].select(*by, "block", "keys").withColumn("group", F.floor(F.col("block") / fan))
        held = answers.withColumn("group", F.col("block")).withColumn("shard", F.pmod("shard", F.lit(fan ** (level + 1))).cast("int"))
        answers = asked.groupBy(*by, "group").cogroup(held.groupBy(*by, "group")).applyInArrow(tidied_cogroup(_answerer(level, by, schema, look)), ddl)
    return answers


def _answerer(level: int, by: list[str], schema: pa.Schema, look: Look):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.Table.from_batches([], schema)
        find, rows = look(held.to_pylist()), []
        for row in asked.to_pylist():
            rows.append((*(row[c] for c in by), row["block"], row["keys"] if level else None, *find(grow(row["keys"], "<u8"))))
        return pa.Table.from_batches([batch(schema, *zip(*rows, strict=True))], schema)

    return run


def joined(keys: list[np.ndarray], *others: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sorted arrays without a key in common as one, and what goes with them."""
    if len(keys) == 1:
        return keys[0], *(x[0] for x in others)
    k = np.concatenate(keys)
    by = np.argsort(k, kind="stable")
    return k[by], *(np.concatenate(x)[by] for x in others)
