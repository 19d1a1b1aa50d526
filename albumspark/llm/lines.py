"""Line dedup through a sharded minimal perfect hash.

Pass one gathers, for each line key's 128-bit hash, the least and greatest document that holds it and a count; keys of
one document go. The rest are dealt over shards, and each shard becomes an index: a minimal perfect hash over its
hashes, an array of fingerprints, one of first documents and one of counts. Pass two packs the line hashes of many
documents by shard; a shard's index probes them as arrays, and only repeated lines come back, each with its first
document. Probes of a shard are also dealt over salts, each with its own copy of the index, so that a line which a third
of all documents hold is spread; there are as many salts as keep the probes of one below a fixed number of bytes. A
foreign key passes for a member with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumspark.session import ship

from .common import batch, checkpointed, free_names, lower_ascii, sliced, texts, tidied

#: Code points of a key at least; keys of a shard; shards at least; copies of a shard's index at least.
SHORTEST, SHARD, SHARDS, SALTS = 10, 1 << 16, 64, 16
#: Text bytes whose probes meet one copy of an index, some half of them in probes over all shards; text bytes at once.
TEXT, SLICE = 64 << 20, 4 << 20
#: Stands for a null doc_id, after all others.
LAST = (1 << 63) - 1

_SPACE = b" \t\n\v\f\r"
_KEYS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64())])
_PROBES = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("hashes", pa.binary()), ("rows", pa.binary())])
_FOUND = pa.schema([("row", pa.int64()), ("key", pa.binary())])


def key_hash(line: bytes) -> bytes | None:
    """The hash of a line's key; None for keys that are too short."""
    key = lower_ascii(line.strip(_SPACE))
    if len(key) < SHORTEST or len(key) < 4 * SHORTEST and len(key.decode()) < SHORTEST:
        return None
    return xxhash.xxh3_128_digest(key)


def _hashes_of(text: bytes) -> set[bytes]:
    return {h for line in text.split(b"\n") if (h := key_hash(line))}


class PerfectHash:
    """A minimal perfect hash over distinct pairs: levels of bits, each for the pairs that collided above it."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        at, rest = 0, np.arange(len(h1))
        while len(rest):
            size = max(64, int(1.6 * len(rest)) + 63 & ~63)
            place = self._place(h1[rest], h2[rest], len(self.levels), size)
            bits = np.bincount(place, minlength=size) == 1
            ranks = at + np.cumsum(bits) - bits
            self.levels.append((size, bits, ranks.astype(np.uint32)))
            at, rest = at + int(bits.sum()), rest[~bits[place]]
        self.n = at

    @staticmethod
    def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % (1 << 64))
        x = h1.astype(np.uint64) + h2.astype(np.uint64) * odd
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed: the mixer of splitmix64
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slots from 0 to n - 1 of members, each its own; any slot or -1 for others."""
        out, rest = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (size, bits, ranks) in enumerate(self.levels):
            place = self._place(h1[rest], h2[rest], level, size)
            hit = bits[place]
            out[rest[hit]] = ranks[place[hit]]
            rest = rest[~hit]
        return out


class LineIndex:
    """Over a shard's keys (h1, h2): fingerprints (h2), first documents and counts, in the slots of a perfect hash."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.hash = PerfectHash(h1, h2)
        slot = self.hash(h1, h2)
        self.fingerprint, self.first, self.count = np.empty(len(h1), np.int64), np.empty(len(h1), np.int64), np.empty(len(h1), np.int64)
        self.fingerprint[slot], self.first[slot], self.count[slot] = h2, first, count

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions that hit a key which counts at least twice, and the first document of each."""
        if not self.hash.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = self.hash(h1, h2)
        hit = np.flatnonzero((slot >= 0) & (self.fingerprint[slot] == h2) & (self.count[slot] > 1))
        return hit, self.first[slot[hit]]

    def to_bytes(self) -> bytes:
        """Levels as packed bits; ranks are made anew."""
        sizes = np.array([len(self.hash.levels), *(x[0] for x in self.hash.levels)], np.int64)
        return b"".join([sizes.tobytes(), *(np.packbits(x[1]).tobytes() for x in self.hash.levels), self.fingerprint.tobytes(), self.first.tobytes(), self.count.tobytes()])

    @classmethod
    def from_bytes(cls, b: bytes) -> LineIndex:
        self, levels = cls.__new__(cls), np.frombuffer(b, np.int64, 1)[0]
        sizes = np.frombuffer(b, np.int64, levels, 8).tolist()
        at, rank, self.hash = 8 + 8 * levels, 0, PerfectHash(np.zeros(0, np.int64), np.zeros(0, np.int64))
        for size in sizes:
            bits = np.unpackbits(np.frombuffer(b, np.uint8, size // 8, at)).astype(bool)
            self.hash.levels.append((size, bits, (rank + np.cumsum(bits) - bits).astype(np.uint32)))
            at, rank = at + size // 8, rank + int(bits.sum())
        self.hash.n = rank
        self.fingerprint, self.first, self.count = (np.frombuffer(b, np.int64, rank, at + k * 8 * rank) for k in range(3))
        return self


def repeated_keys(docs: DataFrame) -> DataFrame:
    """docs (id, text) -> h1, h2, low, n: the keys that at least two documents hold, and the least of these."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in sliced(batches, SLICE):
            found: dict[bytes, list[int]] = {}
            for doc, text in zip(b.column("id").to_pylist(), texts(b.column("text")), strict=True):
                for h in _hashes_of(text):
                    if x := found.get(h):
                        x[0], x[1], x[2] = min(x[0], doc), max(x[1], doc), x[2] + 1
                    else:
                        found[h] = [doc, doc, 1]
            h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            rest = np.array([*found.values()], np.int64).reshape(-1, 3)
            yield batch(_KEYS, h[:, 0], h[:, 1], *rest.T)

    parts = docs.select("id", "text").mapInArrow(tidied(run), "h1 long, h2 long, low long, high long, n long")
    keys = parts.groupBy("h1", "h2").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    return keys.filter("low < high").drop("high")


def line_index(keys: DataFrame) -> tuple[DataFrame, int]:
    """shard, index of every shard that has keys; and how many shards there are."""
    keys = checkpointed(keys)
    shards = max(SHARDS, -(-keys.count() // SHARD))

    def build(t: pa.Table) -> pa.Table:
        h1, h2, low, n = (t.column(c).to_numpy() for c in ("h1", "h2", "low", "n"))
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "index": pa.array([LineIndex(h1, h2, low, n).to_bytes()], pa.binary())})

    return keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, "shard int, index binary"), shards


def found_keys(docs: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """docs (row, text) -> row, key: the repeated keys of each row's text, as the 16 bytes of the hash and the 8 of the
    least document that holds it."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    salts = max(SALTS, -(-total // (shards * TEXT)))

    def ask(batches: Iterator[pa.RecordBatch]):
        task = TaskContext.get().partitionId()
        for k, b in enumerate(sliced(batches, SLICE)):
            found, rows = [], []
            for row, text in zip(b.column("row").to_pylist(), texts(b.column("text")), strict=True):
                own = _hashes_of(text)
                found += own
                rows += [row] * len(own)
            h, rows = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2), np.array(rows, np.int64)
            shard = np.mod(h[:, 0], shards)
            by = np.argsort(shard, kind="stable")
            own, at = np.unique(shard[by], return_index=True)
            cut = [by[x:y] for x, y in zip(at, [*at[1:], len(by)], strict=True)]
            yield batch(_PROBES, own, [(task + k) % salts] * len(own), [h[c].tobytes() for c in cut], [rows[c].tobytes() for c in cut])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        for blob in held.column("index").to_pylist():
            index = LineIndex.from_bytes(blob)
            for hashes, rows in zip(asked.column("hashes").to_pylist(), asked.column("rows").to_pylist(), strict=True):
                h, rows = np.frombuffer(hashes, np.int64).reshape(-1, 2), np.frombuffer(rows, np.int64)
                hit, first = index.probe(h[:, 0], h[:, 1])
                out.append((rows[hit], np.column_stack([h[hit], first])))
        rows, keys = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros((0, 3), np.int64))
        keys = pa.Array.from_buffers(pa.binary(24), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary())
        return pa.Table.from_arrays([pa.array(rows), keys], schema=_FOUND)

    asked = docs.select("row", "text").mapInArrow(tidied(ask), "shard int, salt int, hashes binary, rows binary")
    held = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return asked.groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt")).applyInArrow(answer, "row long, key binary")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Every document with n_lines, n_dropped and kept, the text of the lines that stay.

    Lines end at \\n; null and empty texts are one empty line. A key is a line without ASCII white space at its ends,
    A-Z lowered; keys of at least 10 code points that at least two doc_ids hold go from all but the smallest. Rows of
    one doc_id are one document. Null doc_ids together are one document, after all others. Columns of docs pass
    through, whatever their names, but for any named n_lines, n_dropped or kept. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept")])
    row, gone = free_names(docs, "_row", "_gone")
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    own_row = F.xxhash64("doc_id", "text")  # where two rows share it, each takes from the keys of both what is its own
    slim = docs.select(own_id.alias("id"), own_row.alias("row"), "text")
    index, shards = line_index(repeated_keys(slim))
    found = found_keys(slim, index, shards).groupBy(F.col("row").alias(row)).agg(F.collect_set("key").alias(gone))
    joined = docs.withColumn(row, own_row).join(found, row, "left")
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]):
        for b in sliced(batches, SLICE):
            lines, dropped, kept = [], [], []
            ids, found = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", gone))
            for doc, text, keys in zip(ids, texts(b.column(b.schema.get_field_index("text"))), found, strict=True):
                own = text.split(b"\n")
                lines.append(len(own))
                if keys:
                    doc = LAST if doc is None else int(doc)
                    hashes = {k[:16] for k in keys if int.from_bytes(k[16:], "little", signed=True) < doc}
                    if hashes:
                        own = [x for x in own if key_hash(x) not in hashes]
                        text = b"\n".join(own)
                dropped.append(lines[-1] - len(own))
                kept.append(text)
            more = [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], *more], names=[*columns, "n_lines", "n_dropped", "kept"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.select(*[F.col(f"`{c}`") for c in (*columns, gone)]).mapInArrow(tidied(run), f"{kinds}, n_lines long, n_dropped long, kept string")


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, r.first IS NOT NULL AND k.doc_id > r.first AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
