"""Near duplicates by SimHash under covering masks.

A fingerprint has 64 bits. Give each bit a vector of radius + 1 bits; each non-zero vector v makes a mask, of the bits
whose vectors have an odd product with v. Any `radius` differing bits leave some v orthogonal to all of them, so two
fingerprints within the radius agree under some mask, always. Documents meet by fingerprint first, so copies count
once; fingerprints meet in buckets of (mask, masked bits). A bucket that is too large is dealt anew under a second
family of masks on top of the first, which covers the radius again and leaves so few free bits that its size is
bounded. Inside a bucket, all distances are taken in blocks and only a spanning forest of the links leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumspark.operators.components import components
from albumspark.session import ship

from .common import WORD_RE, batch, checkpointed, free_name, freed, lower_ascii, sliced, stored, texts, tidied

#: Fingerprints of a bucket, beyond which it is dealt anew.
BUCKET = 4096
SEED = 42
#: Bytes of text at once.
SLICE = 4 << 20

_PRINTS = pa.schema([("fp", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(text: bytes, words: int) -> list[bytes]:
    """Shingles in order, repeats included; fewer words: the whole sequence; none: none."""
    w = WORD_RE.findall(lower_ascii(text))
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    if words == 3:
        return list(map(b"%b %b %b".__mod__, zip(w, w[1:], w[2:], strict=False)))
    return [b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)]


_h = xxhash.xxh64_intdigest


def fingerprint(text: bytes, words: int) -> int:
    """The SimHash of a text as a signed long: a bit is 1 if set in over half of the shingles' hashes."""
    own = shingles(text, words)
    if not own:
        return 0
    h = np.array([_h(s, SEED) for s in own], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # whole texts, in bounded memory
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp, a long, of every row of docs; null texts count as empty, null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in sliced(batches, SLICE):
            fp = pa.array([fingerprint(t, words) for t in texts(b.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), fp], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, fp long")


def masks(radius: int, turn: int = 0) -> list[int]:
    """2 ** (radius + 1) - 1 masks that cover the radius; another turn gives an independent family.

    Bit i has vector 1 + i % (2 ** (radius + 1) - 1), after a turn's multiplication of i by an odd number.
    """
    n = 2 ** (radius + 1) - 1
    vector = [1 + (i * (2 * turn + 1) + i // 8 * turn) % n for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucketed(prints: DataFrame, radius: int, limit: int = BUCKET) -> DataFrame:
    """fp -> table, key, fp: each fingerprint under each mask; large buckets under two masks."""
    first, second = masks(radius), masks(radius, 5)
    structs = lambda ms: F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(ms)])
    dealt = prints.select("fp", F.explode(structs(first)).alias("x")).select("x.t", "x.k", "fp")
    large = dealt.groupBy("t", "k").count().filter(F.col("count") > limit).drop("count")
    large = checkpointed(large)
    if large.isEmpty():
        return dealt.select(F.col("t").alias("table"), F.col("k").alias("key"), "fp")
    few = dealt.join(large, ["t", "k"], "left_anti").select(F.col("t").alias("table"), F.col("k").alias("key"), "fp")
    many = dealt.join(large, ["t", "k"], "left_semi")
    both = F.array(*[
        F.array(*[F.struct(F.lit((1 + t) * 1000 + u).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(a | b))).alias("k")) for u, b in enumerate(second)])
        for t, a in enumerate(first)
    ])
    again = many.select("fp", F.explode(F.element_at(both, F.col("t") + 1)).alias("x")).select(F.col("x.t").alias("table"), F.col("x.k").alias("key"), "fp")
    return few.union(again)


def forest(fp: np.ndarray, radius: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius among distinct fingerprints, as few as join what all links join."""
    root = np.arange(len(fp))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    u = fp.view(np.uint64)
    for at in range(0, len(u), block):
        near = np.bitwise_count(u[at : at + block, None] ^ u[None, :]) <= radius
        for x, y in zip(*np.nonzero(near), strict=True):
            x += at
            if x < y and (r := find(x)) != (s := find(y)):
                root[max(r, s)] = min(r, s)
                a.append(x)
                b.append(y)
    return fp[a], fp[b]


def links(prints: DataFrame, radius: int) -> DataFrame:
    """prints (fp, distinct) -> a, b: links that join every two fingerprints within the radius."""

    def run(batches: Iterator[pa.RecordBatch]):
        key, held = None, []

        def close():
            fp = np.unique(np.concatenate(held))
            return batch(_LINKS, *forest(fp, radius)) if len(fp) > 1 else None

        for b in batches:
            table, keys, fp = (b.column(c).to_numpy() for c in ("table", "key", "fp"))
            cuts = np.flatnonzero((np.diff(table) != 0) | (np.diff(keys) != 0)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                if x == y:
                    continue
                if key != (now := (table[x], keys[x])):
                    if held and sum(map(len, held)) > 1 and (out := close()):
                        yield out
                    key, held = now, []
                held.append(fp[x:y])
        if held and (out := close()):
            yield out

    dealt = bucketed(prints, radius).repartition("table", "key").sortWithinPartitions("table", "key")
    return dealt.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, radius: int = 2) -> DataFrame:
    """docs (doc_id, fp, others) with component_id: the least doc_id that links reach, itself included.

    Every row stays. Equal fingerprints are linked, the empty text's too. Null doc_ids take part and are never the
    least, unless a component has no other.
    """
    # Fingerprints are nodes, shifted in order so that they compare as they are.
    prints = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    prints = checkpointed(prints)
    nodes = components(links(prints.select("fp"), radius)).withColumnRenamed("node", "fp")
    own = prints.join(nodes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = own.groupBy("component").agg(F.min("first").alias("component_id"))
    return docs.join(own.join(least, "component").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id of every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    return groups(checkpointed(fingerprints(docs, words)), radius)


# Word sets ------------------------------------------------------------------------------------------------------------
#
# A SimHash of 64 bits differs in some ten bits at a Jaccard similarity of 0.8, and covering ten bits would take
# thousands of masks. one_of_each() takes the pairs that this fingerprint links within two bits, and finds by a second one
# what it cannot reach, for similarity on word shingles. That one is wide: block j of m is the exclusive
# or of the hashes of the shingles that fall into it, and mask j shows block j. Two sets that differ in fewer than m
# shingles agree in some block.

#: Words of a shingle of the fingerprint.
PRINTED = 3

#: Tables a level, ratio of sizes in a level, neighbours to which a bucket's members are linked as candidates.
TABLES, RATIO, NEAR = 32, 1.5, 2

#: Members of a bucket that are compared in one task; larger buckets are cut into tiles of half as many, which meet in pairs.
TOGETHER = 8192

_RID = pa.struct([("a", pa.int64()), ("b", pa.int64())])
_WIDE = pa.schema([("rid", _RID), ("uid", pa.int64()), ("other", pa.int64()), ("doc_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("fp", pa.int64())])
_SETS = pa.schema([("uid", pa.int64()), ("set", pa.binary())])


def word_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles' hashes, in order."""
    own = set(shingles(text, words))
    return np.unique(np.fromiter(map(_h, own), np.uint64, len(own)))


def _tagged(values: np.ndarray, tags: np.ndarray) -> np.ndarray:
    x = values ^ (tags.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def wide_keys(s: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a set, under which it meets every set at least that similar.

    Sets meet at the level of the larger one. There, sets differ in d elements at most, 2 (1 - t) / (1 + t) of the
    level's upper size. Where d is 2 or less, the keys are those of the set without any d of its elements. Else there
    are d + 1 blocks, and at least one agrees. Blocks that are empty have no key; small levels have two or three
    partitions into blocks, so that two similar sets agree in empty blocks alone less than once in a million. Levels
    beyond TABLES blocks show TABLES of them, and at similarity t exactly each is untouched by chance e^-0.9, so that a
    pair is missed once in ten million.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    level = int(np.floor(np.log(n) / np.log(RATIO) + 1e-9))
    out = []
    for k in (level, level + 1):
        if k > level and n / similarity < RATIO**k - 1e-9:
            continue
        d = int(2 * (1 - similarity) / (1 + similarity) * RATIO ** (k + 1))
        if d <= 2:
            whole = np.bitwise_xor.reduce(s)
            i, j = np.triu_indices(n, 1)
            values = [np.array([whole])] + [whole ^ s] * (d >= 1) + [whole ^ s[i] ^ s[j]] * (d >= 2)
            out.append(_tagged(np.concatenate(values), np.full(sum(map(len, values)), 1_000_000 + k)))
            continue
        m = d + 1
        for turn in range(3 if m <= 8 else 2 if m <= 16 else 1):
            block = ((s >> np.uint64(17 + 13 * turn)) % np.uint64(m)).astype(np.int64)
            own = block < TABLES
            values = np.zeros(min(m, TABLES), np.uint64)
            np.bitwise_xor.at(values, block[own], s[own])
            full = np.flatnonzero(np.bincount(block[own], minlength=len(values)))
            out.append(_tagged(values[full], full + 10_000 * (turn + 1) + 100 * (k + 1)))
    return np.concatenate(out).view(np.int64)


def _row_id() -> Column:
    """128 bits of a row's id and text."""
    return F.struct(F.xxhash64(F.col("doc_id"), F.col("text")).alias("a"), F.xxhash64(F.lit(7), F.col("text"), F.col("doc_id")).alias("b"))


def _wide(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """rid (of the row), uid (of the words in order), doc_id, keys, and fp, the SimHash.

    Different words with one uid, which a table of 10**10 rows has a few of, are told apart by 64 bits more and get a uid
    of these.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for b in sliced(batches, SLICE):
            uid, other, keys, fp = [], [], [], []
            for t in texts(b.column("text")):
                whole = b" ".join(lower_ascii(t).split())
                uid.append(_h(whole, 7) - (1 << 63))
                other.append(_h(whole, 8) - (1 << 63))
                keys.append(wide_keys(word_set(t, words), similarity))
                fp.append(fingerprint(t, PRINTED))
            yield batch(_WIDE, b.column("rid"), uid, other, b.column("doc_id"), keys, fp)

    rows = docs.select(_row_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    wide = checkpointed(rows.mapInArrow(tidied(run), "rid struct<a:long,b:long>, uid long, other long, doc_id long, keys array<long>, fp long"))
    return told_apart(wide).drop("other")


def told_apart(rows: DataFrame) -> DataFrame:
    """rows (uid, other, ...) in which rows of one uid have one other: of those that had several, all but the least get a uid
    of both."""
    ends = rows.groupBy("uid").agg(F.min("other").alias("_least"), F.max("other").alias("_most")).filter("_least <> _most")
    ends = checkpointed(ends.select("uid", "_least"))
    if ends.isEmpty():
        return rows
    own = F.when(F.col("_least").isNotNull() & (F.col("other") != F.col("_least")), F.xxhash64("uid", "other")).otherwise(F.col("uid"))
    return rows.join(ends, "uid", "left").withColumn("uid", own).drop("_least")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The word sets of some nodes (rid, uid)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in sliced(batches, SLICE):
            yield batch(_SETS, b.column("uid"), [word_set(t, words).tobytes() for t in texts(b.column("text"))])

    rows = docs.select(_row_id().alias("rid"), "text").join(nodes.select("rid", "uid"), "rid").select("uid", "text")
    return rows.mapInArrow(tidied(run), "uid long, set binary").dropDuplicates(["uid"])


def _similar(a: bytes, b: bytes, similarity: float) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-12


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in sliced(batches, SLICE, "x"):
            fine = [_similar(x, y, similarity) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long")


def set_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs that join what all similar pairs join, through an inverted list of the sets so far."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    every, number = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    held: list[list[int]] = [[] for _ in every]
    sizes, out, at = np.array([len(s) for s in sets]), [], 0
    for k, s in enumerate(sets):
        own = number[at : at + len(s)]
        at += len(s)
        both = np.bincount([x for n in own for x in held[n]], minlength=k)[:k] if k else np.zeros(0, np.int64)
        for x in np.flatnonzero(both >= similarity * (sizes[:k] + len(s) - both) - 1e-12):
            if (r := find(int(x))) != (t := find(k)):
                root[max(r, t)] = min(r, t)
                out.append((int(x), k))
        for n in own:
            held[n].append(k)
    return out


def _rest(buckets: DataFrame, found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links inside buckets of over NEAR + 1 members that are not one component yet."""
    large = buckets.filter(F.col("size") > NEAR + 1).join(found.toDF("uid", "component"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    left = large.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    left = left.filter("c0 <> c1").select("key")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("uid")  # members of both tiles, or of the one
        uid = t.column("uid").to_numpy()
        pairs = set_forest([np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()], similarity)
        return pa.Table.from_batches([batch(_LINKS, uid[[x for x, _ in pairs]], uid[[y for _, y in pairs]])])

    tiles = F.ceil(F.col("size") * 2 / TOGETHER)
    own = F.when(F.col("size") <= TOGETHER, F.lit(0)).otherwise(F.pmod(F.xxhash64("uid"), tiles)).cast("long")
    last = F.when(F.col("size") <= TOGETHER, F.lit(0)).otherwise(tiles - 1).cast("long")
    dealt = buckets.join(left, "key").select("key", "uid", own.alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    dealt = dealt.select("key", "uid", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"))
    return dealt.join(sets, "uid").groupBy("key", "x", "y").applyInArrow(run, "a long, b long")


def _by_print(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes (uid, fp) -> a, b: links that join all whose fingerprints are within the radius of each other."""
    prints = checkpointed(nodes.groupBy("fp").agg(F.min("uid").alias("first")))
    equal = nodes.select("uid", "fp").join(prints, "fp").filter("uid <> first").select(F.col("first").alias("a"), F.col("uid").alias("b"))
    near = links(prints.select("fp"), radius).toDF("x", "y")
    ends = near.join(prints.toDF("x", "a"), "x").join(prints.toDF("y", "b"), "y").select("a", "b")
    return checkpointed(equal.union(ends))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """docs without near duplicates: of each component of texts whose sets of word shingles have a Jaccard similarity
    of at least `similarity`, the row with the least doc_id stays, as it was. Null doc_ids come last.

    Pairs whose SimHash fingerprints (of PRINTED-word shingles) differ in `radius` bits at most, and neighbours in the
    buckets of wide fingerprints, which have the pairs that the radius does not reach, are checked by their sets.

    Texts of equal words are copies; fewer words than a shingle: the whole sequence is the set; texts without words
    are copies of each other. Of rows equal in doc_id and text one stays.
    """
    ship(docs.sparkSession)
    rid = free_name(docs, "_rid")
    wide = _wide(docs, words, similarity)
    nodes = wide.groupBy("uid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("least"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    nodes = nodes.select("fp", "uid", F.col("least.last").alias("last"), F.col("least.doc_id").alias("doc_id"), F.col("least.rid").alias("rid"), "keys")
    every = nodes.select(F.explode(F.array_distinct("keys")).alias("key"), "uid")
    # Similar texts share many blocks: of buckets with the same members, known by two sums of hashes, one is enough.
    members = [F.expr("bit_xor(xxhash64(uid))").alias("x"), F.expr("bit_xor(xxhash64(uid, 1))").alias("y")]
    many = every.groupBy("key").agg(F.count("*").alias("size"), *members).filter("size > 1")
    buckets = checkpointed(every.join(many.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size"), "key"))
    after = Window.partitionBy("key").orderBy("uid")
    near = buckets.withColumn("near", F.array(*[F.lead("uid", k).over(after) for k in range(1, NEAR + 1)]))
    pairs = near.select(F.col("uid").alias("a"), F.explode(F.array_compact("near")).alias("b")).distinct()
    printed = _by_print(nodes, radius)
    pairs = pairs.union(printed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    met = buckets.select("uid").union(printed.select("a")).union(printed.select("b")).distinct()
    sets = stored(_sets(docs, nodes.join(met, "uid"), words))
    found = checkpointed(_checked(pairs, sets, similarity))
    del every, many, near, pairs
    freed(docs.sparkSession)
    first = checkpointed(components(found))
    more = checkpointed(_rest(buckets, first, sets, similarity))
    found = first if more.isEmpty() else components(found.union(more))
    own = nodes.drop("keys", "fp").join(found.toDF("uid", "component"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    stay = own.groupBy("component").agg(F.min(F.struct("last", "doc_id", "rid")).alias("least")).select(F.col("least.rid").alias(rid))
    kept = docs.withColumn(rid, _row_id()).join(stay, rid, "left_semi").dropDuplicates([rid])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
