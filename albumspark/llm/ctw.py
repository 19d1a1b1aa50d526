"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions; each decision's node has a tree of contexts, the last 0 to 5 bytes. A tree node
holds Krichevsky-Trofimov counts, and weighting mixes its estimate with its children's, at all depths. The tree learned
from the training texts is then fixed: the probability of a byte after its context is the mixture along the path, with
each depth's posterior weight, and a context never seen in training leaves the mixture at the depth above it.

How it is dealt out. Texts fall into blocks of bounded size by a hash. A block counts its distinct 6-grams (context and
byte) and words as sorted arrays, cut by shard: 6-grams by a hash of the last two context bytes, words by their own.
These arrays are merged as in `radix`, so that the last ones hold whole sub-trees below depth 2; what is above depth 2
is a table of at most 256 x 256 nodes, whatever the corpus, and is worked out on the driver. Each last array is answered
once, with log probabilities of its keys; the answers go back to the blocks, which add them up text by text. No model is
broadcast or copied that grows with the corpus, and no text, word or 6-gram becomes a Spark row in between.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumspark.session import ship

from .common import batch, lower_ascii, stored, texts, tidied, tidied_cogroup, tidied_group
from .radix import FAN, answered, cut_by, digit, grow, joined, merged, shrink

#: Bytes of context; text bytes of a block; bytes handled at once; entries of an array merged at once.
DEPTH, BLOCK, CHUNK, ENTRIES = 5, 32 << 20, 2 << 20, 4_000_000
#: Fixed: no UTF-8 text has this byte; it stands before and after each text.
EDGE = 255
GRAM, WORD = 0, 1

_ARRAYS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ARRAYS_DDL = "kind int, shard int, block long, keys binary, counts binary"
_ANSWERS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
_ANSWERS_DDL = "kind int, shard int, block long, keys binary, values binary"
_TOPS = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("nodes", pa.binary()), ("n", pa.int64()), ("distinct", pa.int64())])
_TOPS_DDL = "shard int, kind int, nodes binary, n long, distinct long"
_SCORES = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()),
])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


# Arrays ---------------------------------------------------------------------------------------------------------------


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 6-gram at each byte of the texts and at each end: last byte of the context first, the byte itself last. And
    how many each text has."""
    lengths = np.array([len(t) + 1 for t in parts], np.int64)
    edge = bytes([EDGE])
    x = np.frombuffer(edge * DEPTH + (edge * DEPTH).join(parts) + edge, np.uint8)
    g = np.zeros(len(x) - DEPTH, np.uint64)
    for d in range(1, DEPTH + 1):
        g |= x[DEPTH - d : len(x) - d].astype(np.uint64) << np.uint64(8 * (DEPTH - d + 1))
    g |= x[DEPTH:].astype(np.uint64)
    if len(parts) > 1:  # between texts stand DEPTH edges, of which the first is an end
        ends = np.cumsum(lengths + DEPTH - 1)[:-1]
        keep = np.ones(len(g), bool)
        for k in range(1, DEPTH):
            keep[ends - k] = False
        g = g[keep]
    return g, lengths


def hash_of_pairs(g: np.ndarray) -> np.ndarray:
    """A hash of the last two context bytes."""
    x = (g >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def chunks(lowered: list[bytes]) -> Iterator[list[int]]:
    """Numbers of texts, some two megabytes at a time."""
    own, held = [], 0
    for k, t in enumerate(lowered):
        own.append(k)
        held += len(t)
        if held >= CHUNK:
            yield own
            own, held = [], 0
    if own:
        yield own


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


# The tree -------------------------------------------------------------------------------------------------------------

_SMALL = 4096
_TABLES = [np.array([math.lgamma(n + a) for n in range(_SMALL)]) for a in (0.5, 1.0)]


def _lgamma(n: np.ndarray, half: bool) -> np.ndarray:
    """log Gamma(n + 1/2) or log Gamma(n + 1) of counts."""
    out = _TABLES[not half][np.minimum(n, _SMALL - 1)]
    big = n >= _SMALL
    if big.any():
        x = n[big] + (0.5 if half else 1.0)
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _lgamma(n0, True) + _lgamma(n1, True) - _lgamma(n0 + n1, False) - math.log(math.pi)


class Nodes:
    """The nodes of one depth: key = context << 8 | decision, counts of either bit, and the weight of stopping."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        """below: the sum of the children's log weighted probabilities; None at the greatest depth."""
        self.keys, self.n0, self.n1 = keys, n0, n1
        kt = log_kt(n0, n1)
        self.log_pw = kt if below is None else np.logaddexp(kt, below) - math.log(2)
        self.stop = np.ones(len(keys)) if below is None else np.exp(kt - math.log(2) - self.log_pw)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)


def decisions(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight decisions: its number in the byte's binary tree, 1 to 255, and the bit taken."""
    x = symbols.astype(np.uint64)
    for k in range(8):
        yield (np.uint64(1 << k) | x >> np.uint64(8 - k)), (x >> np.uint64(7 - k)) & np.uint64(1)


def leaves(contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node keys with counts of either bit, from counts of symbols in contexts."""
    keys, n0, n1 = [], [], []
    for node, bit in decisions(symbols):
        k, both = summed(contexts << np.uint64(8) | node, np.stack([np.where(bit == 0, counts, 0), np.where(bit == 1, counts, 0)], 1))
        keys.append(k)
        n0.append(both[:, 0])
        n1.append(both[:, 1])
    keys = np.concatenate(keys)
    by = np.argsort(keys)
    return keys[by], np.concatenate(n0)[by], np.concatenate(n1)[by]


def sub_trees(g: np.ndarray, counts: np.ndarray) -> tuple[dict[int, Nodes], tuple[np.ndarray, ...]]:
    """Nodes of depths 5 to 2 for the 6-grams of whole depth-2 contexts, and what they add to depth 1: keys, counts of
    either bit, and sums of log weighted probabilities."""
    seen = counts > 0
    g, counts = g[seen], counts[seen]
    contexts, symbols = g >> np.uint64(8), g & np.uint64(255)
    nodes: dict[int, Nodes] = {}
    keys, n0, n1 = leaves(contexts, symbols, counts)
    below = None
    for d in range(DEPTH, 1, -1):
        nodes[d] = Nodes(keys, n0, n1, below)
        up = keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255)
        by = np.argsort(up, kind="stable")
        first = np.flatnonzero(np.append(True, up[by][1:] != up[by][:-1])[: len(up)])
        keys, below, n0, n1 = up[by][first], *(np.add.reduceat(x[by], first) if len(first) else x for x in (nodes[d].log_pw, n0, n1))
    return nodes, (keys, n0, n1, below)


class Top:
    """Depths 1 and 0, from what the shards add to depth 1: at most 256 x 256 nodes."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        by = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, keys[by][1:] != keys[by][:-1])[: len(keys)])
        keys, n0, n1, below = keys[by][first], *(np.add.reduceat(x[by], first) if len(first) else x for x in (n0, n1, below))
        self.one = Nodes(keys, n0, n1, below)
        z = (keys & np.uint64(255)).astype(np.int64)
        every = np.unique(z)
        sums = [np.bincount(z, x, 256)[every] for x in (n0, n1, self.one.log_pw)]
        self.zero = Nodes(every.astype(np.uint64), sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2])


def log10_probabilities(g: np.ndarray, nodes: dict[int, Nodes], top: Top) -> np.ndarray:
    """log10 P(byte | context) of each 6-gram, seen in training or not."""
    total = np.zeros(len(g))
    symbols = g & np.uint64(255)
    for node, bit in decisions(symbols):
        p = np.full(len(g), np.nan)
        for d in range(DEPTH, -1, -1):
            own = nodes[d] if d > 1 else (top.zero, top.one)[d]
            at, seen = own.find((g >> np.uint64(8 * (DEPTH + 1 - d)) << np.uint64(8) if d else np.zeros(len(g), np.uint64)) | node)
            if not seen.any():
                continue
            at, r = at[seen], np.flatnonzero(seen)
            ones = np.where(bit[r] == 1, own.n1[at], own.n0[at])
            kt = (ones + 0.5) / (own.n0[at] + own.n1[at] + 1)
            w = np.where(np.isnan(p[r]), 1.0, own.stop[at])
            p[r] = w * kt + (1 - w) * np.nan_to_num(p[r])
        total += np.log10(np.where(np.isnan(p), 0.5, p))
    return total


# Blocks and shards ----------------------------------------------------------------------------------------------------


def _ordered(t: pa.Table) -> tuple[list, list[bytes], np.ndarray]:
    ids, train = t.column("doc_id").to_pylist(), t.column("train").to_numpy().astype(bool)
    return ids, [lower_ascii(x) for x in texts(t.column("text"))], train


def block_grams(lowered: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for own in chunks(lowered):
        g, lengths = grams([lowered[k] for k in own])
        learned = np.repeat(train[own], lengths)
        for part, unit in ((np.sort(g[learned]), 1), (np.sort(g[~learned]), 0)):
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
            keys.append(part[first])
            counts.append(np.diff(np.append(first, len(part))) * unit)
        if len(keys) >= 16:
            k, c = summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts = [k], [c]
    return summed(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def block_words(lowered: list[bytes], train: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, their hashes in order, and their counts in training texts."""
    n: Counter = Counter()
    for t, learn in zip(lowered, train, strict=True):
        if learn:
            n.update(t.split())
    n = dict(n)
    for t, learn in zip(lowered, train, strict=True):
        if not learn:
            n.update(dict.fromkeys(set(t.split()).difference(n), 0))
    words = list(n)
    h = word_hashes(words)
    by = np.argsort(h)
    return [words[k] for k in by], h[by], np.fromiter(n.values(), np.int64, len(n))[by]


def _arrays(docs: DataFrame, fan: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        _, lowered, train = _ordered(t)
        rows = []
        g, n = block_grams(lowered, train)
        rows += [(GRAM, s, block, shrink(g[at]), shrink(n[at].astype("<i8"))) for s, at in cut_by(digit(hash_of_pairs(g), 0, fan))]
        _, h, n = block_words(lowered, train)
        rows += [(WORD, s, block, shrink(h[at]), shrink(n[at].astype("<i8"))) for s, at in cut_by(digit(h, 0, fan))]
        return pa.Table.from_batches([batch(_ARRAYS, *zip(*rows, strict=True))] if rows else [], _ARRAYS)

    return docs.groupBy("block").applyInArrow(tidied_group(run), _ARRAYS_DDL)


def sums(rows: Iterator[dict], last: bool):
    """The union of arrays with counts: the counts of a key are added."""
    keys, counts, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for r in rows:
        keys.append(grow(r["keys"], "<u8"))
        counts.append(grow(r["counts"], "<i8"))
        n += len(keys[-1])
        if n > ENTRIES:
            k, c = summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, n = [k], [c], 0
    k, c = summed(np.concatenate(keys), np.concatenate(counts))
    return k, lambda at: (shrink(c[at]),)


def _merged(arrays: DataFrame, blocks: int, fan: int) -> list[DataFrame]:
    return merged(arrays, blocks, _ARRAYS, _ARRAYS_DDL, sums, lambda row, keys: hash_of_pairs(keys) if row["kind"] == GRAM else keys, fan)


def _tops(model: DataFrame) -> DataFrame:
    """What the shards add to depth 1, and to the counts of words: FAN rows of each at most."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for row in b.to_pylist():
                keys, counts = grow(row["keys"], "<u8"), grow(row["counts"], "<i8")
                nodes = b""
                if row["kind"] == GRAM:
                    up, n0, n1, below = sub_trees(keys, counts)[1]
                    nodes = np.concatenate([up.view(np.int64), n0, n1, below.view(np.int64)]).astype("<i8").tobytes() if len(up) else b""
                yield batch(_TOPS, [row["shard"]], [row["kind"]], [nodes], [int(counts.sum())], [int((counts > 0).sum())])

    def add(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["shard"])  # floats are added in the same order each time
        nodes = b"".join(x.astype("<i8").tobytes() for x in depth_one(r["nodes"] for r in rows))
        return pa.Table.from_batches([batch(_TOPS, [rows[0]["shard"] % FAN], [rows[0]["kind"]], [nodes], [sum(r["n"] for r in rows)], [sum(r["distinct"] for r in rows)])])

    return model.mapInArrow(tidied(run), _TOPS_DDL).groupBy("kind", F.pmod("shard", F.lit(FAN))).applyInArrow(add, _TOPS_DDL)


def depth_one(parts) -> tuple[np.ndarray, ...]:
    """Keys of depth 1, counts of either bit and sums of log weighted probabilities, the last as bits, added by key."""
    every = [np.frombuffer(x, "<i8").reshape(4, -1) for x in parts]
    keys, n0, n1, below = np.concatenate([np.zeros((4, 0), np.int64), *every], axis=1)
    by = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, keys[by][1:] != keys[by][:-1])[: len(keys)])
    if not len(first):
        return keys, n0, n1, below
    below = below.copy().view(np.float64)
    return keys[by][first], *(np.add.reduceat(x[by], first) for x in (n0, n1)), np.add.reduceat(below[by], first).view(np.int64)


def _answers(levels: list[DataFrame], top, fan: int) -> DataFrame:
    """Each block's arrays, answered in their own order: log10 probabilities of 6-grams, counts of words."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for row in b.to_pylist():
                values = row["counts"]
                if row["kind"] == GRAM:
                    keys, counts = grow(row["keys"], "<u8"), grow(row["counts"], "<i8")
                    values = shrink(log10_probabilities(keys, sub_trees(keys, counts)[0], top.value).astype("<f4"))
                yield batch(_ANSWERS, [row["kind"]], [row["shard"]], [row["block"]], [row["keys"]], [values])

    def look(rows: list[dict]):
        kind = "<f4" if rows[0]["kind"] == GRAM else "<i8"
        keys, values = joined([grow(r["keys"], "<u8") for r in rows], [grow(r["values"], kind) for r in rows])
        return lambda asked: (shrink(values[np.searchsorted(keys, asked)]),)

    return answered(levels, levels[-1].mapInArrow(tidied(run), _ANSWERS_DDL), _ANSWERS, _ANSWERS_DDL, look, fan)


def _scored(docs: DataFrame, answers: DataFrame, fan: int, train_tokens: int, distinct: int, end: int) -> DataFrame:
    log_all = math.log10(train_tokens + 0.5 * (distinct + 1))

    def run(t: pa.Table, held: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_batches([], _SCORES)
        ids, lowered, train = _ordered(t)
        got = {(r["kind"], r["shard"]): r["values"] for r in held.to_pylist()}
        # The block's keys again, in the order in which they were asked.
        g, _ = block_grams(lowered, train)
        value = np.empty(len(g), np.float32)
        for s, at in cut_by(digit(hash_of_pairs(g), 0, fan)):
            value[at] = grow(got[GRAM, s], "<f4")
        score = np.empty(len(lowered))
        for own in chunks(lowered):
            x, lengths = grams([lowered[k] for k in own])
            u, inverse = np.unique(x, return_inverse=True)
            each = value[np.searchsorted(g, u)].astype(np.float64)[inverse.ravel()]
            score[own] = np.add.reduceat(each, np.append(0, np.cumsum(lengths)[:-1]))
        words, h, _ = block_words(lowered, train)
        c = np.empty(len(h), np.int64)
        for s, at in cut_by(digit(h, 0, fan)):
            c[at] = grow(got[WORD, s], "<i8")
        logs = dict(zip(words, (np.log10(c + 0.5) - log_all).tolist(), strict=True))
        unknown = {w for w, n in zip(words, c.tolist(), strict=True) if not n}
        end_log, end_known = math.log10(end + 0.5) - log_all, int(end > 0)
        tokens, known, base = [], [], []
        for x in lowered:
            own = x.split()
            tokens.append(len(own) + 1)
            known.append(end_known + (len(own) if unknown.isdisjoint(own) else sum(w not in unknown for w in own)))
            base.append(math.fsum(map(logs.__getitem__, own)) + end_log)
        n = len(lowered)
        return pa.Table.from_batches([batch(_SCORES, ids, ~train, tokens, known, [train_tokens] * n, base, score, [len(x) for x in lowered])])

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidied_cogroup(run), SCORES)


def score(docs: DataFrame, held_out, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Scores of every row of docs (doc_id, text), learned from the rows for which held_out is not true.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text and its end),
    n_bytes; -score / (n_bytes + 1) * log2(10) is the code length per byte. A-Z count as a-z. Null texts are empty:
    their score is that of the end alone. Repeated rows count as often as they stand. Without training texts, every
    bit has probability 1/2. Other columns of docs are left out. Blocks have `block` bytes of text, and `fan` arrays are
    merged at once; neither changes a result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(held_out, 0).otherwise(1).alias("train"))
    total, texts_learned = (x or 0 for x in docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64), F.sum("train")).first())
    blocks = max(8, -(-total // block))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    *levels, model = _merged(stored(_arrays(docs, fan)), blocks, fan)
    model = stored(model)
    tops = sorted(_tops(model).collect())  # FAN rows a kind at most, of at most 256 x 256 nodes
    keys, n0, n1, below = depth_one(r["nodes"] for r in tops if r["kind"] == GRAM)
    top = spark.sparkContext.broadcast(Top(keys.astype(np.uint64), n0, n1, below.copy().view(np.float64)))
    n = sum(r["n"] for r in tops if r["kind"] == WORD) + texts_learned
    distinct = sum(r["distinct"] for r in tops if r["kind"] == WORD) + (texts_learned > 0)
    return _scored(docs, _answers([*levels, model], top, fan), fan, n, distinct, texts_learned)
