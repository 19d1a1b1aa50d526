"""Repeated passages by sparse suffix arrays: suffixes at minimisers, sorted, compared with their neighbours, extended.

Every window of `least` words has its 8-word sequence of least hash, the minimiser; equal windows have it at the same
place. The suffixes that begin there, one word in twenty or so, are sorted over all texts in two orders: by the words from
the minimiser on, and by the minimiser and the words before it, from right to left. In a sorted order the suffix of another
text that shares most with a suffix is the nearest one that is of another text, above or below, however many of its own
text, or equal ones, stand between. So neighbours tell exactly how far each suffix agrees with any other text to the right,
and how far to the left. Equal suffixes are one entry with the number of its texts, two or one.

A window can only repeat if its suffix agrees far enough on both sides. Where it does, the match is extended over the whole
window and checked: partners on the left and on the right may be different texts. The hashes of these windows, each once
for a text, go with the two least documents of each; a window repeats if it has two, and a document's passages are what its
repeated windows cover.

Suffixes are compared by four bits a word, so they may seem to agree further than they do, never less; what that adds falls
in the check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumspark.session import ship

from .common import LOWER, batch, checkpointed, sliced, stored, texts, tidied, tidied_cogroup
from .ctw import BLOCK
from .radix import FAN, answered, cut_by, digit, grow, joined, merged, shrink

#: Words of a repeat at least; words of a minimiser; entries of a shard merged at once.
LEAST, GRAM, ENTRIES = 50, 8, 4_000_000
LAST = (1 << 63) - 1
#: Bytes of text handled at once; bytes of text whose suffixes are a range of an order; bytes of text that ranges are cut by.
SLICE, SHARE, SAMPLE = 4 << 20, 48 << 20, 16 << 20
#: Bytes of a minimiser in a key.
HEAD = 6
#: The two orders.
RIGHT, LEFT = 0, 1

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SUFFIXES = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("uid", pa.int64()), ("two", pa.bool_()), ("block", pa.int64())])
_SUFFIXES_DDL = "part int, key binary, uid long, two boolean, block long"
_AGREE = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("uid", pa.int64()), ("role", pa.int32())])
_AGREE_DDL = "kind int, part int, block long, key binary, n int, uid long, role int"
#: Roles: an answer; one that may change by what stands before or behind its range, or both; and the ends of a range.
CLOSED, BEFORE, BEHIND, BOTH, FIRST, FIRST_OTHER, FINAL, FINAL_OTHER = range(8)
_ENTRIES = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("two", pa.binary()), ("first", pa.binary()), ("second", pa.binary())])
_ENTRIES_DDL = "shard int, block long, keys binary, two binary, first binary, second binary"
_WINDOWS = pa.schema([*_ENTRIES, ("docs", pa.binary()), ("counts", pa.binary()), ("starts", pa.binary()), ("places", pa.binary())])
_WINDOWS_DDL = _ENTRIES_DDL + ", docs binary, counts binary, starts binary, places binary"
_FOUND = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("n", pa.int64()), ("hit", pa.binary()), ("first", pa.binary()), ("second", pa.binary())])
_FOUND_DDL = "shard int, block long, keys binary, n long, hit binary, first binary, second binary"
_SPANS = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("n_words", pa.int32()), ("first_doc_id", pa.int64())])
_SPANS_DDL = "doc_id long, start_word int, end_word int, n_words int, first_doc_id long"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row, by doubling."""
    out, at = None, 0
    power, width = h, 1
    while n:
        if n & 1:
            if out is None:
                out, at = power, width
            else:
                m = min(len(out), len(power) - at)
                out = _mixed(out[:m] * _MULTIPLIER + power[at : at + m]) if m > 0 else out[:0]
                at += width
        n >>= 1
        if n:
            m = max(0, len(power) - width)
            power = _mixed(power[:m] * _MULTIPLIER + power[width : width + m] + np.uint64(width))
            width *= 2
    return out


def minimisers(g: np.ndarray, window: int) -> np.ndarray:
    """For each `window` hashes in a row the position of the least, the first among equals. Hashes count as equal by 47 bits."""
    n, low = len(g) - window + 1, np.uint64((1 << 17) - 1)
    out = []
    for at in range(0, n, 1 << 16):
        own = g[at : at + (1 << 16) + window - 1]
        x, width = own & ~low | np.arange(len(own), dtype=np.uint64), 1
        while 2 * width <= window:
            x, width = np.minimum(x[:-width], x[width:]), 2 * width
        if width < window:
            x = np.minimum(x[: width - window], x[window - width :])
        out.append((x & low).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def hashed_words(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, and how many words each text has. Each distinct word is hashed once."""
    offsets = np.append(0, np.cumsum([len(x) for x in found]))
    data = LOWER[np.frombuffer(b"".join(found), np.uint8)]
    inside = ~_BLANK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    first[borders], last[borders - 1] = inside[borders], inside[borders - 1]
    starts = np.flatnonzero(first)
    ends = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - starts)).astype("<i8")
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    return known[words.indices.to_numpy()] if len(starts) else np.zeros(0, np.uint64), np.diff(np.searchsorted(starts, offsets))


class Suffixes:
    """The suffixes of some texts at their minimisers, and the windows that each stands for."""

    def __init__(self, found: list[bytes], least: int):
        self.h, many = hashed_words(found)
        self.span = least - GRAM
        ends = np.cumsum(many)
        self.begin = ends - many
        p = minimisers(rolled(self.h, GRAM), self.span + 1)
        text = np.searchsorted(ends, np.arange(len(p)), side="right")
        whole = np.arange(len(p)) + least <= ends[text]
        self.window = np.flatnonzero(whole)  # where windows begin, in all words
        at = p[self.window]
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        self.at = at[new]  # where the minimisers are
        self.windows = np.diff(np.append(new, len(at)))  # how many windows each suffix stands for
        self.text = text[self.window[new]]
        self._low, self._high = self.begin[self.text], ends[self.text]

    def keys(self, kind: int) -> np.ndarray:
        """What each suffix is sorted by in this order: the minimiser, then four bits a word, 0 where the text has ended."""
        step = np.arange(self.span + self.span % 2)
        words = self.at[:, None] + GRAM + step if kind == RIGHT else self.at[:, None] - 1 - step
        inside = (words >= self._low[:, None]) & (words < self._high[:, None]) & (step < self.span)
        own = np.where(inside, (self.h % np.uint64(15)).astype(np.uint8)[np.where(inside, words, 0)] + np.uint8(1), np.uint8(0))
        gram = (self.gram() * _MULTIPLIER).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :HEAD]
        return np.ascontiguousarray(np.hstack([gram, own[:, ::2] << 4 | own[:, 1::2]]))

    def gram(self) -> np.ndarray:
        g = self.h[self.at]
        for k in range(1, GRAM):
            g = _mixed(g * _MULTIPLIER + self.h[self.at + k])
        return g


def _bytes(keys: np.ndarray) -> np.ndarray:
    """Rows of bytes as texts that numpy sorts; rows are equally long, so trailing zeros do no harm."""
    return np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel()


def _binary(keys: np.ndarray) -> pa.Array:
    n, width = keys.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype("<i4")), pa.py_buffer(np.ascontiguousarray(keys))])


def _rows_of(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1)


def _distinct(rows: pa.Table | pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts, document ids and text ids of rows, each text id once."""
    uid = rows.column("uid").to_numpy()
    first = np.sort(np.unique(uid, return_index=True)[1])
    own = rows.take(pa.array(first))
    return texts(own.column("text")), own.column("doc_id").to_numpy(), uid[first]


def _emitted(docs: DataFrame, least: int, bounds: list[np.ndarray], blocks: int) -> DataFrame:
    """The suffixes of all texts, in both orders, each with the range that it falls into; equal ones of a slice and block
    are one."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in sliced(batches, SLICE):
            found, _, uids = _distinct(b)
            x = Suffixes(found, least)
            uid, block = uids[x.text], np.mod(uids, blocks)[x.text]
            for kind in (RIGHT, LEFT):
                keys = x.keys(kind)
                key = _bytes(keys)
                by = np.lexsort((key, block))
                new = np.flatnonzero(np.append(True, (key[by][1:] != key[by][:-1]) | (block[by][1:] != block[by][:-1]))[: len(by)])
                if not len(new):
                    continue
                low, high = np.minimum.reduceat(uid[by], new), np.maximum.reduceat(uid[by], new)
                part = np.searchsorted(bounds[kind], key[by[new]], side="right") + kind * (len(bounds[RIGHT]) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), _binary(keys[by[new]]), pa.array(low, pa.int64()), pa.array(low < high), pa.array(block[by[new]], pa.int64())], schema=_SUFFIXES)

    return docs.mapInArrow(tidied(run), _SUFFIXES_DDL)


def _agreeing(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Words beyond the minimiser that rows of keys share; -1 where the minimiser differs."""
    same = keys == others
    head = same[:, :HEAD].all(1)
    # Two words a byte: the first of them is its upper half.
    upper = (keys[:, HEAD:] >> 4 == others[:, HEAD:] >> 4) & (keys[:, HEAD:] > 15)
    lower = same[:, HEAD:] & (keys[:, HEAD:] & 15 > 0)
    both = np.stack([upper, lower], 2).reshape(len(keys), 2 * upper.shape[1])
    return np.where(head, np.append(both, np.zeros((len(keys), 1), bool), 1).argmin(1), -1)


def neighbours(keys: np.ndarray, uid: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted suffixes: the entry of each, and for each entry its first suffix, how many words beyond the minimiser it
    shares with another text's (-1: not the minimiser), the one text that it is of (-1: of several) and its run.

    Entries in a row of one and the same text are a run; the nearest entry of another text stands before it or behind it,
    and what an entry shares with that is the least of what neighbours share on the way.
    """
    new = np.append(True, (keys[1:] != keys[:-1]).any(1))
    entry, at = np.cumsum(new) - 1, np.flatnonzero(new)
    low, high = np.minimum.reduceat(uid, at), np.maximum.reduceat(uid, at)
    many = (low < high) | np.logical_or.reduceat(two, at)
    own = keys[at]
    shared = _agreeing(own[1:], own[:-1])
    run = np.cumsum(np.append(False, many[1:] | many[:-1] | (low[1:] != low[:-1])))
    before, behind = np.append(-1, shared), np.append(shared, -1)
    # The least from a run's beginning on: runs are set apart by more than any value.
    apart = 2 * own.shape[1] * run
    before = np.minimum.accumulate(before - apart) + apart
    behind = (np.minimum.accumulate((behind + apart)[::-1] - apart[-1]) + apart[-1])[::-1] - apart
    n = np.where(many, _agreeing(own, own), np.maximum(before, behind))
    return entry, at, n, np.where(many, -1, low), run


def _compared(suffixes: DataFrame, cuts: int) -> DataFrame:
    """How far each suffix agrees with another text, by order, block and key; and the ends of each range."""

    def run(batches: Iterator[pa.RecordBatch]):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).combine_chunks()
        part, block = t.column("part")[0].as_py(), t.column("block").to_numpy()
        keys = _rows_of(t.column("key").chunk(0))
        entry, at, n, text, runs = neighbours(keys, t.column("uid").to_numpy(), t.column("two").to_numpy(zero_copy_only=False))
        role = np.where((runs == 0) & (text >= 0), BEFORE, CLOSED) + np.where((runs == runs[-1]) & (text >= 0), BEHIND, CLOSED)
        own = np.flatnonzero((n >= 0)[entry] | (role > 0)[entry])
        other, final = np.flatnonzero(runs > 0)[:1], np.flatnonzero(runs < runs[-1])[-1:]
        ends = np.concatenate([[0], other, [len(at) - 1], final]).astype(int)
        roles = [FIRST, *[FIRST_OTHER] * len(other), FINAL, *[FINAL_OTHER] * len(final)]
        row = np.concatenate([own, at[ends]])
        group = entry[row]
        columns = [np.full(len(row), part // cuts), np.full(len(row), part), block[row], _binary(keys[row]), n[group], text[group], np.concatenate([role[entry[own]], roles])]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, _AGREE, strict=True)], schema=_AGREE)

    dealt = suffixes.repartitionById(2 * cuts, "part").sortWithinPartitions("key")
    return dealt.mapInArrow(tidied(run), _AGREE_DDL)


def _beyond(found: DataFrame) -> dict[int, tuple[list, list]]:
    """For each range, the nearest entries before it and behind it: the nearest of all, and the nearest that is of another
    text than that one. Four rows a range reach the driver."""
    ends: dict[tuple[int, int], dict[int, tuple[bytes, int]]] = {}
    for r in found.filter(f"role >= {FIRST}").select("kind", "part", "role", "key", "uid").collect():
        ends.setdefault((r["kind"], r["part"]), {})[r["role"]] = (bytes(r["key"]), r["uid"])
    out: dict[int, tuple[list, list]] = {part: ([], []) for _, part in ends}
    for side, near, other, order in ((0, FINAL, FINAL_OTHER, sorted(ends)), (1, FIRST, FIRST_OTHER, sorted(ends, reverse=True))):
        kind, held = None, []
        for k, part in order:
            if k != kind:
                kind, held = k, []
            out[part][side].extend(held)
            own = ends[k, part]
            rest = [own[other]] if other in own else [c for c in held if c[1] < 0 or c[1] != own[near][1]]
            held = [own[near], *rest[:1]]
    return out


def agreements(docs: DataFrame, least: int, blocks: int, total: int) -> DataFrame:
    """kind, block, key, n: of each suffix that shares its minimiser with another text, how many words beyond."""
    spark = docs.sparkSession
    cuts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, -(-total // SHARE))
    sample = docs.sample(min(1.0, SAMPLE / max(1, total)), 7)  # it decides how large ranges are, and nothing else
    keys: list[list[bytes]] = [[], []]
    for r in _emitted(sample, least, [np.zeros(0, "S1")] * 2, 1).select("part", "key").limit(SAMPLE // 16).collect():
        keys[r["part"]].append(bytes(r["key"]))
    width = HEAD + (least - GRAM + 1) // 2
    bounds = [np.sort(np.array(k, f"S{width}"))[(np.arange(1, cuts) * len(k) // cuts)] if k else np.zeros(0, f"S{width}") for k in keys]
    bounds = [b if len(b) == cuts - 1 else np.array([b"\xff" * width] * (cuts - 1), f"S{width}") for b in bounds]
    return settled(_compared(_emitted(docs, least, bounds, blocks), cuts))


def settled(compared: DataFrame) -> DataFrame:
    """kind, block, key, n of all suffixes, those included whose nearest of another text stands beyond their range."""
    found = checkpointed(compared)
    beyond = found.sparkSession.sparkContext.broadcast(_beyond(found))  # four keys a range

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            keys, n, role, part, uid = _rows_of(b.column("key")), b.column("n").to_numpy().copy(), b.column("role").to_numpy(), b.column("part").to_numpy(), b.column("uid").to_numpy()
            for side, open_ in ((0, (BEFORE, BOTH)), (1, (BEHIND, BOTH))):
                for own in np.unique(part):
                    rows = np.flatnonzero((part == own) & np.isin(role, open_))
                    for key, text in beyond.value[int(own)][side] if len(rows) else ():
                        near = rows[uid[rows] != text]
                        n[near] = np.maximum(n[near], _agreeing(keys[near], np.frombuffer(key, np.uint8)[None].repeat(len(near), 0)))
            keep = pa.array(n >= 0)
            yield pa.RecordBatch.from_arrays([b.column("kind").filter(keep), b.column("block").filter(keep), b.column("key").filter(keep), pa.array(n[n >= 0], pa.int32())], names=["kind", "block", "key", "n"])

    closed = found.filter(f"role = {CLOSED}").select("kind", "block", "key", "n")
    return closed.unionByName(found.filter(f"role IN ({BEFORE}, {BEHIND}, {BOTH})").mapInArrow(tidied(run), "kind int, block long, key binary, n int"))


def _pack(x: np.ndarray) -> bytes:
    return shrink(x) if len(x) else b""


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return grow(b, kind) if b else np.zeros(0, kind)


def _bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)


def least_two(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, whether each stands there twice, the least document of each and the next of those that do."""
    by = np.lexsort((docs, keys))
    keys, docs = keys[by], docs[by]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    two = np.diff(np.append(at, len(keys))) > 1
    return keys[at], two, docs[at], docs[at[two] + 1]


def _answer(held: pa.Table, kind: int, keys: np.ndarray) -> np.ndarray:
    """What is known of each key in this order; -1: nothing."""
    own = held.filter(pa.array(held.column("kind").to_numpy() == kind)).combine_chunks()
    if not own.num_rows or not len(keys):
        return np.full(len(keys), -1)
    known, n = _bytes(_rows_of(own.column("key").chunk(0))), own.column("n").to_numpy()
    by = np.lexsort((-n, known))  # two slices of a block may have it
    known, n = known[by], n[by]
    at = np.searchsorted(known, asked := _bytes(keys))
    return np.where(np.append(known, known[:1])[at] == asked, np.append(n, -1)[at], -1)


def _windows(docs: DataFrame, agreeing: DataFrame, least: int, fan: int) -> DataFrame:
    """For each block, the windows whose suffix agrees far enough on both sides: by shards with their two least documents,
    and, under shard -1, where they are: documents, how many each has, the starts as differences, and the places of their
    hashes shard by shard."""

    def run(t: pa.Table, held: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_batches([], _WINDOWS)
        ids, counts, starts, hashes, seen = [], [], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], np.zeros(0, np.int64)
        for b in sliced(t.to_batches(), SLICE):
            uid = b.column("uid").to_numpy()
            b = b.filter(pa.array(~np.isin(uid, seen)))
            found, docs_, uids = _distinct(b)
            seen = np.append(seen, uids)
            x = Suffixes(found, least)
            right, left = (np.repeat(_answer(held, kind, x.keys(kind)), x.windows) for kind in (RIGHT, LEFT))
            before = np.repeat(x.at, x.windows) - x.window  # words of the window before its minimiser
            own = np.flatnonzero((left >= before) & (right >= x.span - before))
            text = np.repeat(x.text, x.windows)[own]
            each = np.bincount(text, minlength=len(found))
            ids.append(docs_[each > 0])
            counts.append(each[each > 0])
            starts.append((x.window[own] - x.begin[text]).astype(np.int32))
            hashes.append(rolled(x.h, least)[x.window[own]])
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        if not len(ids):
            return pa.Table.from_batches([], _WINDOWS)
        block, h = t.column("block")[0].as_py(), np.concatenate(hashes)
        number = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        by = np.argsort(h, kind="stable")
        sorted_h, sorted_n = h[by], number[by]
        new = np.append(True, sorted_h[1:] != sorted_h[:-1])
        once = new | np.append(True, sorted_n[1:] != sorted_n[:-1])
        keys, two, first, second = least_two(sorted_h[once], ids[sorted_n[once]])
        seconds = np.cumsum(two) - 1
        rows, rank, done = [], np.zeros(len(keys), np.int32), 0
        for s, at in cut_by(digit(keys, 0, fan)):
            rank[at] = np.arange(done, done + len(at))
            done += len(at)
            rows.append((s, block, shrink(keys[at]), np.packbits(two[at]).tobytes(), shrink(first[at]), _pack(second[seconds[at[two[at]]]]), None, None, None, None))
        places = np.zeros(len(h), np.int32)
        places[by] = rank[np.cumsum(new) - 1]
        rows.append((-1, block, None, None, None, None, shrink(ids), shrink(counts.astype(np.int32)), shrink(np.diff(np.concatenate(starts), prepend=np.int32(0))), shrink(places)))
        return pa.Table.from_batches([batch(_WINDOWS, *zip(*rows, strict=True))], _WINDOWS)

    return docs.groupBy("block").cogroup(agreeing.groupBy("block")).applyInArrow(tidied_cogroup(run), _WINDOWS_DDL)


def _union(rows: Iterator[dict], last: bool):
    """The union of arrays of windows; the last has only those that stand in two texts."""
    keys, docs, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for r in rows:
        k = _unpack(r["keys"], "<u8")
        keys += [k, k[_bits(r["two"], len(k))]]
        docs += [_unpack(r["first"], "<i8"), _unpack(r["second"], "<i8")]
        n += len(k)
        if n > ENTRIES:
            k, two, first, second = least_two(np.concatenate(keys), np.concatenate(docs))
            keys, docs, n = [k, k[two]], [first, second], 0
    k, two, first, second = least_two(np.concatenate(keys), np.concatenate(docs))
    if last:
        k, first, two = k[two], first[two], two[two]
    seconds = np.cumsum(two) - 1
    return k, lambda at: (np.packbits(two[at]).tobytes(), _pack(first[at]), _pack(second[seconds[at[two[at]]]]))


def _found(entries: DataFrame, blocks: int, fan: int) -> DataFrame:
    """For each block's array, in its order, which windows stand in two texts, and the two least documents of those."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for r in b.to_pylist():
                n = len(_unpack(r["keys"], "<u8"))
                yield batch(_FOUND, [r["shard"]], [r["block"]], [r["keys"]], [n], [r["two"]], [r["first"]], [r["second"]])

    def look(rows: list[dict]):
        every = [_unpack(r["keys"], "<u8") for r in rows]
        keys = [k[_bits(r["hit"], len(k))] for r, k in zip(rows, every, strict=True)]
        known, first, second = joined(keys, *([_unpack(r[c], "<i8") for r in rows] for c in ("first", "second")))

        def find(asked: np.ndarray) -> tuple:
            at = np.searchsorted(known, asked)
            hit = (np.append(known, np.uint64(0))[at] == asked) & (at < len(known))
            return len(asked), np.packbits(hit).tobytes(), _pack(first[at[hit]]), _pack(second[at[hit]])

        return find

    levels = merged(entries, blocks, _ENTRIES, _ENTRIES_DDL, _union, lambda row, keys: keys, fan)
    return answered(levels, levels[-1].mapInArrow(tidied(run), _FOUND_DDL), _FOUND, _FOUND_DDL, look, fan)


def _spans(places: DataFrame, found: DataFrame, least: int) -> DataFrame:
    def run(t: pa.Table, held: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_batches([], _SPANS)
        row = t.to_pylist()[0]
        ids, at = grow(row["docs"], "<i8"), grow(row["places"], "<i4")
        number = np.repeat(np.arange(len(ids)), grow(row["counts"], "<i4"))
        start = np.cumsum(grow(row["starts"], "<i4"), dtype=np.int32)
        answers = sorted(held.select(["shard", "hit", "first", "second", "n"]).to_pylist(), key=lambda r: r["shard"])
        hit = np.concatenate([_bits(r["hit"], r["n"]) for r in answers])
        first, second = np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int64)
        first[hit] = np.concatenate([_unpack(r["first"], "<i8") for r in answers])
        second[hit] = np.concatenate([_unpack(r["second"], "<i8") for r in answers])
        keep = hit[at]
        number, start, at = number[keep], start[keep], at[keep]
        if not len(at):
            return pa.Table.from_batches([], _SPANS)
        other = np.where(first[at] == ids[number], second[at], first[at])  # two texts of one doc_id have it as both
        new = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (start[1:] > start[:-1] + least)))
        end = start[np.append(new[1:], len(start)) - 1] + least
        none = lambda x: None if x == LAST else x
        docs, others = ([none(x) for x in y.tolist()] for y in (ids[number[new]], np.minimum.reduceat(other, new)))
        return pa.Table.from_batches([batch(_SPANS, docs, start[new], end, end - start[new], others)])

    return places.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(tidied_cogroup(run), _SPANS_DDL)


def _once(docs: DataFrame) -> DataFrame:
    """doc_id, text without the repeats that a task has of a row, told by 128 bits of hash; the others go in their block, so
    that a row that stands in a third of the table fills none."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            keep = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b.column("text")), strict=True):
                own = (doc_id, xxhash.xxh3_128_intdigest(text))
                keep.append(own not in seen)
                seen.add(own)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidied(run), "doc_id long, text string")


def repeated_passages(docs: DataFrame, least: int = LEAST, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """doc_id, start_word, end_word, n_words, first_doc_id: a row for each maximal repeated passage of each document.

    Words are runs of anything but ASCII white space, A-Z lowered, numbered from 0; end_word is not in the passage. A
    passage is what windows of `least` words that also stand in another document cover together; first_doc_id is the
    least of the other documents with any of these windows. Repeats inside one document alone do not count. Rows equal in
    doc_id and text are one document. Null doc_ids take part as the number 2 ** 63 - 1 and come back as null. Null, empty
    and shorter texts have no passage, and documents without one have no row.

    Windows are compared by 64 bits of hash: equal ones always meet, and two different ones meet once in 2 ** 64 pairs.
    Blocks have `block` bytes of text, and `fan` arrays are merged at once; neither changes a result.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)).first()[0] or 0
    blocks = max(8, -(-total // block))
    docs = docs.withColumn("uid", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(LAST)))
    agreeing = agreements(docs, least, blocks, total)
    own = _once(docs.select("doc_id", "text")).withColumn("uid", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(LAST)))
    windows = stored(_windows(own.withColumn("block", F.pmod("uid", F.lit(blocks))), agreeing, least, fan))
    entries = windows.filter("shard >= 0").select(*_ENTRIES.names)
    places = windows.filter("shard < 0").select("block", "docs", "counts", "starts", "places")
    return _spans(places, _found(entries, blocks, fan), least)
