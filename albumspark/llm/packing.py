"""Best-fit packing by length patterns: non-negative least squares over the length histogram, then best fit.

Documents become pieces of at most `size` tokens. Only the histogram of piece lengths, at most `size` rows, reaches
the driver. There, patterns of a few lengths that fill a sequence are enumerated on a grid, longer ones are made as
the fit asks for them, and their repeat counts are fitted to the histogram by non-negative least squares and rounded.
A pattern says from which cells of the grid its pieces come; the lengths in these cells are then chosen so that they
add up to the size. What is left after a few such fits is packed best fit, largest first, into the gaps and into new
sequences. The plan is a table of slots: the pieces of a length, numbered from 0, take the slots of that length in
order. Pieces are numbered by two-level counts, so a length that a third of all pieces share is dealt over many tasks.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumspark.session import ship

from .common import checkpointed, free_names, sliced, tidied

#: Fixed: the token that ends a document.
END = 0
#: Grid cells of a sequence; lengths in an enumerated pattern and in any pattern at most; fits of what is left at most.
CELLS, FEW, MOST, FITS = 128, 3, 32, 12
#: Chunks, and parts of chunks, whose ids a worker remembers: some 30 bytes each.
REMEMBERED = 300_000
#: Bytes of text tokenized at once, and words whose ids are put together at once.
SLICE, WORDS = 4 << 20, 1 << 20
#: Parts that are encoded as one text.
TOGETHER = 256

#: Letters that composition leaves alone, then marks: such a chunk has the ids of its letters, then those of its marks.
PLAIN = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?|*%&$#]*)$"


class Remembered:
    """Texts and the ids of each, laid end to end; `make` finds the ids of new texts. Bounded by REMEMBERED texts and
    those of one call."""

    def __init__(self, make):
        self.make = make
        self.texts, self.starts, self.ids = pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def rows(self, texts: pa.Array) -> np.ndarray:
        """The row of each of these distinct texts; rows hold until the next call."""
        at = pc.index_in(texts, value_set=self.texts)
        if len(self.texts) > REMEMBERED:  # those of this call stay
            own = at.drop_null().to_numpy()
            lengths, ids = self.gathered(own)
            self.texts, self.starts, self.ids = self.texts.take(pa.array(own)), np.append(0, np.cumsum(lengths)), ids
            at = pc.index_in(texts, value_set=self.texts)
        out = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh = texts.take(pa.array(new))
            lengths, ids = self.make(fresh)
            out[new] = len(self.texts) + np.arange(len(new))
            self.texts = pa.concat_arrays([self.texts, fresh])
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(lengths))
            self.ids = np.append(self.ids, ids)
        return out

    def gathered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the rows has, and all of them in order."""
        first = self.starts[rows]
        lengths = self.starts[rows + 1] - first
        before = np.cumsum(lengths) - lengths
        return lengths, self.ids[np.repeat(first - before, lengths) + np.arange(lengths.sum())]


class ChunkTokenizer:
    """Ids of whole texts, chunk by chunk between ASCII white space, which this tokenizer drops.

    Chunks and their parts are remembered. A new plain chunk is put together from its letters and its marks, which the
    tokenizer takes apart too; new parts are encoded many at once, since a part's last token, and no other, ends a word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts, self.chunks = Remembered(self._parts), Remembered(self._chunks)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([len(x) for x in found], np.int64), np.array([y for x in found for y in x], np.uint32)

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = parts.to_pylist()
        cut = [texts[at : at + TOGETHER] for at in range(0, len(texts), TOGETHER)]
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for own, found in zip(cut, self.tokenizer.encode_batch_fast([" ".join(x) for x in cut], add_special_tokens=False), strict=True):
            x = np.array(found.ids, np.uint32)
            last = np.flatnonzero(self.ends[x])
            n = np.diff(last, prepend=-1)
            if len(last) != len(own):  # an empty part, or one that is no single word
                n, x = self._each(own)
            lengths.append(n)
            ids.append(x)
        return np.concatenate(lengths), np.concatenate(ids)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = pc.extract_regex(chunks, PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        lengths, ids = np.zeros(len(chunks), np.int64), [np.zeros(0, np.uint32)] * 2
        sides = []
        both = found.drop_null()
        if len(both):
            words = [pc.utf8_lower(pc.struct_field(both, k)).dictionary_encode() for k in (0, 1)]
            every = pa.concat_arrays([w.dictionary for w in words]).unique()
            rows = self.parts.rows(every)
            for w in words:
                own = rows[pc.index_in(w.dictionary, value_set=every).to_numpy()]
                sides.append(own[w.indices.to_numpy()])
            n, ids[0] = self.parts.gathered(np.stack(sides, 1).ravel())
            lengths[plain] = n.reshape(-1, 2).sum(1)
        lengths[~plain], ids[1] = self._each(chunks.filter(pa.array(~plain)).to_pylist())
        if plain.all() or not plain.any():
            return lengths, ids[0] if plain.any() else ids[1]
        out, own = np.empty(lengths.sum(), np.uint32), np.repeat(plain, lengths)
        out[own], out[~own] = ids
        return lengths, out

    def __call__(self, documents: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all of them in order; null is empty."""
        split = pc.ascii_split_whitespace(documents.cast(pa.string()).fill_null(""))
        words, many = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(words), WORDS):
            codes = words.slice(at, WORDS).dictionary_encode()
            n, x = self.chunks.gathered(self.chunks.rows(codes.dictionary)[codes.indices.to_numpy()])
            lengths.append(n)
            ids.append(x)
        total = np.append(0, np.cumsum(np.concatenate(lengths)))
        return np.diff(total[np.append(0, np.cumsum(many))]), np.concatenate(ids)


_OPEN: dict[str, ChunkTokenizer] = {}


def tokenizer_of(path: str) -> ChunkTokenizer:
    """The worker's tokenizer of that file; it and what it remembers, some 40 MB, last from task to task."""
    if path not in _OPEN:
        _OPEN[path] = ChunkTokenizer(path)
    return _OPEN[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, digest: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of whole texts, each ended by id 0; with digest,
    ids_crc32, the checksum of these bytes, in place of ids.

    Null and empty texts are the end token alone. Texts longer than size are cut every size tokens. Other columns of
    docs are left out; a repeated doc_id gives the pieces of each of its rows, a null one stays null. An empty table
    gives none.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        tokenize = tokenizer_of(tokenizer)
        for b in sliced(batches, SLICE):
            many, ids = tokenize(b.column("text"))
            ids = np.insert(ids, np.cumsum(many), END).astype("<u4", copy=False)
            many = many + 1
            n = -(-many // size)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            length = np.minimum(size, np.repeat(many, n) - piece * size)
            ends = 4 * np.cumsum(length)
            if digest:
                raw = memoryview(ids).cast("B")
                last = pa.array([zlib.crc32(raw[x:y]) for x, y in zip((ends - 4 * length).tolist(), ends.tolist(), strict=True)], pa.int64())
            else:
                last = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(ids)]).cast(pa.binary())
            doc_id = b.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
            columns = [doc_id, pa.array(piece, pa.int32()), pa.array(piece * size, pa.int64()), pa.array(length, pa.int64()), last]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32" if digest else "ids"])

    made = "ids_crc32 long" if digest else "ids binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), f"doc_id long, piece int, start long, length long, {made}")


# The plan ------------------------------------------------------------------------------------------------------------


class Grid:
    """Cells of `unit` lengths each: cell c holds the lengths (c - 1) * unit + 1 to c * unit.

    Lengths lie half a unit below their cell's top on average, so the cells of a full pattern of k lengths add up to
    half of k more than the cells of a sequence; with a unit of one, to just as many.
    """

    def __init__(self, size: int):
        self.size, self.unit = size, max(1, -(-size // CELLS))
        self.cells = -(-size // self.unit)

    def cell(self, length: int) -> int:
        return -(-length // self.unit)

    def goal(self, parts: int) -> int:
        return self.cells + (parts // 2 if self.unit > 1 else 0)

    def column(self, pattern: tuple[int, ...]) -> np.ndarray:
        return np.bincount(np.array(pattern, np.int64), minlength=self.cells + 1)[: self.cells + 1].astype(float)

    def patterns(self, parts: int = FEW) -> list[tuple[int, ...]]:
        """All full patterns of at most `parts` lengths, longest first."""
        out: list[tuple[int, ...]] = []

        def grow(left: int, most: int, parts: int, chosen: tuple[int, ...]):
            if not parts:
                out.append(chosen)
                return
            least = left if parts == 1 else -(-left // parts)
            for x in range(min(left - parts + 1, most), least - 1, -1):
                grow(left - x, x, parts - 1, (*chosen, x))

        for k in range(1, parts + 1):
            grow(self.goal(k), self.cells, k, ())
        return out

    def best(self, gain: np.ndarray) -> tuple[tuple[int, ...], float]:
        """The full pattern of at most MOST lengths with the greatest sum of gains, by dynamic programming."""
        top, useful = self.goal(MOST), np.arange(1, self.cells + 1)
        value, came = np.full((MOST + 1, top + 1), -np.inf), np.zeros((MOST + 1, top + 1), np.int32)
        value[0, 0], most, at = 0, 0.0, 0
        before = np.arange(top + 1)[:, None] - useful  # what is filled without the last length
        for k in range(1, MOST + 1):
            new = np.where(before >= 0, value[k - 1][before] + gain[useful], -np.inf)
            last = new.argmax(1)
            value[k], came[k] = new[np.arange(top + 1), last], useful[last]
            if value[k, self.goal(k)] > most:
                most, at = value[k, self.goal(k)], k
        out, left = [], self.goal(at)
        for k in range(at, 0, -1):
            out.append(int(came[k, left]))
            left -= out[-1]
        return tuple(sorted(out, reverse=True)), float(most)


def nnls(columns: np.ndarray, target: np.ndarray, more, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """x >= 0 that brings columns x near the target in squares, by active sets; more(residual) may give a new column.

    The columns with x > 0 and x. At most as many columns as rows are ever active, so few of many repeat counts are
    not zero and rounding loses little.
    """
    active, x = np.zeros((len(target), 0)), np.zeros(0)
    for _ in range(rounds):
        residual = target - active @ x
        if np.abs(residual).max(initial=0) < 1e-7:
            break
        gains = residual @ columns
        k = int(np.argmax(gains)) if len(gains) else -1
        new, gain = (columns[:, k], gains[k]) if k >= 0 else (None, 0.0)
        other, other_gain = more(residual)
        if other_gain > gain:
            new, gain = other, other_gain
        if gain <= 1e-9 * max(1.0, np.abs(target).max()) or (active == new[:, None]).all(axis=0).any():
            break
        active, x = np.column_stack([active, new]), np.append(x, 0.0)
        while len(x):
            free = np.linalg.lstsq(active, target, rcond=None)[0]
            if (free > 0).all():
                x = free
                break
            down = free <= 0
            x = x + np.min(x[down] / np.maximum(x[down] - free[down], 1e-12)) * (free - x)
            keep = x > 1e-9
            if keep.all():
                keep[np.argmin(free)] = False
            active, x = active[:, keep], x[keep]
    return active, x


def fitted(grid: Grid, counts: np.ndarray, base: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], float]]:
    """Patterns with their repeat counts, fitted to the pieces of each cell; squares are divided by the counts."""
    weight = 1 / np.sqrt(counts + 1)

    def more(residual: np.ndarray):
        pattern, gain = grid.best(residual * weight)
        return grid.column(pattern) * weight, gain

    columns = np.array([grid.column(p) for p in base]).T * weight[:, None]
    active, x = nnls(columns, counts * weight, more)
    many = np.rint(active / weight[:, None]).astype(int)
    found = [(tuple(np.repeat(np.arange(len(m)), m)[::-1].tolist()), n) for m, n in zip(many.T, x.tolist(), strict=True)]
    return sorted(found, key=lambda p: (-p[1], p[0]))


def chosen(pattern: tuple[int, ...], held: dict[int, list[int]], left: dict[int, int], grid: Grid) -> list[int] | None:
    """Lengths that are left, one from each cell of the pattern, with the greatest sum that fits: of those with that sum,
    plentiful ones."""
    base = sum((c - 1) * grid.unit for c in pattern)
    room = grid.size - base
    if room < len(pattern):
        return None
    came = np.zeros((len(pattern) + 1, room + 1), np.int32)
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    for k, c in enumerate(pattern):
        now, same = np.zeros(room + 1, bool), pattern[:k].count(c)  # a length serves as many places as it has pieces
        for y in sorted((y for y in held[c] if left[y] > same), key=lambda y: -left[y]):
            d = y - (c - 1) * grid.unit
            new = np.zeros(room + 1, bool)
            new[d:] = reach[: max(0, room + 1 - d)]
            new &= ~now
            came[k + 1][new] = y
            now |= new
        reach = now
    found = np.flatnonzero(reach)
    if not len(found):
        return None
    out, at = [], int(found[-1])
    for k in range(len(pattern), 0, -1):
        out.append(int(came[k, at]))
        at -= out[-1] - (pattern[k - 1] - 1) * grid.unit
    return out[::-1]


class Plan:
    """Sequences as (lengths, how many such) for every piece of the histogram. Its cost depends on size alone, not on
    how many pieces there are. by_patterns: how many pieces under full size the fitted patterns place."""

    def __init__(self, histogram: dict[int, int], size: int = 2048):
        self.grid, self.done, self.by_patterns = Grid(size), [], 0
        self.left = defaultdict(int, {k: v for k, v in histogram.items() if v})
        if self.left[size]:
            self.done.append(((size,), self.left[size]))
        del self.left[size]
        self.fill()
        self.best_fit()

    def counts(self) -> np.ndarray:
        out = np.zeros(self.grid.cells + 1)
        for length, n in self.left.items():
            out[self.grid.cell(length)] += n
        return out

    def fill(self) -> None:
        base, held = self.grid.patterns(), defaultdict(list)
        for y in sorted(self.left, reverse=True):
            held[self.grid.cell(y)].append(y)
        for _ in range(FITS):
            if not any(self.left.values()):
                return
            found = fitted(self.grid, self.counts(), base)
            repeats = [(p, int(n)) for p, n in found if n >= 1] or [(p, 1) for p, n in found if n >= 0.5]
            before = self.by_patterns
            for p, n in repeats:
                self.place(p, n, held)
            if self.by_patterns == before:
                return

    def place(self, pattern: tuple[int, ...], n: int, held: dict[int, list[int]]) -> None:
        """The pattern up to n times, for as long as lengths are left that fill a sequence to within a cell."""
        while n > 0:
            lengths = chosen(pattern, held, self.left, self.grid)
            if lengths is None or sum(lengths) <= self.grid.size - self.grid.unit:
                return
            use = defaultdict(int)
            for y in lengths:
                use[y] += 1
            m = min(n, *(self.left[y] // u for y, u in use.items()))
            for y, u in use.items():
                self.left[y] -= m * u
            self.done.append((tuple(lengths), m))
            self.by_patterns += m * len(lengths)
            n -= m

    def best_fit(self) -> None:
        """What is left, largest first, by counts: of all open sequences the one with the least room that is enough."""
        size, left = self.grid.size, self.left
        open_: dict[int, list[list]] = defaultdict(list)  # room -> [lengths, how many]
        for lengths, m in self.done:
            open_[size - sum(lengths)].append([list(lengths), m])
        rooms = np.zeros(size + 1, bool)
        for room in open_:
            rooms[room] = True
        for length in sorted(left, reverse=True):
            while left[length] > 0:
                fit = np.flatnonzero(rooms[length:])
                if len(fit):
                    room = int(fit[0]) + length
                    lengths, m = open_[room].pop()
                    if not open_[room]:
                        rooms[room] = False
                    n = min(m, left[length])
                    if m > n:
                        open_[room].append([lengths, m - n])
                        rooms[room] = True
                    new, each = [*lengths, length], 1
                else:
                    each = min(size // length, left[length])
                    n, room = left[length] // each, size
                    new = [length] * each
                open_[size - sum(new)].append([new, n])
                rooms[size - sum(new)] = True
                left[length] -= n * each
        self.done = [(tuple(lengths), m) for room in sorted(open_) for lengths, m in open_[room]]


def plan(histogram: dict[int, int], size: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many such), for every piece of the histogram."""
    return Plan(histogram, size).done


def slots(made: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """length -> rows of (first number, first sequence, offset), by first number, for the pieces of that length."""
    out, taken, sequence = defaultdict(list), defaultdict(int), 0
    for lengths, m in made:
        offset = 0
        for x in lengths:
            out[x].append((taken[x], sequence, offset))
            taken[x] += m
            offset += x
        sequence += m
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(rows: DataFrame, size: int = 2048) -> DataFrame:
    """rows (length, doc_id, piece and any others) with sequence_id and offset; every row is placed.

    rows is read more than once, so cut its lineage first. Ties of doc_id and piece fall in any order: rows of one
    length are interchangeable. Null ids come first. An empty table gives no row.
    """
    spark = rows.sparkSession
    rows = rows.select(*[c for c in rows.columns if c.lower() not in ("sequence_id", "offset")])
    part, n, before_it, rank, number = free_names(rows, "_range", "_n", "_before", "_rank", "_number")
    dealt = rows.withColumn(part, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1024)))
    counts = checkpointed(dealt.groupBy("length", part).agg(F.count("*").alias(n)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum(n).alias("n")).collect()}  # at most size rows
    shared = spark.sparkContext.broadcast(slots(plan(histogram, size)))
    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before_it, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    inside = Window.partitionBy("length", part).orderBy("doc_id", "piece")
    numbered = dealt.withColumn(rank, F.row_number().over(inside)).join(counts, ["length", part])
    columns = rows.columns
    numbered = numbered.select(*[F.col(f"`{c}`") for c in columns], (F.col(before_it) + F.col(rank) - 1).alias(number))

    def place(batches: Iterator[pa.RecordBatch]):
        table = shared.value
        for b in batches:
            length, numbers = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", number))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                own, at = table[x], length == x
                k = np.searchsorted(own[:, 0], numbers[at], side="right") - 1
                sequence[at], offset[at] = own[k, 1] + numbers[at] - own[k, 0], own[k, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
