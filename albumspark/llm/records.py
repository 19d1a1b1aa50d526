"""Token ids in binary record files: length-delimited records with masked checksums, and a separate index of offsets.

A record is framed as TFRecord files frame theirs: the payload's length (8 bytes), its masked CRC-32C, the payload, the
payload's masked CRC-32C. A payload is the document's id (8 bytes), 1 if the id is null (2 bytes), the width of a token id
(2 bytes), their number (4 bytes), and the ids, filled with zeros to a multiple of 4 bytes. An id takes 2 bytes where the
vocabulary has 65,536 entries at most, else 4; all numbers are little-endian. Beside each file of records lies an index of fixed rows, one a record: where
its frame begins, its payload's length, the document's id, how many ids it has, and how many the file has before it. Readers that shuffle
need the index alone to choose, and then one read for each record.

Documents are tokenized where they lie and dealt by ranges of doc_id, which come from one aggregate over the ids alone. A
doc_id that holds more rows than a range is dealt over all the ranges that it fills, so the files still ascend. A task
sorts its range and writes files of bounded size under names of its own; the manifest, a table, names the files of the
tries that succeeded, in order, so a lost task leaves files that nothing reads.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from albumspark.session import ship

from .common import files, sliced, strings, tidied, utf8
from .packing import END, TOGETHER, Remembered

#: Bytes of text tokenized at once, of a file of records at most (but for one record), and of records read at once.
SLICE, FILE, BLOCK = 4 << 20, 64 << 20, 4 << 20
#: Files that are read by a task of their own at most; beyond, tasks read several.
TASKS = 10_000
#: Fixed: words (of 4 bytes) of a payload before its ids, of a frame before the payload, and behind it.
HEAD, BEFORE, BEHIND = 4, 3, 1
INDEX = np.dtype([("offset", "<i8"), ("length", "<i8"), ("doc_id", "<i8"), ("first", "<i8"), ("many", "<u4"), ("crc", "<u4"), ("null", "<u4"), ("width", "<u4")])
MANIFEST = "manifest"

# Checksums -----------------------------------------------------------------------------------------------------------

#: Fixed: the reflected polynomial of CRC-32C, and what is added to a rotated checksum.
POLYNOMIAL, DELTA = 0x82F63B78, 0xA282EAD8
#: Words whose checksums are found side by side in one lane.
LANE = 64


def _tables(apply) -> np.ndarray:
    """A linear map of 32 bits as four tables, one for each byte."""
    return np.stack([apply((np.arange(256, dtype=np.uint64) << np.uint64(8 * k)).astype(np.uint32)) for k in range(4)])


def _by(tables: np.ndarray, s: np.ndarray) -> np.ndarray:
    return tables[0][s & 255] ^ tables[1][(s >> 8) & 255] ^ tables[2][(s >> 16) & 255] ^ tables[3][s >> 24]


def _word(s: np.ndarray) -> np.ndarray:
    """The state after a word of zeros, bit by bit."""
    for _ in range(32):
        s = (s >> 1) ^ np.where(s & 1, np.uint32(POLYNOMIAL), np.uint32(0)).astype(np.uint32)
    return s


def _doubled() -> list[np.ndarray]:
    """The state after 1, 2, 4, ... words of zeros."""
    out = [_tables(_word)]
    while len(out) < 32:
        out.append(_tables(lambda s, t=out[-1]: _by(t, _by(t, s))))
    return out


ZEROS = _doubled()
_OVER_LANE = ZEROS[LANE.bit_length() - 1]


def crc32c(words: np.ndarray, many: np.ndarray) -> np.ndarray:
    """CRC-32C of each run of many[k] words, laid end to end, of one word or more.

    Without its first state the checksum is linear, and zeros before a run do not change it: runs are filled in front to
    whole lanes, all lanes advance side by side, lanes of a run are folded in order, and the first state comes on top.
    """
    many = many.astype(np.int64)
    lanes = -(-many // LANE)
    ends = np.cumsum(lanes) * LANE
    filled = np.zeros(int(lanes.sum()) * LANE, np.uint32)
    filled[np.arange(len(words)) + np.repeat(ends - np.cumsum(many), many)] = words
    s = np.zeros(int(lanes.sum()), np.uint32)
    for column in np.ascontiguousarray(filled.reshape(-1, LANE).T):
        s = _by(ZEROS[0], s ^ column)
    by = np.argsort(-lanes, kind="stable")
    first, left = (np.cumsum(lanes) - lanes)[by], lanes[by]
    out = np.zeros(len(many), np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        on = int(np.searchsorted(-left, -k, side="left"))  # runs of over k lanes
        out[:on] = _by(_OVER_LANE, out[:on]) ^ s[first[:on] + k]
    total = np.empty_like(out)
    total[by] = out
    start = np.full(len(many), 0xFFFFFFFF, np.uint32)
    for bit, tables in enumerate(ZEROS):
        on = np.flatnonzero((many >> bit) & 1)
        if len(on):
            start[on] = _by(tables, start[on])
    return ~(total ^ start)


def masked(crc: np.ndarray) -> np.ndarray:
    c = crc.astype(np.uint64)
    return ((((c >> np.uint64(15)) | (c << np.uint64(17))) + np.uint64(DELTA)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


# Tokens --------------------------------------------------------------------------------------------------------------

#: Bytes that begin no white space: printable ASCII, and first bytes of characters whose block has none.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xF5] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?)")] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts begin, and where they may be cut without any effect on a byte-level tokenizer, and where they end.

    The tokenizer first splits a text by a pattern that takes one space with what follows it and leaves other white space
    alone. So it always splits before a space (or a single line feed) before something solid, behind a line feed between
    solid characters, and between a letter and a mark; what is on either side does not depend on the other.
    """
    space, feed = data == 0x20, data == 0x0A
    solid = np.append(_SOLID[data[1:]], False) if len(data) else np.zeros(0, bool)  # of the next byte
    printed = np.append(False, (data[:-1] > 0x20) & (data[:-1] < 0x7F)) if len(data) else solid  # of the byte before
    alone = feed & solid & printed
    at = space & solid
    at |= alone
    at[1:] |= alone[:-1]
    at[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    at[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.append(np.flatnonzero(at), len(data))


#: A piece that holds no space but its first byte, and something solid behind that.
_ONE_SPACE = "^ [^\\s\\p{Z}\\x{85}][^ ]*$"


class SpacedTokenizer:
    """Ids of whole texts, piece by piece; the ids of pieces are remembered, within a bound.

    New pieces that begin with their only space are encoded many at once: the tokenizer splits before each, and a token
    that begins with a space begins a piece.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[k for token, k in vocabulary.items() if token.startswith("\u0120")]] = True  # fixed: a space, as byte-level vocabularies spell it
        self.known = Remembered(self._new)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        spaced = pc.match_substring_regex(pieces, _ONE_SPACE).to_numpy(zero_copy_only=False)
        own = pieces.filter(pa.array(spaced)).to_pylist()
        ids = np.concatenate([np.zeros(0, np.uint32), *self._encoded(["".join(own[k : k + TOGETHER]) for k in range(0, len(own), TOGETHER)])])
        first = np.flatnonzero(self.spaced[ids])
        rest = self._encoded(pieces.filter(pa.array(~spaced)).to_pylist())
        if len(first) != len(own):  # a token spells a space in some other way
            found = self._encoded(pieces.to_pylist())
            return np.array([len(x) for x in found], np.int64), np.concatenate([np.zeros(0, np.uint32), *found])
        lengths = np.zeros(len(pieces), np.int64)
        lengths[spaced], lengths[~spaced] = np.diff(first, append=len(ids)), [len(x) for x in rest]
        out, at = np.empty(lengths.sum(), np.uint32), np.repeat(spaced, lengths)
        out[at], out[~at] = ids, np.concatenate([np.zeros(0, np.uint32), *rest])
        return lengths, out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all of them in order; null is empty."""
        data, offsets = utf8(column)
        borders = cuts(data, offsets)
        codes = strings(data, borders).dictionary_encode()
        lengths, ids = self.known.gathered(self.known.rows(codes.dictionary.cast(pa.string()))[codes.indices.to_numpy()])
        total = np.append(0, np.cumsum(lengths))
        return np.diff(total[np.searchsorted(borders, offsets)]), ids


_OPEN: dict[str, SpacedTokenizer] = {}


def tokenizer_of(path: str) -> SpacedTokenizer:
    """The worker's tokenizer of that file; it lasts from task to task."""
    if path not in _OPEN:
        _OPEN[path] = SpacedTokenizer(path)
    return _OPEN[path]


# Files ---------------------------------------------------------------------------------------------------------------


def framed(doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frames of records as words end to end, the words of each frame, and the masked checksum of each payload."""
    width = ids.itemsize
    payload = HEAD + -(-many * width // 4)
    frame = payload + BEFORE + BEHIND
    ends = np.cumsum(frame)
    starts = ends - frame
    out = np.zeros(int(ends[-1]) if len(ends) else 0, "<u4")
    own = doc_ids.astype("<i8").view("<u4").reshape(-1, 2)
    out[starts + 3], out[starts + 4], out[starts + 5], out[starts + 6] = own[:, 0], own[:, 1], null.astype(np.uint32) | width << 16, many
    out.view(ids.dtype)[np.repeat(4 // width * (starts + BEFORE + HEAD) - (np.cumsum(many) - many), many) + np.arange(len(ids))] = ids
    lengths = (4 * payload).astype("<i8").view("<u4")
    out[starts], out[starts + 1] = lengths[::2], lengths[1::2]
    out[starts + 2] = masked(crc32c(lengths, np.full(len(many), 2)))
    inside = np.repeat(starts + BEFORE - (np.cumsum(payload) - payload), payload) + np.arange(int(payload.sum()))
    crc = masked(crc32c(out[inside], payload))
    out[ends - 1] = crc
    return out, frame, crc


class _Writer:
    """One file of records and its index."""

    def __init__(self, system, base: str):
        self.system, self.name = system, f"{base}/{uuid.uuid4().hex}.records"
        self.out, self.rows, self.docs, self.tokens, self.size = system.open_output_stream(self.name), [], 0, 0, 0

    def add(self, doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, many: np.ndarray) -> None:
        raw, frame, crc = framed(doc_ids, null, ids, many)
        index = np.zeros(len(many), INDEX)
        index["offset"] = self.size + 4 * (np.cumsum(frame) - frame)
        index["length"], index["doc_id"], index["null"], index["crc"] = 4 * (frame - BEFORE - BEHIND), doc_ids, null, crc
        index["many"], index["width"] = many, ids.itemsize
        index["first"] = self.tokens + np.cumsum(many) - many
        self.out.write(raw.tobytes())
        self.rows.append(index.tobytes())
        self.docs, self.tokens, self.size = self.docs + len(many), self.tokens + int(many.sum()), self.size + 4 * len(raw)

    def close(self) -> tuple[str, int, int, int]:
        self.out.close()
        with self.system.open_output_stream(f"{self.name}.index") as f:
            f.write(b"".join(self.rows))
        return self.name, self.docs, self.tokens, self.size


def ranges(docs: DataFrame, partitions: int) -> tuple[int, np.ndarray]:
    """How many ranges the rows without a doc_id fill, and the bounds between the others, some `partitions` in all.

    One aggregate over the ids; bounds are approximate, which decides the sizes of files and nothing else.
    """
    shares = [k / partitions for k in range(1, partitions)]
    quantiles = F.percentile_approx(F.col("doc_id").cast("long"), shares, max(1000, 20 * partitions)) if shares else F.lit(None)
    n, known, bounds = docs.agg(F.count("*"), F.count("doc_id"), quantiles).first()
    nulls = -(-(n - known) * partitions // n) if n else 0
    return nulls, np.array(bounds or [], np.int64)


def width_of(tokenizer: str) -> int:
    """Bytes of an id."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4


_MADE = "part int, number int, path string, docs long, tokens long, bytes long"


def write(docs: DataFrame, directory: str, tokenizer: str, partitions: int | None = None, most: int = FILE) -> DataFrame:
    """Write the ids of each document, ended by id 0, in ascending order of doc_id; the manifest, a row a file.

    docs: doc_id, text; other columns are left out. Null and empty texts are the end alone. Rows without a doc_id come
    first. Rows of one doc_id are ordered by their ids within a range, and stand in neighbouring ranges where there are
    many. Texts are read whole; a file is as long as its longest record where that is over `most` bytes. An empty table
    gives an empty manifest. partitions: ranges, spark.sql.shuffle.partitions if not given.
    """
    spark = docs.sparkSession
    ship(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    nulls, bounds = ranges(docs, partitions)
    width = width_of(tokenizer)

    def tokenized(batches: Iterator[pa.RecordBatch]):
        tokenize, turn = tokenizer_of(tokenizer), 0
        for b in sliced(batches, SLICE):
            many, ids = tokenize(b.column("text"))
            ids = np.insert(ids, np.cumsum(many), END).astype(f"<u{width}", copy=False)
            ends = np.append(0, width * np.cumsum(many + 1))
            doc_id = b.column("doc_id")
            null = doc_id.is_null().to_numpy(zero_copy_only=False)
            k = doc_id.fill_null(0).to_numpy()
            low, high = np.searchsorted(bounds, k, side="left") + nulls, np.searchsorted(bounds, k, side="right") + nulls
            low, high = np.where(null, 0, low), np.where(null, max(0, nulls - 1), high)
            part = low + (turn + np.arange(len(k))) % (high - low + 1)  # of those that its id may stand in, each in turn
            turn += len(k)
            column = pa.Array.from_buffers(pa.large_binary(), len(k), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([doc_id, column, pa.array(part, pa.int32())], names=["doc_id", "ids", "part"])

    def written(batches: Iterator[pa.RecordBatch]):
        system, base = files(directory)
        system.create_dir(base, recursive=True)
        out, part, number = None, None, 0

        def closed():
            columns = [[part], [number], *([x] for x in out.close())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "number", "path", "docs", "tokens", "bytes"])

        for whole in batches:
            for b in sliced([whole], SLICE, "ids"):
                part = b.column("part")[0].as_py()
                doc_id, ids = b.column("doc_id"), b.column("ids").cast(pa.large_binary())
                offsets = np.frombuffer(ids.buffers()[1], "<i8")[ids.offset : ids.offset + len(ids) + 1]
                own = np.frombuffer(ids.buffers()[2], f"<u{width}")[offsets[0] // width : offsets[-1] // width]
                if out is not None and out.size + offsets[-1] - offsets[0] > most:
                    yield closed()
                    out, number = None, number + 1
                out = out or _Writer(system, base)
                out.add(doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False), own, np.diff(offsets) // width)
        if out is not None:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(tokenized), "doc_id long, ids binary, part int")
    # Every row names its range; no sampling pass over the texts is needed.
    dealt = rows.repartitionById(nulls + len(bounds) + 1, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    dealt.mapInArrow(tidied(written), _MADE).write.mode("overwrite").parquet(f"{directory.rstrip('/')}/{MANIFEST}")
    return manifest(spark, directory)


def manifest(spark: SparkSession, directory: str) -> DataFrame:
    """part, number, path, docs, tokens, bytes of each file, and start, the ids of all files before it. A row a file, which
    has some 64 MB: the sums over all files are one small task."""
    made = spark.read.schema(_MADE).parquet(f"{directory.rstrip('/')}/{MANIFEST}")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def checked(raw: bytes, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of frames that lie end to end, and where each begins; ValueError where one is damaged."""
    words = np.frombuffer(raw, "<u4")
    payload = index["length"] // 4
    frame = payload + BEFORE + BEHIND
    starts = np.cumsum(frame) - frame
    lengths = np.stack([words[starts], words[starts + 1]], 1)
    inside = np.repeat(starts + BEFORE - (np.cumsum(payload) - payload), payload) + np.arange(int(payload.sum()))
    crc = masked(crc32c(words[inside], payload))
    sound = (lengths.ravel().view("<i8") == index["length"]) & (words[starts + 2] == masked(crc32c(lengths.ravel(), np.full(len(index), 2))))
    sound &= (crc == words[starts + frame - 1]) & (crc == index["crc"])
    if not sound.all():
        raise ValueError(f"damaged record of document {index['doc_id'][np.flatnonzero(~sound)[0]]}")
    return words, starts


def _records(words: np.ndarray, starts: np.ndarray, index: np.ndarray, start: np.ndarray, digest: bool) -> pa.RecordBatch:
    """index: of one width of ids."""
    many, width = words[starts + 6].astype(np.int64), int(index["width"][0])
    doc_id = np.ascontiguousarray(np.stack([words[starts + 3], words[starts + 4]], 1)).view("<i8").ravel()
    null = (words[starts + 5] & 0xFFFF) == 1
    at = np.repeat(4 // width * (starts + BEFORE + HEAD) - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    ids, ends = words.view(f"<u{width}")[at].astype("<u4"), 4 * np.cumsum(many)
    if digest:
        raw = memoryview(ids).cast("B")
        last = pa.array([zlib.crc32(raw[x:y]) for x, y in zip((ends - 4 * many).tolist(), ends.tolist(), strict=True)], pa.int64())
    else:
        last = pa.Array.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(np.append(0, ends).astype("<i8")), pa.py_buffer(ids)]).cast(pa.binary())
    columns = [pa.array(doc_id, pa.int64(), mask=null), pa.array(start, pa.int64()), pa.array(many, pa.int64()), last]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def _schema(digest: bool) -> str:
    return "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary")


def read(spark: SparkSession, directory: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of each record; with digest, ids_crc32, the checksum
    of its ids' bytes, in place of ids. A task reads whole files in blocks; a damaged record is an error."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]):
        system, _ = files(directory)
        for row in (r for b in batches for r in b.to_pylist()):
            with system.open_input_file(f"{row['path']}.index") as f:
                index = np.frombuffer(f.read(), INDEX)
            block = (index["offset"] // BLOCK).astype(np.int64)
            edges = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(index)]
            with system.open_input_file(row["path"]) as f:
                for x, y in zip(edges, edges[1:], strict=False):
                    own = index[x:y]
                    end = int(own["offset"][-1] + own["length"][-1]) + 4 * (BEFORE + BEHIND)
                    words, starts = checked(f.read_at(end - int(own["offset"][0]), int(own["offset"][0])), own)
                    yield _records(words, starts, own, row["start"] + own["first"], digest)

    named = manifest(spark, directory).select("path", "start")
    return named.repartition(max(1, min(named.count(), TASKS))).mapInArrow(tidied(run), _schema(digest))


def index(spark: SparkSession, directory: str) -> DataFrame:
    """path, offset, length, doc_id, start, many, width and crc of each record, from the indexes alone."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]):
        system, _ = files(directory)
        for row in (r for b in batches for r in b.to_pylist()):
            with system.open_input_file(f"{row['path']}.index") as f:
                own = np.frombuffer(f.read(), INDEX)
            path = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(own), np.int32)), pa.array([row["path"]])).cast(pa.string())
            columns = [path, *(pa.array(np.ascontiguousarray(own[c]), pa.int64()) for c in ("offset", "length"))]
            columns += [pa.array(own["doc_id"], pa.int64(), mask=own["null"] == 1), pa.array(row["start"] + own["first"], pa.int64()), *(pa.array(own[c].astype(np.int64)) for c in ("many", "width", "crc"))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "offset", "length", "doc_id", "start", "many", "width", "crc"])

    named = manifest(spark, directory).select("path", "start")
    kinds = "path string, offset long, length long, doc_id long, start long, many long, width long, crc long"
    return named.repartition(max(1, min(named.count(), TASKS))).mapInArrow(tidied(run), kinds)


def shuffled(spark: SparkSession, directory: str, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """As read(), in an order by the hash of seed and start: the index is shuffled, and each record fetched by its offset.

    Partitions are shares of the shuffle, each in its order. Records of a batch are fetched file by file.
    """
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.xxhash64(F.lit(seed), "start")
    rows = index(spark, directory).withColumn("key", key).repartition(partitions, "key").sortWithinPartitions("key", "start").drop("key")

    def run(batches: Iterator[pa.RecordBatch]):
        system, _ = files(directory)
        for b in batches:
            for x, y in _filled(b.column("length").to_numpy(), BLOCK):
                own = b.slice(x, y - x)
                paths, offsets, lengths = own.column("path").to_pylist(), own.column("offset").to_numpy(), own.column("length").to_numpy()
                raw: list[bytes] = [b""] * len(paths)
                by = sorted(range(len(paths)), key=lambda k: (paths[k], offsets[k]))
                name, f = None, None
                for k in by:
                    if paths[k] != name:
                        if f is not None:
                            f.close()
                        name, f = paths[k], system.open_input_file(paths[k])
                    raw[k] = f.read_at(int(lengths[k]) + 4 * (BEFORE + BEHIND), int(offsets[k]))
                if f is not None:
                    f.close()
                at = np.zeros(len(paths), INDEX)
                at["length"], at["doc_id"] = lengths, own.column("doc_id").fill_null(0).to_numpy()
                at["crc"], at["width"] = own.column("crc").to_numpy(), own.column("width").to_numpy()
                words, starts = checked(b"".join(raw), at)
                yield _records(words, starts, at, own.column("start").to_numpy(), False)

    return rows.mapInArrow(tidied(run), _schema(False))


def _filled(lengths: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of some `size` bytes in all, or one."""
    at = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // size, prepend=-1)).tolist()
    yield from zip(at, [*at[1:], len(lengths)], strict=True)
