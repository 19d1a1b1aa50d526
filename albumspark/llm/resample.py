"""Importance resampling towards a target: documents weighed by how much likelier their hashed n-grams are in the target.

The words of a slice of texts get ids, and the suffixes of the sequence of ids are sorted by their first `order` words;
a suffix ends with its document. Suffixes that share k words or more stand together: such a run of the array of common
prefixes (LCP) is one distinct k-gram with all its occurrences. A run is hashed once, from the hash of the run of one word
less that holds it. Counting adds a run's length to its bucket; scoring hands the gain of a run's bucket to the documents
of its occurrences. A task thus sends one count for each bucket, whatever the number of its n-grams, and no n-gram is
shuffled. Texts are read twice, once to count and once to score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumspark.session import ship

from .common import LOWER, checkpointed, free_names, sliced, texts, tidied

#: Fixed: bytes that are part of a word once A-Z are lower case: 0-9, a-z and all beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
WORD_BYTE[128:] = True
WORD_RE = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes of text handled at once; longer texts are cut between words.
SLICE = 4 << 20
#: Copies of a row that are numbered at once.
COPIES = 1 << 16


class Stretch(NamedTuple):
    """Texts laid end to end, lower-cased: text k is data[offsets[k]:offsets[k + 1]], part of row rows[k], and n-grams count
    that begin before its byte until[k]."""

    data: np.ndarray
    offsets: np.ndarray
    rows: np.ndarray
    until: np.ndarray


def stretches(batch: pa.RecordBatch, order: int, size: int = SLICE) -> Iterator[Stretch]:
    """The texts of a batch, in which only a batch of one row may be longer than size: that one comes in parts which end
    between words, each with the order - 1 words behind it."""
    found = texts(batch.column("text"))
    n = np.array([len(x) for x in found], np.int64)
    if len(found) != 1 or n[0] <= size:
        offsets = np.append(0, np.cumsum(n))
        yield Stretch(LOWER[np.frombuffer(b"".join(found), np.uint8)], offsets, np.arange(len(found)), offsets[1:])
        return
    (text,), at = found, 0
    while at < len(text):
        inside = WORD_RE.match(text, at + size) if at + size < len(text) else None
        end = inside.end() if inside else min(at + size, len(text))
        behind = max((m.end() for m in islice(WORD_RE.finditer(text, end), order - 1)), default=end)
        yield Stretch(LOWER[np.frombuffer(text, np.uint8)[at:behind]], np.array([0, behind - at]), np.zeros(1, np.int64), np.array([end - at]))
        at = end


class Words(NamedTuple):
    """ids of all words in order, the distinct words that they stand for, each word's row, how many words its text has from
    it on, and whether it counts."""

    ids: np.ndarray
    distinct: list[bytes]
    rows: np.ndarray
    left: np.ndarray
    counts: np.ndarray


def words_of(s: Stretch) -> Words:
    inside = WORD_BYTE[s.data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = s.offsets[(s.offsets > 0) & (s.offsets < len(s.data))]
    first[borders], last[borders - 1] = inside[borders], inside[borders - 1]
    starts = np.flatnonzero(first)
    ends = np.cumsum(np.flatnonzero(last) + 1 - starts)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(0, ends).astype("<i8")), pa.py_buffer(s.data[inside])]).dictionary_encode()
    text = np.searchsorted(s.offsets, starts, side="right") - 1
    after = np.searchsorted(text, np.arange(len(s.rows)), side="right")  # words up to each text's end
    return Words(found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist(), s.rows[text], after[text] - np.arange(len(text)), starts < s.until[text])


class Runs(NamedTuple):
    """All n-grams of one length: the occurrences (rows of words) in the order of the suffix array, the run that each is in,
    and the crc32 of each run."""

    at: np.ndarray
    run: np.ndarray
    crc: np.ndarray


def runs_of(w: Words, order: int) -> list[Runs]:
    """The distinct n-grams of 1 to `order` words, with their occurrences, from the suffix array of the word ids."""
    n, many = len(w.ids), len(w.distinct) + 1
    columns = []
    for k in range(order):
        c = np.zeros(n, np.int64)  # 0: the text has ended
        c[: max(0, n - k)] = w.ids[k:] + 1
        columns.append(np.where(w.left > k, c, 0))
    key, top = columns[0], many
    for c in columns[1:]:
        if top * many >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            top = n + 1
        key, top = key * many + c, top * many
    suffixes = np.argsort(key)
    common, same = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)  # words shared with the suffix before, up to `order`
    for c in columns:
        c = c[suffixes]
        same &= (c[1:] == c[:-1]) & (c[1:] > 0)
        common[1:] += same
    out: list[Runs] = []
    parent, spaced = np.zeros(n, np.int64), [b" " + x for x in w.distinct]
    for k, c in enumerate(columns):
        member = c[suffixes] > 0
        head = member & (common <= k)
        run = np.cumsum(head) - 1
        heads = c[suffixes[head]] - 1
        if k:
            crc = list(map(zlib.crc32, [spaced[x] for x in heads.tolist()], out[-1].crc[parent[head]].tolist()))
        else:
            crc = [zlib.crc32(w.distinct[x]) for x in heads.tolist()]
        out.append(Runs(suffixes[member], run[member], np.array(crc, np.int64)))
        parent = run
    return out


def bucket_counts(docs: DataFrame, order: int = 2, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how many n-grams of all texts, repeats included, fall into each bucket that has any.

    docs: text; a null one has none. A task sends a row a bucket at most.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for b in sliced(batches, SLICE):
            for s in stretches(b, order):
                w = words_of(s)
                for r in runs_of(w, order):
                    length = np.bincount(r.run[w.counts[r.at]], minlength=len(r.crc))
                    np.add.at(total, r.crc % buckets, length)
        any_ = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(any_, pa.int32()), pa.array(total[any_], pa.int64())], names=["bucket", "n"])

    return docs.select("text").mapInArrow(tidied(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, order: int = 2, buckets: int = 10_000) -> np.ndarray:
    """The floor of 1000 times the log of each bucket's smoothed share in target by that in docs; `buckets` numbers reach
    the driver, whatever the size of the tables."""

    def counted(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, order, buckets).collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = counted(docs), counted(target)
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((y + 1.0) * all_s / ((x + 1.0) * all_t))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, order: int = 2) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain of all n-grams of the whole text (none: 0)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]):
        gain = shared.value
        for b in sliced(batches, SLICE):
            n_words, n_features, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for s in stretches(b, order):
                w = words_of(s)
                n_words += np.bincount(w.rows[w.counts], minlength=b.num_rows)
                for r in runs_of(w, order):
                    own = w.counts[r.at]
                    rows, g = w.rows[r.at[own]], gain[r.crc % len(gain)][r.run[own]]
                    n_features += np.bincount(rows, minlength=b.num_rows)
                    total += np.bincount(rows, g, b.num_rows).astype(np.int64)  # whole numbers far below 2**53
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, doc_id: str = "doc_id") -> Column:
    """Gumbel noise times 1000, floored, from the hash of seed and id; a null id counts as empty."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, percent: int = 25, least: int = 20) -> DataFrame:
    """scored (doc_id, n_words, score, others) without n_words and with rank: of the N rows of `least` words or more, the
    floor of percent * N / 100 with the highest scores are numbered from 1, ties by doc_id, null last, then by the others.

    A count for each score, of which there are some 100,000 at most as scores are whole thousandths of logs, gives every
    score its first rank; only rows of one score are ranked together. Repeated rows are one row with a count there, so
    that no task gets them one by one, and are laid out again with ranks of their own.
    """
    scored = checkpointed(scored)
    columns = [c for c in scored.columns if c != "n_words"]
    before, n, at, rank = free_names(scored, "_before", "_n", "_at", "rank")
    fit = F.col("n_words") >= least
    by_score = scored.filter(fit).groupBy("score").agg(F.count("*").alias(n))
    by_score = checkpointed(by_score.withColumn(before, F.coalesce(F.sum(n).over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    goal = (by_score.agg(F.sum(n)).first()[0] or 0) * percent // 100
    first = by_score.filter(F.col(before) < goal)
    cut = first.agg(F.min("score")).first()[0]
    reached = F.lit(False) if cut is None else fit & (F.col("score") >= cut)
    own = [F.col(f"`{c}`") for c in columns]
    rows = scored.filter(reached).groupBy(*own).agg(F.count("*").alias(n)).join(F.broadcast(first.select("score", before)), "score")
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), *own).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(before, F.col(before) + F.coalesce(F.sum(n).over(inside), F.lit(0)))
    rows = rows.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(COPIES).cast("long"))))
    rows = rows.withColumn(at, F.explode(F.sequence(F.col(at), F.least(F.col(n), F.col(at) + COPIES) - 1)))
    place = F.col(before) + F.col(at) + 1
    return rows.select(*own, F.when(place <= goal, place).alias(rank)).unionByName(scored.filter(~F.coalesce(reached, F.lit(False))).select(*own, F.lit(None).cast("long").alias(rank)))


def resample(docs: DataFrame, target: DataFrame, order: int = 2, buckets: int = 10_000, percent: int = 25, least: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document; rank is null for those not drawn.

    docs: doc_id, text; target: text; other columns are left out. Texts are read whole. Null and empty texts have no
    n-gram, weight 0, and are never drawn, as those under `least` words. A null doc_id stays null, its noise is that of an
    empty id, and it comes last of a tie. Repeated rows are drawn one by one. An empty target gives gains from smoothing
    alone; an empty docs table no row.
    """
    weighed = weights(docs, gains(docs, target, order, buckets), order)
    scored = weighed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score"))
    return draw(scored, percent, least)


def drawn(docs: DataFrame, resampled: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id was drawn, unchanged; every row of a repeated id where any was."""
    ids = resampled.filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")


#: DuckDB has no crc32: it goes bytewise over a table of 256 steps, once for each distinct n-gram.
ORACLE = """
WITH steps AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS pos, text FROM documents
  UNION ALL SELECT 't', NULL, -row_number() OVER (), text FROM benchmark),
w AS (
  SELECT side, id, pos, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
f AS (
  SELECT side, pos, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM w),
n AS (SELECT side, pos, f, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n)),
b AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda k: ('0x' || h[2 * k + 1:2 * k + 2])::BIGINT)),
                            lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM x, steps),
c AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t
  FROM n JOIN b USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((sum(s) OVER ()) + 10000) / ((s + 1) * ((sum(t) OVER ()) + 10000))))::BIGINT AS gain FROM c),
v AS (SELECT pos, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM n JOIN b USING (f) JOIN g USING (bucket) WHERE side = 'd' GROUP BY pos),
r AS (
  SELECT id AS doc_id, pos, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
         CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
         ('0x' || sha256('7:' || coalesce(id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM w LEFT JOIN v USING (pos) WHERE side = 'd'),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM r),
k AS (SELECT pos, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS m FROM z WHERE n_words >= 20)
SELECT doc_id, n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= 25 * m // 100 THEN rank END AS rank
FROM z LEFT JOIN k USING (pos)
"""
