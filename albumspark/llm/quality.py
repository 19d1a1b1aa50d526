"""Quality by compression: zstandard dictionaries of good and of bad text, and the difference they make.

Labelled texts, a bounded sample of each class, are split in two. One half trains a dictionary for each class. The
other half calibrates: the normalised difference of the sizes under the two dictionaries, and its square, go through a
logistic function to a score from 0 to 1; nothing else does. A text is compressed block by block, all of it, so that the
dictionaries bear on every part of a long text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumspark.session import ship

from .common import batch, sliced, texts, tidied
from .logistic import Logistic

#: Labelled texts of a class at most and their bytes, bytes of a dictionary, bytes of a block, zstandard's level.
SAMPLE, BYTES, DICTIONARY, BLOCK, LEVEL = 3000, 4 << 20, 64 << 10, 2048, 3
#: Bytes of text at once.
SLICE = 4 << 20

_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    blocks = [x[at : at + BLOCK] for x in samples for at in range(0, len(x), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks)
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return zstandard.ZstdCompressionDict(b"".join(blocks)[-DICTIONARY:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class CompressionClassifier:
    """P(label 1) of texts. Without examples of both classes, it is the share of label 1, or 0.5 without any."""

    def __init__(self, bad: list[bytes], good: list[bytes]):
        self.constant = None if bad and good else (len(good) + 0.5) / (len(good) + len(bad) + 1)
        self.compressors = None
        if self.constant is not None:
            return
        halves = [(x[::2], x[1::2] or x) for x in (good, bad)]
        self.dictionaries = [_dictionary(train).as_bytes() for train, _ in halves]
        x = np.array([self.features(t) for _, own in halves for t in own])
        self.calibrated = Logistic(x, np.repeat([1.0, 0.0], [len(own) for _, own in halves]))

    def __getstate__(self):
        return self.__dict__ | {"compressors": None}

    def features(self, text: bytes) -> list[float]:
        """How much smaller the text is under the good dictionary than under the bad one, per byte; and its square."""
        if self.compressors is None:
            own = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
            loaded = [zstandard.ZstdCompressionDict(d) for d in self.dictionaries]
            for d in loaded:
                d.precompute_compress(level=LEVEL)
            self.compressors = [zstandard.ZstdCompressor(dict_data=d, **own) for d in loaded]
        n = max(1, len(text))
        blocks = [text[at : at + BLOCK] for at in range(0, n, BLOCK)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.compressors)
        d = (bad - good) / n
        return [d, d * abs(d)]

    def __call__(self, documents: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(documents), self.constant)
        return self.calibrated(np.array([self.features(t) for t in documents]).reshape(len(documents), 2))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = BYTES) -> CompressionClassifier:
    """labels: doc_id, label 0 or 1. Of each class, `sample` labelled documents, least by a hash of the id, are looked at,
    and those whose bytes add up to `most` are read.

    Rows without id or label are left out; of repeated ids or texts one counts; null texts are empty.
    """
    labels = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", "label").distinct()
    order = F.xxhash64("doc_id", F.lit("quality"))
    few = [labels.filter(F.col("label") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    ids = few[0].union(few[1])  # 2 * sample rows at most
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"), order.alias("at"))
    sizes = own.select("doc_id", "label", "at", F.octet_length("text").alias("n"))
    read, held = set(), {0: 0, 1: 0}
    for r in sorted(sizes.collect(), key=lambda r: (r["at"], r["doc_id"])):  # 2 * sample rows
        if held[r["label"]] + r["n"] <= most:
            held[r["label"]] += r["n"]
            read.add((r["doc_id"], r["label"]))
    if not read:
        return CompressionClassifier([], [])
    chosen = docs.sparkSession.createDataFrame(sorted(read), "doc_id long, label long")
    rows = own.withColumn("label", F.col("label").cast("long")).join(F.broadcast(chosen), ["doc_id", "label"]).collect()  # 2 * most bytes
    rows = sorted({(r["text"], r["label"]): r["at"] for r in rows}.items(), key=lambda x: (x[1], x[0]))
    return CompressionClassifier(*[[t.encode() for (t, label), _ in rows if label == k] for k in (0, 1)])


def score(docs: DataFrame, classifier: CompressionClassifier) -> DataFrame:
    """doc_id and score of every row of docs, repeated rows alike; null texts count as empty, null ids stay null, other
    columns are left out. An empty table gives no row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in sliced(batches, SLICE):
            yield batch(_OUT, b.column("doc_id"), shared.value(texts(b.column("text"))))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, score double")
