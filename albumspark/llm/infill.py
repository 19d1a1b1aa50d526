"""Fill-in-middle transformation: prefix, middle and suffix of each text, cut between tokens, laid out for infilling.

A whole batch is one numpy kernel on the UTF-8 buffer of its texts. A look-up table gives each byte its class, a mask of
neighbouring bytes shows where tokens end, cumulative sums of the mask, less what they are at a text's start, number the
tokens of each text, and one binary search finds the cuts of all rows. Pieces are laid out by one take from the buffer,
and what a sentinel stands before is found again in the output by the same masks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumspark.session import ship

from .common import free_names, sliced, strings, tidied, utf8

#: Fixed: what stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, SPM, PSM = "plain", "spm", "psm"
#: ASCII white space, and the letters of sentinels.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, bool)
LETTER[list(b"PSM")] = True
#: Bytes of text in a kernel, but for a longer text.
SLICE = 4 << 20


def draws(doc_ids: list[int | None], seed: int) -> np.ndarray:
    """Four numbers a row: the first 32-bit groups of the hash of seed and id; a null id counts as empty."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).digest()[:16] for k in doc_ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def token_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text; the running number of tokens that end with a word, at each byte; what that is before each text.

    A token is a word with the white space before it; white space at the end of a text is a last one.
    """
    blank = BLANK[data]
    ends = ~blank
    ends[:-1] &= blank[1:]
    lasts = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[lasts] = ~blank[lasts]
    numbers = np.cumsum(ends, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    before = np.append(0, numbers)[offsets]
    n = np.diff(before)
    full = offsets[1:] > offsets[:-1]
    n[full] += blank[offsets[1:][full] - 1]
    return n.astype(np.int64), numbers, before[:-1].astype(np.int64)


def sentinels(data: np.ndarray) -> np.ndarray:
    """Where sentinels begin."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[:-2] == ord("<"))
    return at[LETTER[data[at + 1]] & (data[at + 2] == ord(">"))]


def cut(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, rate: int, spm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n tokens of each text; its form, 0 plain, 1 spm, 2 psm; and the first, second, third and last byte of its pieces."""
    n, numbers, before = token_ends(data, offsets)
    found = sentinels(data)
    text = np.searchsorted(offsets, found, side="right") - 1
    text = text[found + 3 <= offsets[text + 1]]  # inside one text
    plain = (offsets[1:] == offsets[:-1]) | (h[:, 2] % 100 >= rate)
    plain[text] = True
    places = [offsets[:-1]]
    for k in (np.minimum(h[:, 0] % (n + 1), h[:, 1] % (n + 1)), np.maximum(h[:, 0] % (n + 1), h[:, 1] % (n + 1))):
        at = np.searchsorted(numbers, (before + k).astype(numbers.dtype), side="left") + 1  # behind the k-th word's last byte
        places.append(np.where(k == 0, offsets[:-1], np.minimum(at, offsets[1:])))
    return n, np.where(plain, 0, np.where(h[:, 3] % 100 < spm, 1, 2)), np.stack([*places, offsets[1:]], 1)


def laid_out(pieces: pa.Array, order: np.ndarray, parts: np.ndarray) -> pa.Array:
    """Texts, each put together from the next parts[k] of pieces.take(order)."""
    taken = pieces.take(pa.array(order))
    data, offsets = utf8(taken)
    return strings(data, offsets[np.append(0, np.cumsum(parts))])


def transformed(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, places: np.ndarray) -> pa.Array:
    """The texts in their forms."""
    rows = len(form)
    pieces = pa.concat_arrays([strings(data, np.append(places[:, :3].ravel(), places[-1, 3])), pa.array([PREFIX, SUFFIX, MIDDLE], pa.large_string())])
    own = 3 * np.arange(rows)[:, None]
    marks = 3 * rows
    forms = np.empty((rows, 6), np.int64)
    forms[:] = np.hstack([own, own + 1, own + 2, own, own, own])  # plain uses the first three
    for kind, order in ((1, ((marks + 1, 2), (marks, 0), (marks + 2, 1))), (2, ((marks, 0), (marks + 1, 2), (marks + 2, 1)))):
        at = form == kind
        for k, (mark, piece) in enumerate(order):
            forms[at, 2 * k], forms[at, 2 * k + 1] = mark, own[at, 0] + piece
    parts = np.where(form == 0, 3, 6)
    return laid_out(pieces, forms[np.arange(6) < parts[:, None]], parts)


def restored(outputs: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts that the outputs were made from. No text that is cut holds a sentinel, and no piece makes one with a
    sentinel beside it, so the three that such an output holds are its own."""
    data, offsets = utf8(outputs)
    rows = np.flatnonzero(form)
    found = sentinels(data)
    text = np.searchsorted(offsets, found, side="right") - 1
    found = found[(form[text] > 0) & (found + 3 <= offsets[text + 1])].reshape(len(rows), 3)
    if len(rows) and not (found[:, 0] == offsets[rows]).all():
        raise ValueError("an output does not begin with a sentinel")
    # Segments of an output: the whole of a plain one; else a sentinel and a piece, three times.
    parts = np.where(form == 0, 1, 6)
    own = np.cumsum(parts) - parts
    borders = np.zeros(parts.sum() + 1, np.int64)
    borders[own], borders[-1] = offsets[:-1], offsets[-1]
    borders[own[rows][:, None] + 2 * np.arange(3)], borders[own[rows][:, None] + 2 * np.arange(3) + 1] = found, found + 3
    first = np.where(form[rows] == 1, 1, 0)
    order = np.zeros((len(form), 3), np.int64)
    order[:, 0], order[rows] = own, own[rows][:, None] + 1 + 2 * np.stack([first, np.full(len(rows), 2), 1 - first], 1)  # prefix, middle, suffix
    pieces = np.where(form == 0, 1, 3)
    return laid_out(strings(data, borders), order[np.arange(3) < pieces[:, None]], pieces)


_NAMES = pa.array([PLAIN, SPM, PSM])


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """docs with n (tokens), form, prefix_chars, middle_chars and output; other columns pass through, but for those of these
    names.

    rate: of 100 texts, how many are transformed; spm: of 100 such, how many put the suffix first. Null texts are empty
    and plain. A null doc_id draws as an empty one. Texts are cut whole, however long: a kernel takes some 6 bytes a byte
    of its texts. Rows of equal id and text have equal outputs; an empty table has none. No row leaves its partition.
    """
    ship(docs.sparkSession)
    own = ("n", "form", "prefix_chars", "middle_chars", "output")
    keep = [c for c in docs.columns if c.lower() not in own]
    (text,) = free_names(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in sliced(batches, SLICE, text):
            data, offsets = utf8(b.column(b.schema.get_field_index(text)))
            h = draws(b.column(b.schema.get_field_index("doc_id")).to_pylist(), seed)
            n, form, places = cut(data, offsets, h, rate, spm)
            output = transformed(data, offsets, form, places) if b.num_rows else pa.array([], pa.large_string())
            chars = []
            for k in (0, 1):
                piece = np.stack([places[:, k], places[:, k + 1]], 1).ravel()
                c = pc.utf8_length(strings(data, np.append(piece, places[-1, 3])).take(pa.array(2 * np.arange(len(n))))) if b.num_rows else pa.array([], pa.int64())
                chars.append(pc.if_else(pa.array(form > 0), c.cast(pa.int64()), pa.scalar(None, pa.int64())))
            made = [pa.array(n, pa.int64()), _NAMES.take(pa.array(form)), *chars, output.cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names=[*keep, *own])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema)
    made = "n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(text)).mapInArrow(tidied(run), f"{kinds}, {made}")


def restore(transformed: DataFrame) -> DataFrame:
    """Rows with form and output, and restored: the exact text (a null one: empty) that each output was made from."""
    ship(transformed.sparkSession)
    columns = [c for c in transformed.columns if c.lower() != "restored"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in sliced(batches, SLICE, "output"):
            form = pc.index_in(b.column(b.schema.get_field_index("form")), value_set=_NAMES).to_numpy(zero_copy_only=False).astype(np.int64)
            made = restored(b.column(b.schema.get_field_index("output")), form)
            yield pa.RecordBatch.from_arrays([*b.columns, made.cast(pa.string())], names=[*columns, "restored"])

    rows = transformed.select(*[F.col(f"`{c}`") for c in columns])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(tidied(run), f"{kinds}, restored string")


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS t FROM documents),
k AS (
  SELECT *, len(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT doc_id, n, form, text, array_to_string(t[1:least(a, b)], '') AS prefix,
         array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(t[greatest(a, b) + 1:n], '') AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
