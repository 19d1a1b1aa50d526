"""Operators 11, 12 and 13 against plain Python."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from albumspark.llm import infill, records, resample
from albumspark.llm.common import scratch
from albumspark.llm.registry import QUERIES, tokenizer_path

from .helpers import corpus, frame, lower

BYTES = tokenizer_path("byte_bpe_50k.json")

# Resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, order=2):
    w = WORD.findall(lower(text))
    return w, [" ".join(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1)]


def plain_resample(rows, target, order=2, buckets=10_000, percent=25, least=20, seed=7):
    """doc_id, n_features, weight, score, rank, without the ranks of ties."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in grams(x, order)[1]) for texts in ([r[1] for r in rows], target))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for doc_id, text, *_ in rows:
        w, f = grams(text, order)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least, None])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = k + 1
    return [(r[0], r[1], r[2], r[3], r[5]) for r in out]


def by_row(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


TARGET = ["W1 w2, w3 w4 été w5", None, "", "w1 w2 w3 free text"]


@pytest.mark.parametrize(("order", "partitions"), [(1, 1), (2, 5), (3, 2)])
def test_resampling(spark, order, partitions, monkeypatch):
    monkeypatch.setattr(resample, "COPIES", 2)
    rows = corpus()
    rows += [(2000, "Äpfel ÄPFEL　x,y--Z9 _a_ \x00b\x7fc", "s")] + [rows[3]] * 7 + [(None, rows[9][1], "s")] * 5
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resample.resample(frame(spark, rows, partitions), target, order=order, percent=60, least=10)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert by_row(tuple(r) for r in got.collect()) == by_row(plain_resample(rows, TARGET, order, percent=60, least=10))


def test_resampling_of_little(spark):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    empty = frame(spark, [(1, "a", "s")]).filter("false")
    assert resample.resample(empty, target).collect() == []
    rows = [(1, None, "s"), (2, "", "s"), (3, "a b " * 30, "s")]
    got = resample.resample(frame(spark, rows), target.filter("false"), percent=100)
    assert by_row(tuple(r) for r in got.collect()) == by_row(plain_resample(rows, [], percent=100))
    assert [r.doc_id for r in resample.drawn(frame(spark, rows), got).collect()] == [3]


def test_stretches_are_the_whole_text():
    """Counts of a text that is cut into stretches, whatever their size."""
    rnd = random.Random(4)
    for trial in range(40):
        text = "".join(rnd.choice(["a", "B7", "é", " ", ", ", "\n", "longer", "x"]) for _ in range(rnd.randrange(300)))
        for order in (1, 2, 3):
            got = Counter()
            for s in resample.stretches(pa.RecordBatch.from_pydict({"text": [text]}), order, rnd.randrange(1, 60)):
                w = resample.words_of(s)
                for r in resample.runs_of(w, order):
                    got.update(r.crc[r.run[w.counts[r.at]]].tolist())
            assert got == Counter(zlib.crc32(f.encode()) for f in grams(text, order)[1]), (trial, order, text)


# Fill in the middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(doc_id, text, rate=50, spm=80, seed=42):
    text = text or ""
    t = TOKEN.findall(text)
    n = len(t)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(y in text for y in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["<P", "P>", "<", "<P>", "a <S> b", "x<M>", "a<b>c<P", ">", " a ", "\t\n", "é　ü  \x0bx", "<S <M <P", "word\x1cword \x85"]


def test_infill(spark, monkeypatch):
    monkeypatch.setattr(infill, "SLICE", 3000)
    rnd = random.Random(1)
    texts = [t for _, t, _ in corpus()] + ODD + ["".join(rnd.choice(["<", "P", "S", ">", " ", "é", "M", "\n"]) for _ in range(rnd.randrange(12))) for _ in range(200)]
    rows = [(k if k % 17 else None, t, "s") for k, t in enumerate(texts)] + [(5, "a b", "s")] * 2
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, source string, N long, Form string").repartition(3)
    made = infill.fill_in_middle(docs, rate=80, spm=50)
    assert made.columns == ["doc_id", "text", "source", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in infill.restore(made).collect())
    assert got == Counter((i, t, *plain_infill(i, t, 80, 50), t or "") for i, t, _ in rows)
    assert {k[3] for k in got} == {"plain", "spm", "psm"}
    assert infill.restore(infill.fill_in_middle(docs.filter("false"))).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("<PSM> \néa", max_size=20), max_size=6), st.integers(0, 10**6))
def test_infill_kernel(texts, seed):
    data, offsets = infill.utf8(pa.array([*texts, None], pa.string()).slice(min(1, len(texts))))
    own = [*texts, None][min(1, len(texts)) :]
    n, form, places = infill.cut(data, offsets, infill.draws(list(range(len(own))), seed), 90, 50)
    output = infill.transformed(data, offsets, form, places)
    assert output.to_pylist() == [plain_infill(k, t, 90, 50, seed)[4] for k, t in enumerate(own)]
    assert infill.restored(output, form).to_pylist() == [t or "" for t in own]


# Records


def plain_crc32c(b):
    c = 0xFFFFFFFF
    for x in b:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def plain_masked(b):
    c = plain_crc32c(b)
    return ((c >> 15 | c << 17) + 0xA282EAD8) % 2**32


def test_crc32c():
    assert plain_crc32c(b"123456789") == 0xE3069283
    rnd = np.random.default_rng(3)
    many = np.array([1, 2, 3, 63, 64, 65, 128, 129, 700, 1, 5, 64])
    words = rnd.integers(0, 1 << 32, many.sum(), dtype=np.uint32)
    ends = np.cumsum(many)
    want = [plain_crc32c(words[y - n : y].astype("<u4").tobytes()) for n, y in zip(many, ends, strict=True)]
    assert records.crc32c(words, many).tolist() == want
    assert records.crc32c(words[:0], many[:0]).tolist() == []


def check_pieces(texts):
    many, ids = records.tokenizer_of(BYTES)(pa.array([*texts, None], pa.string()))
    want = [e.ids for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)] + [[]]
    assert many.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(" \n\t 　 \x85\x0b\x1c.,'sa1é)<|", max_size=30)), max_size=8))
def test_pieces_are_the_tokenizer(texts):
    check_pieces([t.encode("utf-8", "ignore").decode() for t in texts])


def test_pieces_of_odd_texts():
    check_pieces(["a  b", "a \n b\n\nc\n", "x.\n'S it's I'LL 's", "<|endoftext|> a<|endoftext|>\n.b <|endoftext|>", " lead", "trail ", "a   b", "1 2,3.4", "é, ́.", "...,! a?! (b)", "a　 x", "  a", "\n", " ", "Größe: 5 km"])


def read_records(path):
    """A plain reader of framed records."""
    raw, at, out = open(path, "rb").read(), 0, []
    while at < len(raw):
        n, c = struct.unpack("<QI", raw[at : at + 12])
        assert c == plain_masked(raw[at : at + 8])
        body = raw[at + 12 : at + 12 + n]
        assert struct.unpack("<I", raw[at + 12 + n : at + 16 + n])[0] == plain_masked(body)
        doc_id, null, width, many = struct.unpack("<qHHI", body[:16])
        ids = np.frombuffer(body[16 : 16 + many * width], f"<u{width}").astype("<u4").tobytes()
        out.append((at, n, None if null else doc_id, ids))
        assert n == 16 + -(-many * width // 4) * 4
        at += 16 + n
    return out


def test_records(spark, monkeypatch):
    monkeypatch.setattr(records, "SLICE", 2000)
    monkeypatch.setattr(records, "BLOCK", 5000)
    rows = corpus() + [(-5, "negative id", "s")] + [(7, "a hot id", "s"), (7, "and another", "s")] * 30 + [(None, "no id", "s")] * 9
    at = scratch(spark, "records")
    made = records.write(frame(spark, rows, 4), at, BYTES, partitions=6, most=9000).orderBy("start").collect()
    encode = Tokenizer.from_file(BYTES).encode
    want = Counter((i, np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t, _ in rows)
    stored = [(r.path, *x) for r in made for x in read_records(r.path)]
    assert Counter(x[3:] for x in stored) == want and len(made) > 6
    order = [(i is not None, i or 0) for _, _, _, i, _ in stored]
    assert order == sorted(order) and max(Counter(r.path for r in made).values()) == 1
    starts = np.append(0, np.cumsum([len(x[4]) // 4 for x in stored]))
    listed = [(i, int(s), len(b) // 4, b) for (_, _, _, i, b), s in zip(stored, starts, strict=False)]
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in records.read(spark, at).collect()]
    assert sorted(got, key=lambda r: r[1]) == listed
    digests = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in records.read(spark, at, digest=True).collect()]
    assert sorted(digests, key=lambda r: r[1]) == [(*r[:3], zlib.crc32(r[3])) for r in listed]
    index = [(r.path, r.offset, r.length, r.doc_id) for r in records.index(spark, at).orderBy("start").collect()]
    assert index == [x[:4] for x in stored]
    once, again, other = ([(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in records.shuffled(spark, at, seed, 3).collect()] for seed in (1, 1, 2))
    assert once == again != other and sorted(once, key=lambda r: r[1]) == sorted(other, key=lambda r: r[1]) == listed
    # A hot id fills several ranges.
    assert len({r.path for r in records.index(spark, at).filter("doc_id = 7").collect()}) > 1


def test_wide_ids(spark, monkeypatch):
    monkeypatch.setattr(records, "width_of", lambda _: 4)
    at = scratch(spark, "records")
    docs = spark.createDataFrame([(k, f"text {k}" * k) for k in range(5)], "doc_id long, text string")
    (made,) = records.write(docs, at, BYTES, partitions=1).collect()
    want = [np.array([*Tokenizer.from_file(BYTES).encode(f"text {k}" * k, add_special_tokens=False).ids, 0], "<u4").tobytes() for k in range(5)]
    assert [x[3] for x in read_records(made.path)] == want
    assert [bytes(r.ids) for r in records.read(spark, at).orderBy("start").collect()] == [bytes(r.ids) for r in records.shuffled(spark, at).orderBy("start").collect()] == want


def test_damaged_records(spark):
    at = scratch(spark, "records")
    (row,) = records.write(spark.createDataFrame([(k, f"text {k}") for k in range(5)], "doc_id long, text string"), at, BYTES, partitions=1).collect()
    raw = bytearray(open(row.path, "rb").read())
    raw[-6] ^= 1
    open(row.path, "wb").write(raw)
    for rows in (records.read(spark, at), records.shuffled(spark, at)):
        with pytest.raises(Exception, match="damaged record of document 4"):
            rows.collect()


def test_records_of_nothing(spark):
    at = scratch(spark, "records")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert records.write(docs.filter("false"), at, BYTES).collect() == [] and records.read(spark, at).collect() == [] and records.shuffled(spark, at).collect() == []
    at = scratch(spark, "records")
    records.write(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string"), at, BYTES)
    assert sorted((r.doc_id is None, r.start, r.n_tokens) for r in records.read(spark, at).collect()) == [(True, 0, 1), (True, 1, 1)]


# The queries, over the smallest tables

SF = "/root/testdata/sf0.001"


def test_queries(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op11_importance_resampling"](spark, SF)
    assert by_row(tuple(r) for r in got.collect()) == by_row(plain_resample(docs, target))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = QUERIES["op12_fill_in_middle"](spark, SF).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *(x := plain_infill(i, t))[:4], digest(x[4]), digest(t or "")) for i, t in docs)
    got = QUERIES["op13_token_records"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    start, want = 0, []
    for i, t in sorted(docs):
        ids = np.array([*Tokenizer.from_file(BYTES).encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in got.collect()) == want
