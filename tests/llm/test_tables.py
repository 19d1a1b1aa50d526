"""Operators 5, 7, 8 and 9."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from albumspark.llm import media, mixing, packing, topk
from albumspark.llm.common import scratch

from .helpers import corpus, frame, words

PATH = public_tokenizers.path("word_bpe_49k.json")

# Packing


def check_chunks(texts):
    many, ids = packing.tokenizer_of(PATH)(pa.array([*texts, None], pa.string()))
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)] + [[]]
    assert many.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_chunks_are_the_tokenizer(texts):
    check_chunks([t.encode("utf-8", "ignore").decode() for t in texts])


def test_chunks_of_odd_texts():
    check_chunks(["a\x1cb c\x85d <|endoftext|>x é", "　x y's  I'LL", "café z ́a", "STRASSE ßẞ İ ﬁ", "a.b,c!? 12 3x x3", "", " \t", "same same. Same, same"])


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "WORDS", 64)
    monkeypatch.setitem(packing._OPEN, PATH, packing.ChunkTokenizer(PATH))
    rnd = random.Random(8)
    for _ in range(12):
        check_chunks([" ".join(f"{rnd.choice('abcdefgh')}{rnd.choice('xyz')}{rnd.choice(['', '.', '!?'])}{rnd.randrange(40) or ''}" for _ in range(60)) for _ in range(5)])
    own = packing.tokenizer_of(PATH)
    assert len(own.chunks.texts) <= 50 + 2 * 64 and len(own.parts.texts) <= 50 + 2 * 64


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 2048), st.integers(0, 3000), max_size=40))
def test_plan_places_every_piece(histogram):
    got = Counter()
    made = packing.plan(histogram)
    for lengths, m in made:
        assert sum(lengths) <= 2048 and m > 0
        for x in lengths:
            got[x] += m
    assert got == Counter({k: v for k, v in histogram.items() if v})


def test_best_pattern():
    """Against all patterns of a small grid."""
    grid, rnd = packing.Grid(64), np.random.default_rng(2)
    grid.unit, grid.cells = 8, 8
    every = grid.patterns(6)
    assert len(set(every)) == len(every) and all(sum(p) == 8 + len(p) // 2 and max(p) <= 8 and min(p) >= 1 for p in every)
    for _ in range(30):
        gain = np.append(0, rnd.normal(size=8) - 1)
        gain[rnd.integers(1, 9)] = 0.5
        found, value = grid.best(gain)
        assert value >= max(max(gain[list(p)].sum() for p in every), 0) - 1e-9
        assert not found or value == pytest.approx(gain[list(found)].sum())


def test_nnls():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        a, want = rnd.random((12, 30)), np.maximum(0, rnd.normal(size=30))
        active, x = packing.nnls(a, a @ want, lambda r: (None, -np.inf))
        assert (x > 0).all() and active.shape[1] <= 12 and np.allclose(active @ x, a @ want, atol=1e-5)


@pytest.mark.parametrize("draw", [lambda r: int(r.lognormvariate(6, 0.8)) + 1, lambda r: int(r.expovariate(1 / 120)) + 1, lambda r: r.randrange(1, 1800)])
def test_plan_is_tight(draw):
    """The fitted patterns do the work: over 0.9 of the pieces are theirs, and the sequences are near the bound."""
    rnd = random.Random(1)
    h = Counter(min(2048, draw(rnd)) for _ in range(20000))
    made = packing.Plan(h)
    n, least = sum(m for _, m in made.done), math.ceil(sum(k * v for k, v in h.items()) / 2048)
    assert n <= 1.005 * least and made.by_patterns >= 0.9 * sum(v for k, v in h.items() if k < 2048)


@pytest.mark.parametrize("sf, share", [("0.01", 0.75), ("0.1", 0.95)])
def test_plan_of_the_table(spark, sf, share):
    """Rounding costs more where there are few pieces."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    made = packing.pieces(docs, PATH, digest=True).groupBy("length").count().collect()
    made = packing.Plan({r["length"]: r["count"] for r in made})
    part = sum(m * len(x) for x, m in made.done if x != (2048,))
    tokens = sum(m * sum(x) for x, m in made.done)
    assert sum(m for _, m in made.done) <= 1.005 * tokens / 2048 and made.by_patterns >= share * part


def test_pack(spark):
    rows = corpus()
    cut = frame(spark, rows)
    made = packing.pieces(cut, PATH, 256)
    got = packing.pack(made, 256).collect()
    ids = defaultdict(list)
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text, _ in rows:
        own = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(own), 256)):
            want[i, k, at, len(own[at : at + 256]), zlib.crc32(np.array(own[at : at + 256], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == want
    for r in got:
        ids[r.sequence_id].append((r.offset, r.length))
    for parts in ids.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 256
    digest = packing.pieces(cut, PATH, 256, digest=True).collect()
    assert Counter(tuple(r) for r in digest) == want
    assert packing.pack(packing.pieces(frame(spark, []), PATH)).count() == 0


# Mixing


def plain_targets(sizes, weights=(3, 1, 2)):
    """The contract step by step: deal, stop, deal what is above anew."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("rows", [corpus(), [(k, "w " * (k % 7), f"s{k % 11}") for k in range(200)], [(1, "a b", None)], [(k, "x", "\U0001f600" if k % 2 else "￿") for k in range(9)], [(1, "", "a"), (2, None, "b")]])
def test_mix(spark, rows):
    base = frame(spark, rows).drop("size")
    got = mixing.mix(base).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(words(t))) for i, t, _ in rows)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(base.repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_mix_whole(spark):
    rows = [(k, "w " * 10, f"s{k % 4}") for k in range(80)]
    df = frame(spark, rows).drop("size")
    mixed = mixing.mix(df, whole=True)
    out = mixing.documents_of(mixed, df.columns)
    assert out.columns == df.columns and out.count() == mixed.agg(F.sum("copies")).first()[0]
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want")).collect():
        assert abs(r.t - r.want) <= 10
    assert mixing.mix(df.limit(0)).count() == 0


# Media


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000))
def test_pictures_are_lossless(data):
    x = media.payload(data)
    assert len(x) % 576 == 0 and len(x) >= 576 and x.startswith(data) and media.decode(media.encode(x)) == x


def test_damage_is_seen():
    m = bytearray(media.encode(media.payload(b"abc")))
    m[45] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        media.decode(bytes(m))


def test_media_columns(spark):
    rows = corpus()
    got = media.digests(media.media_columns(frame(spark, rows))).collect()
    want = []
    for i, t, _ in rows:
        x = media.payload((t or "").encode())
        want.append((str(i), len((t or "").encode()), len(x), zlib.crc32(x[-32:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.tail_crc32) for r in got) == sorted(want)
    by = defaultdict(set)
    for r in got:
        by[r.payload_sha256].add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(v) == 1 for v in by.values())
    assert media.digests(media.media_columns(frame(spark, []))).count() == 0


def test_ranges_and_retries(spark):
    """Small ranges and archives give each member once; one damaged member is reported and the rest are read."""
    at = scratch(spark, "media-test")
    found = media.write_archives(frame(spark, [(k, f"text {k} " * 200, "s") for k in range(60)], 1), at, archive=2000)
    assert found.count() > 1 and found.agg(F.sum("members")).first()[0] == 60
    read = media.read_archives(spark, at, range=1000, batch=500)
    rows = read.collect()
    assert sorted(r.doc_id for r in rows) == list(range(60)) and not any(r.error for r in rows)
    victim = rows[7]
    with open(victim.path, "r+b") as f:
        f.seek(victim.offset + 60)
        f.write(b"\0\1\2")
    again = media.read_archives(spark, at, onError="report", tries=2).collect()
    assert sorted(r.doc_id for r in again) == list(range(60)) and [r.doc_id for r in again if r.error] == [victim.doc_id]
    with pytest.raises(Exception, match="checksum"):
        media.read_archives(spark, at, tries=1).collect()


# Top k


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(1, 12), st.sampled_from([1, 3, 50, 100000]))
def test_index_is_exact(seed, n, d, span):
    rnd = np.random.default_rng(seed)
    ids, m = rnd.permutation(n * 2)[:n], rnd.integers(-span, span + 1, (n, d))
    index = topk.ImpactIndex(ids, m)
    q = rnd.integers(-span, span + 1, d)
    own = int(ids[0])
    at, score = index.search(q, 10, own)
    want = sorted((-int(m[k] @ q), int(ids[k])) for k in range(n) if ids[k] != own)[:10]
    assert [(-s, i) for s, i in zip(score.tolist(), index.ids[at].tolist(), strict=True)] == want


def test_thresholds_are_carried(spark, monkeypatch):
    """Over many blocks of a run, with ties across blocks; and a block that holds nothing better is left sooner."""
    monkeypatch.setattr(topk, "ROWS", 40)
    monkeypatch.setattr(topk, "RUN", 3)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rnd = np.random.default_rng(5)
    m = rnd.integers(-3, 4, (400, 6))
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(m.tolist())], "vec_id long, v array<long>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(rows.filter("vec_id % 20 = 0"), rows, 5).collect())
    want = []
    for q in range(0, 400, 20):
        ranked = sorted((-int(m[q] @ m[c]), c) for c in range(400) if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(ranked)]
    assert got == want
    index, q = topk.ImpactIndex(np.arange(3000), rnd.integers(-1000, 1001, (3000, 16))), rnd.integers(-1000, 1001, 16)
    at, score = index.search(q, 10)
    alone = index.steps
    assert index.search(q, 10, None, int(score[0]) * 2)[0].tolist() in ([], at.tolist()) and index.steps < alone
    again, same = index.search(q, 10, None, int(score[-1]))
    assert again.tolist() == at.tolist() and same.tolist() == score.tolist()


def test_scores_do_not_wrap():
    big = 3 * 10**18
    index = topk.ImpactIndex(np.arange(4), np.array([[big, 1], [-big, 0], [1, 1], [0, 0]]))
    at, score = index.search(np.array([big, 0]), 4)
    assert list(zip(at.tolist(), score.tolist(), strict=True)) == [(0, topk.TOP), (2, big), (3, 0), (1, -topk.TOP)]


def test_top_k(spark):
    rnd = random.Random(7)
    rows = [(k, [rnd.uniform(-1, 1) for _ in range(8)]) for k in range(0, 350)] + [(400, None), (500, [1.0, None]), (600, [float("nan")]), (700, [float("inf")]), (800, []), (900, [0.5, 0.5]), (7, [0.1] * 8), (None, [1.0]), (100, [0.9] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"at": F.lit("x"), "block": F.lit(1)})
    v = topk.whole_vectors(df)
    got = topk.top_k(v.filter("vec_id % 100 = 0"), v, 10)
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q in sorted({i for i, _ in whole if i % 100 == 0}):
        v0 = min(e for i, e in whole if i == q)
        ranked = sorted((-sum(a * b for a, b in zip(v0, e, strict=False)), i) for i, e in whole if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    assert sorted(tuple(r) for r in got.collect()) == want
    none = v.limit(0)
    assert topk.top_k(none, v).count() == 0 and topk.top_k(v, none).count() == 0
