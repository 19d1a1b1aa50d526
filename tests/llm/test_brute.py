"""Operators 3, 4 and 8 and the pipeline against plain Python, and columns that are named like the operators' own."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from albumspark.llm import ctw, lines, media, mixing, packing, quality, records, resample, simhash, suffixes, topk, toxicity
from albumspark.llm.common import crc32_id, scratch
from albumspark.llm.registry import tokenizer_path

from .helpers import corpus, frame, lower, words
from .test_dedup import plain_one_of_each
from .test_scores import edits, labelled
from .test_tables import plain_targets

# Scores


def plain_match(word, entries, excused):
    stems = sorted((len(t), k) for k, (t, stem, _) in enumerate(entries) if stem and word.startswith(t))
    if stems:
        return stems[0][1], 0
    near = [(edits(word, t), k) for k, (t, stem, _) in enumerate(entries) if not stem and abs(len(word) - len(t)) <= 1]
    near = [(e, k) for e, k in near if e == 0 or e == 1 and len(entries[k][0]) >= 5]
    return min(near)[::-1] if near and (min(near)[0] == 0 or word not in excused) else None


def plain_toxicity(text, scorer):
    """The score of a text from the entries and weights of a scorer."""
    entries, tokens = scorer.matcher.entries, (text or "").split(" ")
    tokens = [t for line in tokens for t in line.replace("\t", "\n").replace("\r", "\n").replace("\v", "\n").replace("\f", "\n").split("\n") if t]
    abuse, quoted, fuzzy, seen, most, n, n_quoted = 0.0, 0.0, 0.0, set(), 0.0, 0, 0
    for k, t in enumerate(tokens):
        m = plain_match(toxicity.word_of(t), entries, scorer.matcher.excused)
        if m is None:
            continue
        n += 1
        weight = entries[m[0]][2] / (2 if m[1] else 1)
        left, right = tokens[max(0, k - 5) : k + 1], tokens[k : k + 6]
        opened = any(x[0] in toxicity.QUOTES for x in left)
        closed = any(y and y[-1] in toxicity.QUOTES for y in (x.rstrip(".,;:!?") for x in right))
        told = t[0] in toxicity.QUOTES and any(toxicity.word_of(x) in toxicity.REPORTING for x in left[:-1])
        if opened and closed or told:
            quoted, n_quoted = quoted + weight, n_quoted + 1
        else:
            abuse, fuzzy, most = abuse + weight, fuzzy + (weight if m[1] else 0), max(most, weight)
            seen.add(m[0])
    x = [math.log(1 + abuse), math.log(1 + quoted), math.log(1 + fuzzy), most, math.log(1 + len(seen)), abuse / (len(tokens) + 20), 1.0 if seen else 0.0]
    c = scorer.calibrated
    z = sum(w * (v - m) / s for w, v, m, s in zip(c.w, x, c.mean, c.scale, strict=False)) + c.w[-1]
    return 1 / (1 + math.exp(-z)), n, n_quoted


def toxic_rows():
    rows, labels = labelled()
    rnd = random.Random(9)
    odd = ["moron", 'they said "moron" once', "«scum»", "word1\tscumm\nword2", "patheticc, Moron!", "", None, " \n", "'pathetic' word3", "word4 " * 3000 + "scum"]
    rows += [(1000 + k, t, "s") for k, t in enumerate(odd)] + [(None, "moron scum", "s")]
    rows += [(1100 + k, " ".join(rnd.choice(["word1", '"moron"', "scum", "mor0n", "said", "pathetics", "x"]) for _ in range(12)), "s") for k in range(60)]
    return rows + rows[:3] + rows[-2:], labels


def test_toxicity_scores(spark):
    rows, labels = toxic_rows()
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, label int")
    scorer = toxicity.fit(df, lab)
    want = sorted((str(i), *plain_toxicity(t, scorer)) for i, t, _ in rows)
    got = sorted((str(r.doc_id), r.score, r.n_hits, r.n_quoted) for r in toxicity.score(df, scorer).collect())
    assert [(g[0], *g[2:]) for g in got] == [(w[0], *w[2:]) for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)
    kept = toxicity.keep_clean(df, scorer)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if w[1] < 0.5)


def test_quality_scores(spark):
    rnd = random.Random(10)
    rows = [(k, " ".join(rnd.choice(["the", "house", "stands", "hill", "people"] if k % 2 else ["BUY", "$$", "now", "###"]) for _ in range(rnd.randrange(30, 900))), "s") for k in range(160)]
    rows += [(500, None, "s"), (501, "", "s"), (None, "the house", "s"), rows[3], rows[3]]
    df, lab = frame(spark, rows), spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, label int")
    model = quality.fit(df, lab)
    good, bad = (zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in model.dictionaries)

    def plain(text):
        x = (text or "").encode()
        size = lambda c: sum(len(c.compress(x[a : a + 2048])) for a in range(0, max(1, len(x)), 2048))
        d = (size(bad) - size(good)) / max(1, len(x))
        c = model.calibrated
        return 1 / (1 + math.exp(-sum(w * (v - m) / s for w, v, m, s in zip(c.w, [d, d * abs(d)], c.mean, c.scale, strict=False)) - c.w[-1]))

    got = sorted((str(r.doc_id), r.score) for r in quality.score(df, model).collect())
    want = sorted((str(i), plain(t)) for i, t, _ in rows)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)
    # A fit that reads few bytes still works, and reads no more.
    small = quality.fit(df, lab, most=20_000)
    assert 0 <= min(small([b"", b"the house"])) and quality.fit(df, lab, most=0).constant == 0.5


# Media


def test_media_digests(spark):
    rows = [r for r in corpus() if len(r[1] or "") < 9000] + [(2000, "é" * 700, "s")]
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in media.digests(media.media_columns(frame(spark, rows))).collect())
    want = []
    for i, t, _ in rows:
        own = (t or "").encode()
        x = own + b"\xff" * ((-len(own)) % 576 or (0 if own else 576))
        raw = b"".join(b"\0" + x[a : a + 576] for a in range(0, len(x), 576))
        chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
        head = (576).to_bytes(4, "big") + (len(x) // 576).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")
        mean = sum(x) / len(x)
        deviation = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
        step = sum(abs(a - b) for a, b in zip(x, x[1:], strict=False)) / len(x)
        cells = [[0] * 8 for _ in range(8)]
        for k, v in enumerate(x):
            cells[k % 576 // 24 // 3][k % 24 // 3] += v
        flat = [v for row in cells for v in row]
        bits = "".join("1" if v * 64 > sum(flat) else "0" for v in flat)
        want.append((str(i), len(own), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), len(png), hashlib.sha256(png).hexdigest(), (mean, deviation, step, f"{int(bits, 2):016x}")))
    want.sort(key=lambda w: w[:6])
    got.sort(key=lambda g: g[:6])
    assert [g[:7] for g in got] == [w[:7] for w in want]
    for g, w in zip(got, want, strict=True):
        *numbers, bits = g[7].split()
        assert bits == w[7][3] and np.allclose(list(map(float, numbers)), w[7][:3], atol=6e-5)


# Names


NAMES = "_id _row _gone _key _range _before _rank _number _n _offset _copy _rid _sum id row h1 h2 low shard salt hashes part offset_ sum fp uid rid set".split()


@pytest.mark.parametrize("operator", ["lines", "mix", "near", "pack"])
def test_clashing_names(spark, operator):
    """Columns named like the operators' own pass through unchanged, in any case."""
    rows = [r for r in corpus(3, 12) if len(r[1] or "") < 5000]
    df = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in NAMES]) for r in rows], f"doc_id long, text string, source string, {', '.join(f'`{n.upper() if k % 2 else n}` string' for k, n in enumerate(NAMES))}")
    run = {
        "lines": lines.drop_repeated_lines, "mix": lambda d: mixing.documents_of(mixing.mix(d, whole=True), d.columns), "near": simhash.one_of_each,
        "pack": lambda d: packing.pack(d.withColumns({"piece": F.lit(0), "length": F.length(F.coalesce("text", F.lit(""))).cast("long") % 2000 + 1})),
    }
    out = run[operator](df).collect()
    assert out
    for r in out:
        assert all(r[n.upper() if k % 2 else n] == f"{n}{r.doc_id}" for k, n in enumerate(NAMES))
    plain = run[operator](df.select("doc_id", "text", "source")).collect()
    assert Counter((r.doc_id, r.text) for r in plain) == Counter((r.doc_id, r.text) for r in out)


OWN = "block train uid held_out score label half x n_hits fp kind keys counts path offset media error n form output bucket weight rank part ids start query_id vec_id v m".split()


@pytest.mark.parametrize("operator", ["ctw", "toxicity", "quality", "media", "top_k", "suffixes", "resample", "records"])
def test_other_columns_change_nothing(spark, operator):
    """Where an operator leaves other columns out, they may be called what they like."""
    rows = [r for r in corpus(3, 12) if len(r[1] or "") < 5000]
    other = {n.upper() if k % 2 else n: F.lit(f"{n}!") for k, n in enumerate(OWN)}
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, label int")
    e = spark.createDataFrame([(k, [math.sin(k * j) for j in range(6)]) for k in range(40)], "vec_id long, embedding array<float>")

    def tokens(d):
        at = scratch(spark, "records")
        records.write(d, at, tokenizer_path("byte_bpe_50k.json"), partitions=3)
        return records.read(spark, at, digest=True)

    run = {
        "ctw": lambda d: ctw.score(d, crc32_id() % 5 == 1), "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, lab)), "quality": lambda d: quality.score(d, quality.fit(d, lab)),
        "media": lambda d: media.digests(media.media_columns(d)), "suffixes": lambda d: suffixes.repeated_passages(d, 50), "records": tokens,
        "resample": lambda d: resample.resample(d, df.select("text")), "top_k": lambda d: topk.top_k(topk.whole_vectors(d), topk.whole_vectors(d), 3),
    }
    own = e if operator == "top_k" else df
    more = own.withColumns({k: v for k, v in other.items() if k.lower() not in own.columns})
    listed = lambda d: Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in run[operator](d).collect())
    assert listed(more) == listed(own)


# The pipeline


def plain_kept_lines(rows):
    strip, big = " \t\n\v\f\r", 2**63 - 1
    key = lambda x: lower(x.strip(strip))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(big if i is None else i)
    gone = lambda x, i: len(key(x)) >= 10 and len(held[key(x)]) > 1 and min(held[key(x)]) != (big if i is None else i)
    return [(i, "\n".join(x for x in (t or "").split("\n") if not gone(x, i))) for i, t in rows]


def plain_mix(rows):
    """rows (id, text, source) -> how often each stands in the mix."""
    sizes, by = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        sizes[s] += len(words(t))
        by[s].append((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i is not None, i or 0, len(words(t)), i, t))
    want, out = plain_targets(sizes) if sizes else {}, Counter()
    for s, own in by.items():
        full = math.floor(want[s] / sizes[s]) if sizes[s] else 0
        rest, before = math.floor(want[s]) - full * sizes[s], 0
        for *_, n, i, t in sorted(own, key=lambda x: x[:4]):
            out[i, t] += full + (1 if rest > 0 and before * 2 + n <= rest * 2 else 0)
            before += n
    return +out


@pytest.mark.parametrize("seed", [0, 1])
def test_pipeline(spark, seed):
    """Nulls, empty and long texts, copies, near copies, repeated rows and lines, toxic texts; then an empty table."""
    toxic, labels = toxic_rows()
    rows = [(None if i is None else i + 5000, t, s) for i, t, s in corpus(seed)] + toxic
    at, size = scratch(spark, "documents"), 2048
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    scorer = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, label int"))
    clean = [r for r in rows if plain_toxicity(r[1], scorer)[0] < 0.5]
    assert 0 < len(clean) < len(rows)
    kept = [(i, t, s) for (i, t), (_, _, s) in zip(plain_kept_lines([r[:2] for r in clean]), clean, strict=True)]
    assert len({i for i, _, _ in kept}) == len({r[0] for r in clean})
    source = {(i is None, i or 0, t): s for i, t, s in kept}
    single = [(None if k[0] else k[1], k[2], source[k]) for k in plain_one_of_each(kept, 5, 0.8, True)]
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for (i, t), n in plain_mix(single).items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, x in enumerate(range(0, len(ids), size)):
            own = ids[x : x + size]
            want[i, k, x, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += n
    got = corpus_pipeline.run(spark, at).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for own in placed.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= size


def test_pipeline_of_nothing(spark):
    at = scratch(spark, "empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
