"""Operators 1, 3 and 4."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from albumspark.llm import ctw, quality, toxicity
from albumspark.llm.common import crc32_id
from albumspark.llm.logistic import Logistic

from .helpers import corpus, frame, lower, words

# Context-tree weighting


class PlainTree:
    """The same tree, node by node."""

    def __init__(self, texts, depth=ctw.DEPTH):
        self.depth, self.n = depth, Counter()
        for t in texts:
            for context, x in self.steps(t):
                for k in range(8):
                    node, bit = 1 << k | x >> 8 - k, x >> 7 - k & 1
                    for d in range(depth + 1):
                        self.n[context[:d], node, bit] += 1
        self.below = {}
        for c, node, _ in self.n:
            if c:
                self.below.setdefault((c[:-1], node), set()).add(c)
        self.pw = {}

    def steps(self, text):
        x = [255] * self.depth + list(lower(text).encode()) + [255]
        return [(tuple(reversed(x[k - self.depth : k])), x[k]) for k in range(self.depth, len(x))]

    def kt(self, c, node):
        a, b = self.n[c, node, 0], self.n[c, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, c, node):
        if (c, node) not in self.pw:
            kt = self.kt(c, node)
            self.pw[c, node] = kt if len(c) == self.depth else np.logaddexp(kt, sum(self.weighted(s, node) for s in self.below[c, node])) - math.log(2)
        return self.pw[c, node]

    def p(self, context, d, node, bit):
        c = context[:d]
        total = self.n[c, node, 0] + self.n[c, node, 1]
        if not total:
            return None
        own = (self.n[c, node, bit] + 0.5) / (total + 1)
        deeper = self.p(context, d + 1, node, bit) if d < self.depth else None
        if deeper is None:
            return own
        w = math.exp(self.kt(c, node) - math.log(2) - self.weighted(c, node))
        return w * own + (1 - w) * deeper

    def score(self, text):
        total = 0.0
        for context, x in self.steps(text):
            for k in range(8):
                p = self.p(context, 0, 1 << k | x >> 8 - k, x >> 7 - k & 1)
                total += math.log10(0.5 if p is None else p)
        return total


def plain_base(rows, held):
    n = Counter()
    for (_, t, _), h in zip(rows, held, strict=True):
        if not h:
            n.update([*words(t), None])
    total, kinds = sum(n.values()), len(n)
    return [sum(math.log10((n[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in [*words(t), None]) for _, t, _ in rows], n


@pytest.mark.parametrize(("block", "fan"), [(32 << 20, 64), (2000, 64), (2000, 3)])
def test_ctw(spark, block, fan):
    """Also where arrays are merged, and answered, over several levels."""
    rows = [r for r in corpus() if len(r[1] or "") < 5000]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _, _ in rows]
    tree = PlainTree([t for (_, t, _), h in zip(rows, held, strict=True) if not h])
    base, n = plain_base(rows, held)
    want = sorted((str(i), h, len(words(t)) + 1, sum(n[w] > 0 for w in [*words(t), None]), round(b, 6), round(tree.score(t), 3)) for (i, t, _), h, b in zip(rows, held, base, strict=True))
    got = ctw.score(frame(spark, rows), crc32_id() % 5 == 1, block, fan).collect()
    rounded = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in got)
    assert [r[:4] for r in rounded] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in rounded], [r[4:] for r in want], rtol=1e-4, atol=2e-3)
    assert {r.train_tokens for r in got} == {sum(n.values())}


def test_ctw_is_a_distribution():
    """The probabilities of all bytes after a context add up to one, seen context or not."""
    rnd = random.Random(1)
    learned = ["".join(rnd.choice("abc ") for _ in range(300)).encode() for _ in range(5)]
    g, _ = ctw.grams(learned)
    u, c = ctw.summed(g, np.ones(len(g), np.int64))
    nodes, up = ctw.sub_trees(u, c)
    top = ctw.Top(*up)
    for context in (0, int(g[40]) >> 8, int(g[3]) >> 8, 0x616261FFFF, 0x7A7A7A7A7A):
        every = np.uint64(context << 8) | np.arange(256, dtype=np.uint64)
        assert (10 ** ctw.log10_probabilities(every, nodes, top)).sum() == pytest.approx(1)


def test_ctw_edges(spark):
    assert ctw.score(frame(spark, []), F.lit(False)).count() == 0
    r = ctw.score(frame(spark, [(1, "ab", "s")]), F.lit(True)).first()
    assert (r.train_tokens, r.n_known, r.score) == (0, 0, pytest.approx(24 * math.log10(0.5)))


# Toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_matcher():
    terms = ["moron", "idiot", "scum", "worthless"]
    m = toxicity.Matcher([(t, False, 1.0) for t in terms] + [("lowei", True, 1.0)])
    rnd = random.Random(2)
    tried = list(terms)
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rnd.randrange(1, 3)):
                k = rnd.randrange(len(w))
                w[k : k + rnd.randrange(2)] = rnd.choice(["", "x", "0", t[0]])
            tried.append("".join(w))
    for w in tried:
        near = [(edits(w, t), t) for t in terms if edits(w, t) <= (1 if len(t) >= toxicity.FUZZY else 0)]
        got = m.match(w)
        assert (got is None) == (not near), w
        if near:
            assert (got[1], m.entries[got[0]][0]) == min(near), w
    assert m.match("loweixyz")[1] == 0 and m.match("lowexyz") is None and m.match("") is None
    assert [m.match(w) and m.match(w)[1] for w in ("boron", "oron", "xmoron", "omron", "cum")] == [1, 1, 1, None, None]
    shy = toxicity.Matcher(m.entries, frozenset({"boron", "moron"}))
    assert shy.match("boron") is None and shy.match("moron")[1] == 0 and shy.match("noron")[1] == 1


def test_lexicon_has_no_bound(spark):
    """Thousands of terms, long and short ones, all learned; words that clean texts use are no misspellings."""
    rnd = random.Random(8)
    terms = [f"{rnd.choice('bcdfgh')}{k:05d}{'z' * (k % 60)}" for k in range(6000)] + ["k0", "ü"]
    toxic = [(k, " ".join(terms[j] for j in range(k, len(terms), 40)), "s") for k in range(40)]
    toxic = [(1000 * n + k, f"{t} pick{n}", "s") for n in range(8) for k, t, _ in toxic]
    clean = [(10_000 + k, f"plain words c00001 b00001 {k}", "s") for k in range(400)]
    docs = frame(spark, toxic + clean)
    labels = spark.createDataFrame([(i, 1) for i, *_ in toxic] + [(i, 0) for i, *_ in clean], "doc_id long, label int")
    rows = docs.join(labels, "doc_id")
    entries = toxicity.lexicon(rows.filter("label = 1"), rows.filter("label = 0"), 320, 400)
    matcher = toxicity.Matcher(entries)
    assert len(entries) > 1000 and all(matcher.match(t) for t in terms if t not in ("c00001", "b00001"))
    assert toxicity.excused(rows.filter("label = 0"), [("moron", False, 1.0), ("c00002", False, 1.0)]) == {"c00001"}


def test_quotation():
    m = toxicity.Matcher([("moron", False, 3.0)])

    def of(text):
        t = text.split()
        return toxicity.features(t, m.hits(t), m.entries)[1:]

    assert of("you moron go") == (1, 0) and of('he said "you moron" twice') == (1, 1) and of('they called it "moron and went') == (1, 1) and of("fine") == (0, 0)


def labelled(n=400):
    rnd = random.Random(3)
    plain, bad = [f"word{k}" for k in range(200)], ["moron", "scum", "pathetic"]
    rows, labels = [], []
    for k in range(n):
        own = [rnd.choice(plain) for _ in range(rnd.randrange(20, 60))]
        toxic = k % 4 == 0
        if toxic:
            for x in rnd.sample(range(len(own)), 4):
                own[x] = rnd.choice(bad)
        rows.append((k, " ".join(own), "s"))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled()
    rows += [(900, None, "s"), (901, "", "s"), (902, "word1 morom word2 scum pathetik word3", "s"), (None, "word1", "s"), (903, "word5 " * 20000 + "moron scum moron pathetic " * 900, "s")]
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, label int")
    scorer = toxicity.fit(frame(spark, rows), lab.filter(crc32_id() % 5 != 0))
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows), scorer).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k].score >= 0.5) == y for k, y in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score < 0.5 < min(got[902].score, got[903].score) and got[902].n_hits == 3
    kept = toxicity.keep_clean(frame(spark, rows), scorer)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(r.score < 0.5 for r in got.values())


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    scorer = toxicity.fit(frame(spark, [(1, "a", "s")]), none)
    assert [r.score for r in toxicity.score(frame(spark, [(1, "a", "s")]), scorer).collect()] == [0.5]
    assert toxicity.score(frame(spark, []), scorer).count() == 0


# Quality


def test_quality(spark):
    rnd = random.Random(4)
    good = [(k, " ".join(rnd.choice(["the", "house", "stands", "on", "a", "hill", "and", "people", "walk"]) for _ in range(80)), "s") for k in range(200)]
    bad = [(1000 + k, " ".join(rnd.choice(["$$$", "BUY!!", "click", "###", "now%%%"]) + str(rnd.randrange(99)) for _ in range(80)), "s") for k in range(100)]
    rows = good + bad + [(2000, None, "s"), (2001, "", "s"), (None, "the house", "s"), (2002, "the hill " * 20000, "s")]
    lab = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad] + [(None, 1), (3, None)], "doc_id long, label int")
    model = quality.fit(frame(spark, rows), lab.filter(crc32_id() % 3 != 1))
    got = {r.doc_id: r.score for r in quality.score(frame(spark, rows), model).collect()}
    held = [(r[0], y) for part, y in ((good, 1), (bad, 0)) for r in part if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(got) == len(rows) and sum((got[k] >= 0.5) == y for k, y in held) >= 0.97 * len(held)
    assert got[2000] == got[2001] and 0 <= got[2000] <= 1


def test_quality_without_examples(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    model = quality.fit(frame(spark, [(1, "a", "s")]), none)
    assert [r.score for r in quality.score(frame(spark, [(1, "a", "s")]), model).collect()] == [0.5]
    few = quality.CompressionClassifier([b"x"], [b"good text"])
    assert all(0 <= s <= 1 for s in few([b"", b"x", b"good text"]))


def test_dictionaries_round_trip():
    c = quality.CompressionClassifier([b"bad words here " * 50] * 20, [b"good words there " * 50] * 20)
    d = zstandard.ZstdCompressionDict(c.dictionaries[0])
    x = b"good words there, at last"
    assert zstandard.ZstdDecompressor(dict_data=d).decompress(zstandard.ZstdCompressor(dict_data=d).compress(x)) == x


def test_logistic():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(500, 3))
    y = (x @ [2, -1, 0] + 0.5 > 0).astype(float)
    assert ((Logistic(x, y)(x) >= 0.5) == y).mean() > 0.98


def test_words_under_a_stem_take_an_edit(spark):
    toxic = spark.createDataFrame([(f"you {w} {w[:1]}{k}",) for k, w in enumerate(["idiot"] * 10 + ["idiotic"] * 10)], "text string")
    clean = spark.createDataFrame([(f"you fine {k}",) for k in range(20)], "text string")
    entries = toxicity.lexicon(toxic, clean, 20, 20)
    assert [e[:2] for e in entries if e[1]] == [("idiot", True)]
    matcher = toxicity.Matcher(entries)
    assert [entries[matcher.match(w)[0]][:2] + matcher.match(w)[1:] for w in ("idiot", "idiotically", "idiet")] == [("idiot", True, 0), ("idiot", True, 0), ("idiot", False, 1)]
