"""Operators 2, 6 and 10 and the near-duplicate stage, against plain Python."""

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from albumspark.llm import lines, simhash, suffixes
from albumspark.operators import components

from .helpers import corpus, frame, lower, sentence, words


def groups_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        r, s = find(a), find(b)
        root[max(r, s)] = min(r, s)
    return [find(k) for k in range(n)]


# SimHash


def plain_fingerprint(text, n):
    w = words(text)
    own = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("turn", [0, 5])
def test_masks_cover(radius, turn):
    ms = simhash.masks(radius, turn)
    for bits in itertools.combinations(range(64), radius):
        assert any(not any(m >> b & 1 for b in bits) for m in ms)


def test_two_families_leave_few_bits():
    assert max(64 - (a | b).bit_count() for a in simhash.masks(2) for b in simhash.masks(2, 5)) <= 14


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups_of(500, edges)
    assert got == {k: want[k] for e in edges if e[0] != e[1] for k in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [4096, 2])
def test_links_join_what_is_near(spark, limit, monkeypatch):
    """Also where every bucket is dealt anew."""
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = sorted({simhash._signed(b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(6)))) for b in base for _ in range(8)})
    real = simhash.bucketed
    monkeypatch.setattr(simhash, "bucketed", lambda p, r: real(p, r, limit))
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2).collect()
    at = {f: k for k, f in enumerate(fps)}
    u = np.array(fps).view(np.uint64)
    true = [(i, j) for i in range(len(fps)) for j in range(i) if int(u[i] ^ u[j]).bit_count() <= 2]
    assert {tuple(sorted((at[r.a], at[r.b]))) for r in found} <= {tuple(sorted(t)) for t in true}
    assert groups_of(len(fps), [(at[r.a], at[r.b]) for r in found]) == groups_of(len(fps), true)


def test_near_duplicates(spark):
    rows = corpus()
    got = simhash.near_duplicates(frame(spark, rows), 3, 2).collect()
    fps = [plain_fingerprint(t, 3) for _, t, _ in rows]
    group = groups_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = defaultdict(list)
    for g, (i, _, _) in zip(group, rows, strict=True):
        least[g] += [i] if i is not None else []
    want = sorted((str(i), fp, min(least[g], default=None)) for (i, _, _), fp, g in zip(rows, fps, group, strict=True))
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash.near_duplicates(frame(spark, []), 3, 2).count() == 0


# Word sets


def plain_one_of_each(rows, n, t, whole=False):
    sets = []
    for _, text, _ in rows:
        w = words(text)
        sets.append({" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) > n else ({" ".join(w)} if w else set()))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] | sets[j] == set() or len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])]
    least = {}
    for g, (i, text, _) in zip(groups_of(len(rows), links), rows, strict=True):
        key = (i is None, i or 0, text or "")
        least[g] = min(least.get(g, key), key)
    return sorted(k if whole else k[:2] for k in least.values())


def family(seed):
    """A group of near copies, all at different distances, larger than what is linked in a bucket at once."""
    rnd = random.Random(seed)
    rows, base = [], sentence(rnd, 260).split()
    for k in range(40):
        own = list(base)
        for x in rnd.sample(range(260), rnd.randrange(0, 7)):
            own[x] = f"n{rnd.random()}"
        rows.append((1000 + k, " ".join(own), "s"))
    return rows


@pytest.mark.parametrize("rows", [corpus(), family(1), family(2) + corpus(5)])
def test_one_of_each(spark, rows):
    got = simhash.one_of_each(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == plain_one_of_each(rows, 5, 0.8)


def test_one_of_each_in_tiles(spark, monkeypatch):
    """Buckets of more members than a task compares."""
    monkeypatch.setattr(simhash, "TOGETHER", 4)
    rnd = random.Random(21)
    base, rows = sentence(rnd, 60, 10**6).split(), []
    for k in range(60):
        own = list(base)
        for _ in range(rnd.randrange(0, 9)):
            own[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(own), "s"))
    got = simhash.one_of_each(frame(spark, rows), 5, 0.8)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == plain_one_of_each(rows, 5, 0.8)


def test_colliding_ids_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 7, "c"), (2, 9, "d"), (1, 7, "e")], "uid long, other long, x string")
    got = {r.x: r.uid for r in simhash.told_apart(rows).collect()}
    assert got["a"] == got["b"] == 1 and got["d"] == 2 and got["c"] == got["e"] not in (1, 2)


def test_wide_keys_meet():
    rnd = np.random.default_rng(5)
    for n in (1, 2, 5, 30, 100, 140, 160, 1000, 15000):  # beyond some 150 elements not all blocks are shown
        for _ in range(30):
            a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
            gone = int(0.2 * len(a) / 1.0)
            b = np.sort(rnd.permutation(a)[gone:])
            assert set(simhash.wide_keys(a, 0.8)) & set(simhash.wide_keys(b, 0.8)), n


def test_set_forest():
    rnd = random.Random(6)
    sets = [np.array(sorted(rnd.sample(range(60), 30)), np.uint64) for _ in range(60)]
    true = [(i, j) for i in range(60) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= 0.45 * len(set(sets[i]) | set(sets[j]))]
    assert groups_of(60, simhash.set_forest(sets, 0.45)) == groups_of(60, true)
    assert simhash.set_forest([], 0.8) == []


# Lines


def plain_lines(rows):
    strip = " \t\n\v\f\r"
    key = lambda x: lower(x.strip(strip))
    held = defaultdict(set)
    big = 2**63 - 1
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(big if i is None else i)
    out = []
    for i, t, _ in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(key(x)) >= 10 and len(held[key(x)]) > 1 and min(held[key(x)]) != (big if i is None else i))]
        out.append((str(i), len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_lines(spark):
    rows = corpus() + [(900, "éééééééééé\nééééééééé\nx", "s"), (901, "ÉÉÉÉÉÉÉÉÉÉ\néééééééééé\nééééééééé\r", "s")]
    done = lines.drop_repeated_lines(frame(spark, rows))
    assert [c for c in done.columns if c in ("kept", "n_lines")] == ["n_lines", "kept"]
    got = done.select(F.col("doc_id").cast("string"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_lines(rows)
    assert lines.drop_repeated_lines(frame(spark, [])).count() == 0


def test_perfect_hash():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        h1, h2 = rnd.integers(-(2**63), 2**63 - 1, (2, n))
        index = lines.LineIndex(h1, h2, np.arange(n), np.full(n, 2))
        assert sorted(index.hash(h1, h2).tolist()) == list(range(n))
        again = lines.LineIndex.from_bytes(index.to_bytes())
        hit, first = again.probe(h1, h2)
        assert hit.tolist() == list(range(n)) and first.tolist() == list(range(n))
        assert len(again.probe(*rnd.integers(-(2**63), 2**63 - 1, (2, 1000)))[0]) == 0


# Suffixes


def planted(seed):
    rnd = random.Random(seed)
    passages = [sentence(rnd, n) for n in (49, 50, 51, 60, 120, 300)]
    rows = [(k, " ".join([sentence(rnd, rnd.randrange(0, 90)), rnd.choice(passages), sentence(rnd, rnd.randrange(0, 90))]), "s") for k in range(60)]
    return rows + [(100, "same " * 400, "s"), (101, "same " * 130, "s"), (102, "a b " * 100, "s"), (103, "b a " * 90, "s"), (104, sentence(rnd, 600), "s")]


def test_no_passages(spark):
    assert suffixes.repeated_passages(frame(spark, []), 50).count() == 0
    assert suffixes.repeated_passages(frame(spark, [(1, "a b", "s"), (2, None, "s"), (2, "a b", "s")]), 50).count() == 0


def plain_passages(rows, least):
    held = defaultdict(set)
    texts = {(2**63 - 1 if i is None else i, t): words(t) for i, t, _ in rows}
    for own, w in texts.items():
        for k in range(len(w) - least + 1):
            held[tuple(w[k : k + least])].add(own)
    out = []
    for own, w in texts.items():
        spans = []
        for k in range(len(w) - least + 1):
            if others := held[tuple(w[k : k + least])] - {own}:
                first = min(i for i, _ in others)
                if spans and k <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], k + least, min(first, spans[-1][2]))
                else:
                    spans.append((k, k + least, first))
        out += [(own[0], a, b, first) for a, b, first in spans]
    return sorted(out)


def passages(spark, rows, **how):
    number = lambda i: 2**63 - 1 if i is None else i
    return sorted((number(r.doc_id), r.start_word, r.end_word, number(r.first_doc_id)) for r in suffixes.repeated_passages(frame(spark, rows), 50, **how).collect())


def test_passages_behind_a_repeated_line(spark):
    """The line stands more often before the passage in one text than in the other."""
    rnd = random.Random(11)
    rows = []
    for k in range(40):
        line, after = sentence(rnd, 20, 10**6), sentence(rnd, 15, 10**6)
        rows += [(2 * k, " ".join([line] * 4 + [after]), "s"), (2 * k + 1, " ".join([sentence(rnd, 30, 10**6), line, line, after]), "s")]
    assert passages(spark, rows) == plain_passages(rows, 50)


@pytest.mark.parametrize("rows", [planted(1), planted(2), corpus(), [*planted(3), (None, sentence(random.Random(1), 80), "s"), (7, sentence(random.Random(1), 80), "s")]])
def test_passages_are_exact(spark, rows):
    """Also inside texts that repeat one word, and in rows without an id."""
    assert passages(spark, rows) == plain_passages(rows, 50)


@pytest.mark.parametrize("fan", [3, 64])
def test_passages_over_several_levels(spark, fan):
    """Many small blocks, whose arrays meet level by level."""
    rows = [*planted(4), *corpus()]
    assert passages(spark, rows, block=sum(len(t or "") for _, t, _ in rows) // 20, fan=fan) == plain_passages(rows, 50)


def test_passages_many_times_in_a_text(spark):
    """Each text holds the passage more often than there were places among neighbours, with words of its own between."""
    rnd = random.Random(12)
    passage = sentence(rnd, 55, 10**6)
    rows = [(k, " ".join(f"{passage} {sentence(rnd, 5, 10**6)}" for _ in range(20)), "s") for k in range(4)]
    rows += [(10, " ".join([passage, sentence(rnd, 60, 10**6), passage]), "s"), (11, passage, "s"), (11, passage + " x", "s")]
    assert passages(spark, rows) == plain_passages(rows, 50)


def plain_neighbours(rows):
    """(key, text) of suffixes: of each, how many words beyond the minimiser it shares with one of another text."""

    def shared(x, y):
        if x[: suffixes.HEAD] != y[: suffixes.HEAD]:
            return -1
        words = [[w for b in k[suffixes.HEAD :] for w in (b >> 4, b & 15)] for k in (x, y)]
        n = 0
        while n < len(words[0]) and words[0][n] == words[1][n] and words[0][n]:
            n += 1
        return n

    return [max((shared(k, o) for o, u in rows if u != t), default=-1) for k, t in rows]


@pytest.mark.parametrize("cuts", [1, 2, 7, 40])
def test_neighbours_are_the_best_of_all(spark, cuts):
    """However many suffixes of its own text stand between a suffix and its best, also where ranges are cut between them."""
    rnd = random.Random(5)
    for trial in range(2):
        own = sorted({(bytes([0, 0, 0, 0, 0, rnd.randrange(3), *(rnd.choice([0x11, 0x12, 0x21]) for _ in range(4))]), rnd.choice([1, 1, 1, 1, 2, 3] if trial else [1, 2, 3, 4])) for _ in range(150)})
        want = {}
        for (k, _), n in zip(own, plain_neighbours(own), strict=True):
            want[k] = max(want.get(k, -1), n)
        keys = sorted({k for k, _ in own})
        bounds = np.array([keys[len(keys) * c // cuts] for c in range(1, cuts)], "S10")
        rows = [(int(np.searchsorted(bounds, np.array([k], "S10"), side="right")[0]), bytearray(k), t, False, t) for k, t in own]
        table = spark.createDataFrame(rows, suffixes._SUFFIXES_DDL)
        got = {}
        for r in suffixes.settled(suffixes._compared(table, cuts)).collect():
            got[bytes(r.key)] = max(got.get(bytes(r.key), -1), r.n)
        assert got == {k: n for k, n in want.items() if n >= 0}


@pytest.mark.parametrize("partitions", [2, 16])
def test_passages_that_end_in_a_frequent_line(spark, partitions):
    """What is equal lies to the left of the line; what follows it differs. However the rows are dealt, all are found."""
    rnd = random.Random(13)
    least = lambda x: suffixes.rolled(np.array([xxhash.xxh64_intdigest(w) for w in x.split()], np.uint64), suffixes.GRAM).min()
    line, rows = min((sentence(rnd, 20, 10**6) for _ in range(2000)), key=least), []  # the minimiser is in the line
    for k in range(300):
        before = sentence(rnd, 30, 10**6)
        rows += [(2 * k + x, " ".join([sentence(rnd, 20, 10**6), before, line, sentence(rnd, 60, 10**6)]), "s") for x in range(2)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert passages(spark, rows) == plain_passages(rows, 50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
