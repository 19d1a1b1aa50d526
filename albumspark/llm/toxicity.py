"""Toxicity by a lexicon trie met with Levenshtein automata, and a window that tells quotation from abuse.

The lexicon holds whole terms and stems, words and beginnings of words that labelled toxic texts use far more often
than others, and any terms given. Words run through the product of the trie and the automata of its entries, made
deterministic state by state as words need it, so a word costs a look-up a letter however large the lexicon is, and
most words end in the dead state after a few letters. An edit may be anywhere in a word; words that clean texts use are
themselves, not misspellings. Each hit is weighed by its window: quotation marks around it or
a reporting word before it make it a quotation. Sums over the document go through a logistic function.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumspark.session import ship

from .common import batch, sliced, stored, texts, tidied
from .logistic import Logistic

#: Labelled texts at most. The lexicon has no bound of its own: an entry is in one toxic text of a hundred at least, so there
#: are a hundred times as many as a toxic text has words, at most.
SAMPLE = 12_000
#: Letters of a stem; letters from which a word may have an edit; clean texts from which a word is not a misspelling.
STEMS, FUZZY, CLEAN = (4, 5, 6, 7), 5, 2
#: Words of the window on each side.
WINDOW = 5
#: States remembered, some 500 bytes each; bytes of text at once.
STATES, SLICE = 20_000, 4 << 20

#: Fixed: marks that open or close a quotation, and words that report one.
QUOTES = "\"'«»‘’‚“”„"
REPORTING = frozenset("said says wrote writes quoted quote called calls term word dit sagte schrieb dijo".split())

_EDGE = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "«»‘’‚“”„…¡¿"
_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_hits", pa.int32()), ("n_quoted", pa.int32())])
FEATURES = 7


def word_of(token: str) -> str:
    """A token without marks at its ends, in lower case."""
    return token.strip(_EDGE).lower()


class Matcher:
    """entries: (letters, is stem, weight). match(word) -> (entry, edits) or None; excused words match without an edit alone."""

    DEAD = 0

    def __init__(self, entries: list[tuple[str, bool, float]], excused: frozenset[str] = frozenset()):
        self.entries, self.excused = entries, excused
        self.children: list[dict[str, int]] = [{}]
        self.term, self.stem = [-1], [-1]
        for k, (letters, is_stem, _) in enumerate(entries):
            node = 0
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.stem.append(-1)
                node = self.children[node][c]
            (self.stem if is_stem else self.term)[node] = k
        self._start()

    def _start(self) -> None:
        # At first a term's first letter may be left out.
        self.sets: list[frozenset] = [frozenset(), frozenset({(0, 0), *((child, 1) for child in self.children[0].values())})]
        self.number = {self.sets[0]: 0, self.sets[1]: 1}
        self.moves: list[dict[str, int]] = [{}, {}]
        self.accepts: list[tuple[int, int] | None] = [None, None]
        self.final = [False, False]

    def __getstate__(self):
        return {"entries": self.entries, "excused": self.excused, "children": self.children, "term": self.term, "stem": self.stem}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._start()

    def _fits(self, entry: int, edits: int) -> bool:
        return edits == 0 or len(self.entries[entry][0]) >= FUZZY and not self.entries[entry][1]

    def _move(self, state: int, c: str) -> int:
        """The state after c: matches, substitutions and insertions, then deletions."""
        best: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= 1 and edits < best.get(node, 2):
                best[node] = edits

        for node, edits in self.sets[state]:
            own = self.children[node]
            if c in own:
                reach(own[c], edits)
            if edits == 0:
                reach(node, 1)
                for child in own.values():
                    reach(child, 1)
        for node, edits in list(best.items()):
            if edits == 0:
                for child in self.children[node].values():
                    reach(child, 1)
        stems = [(self.stem[n], 0) for n, e in best.items() if e == 0 and self.stem[n] >= 0]
        key = frozenset(best.items()) if not stems else frozenset({("stem", stems[0][0])})
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key if not stems else frozenset())
            self.moves.append({})
            terms = [(e, self.term[n]) for n, e in best.items() if self.term[n] >= 0 and self._fits(self.term[n], e)]
            self.accepts.append(stems[0] if stems else min(terms)[::-1] if terms else None)
            self.final.append(bool(stems))
        new = self.number[key]
        self.moves[state][c] = new
        return new

    def match(self, word: str) -> tuple[int, int] | None:
        state = 1
        for c in word:
            state = self.moves[state].get(c) if c in self.moves[state] else self._move(state, c)
            if state == self.DEAD:
                return None
            if self.final[state]:
                break
        found = self.accepts[state]
        return None if found and found[1] and word in self.excused else found

    def hits(self, tokens: list[str]) -> dict[str, tuple[int, int]]:
        """The tokens that match."""
        out = {}
        for t in tokens:
            if len(self.sets) > STATES:
                self._start()
            if m := self.match(word_of(t)):
                out[t] = m
        return out


def features(tokens: list[str], hits: dict[str, tuple[int, int]], entries: list[tuple[str, bool, float]]) -> tuple[list[float], int, int]:
    """What the hits of a document say, how many there are, and how many of them are quotations."""
    at = [k for k, t in enumerate(tokens) if t in hits]
    abuse = quoted = fuzzy = 0.0
    seen, most, n_quoted = set(), 0.0, 0
    for k in at:
        entry, edits = hits[tokens[k]]
        weight = entries[entry][2] * (0.5 if edits else 1)
        near = tokens[max(0, k - WINDOW) : k + WINDOW + 1]
        own = min(k, WINDOW)
        marks = any(t[0] in QUOTES for t in near[: own + 1]) and any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in near[own:] if t.rstrip(".,;:!?"))
        told = any(word_of(t) in REPORTING for t in near[:own])
        if marks or told and near[own][0] in QUOTES:
            quoted += weight
            n_quoted += 1
        else:
            abuse += weight
            fuzzy += weight if edits else 0
            most = max(most, weight)
            seen.add(entry)
    x = [math.log1p(abuse), math.log1p(quoted), math.log1p(fuzzy), most, math.log1p(len(seen)), abuse / (len(tokens) + 20), float(bool(seen))]
    return x, len(at), n_quoted


class Scorer:
    """P(toxic) of texts: a matcher, and the logistic function over features()."""

    def __init__(self, entries: list[tuple[str, bool, float]], excused: frozenset[str] = frozenset()):
        self.matcher, self.calibrated, self.constant = Matcher(entries, excused), None, 0.5

    def features(self, documents: pa.Array) -> list[tuple[list[float], int, int]]:
        """Of each text; null is empty. Each distinct token of these texts is matched once."""
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(documents.cast(pa.string()).fill_null("")))
        codes = split.flatten().dictionary_encode()
        words = codes.dictionary.to_pylist()
        hits = self.matcher.hits(words)
        out = [([0.0] * FEATURES, 0, 0)] * len(documents)
        if hits:
            known = np.fromiter((w in hits for w in words), bool, len(words))
            ends = np.cumsum(pc.list_value_length(split).to_numpy())
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(known[codes.indices.to_numpy()]), side="right")).tolist():
                out[k] = features(split[k].as_py(), hits, self.matcher.entries)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.constant = (y.sum() + 0.5) / (len(y) + 1)
        if 0 < y.sum() < len(y):
            self.calibrated = Logistic(x, y)

    def __call__(self, documents: pa.Array) -> tuple[np.ndarray, list[int], list[int]]:
        found = self.features(documents)
        x = np.array([f for f, _, _ in found]).reshape(len(found), FEATURES)
        scores = self.calibrated(x) if self.calibrated else np.full(len(found), self.constant)
        return scores, [n for _, n, _ in found], [q for _, _, q in found]


def _candidates(text: bytes) -> set[str]:
    """Words and stems of a text; a stem ends in *."""
    words = {w for t in set(text.split()) if (w := word_of(t.decode()))}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


_COUNTS = pa.schema([("entry", pa.string()), ("n", pa.int64())])


def _counts(sample: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """entry, n: how many texts of the sample use it."""

    def run(batches: Iterator[pa.RecordBatch]):
        n: Counter = Counter()
        for b in batches:
            for text in texts(b.column("text")):
                found = _candidates(text)
                n.update(found if only is None else found & only)
        yield batch(_COUNTS, list(n), list(n.values()))

    return sample.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def lexicon(
    toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int, terms: Iterable[str] = ()
) -> list[tuple[str, bool, float]]:
    """Entries with their log odds: all words and stems that one toxic text of a hundred has, or three texts, and clean ones
    far less. A word that a chosen stem covers is met by the stem; if it may have an edit, it stays beside them for words
    that are one edit away. Given terms all count."""
    least = max(3, math.ceil(0.01 * n_toxic))
    bad = {r["entry"]: r["n"] for r in _counts(toxic).filter(F.col("n") >= least).collect()}  # see SAMPLE
    good = {r["entry"]: r["n"] for r in _counts(clean, frozenset(bad)).collect()} if bad else {}
    odds = {e: math.log((n + 0.5) / (n_toxic + 1)) - math.log((good.get(e, 0) + 0.5) / (n_clean + 1)) for e, n in bad.items()}
    chosen: dict[str, float] = {}
    covered: dict[str, float] = {}
    ordered = sorted(odds)  # entries that begin alike stand together

    def gives_way(stem: str) -> bool:
        """Whether a longer stem or word says as much."""
        for k in range(bisect.bisect_left(ordered, stem), len(ordered)):
            x = ordered[k]
            if not x.startswith(stem):
                return False
            if len(x.rstrip("*")) > len(stem) and bad[x] >= 0.95 * bad[stem + "*"]:
                return True
        return False

    for e in sorted((e for e in odds if odds[e] >= 2.5 and bad[e] >= 4 * good.get(e, 0)), key=lambda e: (-bad[e], len(e), e)):
        word = e.rstrip("*")
        if any(word[:n] + "*" in chosen for n in STEMS if n <= len(word)):
            if e[-1] != "*" and len(word) >= FUZZY:
                covered[e] = odds[e]
        elif e[-1] != "*" or not gives_way(word):
            chosen[e] = odds[e]
    chosen |= covered
    chosen |= {t.lower(): chosen.get(t.lower(), 4.0) for t in terms}
    return [(e.rstrip("*"), e[-1] == "*", w) for e, w in sorted(chosen.items()) if e.rstrip("*")]


def excused(clean: DataFrame, entries: list[tuple[str, bool, float]]) -> frozenset[str]:
    """Words of at least CLEAN clean texts of the sample that are one edit from an entry: no misspellings of it."""
    matcher = Matcher(entries)

    def run(batches: Iterator[pa.RecordBatch]):
        n: Counter = Counter()
        for b in batches:
            for text in texts(b.column("text")):
                n.update({w for t in set(text.decode().split()) if (w := word_of(t)) and (m := matcher.match(w)) and m[1]})
                if len(matcher.sets) > STATES:
                    matcher._start()
        yield batch(_COUNTS, list(n), list(n.values()))

    found = clean.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).filter(F.col("n") >= CLEAN)
    return frozenset(r["entry"] for r in found.collect())  # words of the sample


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: Iterable[str] = ()) -> Scorer:
    """labels: doc_id, label 0 or 1. `sample` labelled documents, least by a hash of the id, are read.

    Each distinct text counts once. One half of them makes the lexicon, the other calibrates. Rows without id or label
    are left out; null texts are empty. Without labels of both classes the score is the share of label 1, or 0.5.
    """
    ship(docs.sparkSession)
    labels = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", "label").distinct()
    ids = labels.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(sample)  # a bounded table
    half = F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")  # equal texts fall in one half
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", "text", half).distinct())
    n = {(r["label"], r["half"]): r["n"] for r in rows.groupBy("label", "half").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (rows.filter((F.col("label") == k) & (F.col("half") == 0)) for k in (1, 0))
    entries = lexicon(toxic, clean, n.get((1, 0), 0), n.get((0, 0), 0), terms)
    scorer = Scorer(entries, excused(clean, entries))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in sliced(batches, SLICE):
            found = scorer.features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int32()), pa.array([f for f, _, _ in found], pa.list_(pa.float64()))], names=["label", "x"])

    own = rows.filter("half = 1").select("label", "text").mapInArrow(tidied(run), "label int, x array<double>").collect()  # sample rows at most
    own.sort(key=lambda r: (r["label"], r["x"]))
    scorer.fit(np.array([r["x"] for r in own]).reshape(len(own), FEATURES), np.array([r["label"] for r in own], float))
    return scorer


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score, n_hits and n_quoted of every row of docs, repeated rows alike; null and empty texts have no hits,
    null ids stay null, other columns are left out. An empty table gives no row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in sliced(batches, SLICE):
            yield batch(_OUT, b.column("doc_id"), *shared.value(b.column("text")))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, score double, n_hits int, n_quoted int")


def keep_clean(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores under the threshold, all columns as they were, whatever their names. Only texts
    go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def run(columns: Iterator[pa.Array]):
            for column in columns:
                rows = [pa.RecordBatch.from_arrays([column], names=["text"])]
                parts = [shared.value(b.column("text"))[0] < threshold for b in sliced(rows, SLICE)]
                yield pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

        return tidied(run)(batches)

    return docs.filter(clean("text"))
