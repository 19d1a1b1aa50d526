"""Small corpora and plain versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size string, n_lines int, fp string, uid string, block string, kept string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def sentence(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=0, n=40):
    """Rows of doc_id, text, source: nulls, empty and long texts, copies, near copies, repeated rows and lines."""
    rnd = random.Random(seed)
    rows = [(k, "\n".join(sentence(rnd, rnd.randrange(1, 40)) for _ in range(rnd.randrange(1, 6))), f"s{k % 3}") for k in range(n)]
    base = sentence(rnd, 300)
    near = base.split()
    near[150] = "changed"
    rows += [(n, base, "s0"), (n + 1, base.upper(), "s1"), (n + 2, " ".join(near), None), (n + 3, None, None), (n + 4, "", "s0"), (n + 5, " \t\n ", "s2"), (n + 6, "one", "é"), (n + 7, "A Shared Line of text\nown é 1", "s0"), (n + 8, " a shared line OF text \nown 2", "s1"), (n + 9, sentence(rnd, 20000), "s2"), (None, base, "s1"), (None, "free text", "s1")]
    rows += rows[n : n + 2] + rows[n + 7 : n + 8]
    return rows


def frame(spark, rows, partitions=3):
    """With columns whose names the operators use themselves."""
    full = [(*r[:3], "x", 7, "x", "x", "x", "x") for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)
