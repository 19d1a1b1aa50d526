"""A corpus, cleaned, deduplicated, mixed and packed: each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumspark.llm import lines, mixing, packing, simhash, toxicity
from albumspark.llm.common import checkpointed, scratch
from albumspark.llm.registry import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; all others stay as they are. Labels of all labelled documents are learned from.

    Null and empty texts have no hits and stay, unless most labelled texts without a hit are toxic. Whole texts count,
    however long. Repeated rows are judged alike. An empty table, or one without labels of both classes, loses nothing
    unless over half of its labels are toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its text keeps the lines that no earlier document has, and n_chars follows.

    Null texts become empty. Rows of one doc_id are one document, and so are all rows without one, after all others.
    Documents may end up empty. An empty table stays empty.
    """
    done = lines.drop_repeated_lines(docs)
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id; groups are the components of
    texts whose sets of five-word shingles have a similarity of 0.8 or more, which pairs of near SimHashes are checked for.

    Texts without words, null or empty, are copies of each other; shorter texts than a shingle are compared whole. Null
    ids come last; of ties, by id, the least hash of id and text stays; of repeated rows one. An empty table stays empty.
    """
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; documents are taken whole, so each source comes within half of
    its longest document of its target. Documents that the budget of their source does not reach go.

    Documents without words, null or empty texts too, stand as often as a word-carrying one at their place would. Null
    sources are one source. Ties of the hash fall by doc_id; repeated rows are taken one by one. An empty table stays
    empty.
    """
    return mixing.documents_of(mixing.mix(docs, whole=True), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands. The copies of a document that the mix takes twice are pieces each.

    Null and empty texts are one end token. Long texts are cut, never shortened. An empty table gives no row.
    """
    return packing.pack(checkpointed(packing.pieces(docs, tokenizer_path(), digest=True)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack),
]

#: The first stage learns a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        at = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
