"""The queries of this subpackage, one for each operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, infill, lines, media, mixing, packing, quality, records, resample, simhash, suffixes, topk, toxicity
from .common import crc32_id, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query(mixing.ORACLE)
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = mixing.checkpointed(docs.select("doc_id", "source", mixing.word_count().alias("size")))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), digest=True)
    return packing.pack(packing.checkpointed(made))


@query()
def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.media_columns(read(spark, sf_dir, "documents", "doc_id", "text")))


@query(topk.ORACLE)
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors, 10)


@query()
def op4_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held_out = (crc32_id() % 3 == 1).alias("held_out")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality").withColumnRenamed("quality", "label")
    classifier = quality.fit(docs, labels.filter(crc32_id() % 3 != 1))
    scored = quality.score(docs, classifier)
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(lines.ORACLE)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query()
def op3_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held_out = (crc32_id() % 5 == 0).alias("held_out")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").withColumnRenamed("toxic", "label")
    scorer = toxicity.fit(docs, labels.filter(crc32_id() % 5 != 0))
    scored = toxicity.score(docs, scorer)
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_quoted")


@query()
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op1_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(read(spark, sf_dir, "documents", "doc_id", "text"), crc32_id() % 5 == 1)


@query()
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(read(spark, sf_dir, "documents", "doc_id", "text"), least=50)


@query(resample.ORACLE)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "text")
    return resample.resample(docs, target, order=2, buckets=10_000, percent=25, least=20, seed=7)


@query(infill.ORACLE)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.restore(infill.fill_in_middle(read(spark, sf_dir, "documents", "doc_id", "text")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


@query()
def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "records")
    records.write(read(spark, sf_dir, "documents", "doc_id", "text"), at, tokenizer_path("byte_bpe_50k.json"))
    return records.read(spark, at, digest=True)
