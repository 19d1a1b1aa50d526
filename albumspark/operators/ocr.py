"""OCR detections to phrases and regions, and filters over stored regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumspark.functions.text import good_words, title

# The gates of a detection, and the mark of a region that OCR wrote.
MIN_CONFIDENCE, HIGH_CONFIDENCE, MIN_PHRASE, MAX_TAGS = 0.60, 0.80, 6, 10
OCR_ROLE = "annotatedText"


def box(poly: Column, width: Column, height: Column) -> Column:
    """struct(x, y, w, h), relative to the picture; unknown sizes count as 1."""
    w, h = F.greatest(F.coalesce(width, F.lit(1)), F.lit(1)), F.greatest(F.coalesce(height, F.lit(1)), F.lit(1))
    axis = lambda k: F.transform(poly, lambda p: F.get(p, F.lit(k)))
    low, high = [F.array_min(axis(k)) for k in (0, 1)], [F.array_max(axis(k)) for k in (0, 1)]
    return F.struct((low[0] / w).alias("x"), (low[1] / h).alias("y"), ((high[0] - low[0]) / w).alias("w"), ((high[1] - low[1]) / h).alias("h"))


def phrases(
    detections: DataFrame, min_confidence: float = MIN_CONFIDENCE, high_confidence: float = HIGH_CONFIDENCE, min_length: int = MIN_PHRASE, max_tags: int = MAX_TAGS
) -> DataFrame:
    """detections (path, page_idx, det_idx, text, score, others) -> those that give a phrase, with phrase, tag and n.

    Words must be plausible; one word alone needs high confidence; short phrases go; of phrases that differ by case the
    first counts. A page stops at the detection that brings the file's count to max_tags, so each page after that adds
    one at most.
    """
    # Behind a generator, words are found once; filters on them are not pushed below it.
    rows = detections.filter(F.col("score") >= min_confidence).select("*", F.inline(F.array(F.struct(good_words(F.col("text")).alias("_words")))))
    rows = rows.withColumn("phrase", F.array_join("_words", " "))
    rows = rows.filter((F.size("_words") > 0) & ((F.size("_words") > 1) | (F.col("score") >= high_confidence)) & (F.length("phrase") >= min_length)).drop("_words")
    order = Window.partitionBy("path", F.lower("phrase")).orderBy("page_idx", "det_idx")
    rows = rows.repartition("path").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    # Pages fill the file's count in turn; each page after the one that fills it adds its first phrase.
    file = Window.partitionBy("path").orderBy("page_idx", "det_idx")
    rows = rows.withColumns({
        "_k": F.row_number().over(Window.partitionBy("path", "page_idx").orderBy("det_idx")),
        "_all": F.row_number().over(file),
        "_page": F.dense_rank().over(Window.partitionBy("path").orderBy("page_idx")),
    }).withColumn("_before", F.col("_all") - F.col("_k"))
    last = F.max(F.when(F.col("_before") < max_tags, F.col("_page"))).over(Window.partitionBy("path"))
    n = F.when(F.col("_before") < max_tags, F.col("_all")).otherwise(F.lit(max_tags) + F.col("_page") - last)
    taken = F.when(F.col("_before") < max_tags, F.col("_all") <= max_tags).otherwise(F.col("_k") == 1)
    kept = rows.withColumns({"n": n, "_taken": taken}).filter("_taken")
    return kept.withColumn("tag", title(F.col("phrase"))).drop("_k", "_all", "_page", "_before", "_taken")


def rounded(box: Column, places: int = 5) -> Column:
    """A box as it is written."""
    return F.struct(*[F.round(box[c], places).alias(c) for c in "xywh"])


def not_ocr(regions: Column) -> Column:
    """Regions without a role that marks OCR."""
    marked = lambda r: F.exists(F.coalesce(r["RRole"], F.array()), lambda x: F.exists(F.coalesce(x["Identifier"], F.array()), lambda i: F.coalesce(F.contains(i, F.lit(OCR_ROLE)), F.lit(False))))
    return F.filter(F.coalesce(regions, F.array()), lambda r: ~marked(r))


def region_cleanup(rows: DataFrame, description: str, kind: str = "BarCode") -> DataFrame:
    """rows (path, regions) -> those with a region of that Type and Description, with keep and action: delete where
    nothing is kept, else rewrite."""
    ours = lambda r: F.coalesce((r["Type"] == kind) & (r["Description"] == description), F.lit(False))
    rows = rows.withColumns({"drop": F.filter("regions", ours), "keep": F.filter("regions", lambda r: ~ours(r))}).filter(F.size("drop") > 0)
    return rows.withColumn("action", F.when(F.size("keep") == 0, "delete").otherwise("rewrite"))
