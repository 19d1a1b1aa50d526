"""The pipeline over the smallest tables."""

import corpus_pipeline
from albumspark.llm import registry
from albumspark.llm.common import scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        at = scratch(spark, name)
        out.write.parquet(at)
        docs = spark.read.parquet(at)
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] < counts[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.filter("piece = 0").count() == counts[4]


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
