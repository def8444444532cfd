import corpus_pipeline
from pyspark.sql import functions as F

from turnweave.llm import decontam


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in left.select("doc_id").collect()}
        left = stage(spark, left, sf_dir).cache()
        assert left.columns == docs.columns, name
        after = [r.doc_id for r in left.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before
        assert name != "near_dedup" or len(after) < len(before)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontam.contaminated(left, bench).count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, left, sf_dir)
    assert {r.copies for r in mixed.collect()} <= {1, 2}
    assert mixed.where(F.col("taken") > 2 * F.col("size")).count() == 0


def test_empty_documents(spark, sf_dir):
    left = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, sf_dir)
        assert left.count() == 0
