"""From raw documents to a training mix, in five stages that are each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm import decontam, mixing, near_dedup, pii, quality
from turnweave.llm.common import set_aside, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.kept(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item lies."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data and secrets; n_chars follows the text."""
    new = pii.surrogates(docs)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(new.columns[-1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, target, taken (words) and copies (times taken) in place of columns so named.

    A document is known by its doc_id, text and source; near-dedup leaves one row of each with words.
    """
    plan = mixing.mix(docs).where("taken > 0").groupBy(F.col("key").alias("_mix_key"), F.col("source").alias("_mix_source"))
    plan = plan.agg(F.first("size").alias("size"), F.first("target").alias("target"), F.max("taken").alias("taken"))
    same = (mixing.shuffle_key(F.col("doc_id").cast("long"), F.col("text")) == F.col("_mix_key")) & F.col("source").eqNullSafe(F.col("_mix_source"))
    kept, back = set_aside(docs.drop("size", "target", "taken", "copies"), "doc_id", "text", "source")
    joined = kept.join(plan, same).drop("_mix_key", "_mix_source")
    return back(joined.withColumn("copies", (F.col("taken") / F.col("size")).cast("int")))


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("pii", replace_private),
    ("mix", mix_sources),
]

#: Trained, hashed and aligned stages are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
