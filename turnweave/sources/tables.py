"""The given tables as recordings: spans, voiceprints and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01T00:00:00Z, the start of every recording made of events.
EPOCH = 1704067200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording for each user; an event of value v lasts v minutes. rec, span_id, kind, level, start, end (seconds)."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0) - EPOCH
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), F.col("event_id").alias("span_id"), F.col("event_type").alias("kind"), F.col("value").alias("level"), start.alias("start"), (start + F.col("value") * 60).alias("end"))


def voiceprints(spark: SparkSession, sf_dir: str, per_recording: int = 50) -> DataFrame:
    """Fifty consecutive vectors are a recording's windows of 1.5 s, every 0.75 s. rec, win_no, start, end, embedding, label."""
    n = F.col("vec_id") % per_recording
    return read(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / per_recording).cast("long").alias("rec"), n.alias("win_no"), (n * F.lit(0.75)).alias("start"), (n * F.lit(0.75) + 1.5).alias("end"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label"
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word i of a conversation, counted from 0 over its turns, is said at 0.4 i for 0.35 s. rec, word_no, turn, role, start, end, text."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec"), "turn", "role", F.split("text", " ").alias("w"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum(F.size("w")).over(Window.partitionBy("rec").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = turns.withColumn("before", before).select("rec", "turn", "role", "before", F.posexplode("w").alias("i", "text"))
    no = (F.col("before") + F.col("i")).cast("long")
    return each.select("rec", no.alias("word_no"), "turn", "role", (no * F.lit(0.4)).alias("start"), (no * F.lit(0.4) + 0.35).alias("end"), F.concat(F.lit(" "), "text").alias("text"))
