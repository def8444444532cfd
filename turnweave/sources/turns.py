"""Turns from another engine: RTTM files or tables, with simultaneous speech cut out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.operators.frames import canonical_ids
from turnweave.operators.intervals import merge_gaps, subtract


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """uri, start, end, name of the SPEAKER lines."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("value like 'SPEAKER %'").select(part.alias("p"))
    start = F.col("p")[3].cast("double")
    return rows.select(F.col("p")[1].alias("uri"), start.alias("start"), (start + F.col("p")[4].cast("double")).alias("end"), F.col("p")[7].alias("name"))


def simultaneous(turns: DataFrame) -> DataFrame:
    """Where two turns or more of a recording run at once: rec, start, end. A running count of starts less ends, by time."""
    marks = turns.select("rec", F.col("start").alias("t"), F.lit(1).alias("d")).unionByName(turns.select("rec", F.col("end").alias("t"), F.lit(-1).alias("d")))
    marks = marks.groupBy("rec", "t").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("rec").orderBy("t")
    open_ = marks.withColumn("n", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("t").over(order))
    return merge_gaps(open_.where("n > 1 and until > t").select("rec", F.col("t").alias("start"), F.col("until").alias("end")), 0.0).select("rec", "start", "end")


def ingest(turns: DataFrame, least: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(segments, overlap spans) of turns (rec, name, start, end): overlaps cut out, pieces of 1 ms or less dropped, speakers numbered by first appearance."""
    named = turns.where(F.col("end") - F.col("start") > least)
    ids = named.select("rec", "name").distinct().withColumn("speaker", F.row_number().over(Window.partitionBy("rec").orderBy("name")) - 1)
    rows = named.join(ids, ["rec", "name"]).withColumn("span_id", F.row_number().over(Window.partitionBy("rec").orderBy("start", "end", "name")))
    over = simultaneous(rows)
    pieces = subtract(rows, over).join(rows.select("rec", "span_id", "name", "speaker"), ["rec", "span_id"])
    return canonical_ids(pieces).select("rec", "name", "speaker", "start", "end"), over


__all__ = ["ingest", "read_rttm", "simultaneous"]
