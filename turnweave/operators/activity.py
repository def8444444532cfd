"""Activity from energy: levels, thresholds, runs and the whole-recording fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.operators.frames import boolean_runs
from turnweave.operators.intervals import merge_gaps


def decibels(mean_square: Column) -> Column:
    return F.log10(F.sqrt(mean_square + 1e-10) + 1e-10) * 20


def levels(samples: DataFrame, frame: float) -> DataFrame:
    """rec, frame, n, rms, db of samples (rec, start, level) in frames of ``frame`` seconds without overlap."""
    out = samples.groupBy("rec", F.floor(F.col("start") / frame).cast("long").alias("frame")).agg(F.count("*").alias("n"), F.avg(F.col("level") * F.col("level")).alias("_ms"))
    return out.select("rec", "frame", "n", F.sqrt("_ms").alias("rms"), decibels(F.col("_ms")).alias("db"))


#: Level in dB under which a frame is digital silence.
SILENT_DB = -99.0


def energy_gate(frames: DataFrame, below_db: float, silent_db: float = SILENT_DB) -> DataFrame:
    """frames with limit and active: db over the recording's 95th percentile (interpolated, exact) less ``below_db``, and over ``silent_db``.

    Without that floor a recording of digital silence, all of it equally loud, would be active throughout.
    """
    top = frames.groupBy("rec").agg((F.percentile("db", F.lit(0.95)) - below_db).alias("limit"))
    return frames.join(top, "rec").withColumn("active", (F.col("db") > F.col("limit")) & (F.col("db") > silent_db))


def active_spans(gated: DataFrame, frame: float, gap: float, least: float) -> DataFrame:
    """Merged runs of active frames: rec, start, end."""
    runs = boolean_runs(gated.withColumn("frame", F.col("frame")), "active")
    spans = runs.select("rec", (F.col("first") * F.lit(frame)).alias("start"), (F.col("past") * F.lit(frame)).alias("end"))
    return merge_gaps(spans, gap, least=least).select("rec", "start", "end")


def with_fallback(spans: DataFrame, recordings: DataFrame, least_total: float = 0.5, least_rms: float = 1e-3) -> DataFrame:
    """spans, but one span over the whole of any recording (rec, duration, rms) that is not silent and has under ``least_total`` seconds of them."""
    total = spans.groupBy("rec").agg(F.sum(F.col("end") - F.col("start")).alias("_total"))
    judged = recordings.join(total, "rec", "left").withColumn("_little", F.coalesce(F.col("_total"), F.lit(0.0)) < least_total)
    whole = judged.where(F.col("_little") & (F.col("rms") > least_rms)).select("rec", F.lit(0.0).alias("start"), F.col("duration").cast("double").alias("end"))
    rest = spans.join(judged.where(F.col("_little") & (F.col("rms") > least_rms)).select("rec"), "rec", "left_anti").select("rec", "start", "end")
    return rest.unionByName(whole)
