"""Votes of labelled windows per 10 ms frame, runs of equal frames, and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.settings import FRAME_SEC, OVERLAP, SILENCE


def vote_runs(windows: DataFrame, frame: float = FRAME_SEC, duration: str | None = None) -> DataFrame:
    """(rec, label, first, past): what each stretch of 10 ms frames goes to that windows (rec, start, end, label) cover; stretches end where a window begins or ends.

    A stretch goes to the speaker of most windows, the least label of equals; to overlap where overlap windows are at least as many. What
    nothing covers is not there: a jump in frame numbers is silence. A window counts once for each stretch that it covers, of which there are few, not for each frame.
    """
    first = F.greatest(F.lit(0), F.floor(F.col("start") / F.lit(frame)))
    last = F.ceil(F.col("end") / F.lit(frame))
    if duration is not None:
        last = F.least(last, F.greatest(F.lit(1), F.ceil(F.col(duration) / F.lit(frame))))
    spans = windows.select("rec", "label", first.alias("_a"), last.alias("_b")).where("_b > _a and (label >= 0 or label = -2)")
    spans = spans.groupBy("rec", "label", "_a", "_b").agg(F.count("*").alias("votes"))
    # the ends of all windows of a recording, numbered; a window covers the stretches between its own two
    ends = spans.select("rec", "label", "_a", "_b", "votes", F.explode(F.array("_a", "_b")).alias("at"))
    ends = ends.withColumn("no", F.dense_rank().over(Window.partitionBy("rec").orderBy("at")))
    placed = ends.groupBy("rec", "label", "_a", "_b", "votes").agg(F.min("no").alias("lo"), F.max("no").alias("hi"))
    covered = placed.select("rec", "label", "votes", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("no"))
    counts = covered.groupBy("rec", "no", "label").agg(F.sum("votes").alias("votes"))
    speaker = F.when(F.col("label") >= 0, F.col("votes"))
    best = counts.groupBy("rec", "no").agg(
        F.max_by("label", F.when(F.col("label") >= 0, F.struct(F.col("votes").alias("v"), (-F.col("label")).alias("l")))).alias("speaker"),
        F.coalesce(F.max(speaker), F.lit(0)).alias("most"),
        F.coalesce(F.max(F.when(F.col("label") == OVERLAP, F.col("votes"))), F.lit(0)).alias("overlap"),
    )
    places = ends.select("rec", "no", F.col("at").alias("first")).distinct()
    places = places.withColumn("past", F.lead("first").over(Window.partitionBy("rec").orderBy("no")))
    label = F.when((F.col("overlap") > 0) & (F.col("overlap") >= F.col("most")), OVERLAP).otherwise(F.col("speaker")).cast("int")
    return best.join(places, ["rec", "no"]).select("rec", label.alias("label"), "first", "past")


def frame_votes(windows: DataFrame, frame: float = FRAME_SEC, duration: str | None = None) -> DataFrame:
    """``vote_runs`` frame by frame: (rec, frame, label)."""
    return vote_runs(windows, frame, duration).select("rec", F.explode(F.sequence("first", F.col("past") - 1)).alias("frame"), "label")


def label_runs(frames: DataFrame) -> DataFrame:
    """Maximal runs of consecutive frames of one label: rec, label, first, past (one after the last)."""
    of_label = Window.partitionBy("rec", "label").orderBy("frame")
    group = F.col("frame") - F.row_number().over(of_label)
    runs = frames.withColumn("_group", group).groupBy("rec", "label", "_group").agg(F.min("frame").alias("first"), (F.max("frame") + 1).alias("past"))
    return runs.drop("_group")


def smooth_short_runs(runs: DataFrame, least: int) -> DataFrame:
    """Speaker runs under ``least`` frames take the label of the longer adjoining speaker run, the left one of equals.

    Labels and lengths are those before smoothing, so neighbouring short runs can trade labels; overlap and silence neither
    change nor spread.
    """
    order = Window.partitionBy("rec").orderBy("first")
    for side, at in (("left", F.lag), ("right", F.lead)):
        joins = at("past").over(order) == F.col("first") if side == "left" else at("first").over(order) == F.col("past")
        speaks = at("label").over(order) >= 0
        length = at("past").over(order) - at("first").over(order)
        runs = runs.withColumn(f"_{side}", F.when(joins & speaks, at("label").over(order))).withColumn(f"_{side}_n", F.when(joins & speaks, length))
    new = F.when(F.coalesce(F.col("_left_n"), F.lit(-1)) >= F.coalesce(F.col("_right_n"), F.lit(-1)), F.col("_left")).otherwise(F.col("_right"))
    short = (F.col("label") >= 0) & (F.col("past") - F.col("first") < least)
    return runs.select("rec", F.when(short, F.coalesce(new, F.col("label"))).otherwise(F.col("label")).alias("label"), "first", "past")


def joined_runs(runs: DataFrame) -> DataFrame:
    """Adjoining runs of one label become one."""
    order = Window.partitionBy("rec").orderBy("first")
    fresh = F.when((F.lag("label").over(order) == F.col("label")) & (F.lag("past").over(order) == F.col("first")), 0).otherwise(1)
    marked = runs.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("rec", "_run", "label").agg(F.min("first").alias("first"), F.max("past").alias("past")).drop("_run")


def seconds(runs: DataFrame, frame: float = FRAME_SEC) -> DataFrame:
    return runs.select("rec", F.col("label").alias("speaker"), (F.col("first") * F.lit(frame)).alias("start"), (F.col("past") * F.lit(frame)).alias("end"))


def run_segments(runs: DataFrame, min_segment: float, frame: float = FRAME_SEC) -> DataFrame:
    """Speaker segments of smoothed runs (``vote_runs``, ``label_runs``): rec, speaker, start, end."""
    least = max(1, round(min_segment / frame))
    return seconds(joined_runs(smooth_short_runs(joined_runs(runs), least)).where("label >= 0"), frame)


def run_overlaps(runs: DataFrame, frame: float = FRAME_SEC) -> DataFrame:
    """Spans of simultaneous speech, before smoothing: rec, start, end."""
    return seconds(joined_runs(runs).where(F.col("label") == OVERLAP), frame).drop("speaker")


def segments(frames: DataFrame, min_segment: float, frame: float = FRAME_SEC) -> DataFrame:
    """``run_segments`` of frames (rec, frame, label)."""
    return run_segments(label_runs(frames), min_segment, frame)


def overlap_spans(frames: DataFrame, frame: float = FRAME_SEC) -> DataFrame:
    """``run_overlaps`` of frames (rec, frame, label)."""
    return run_overlaps(label_runs(frames), frame)


def canonical_ids(segs: DataFrame) -> DataFrame:
    """speaker renumbered from 0 by first appearance; was keeps the old number."""
    first = segs.groupBy("rec", "speaker").agg(F.min("start").alias("_first"))
    order = Window.partitionBy("rec").orderBy("_first", "speaker")
    ids = first.select("rec", F.col("speaker").alias("was"), (F.row_number().over(order) - 1).cast("int").alias("_id"))
    return segs.withColumnRenamed("speaker", "was").join(ids, ["rec", "was"]).withColumnRenamed("_id", "speaker")


def boolean_runs(rows: DataFrame, flag: str) -> DataFrame:
    """Runs of rows (rec, frame, flag) in which the flag holds: rec, first, past."""
    return label_runs(rows.where(flag).select("rec", "frame", F.lit(1).alias("label"))).drop("label")


__all__ = ["OVERLAP", "SILENCE", "boolean_runs", "canonical_ids", "frame_votes", "joined_runs", "label_runs", "overlap_spans", "run_overlaps", "run_segments", "segments", "smooth_short_runs", "vote_runs"]
