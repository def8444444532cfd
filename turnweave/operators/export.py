"""Timelines, RTTM, CSV and subtitles as rows of text, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.text import hms, speaker_label, subtitle_time


def speaker_time(segments: DataFrame) -> DataFrame:
    """Seconds of each speaker (rec, speaker, seconds, segments); what was silenced inside segments still counts."""
    return segments.groupBy("rec", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"), F.count("*").alias("segments"))


def speaker_share(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """speaker_time with percent of the recording (rec, duration); 0 for an empty one."""
    return speaker_time(segments).join(durations, "rec").withColumn("percent", F.when(F.col("duration") != 0, 100 * F.col("seconds") / F.col("duration")).otherwise(0.0))


def csv_rows(segments: DataFrame) -> DataFrame:
    three = lambda c: F.format_string("%.3f", c)
    return segments.select("rec", three(F.col("start")).alias("start_sec"), three(F.col("end")).alias("end_sec"), three(F.col("end") - F.col("start")).alias("duration_sec"), speaker_label(F.col("speaker")).alias("speaker"))


def rttm_lines(segments: DataFrame) -> DataFrame:
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col("rec").cast("string"), F.col("start"), F.col("end") - F.col("start"), speaker_label(F.col("speaker")))
    return segments.select("rec", "start", line.alias("line"))


def timeline_lines(segments: DataFrame) -> DataFrame:
    """rec, place, line: a row for each segment in order, then totals for each speaker."""
    order = Window.partitionBy("rec").orderBy("start", "end", "speaker")
    row = F.format_string("%s --> %s  [%7.2fs]  %s", hms(F.col("start")), hms(F.col("end")), F.col("end") - F.col("start"), speaker_label(F.col("speaker")))
    rows = segments.select("rec", F.lit(0).alias("part"), F.row_number().over(order).alias("place"), row.alias("line"))
    total = F.format_string("%s: %.2fs", speaker_label(F.col("speaker")), F.col("seconds"))
    return rows.unionByName(speaker_time(segments).select("rec", F.lit(1).alias("part"), F.col("speaker").cast("int").alias("place"), total.alias("line")))


def srt_blocks(cues: DataFrame) -> DataFrame:
    """rec, number, block."""
    number = F.row_number().over(Window.partitionBy("rec").orderBy("cue_no"))
    text = F.format_string("%d\n%s --> %s\n[%s] %s\n", F.col("number"), subtitle_time(F.col("start"), ","), subtitle_time(F.col("end"), ","), speaker_label(F.col("speaker")), F.col("text"))
    return cues.withColumn("number", number).select("rec", "number", text.alias("block"))


def vtt_blocks(cues: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("rec").orderBy("cue_no"))
    text = F.format_string("%s --> %s\n<v %s>%s\n", subtitle_time(F.col("start"), "."), subtitle_time(F.col("end"), "."), speaker_label(F.col("speaker")), F.col("text"))
    return cues.withColumn("number", number).select("rec", "number", text.alias("block"))


def transcript_lines(turns: DataFrame) -> DataFrame:
    line = F.format_string("[%s] %s: %s", hms(F.col("start"), 2), speaker_label(F.col("speaker")), F.col("text"))
    return turns.select("rec", F.col("turn_no").alias("number"), line.alias("line"))


def speaker_texts(words: DataFrame) -> DataFrame:
    """All that each known speaker says, in order: rec, speaker, text."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"])
    return words.where("speaker >= 0").groupBy("rec", "speaker").agg(F.trim(F.array_join(texts, "")).alias("text"))


def write_all(segments: DataFrame, path: str, cue_rows: DataFrame | None = None) -> None:
    """CSV, RTTM and timeline for every recording, subtitles where there are cues; one folder per kind, partitioned by recording."""
    csv_rows(segments).write.partitionBy("rec").option("header", True).csv(f"{path}/csv")
    in_order = lambda df, *by: df.repartition("rec").sortWithinPartitions("rec", *by)
    in_order(rttm_lines(segments), "start").select("rec", "line").write.partitionBy("rec").text(f"{path}/rttm")
    in_order(timeline_lines(segments), "part", "place").select("rec", "line").write.partitionBy("rec").text(f"{path}/timeline")
    if cue_rows is not None:
        in_order(srt_blocks(cue_rows), "number").select("rec", "block").write.partitionBy("rec").text(f"{path}/srt")
        in_order(vtt_blocks(cue_rows), "number").select("rec", "block").write.partitionBy("rec").text(f"{path}/vtt")
