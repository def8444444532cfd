"""Sliding windows over spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_windows(spans: DataFrame, win: float, hop: float, least: float, duration: str | None = None) -> DataFrame:
    """Windows of ``win`` seconds every ``hop`` over spans (rec, span_id, start, end): + win_no, start, end, audio_start, audio_end.

    A span no longer than a window is one window; its audio is widened about its centre to ``least``, inside the
    recording (column ``duration``, if named). A longer one has whole windows and, if the next would start over 1 ms before the
    end, a last one that ends with the span, though that may repeat the one before: it then votes twice.
    """
    length = F.col("end") - F.col("start")
    n = F.when(length <= win, 1).otherwise(F.floor((length - win + 1e-6) / hop) + 1)
    tail = (length > win) & (F.col("start") + n * F.lit(hop) < F.col("end") - 1e-3)
    rows = spans.withColumn("_n", n.cast("int")).withColumn("_tail", tail)
    rows = rows.withColumn("win_no", F.explode(F.sequence(F.lit(0), F.col("_n") - F.when(F.col("_tail"), 0).otherwise(1))))
    short = F.col("end") - F.col("start") <= win
    last = F.col("win_no") == F.col("_n")
    start = F.when(short, F.col("start")).when(last, F.greatest(F.col("start"), F.col("end") - win)).otherwise(F.col("start") + F.col("win_no") * F.lit(hop))
    end = F.when(short, F.col("end")).when(last, F.col("end")).otherwise(F.col("start") + F.col("win_no") * F.lit(hop) + win)
    need = F.greatest(F.lit(min(least, win)), length)
    a0 = F.greatest(F.lit(0.0), (F.col("start") + F.col("end")) * 0.5 - need / 2)
    a1 = a0 + need if duration is None else F.least(F.col(duration), a0 + need)
    a0 = F.greatest(F.lit(0.0), a1 - need)
    return rows.select("rec", "span_id", "win_no", start.alias("start"), end.alias("end"), F.when(short, a0).otherwise(start).alias("audio_start"), F.when(short, a1).otherwise(end).alias("audio_end"))


def fine_windows(segments: DataFrame, hop: float, win: float, duration: str | None = None) -> DataFrame:
    """Slices of ``hop`` seconds through segments (rec, span_id, speaker, start, end), each with ``win`` seconds of audio about its centre."""
    steps = F.greatest(F.lit(0), F.ceil((F.col("end") - F.lit(1e-3) - F.col("start")) / hop)).cast("int")
    rows = segments.withColumn("_n", steps).where("_n > 0").withColumn("win_no", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    centre = F.least(F.col("end"), F.col("start") + F.col("win_no") * F.lit(hop) + hop * 0.5)
    a0 = F.greatest(F.lit(0.0), centre - win / 2)
    a1 = a0 + win if duration is None else F.least(F.col(duration), a0 + win)
    k0, k1 = F.greatest(F.col("start"), centre - hop / 2), F.least(F.col("end"), centre + hop / 2)
    out = rows.select("rec", "span_id", "speaker", "win_no", k0.alias("start"), k1.alias("end"), F.greatest(F.lit(0.0), a1 - win).alias("audio_start"), a1.alias("audio_end"))
    return out.where("end > start")
