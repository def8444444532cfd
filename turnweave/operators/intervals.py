"""Intervals per recording: merging, subtraction, dilation, guards. All are window and join plans keyed by the recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, gap: float, keys: Sequence[str] = ("rec",)) -> DataFrame:
    """spans (keys, start, end) with ``island``: numbered from 1 in order of start; a new one begins more than ``gap`` after all ends before."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") - before <= F.lit(gap), 0).otherwise(1)
    return spans.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def merge_gaps(spans: DataFrame, gap: float, keys: Sequence[str] = ("rec",), least: float | None = None) -> DataFrame:
    """Spans no more than ``gap`` apart become one (keys, island, start, end, n); shorter results than ``least`` go, after merging."""
    out = islands(spans, gap, keys).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    return out if least is None else out.where(F.col("end") - F.col("start") >= F.lit(least))


def subtract(spans: DataFrame, holes: DataFrame, id_col: str = "span_id", least: float = 1e-3, bucket: float | None = None) -> DataFrame:
    """What is left of each span (rec, id, start, end) outside all holes (rec, start, end): rec, id, start, end of every piece over ``least``.

    Holes are merged first, so that a span's pieces lie between neighbouring holes. Spans meet holes by recording and time
    bucket, each side copied to the buckets it touches, instead of by a nested loop over all pairs of a recording. Unless ``bucket``
    is given, it is four times the longer of the two mean lengths, so that most spans touch one or two buckets and a bucket holds few.
    """
    if bucket is None:
        mean = lambda df: df.agg(F.avg(F.greatest(F.col("end") - F.col("start"), F.lit(0.0)))).first()[0] or 0.0
        bucket = 4 * max(mean(spans), mean(holes)) or 1.0
    merged = merge_gaps(holes.where("end > start"), 0.0).select("rec", F.col("start").alias("h0"), F.col("end").alias("h1"))
    touch = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.greatest(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))))
    own = spans.select("rec", id_col, "start", "end")
    met = own.withColumn("bucket", touch("start", "end")).join(merged.withColumn("bucket", touch("h0", "h1")), ["rec", "bucket"]).where("h0 < end and h1 > start")
    met = met.select("rec", id_col, "start", "end", "h0", "h1").distinct()
    clear = own.join(met.select("rec", id_col).distinct(), ["rec", id_col], "left_anti")
    order = Window.partitionBy("rec", id_col).orderBy("h0")
    cut = met.withColumn("after", F.coalesce(F.lead("h0").over(order), F.col("end"))).withColumn("first", F.lag("h0").over(order).isNull())
    tail = cut.select("rec", id_col, F.col("h1").alias("start"), F.least("after", "end").alias("end"))
    head = cut.where("first and h0 > start").select("rec", id_col, "start", F.col("h0").alias("end"))
    pieces = clear.unionByName(tail).unionByName(head)
    return pieces.where(F.col("end") - F.col("start") > F.lit(least))


def dilate(spans: DataFrame, by: float, speakers: DataFrame) -> DataFrame:
    """Each span, widened on both sides, for every speaker (rec, speaker) of its recording. Starts may become negative; sinks clamp them."""
    return spans.select("rec", (F.col("start") - by).alias("start"), (F.col("end") + by).alias("end")).join(speakers.select("rec", "speaker").distinct(), "rec").select("rec", "speaker", "start", "end")


def boundary_guards(segments: DataFrame, guard: float, tie: str = "span_id") -> DataFrame:
    """The first and last ``guard`` seconds of a segment (rec, speaker, start, end) whose neighbour, by start, has another speaker."""
    order = Window.partitionBy("rec").orderBy("start", tie)
    near = segments.withColumn("before", F.lag("speaker").over(order)).withColumn("after", F.lead("speaker").over(order))
    heads = near.where("before != speaker").select("rec", "speaker", "start", (F.col("start") + guard).alias("end"))
    tails = near.where("after != speaker").select("rec", "speaker", (F.col("end") - guard).alias("start"), "end")
    return heads.unionByName(tails)


def kill_union(*kills: DataFrame, gap: float = 0.06) -> DataFrame:
    """All kill spans (rec, speaker, start, end) as one merged list for each speaker."""
    whole = kills[0].select("rec", "speaker", "start", "end")
    for k in kills[1:]:
        whole = whole.unionByName(k.select("rec", "speaker", "start", "end"))
    return merge_gaps(whole, gap, ("rec", "speaker"))


def deterministic_kills(segments: DataFrame, overlaps: DataFrame, dilate_sec: float, guard_sec: float, gap: float = 0.06, tie: str = "span_id") -> DataFrame:
    """Widened overlaps for every speaker and guards at turns between speakers, merged. Nothing where both are 0."""
    parts = []
    if dilate_sec > 0:
        parts.append(dilate(overlaps, dilate_sec, segments))
    if guard_sec > 0:
        parts.append(boundary_guards(segments, guard_sec, tie))
    if not parts:
        return kill_union(segments.where(F.lit(False)))
    return kill_union(*parts, gap=gap)
