"""Speakers' tracks as blocks (rec, speaker, channel, block_no, start_sample, samples): separated speech put in, silence taken out, and the studio chain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.operators import signal
from turnweave.operators.intervals import merge_gaps
from turnweave.operators.tiles import reblocked, sliced

TRACK = ("rec", "speaker", "channel")
TRACKS = "rec long, speaker int, channel int, block_no long, start_sample long, samples array<float>"
SIZE = 1 << 20


def injected(tracks: DataFrame, injections: DataFrame, sr: int, size: int = SIZE) -> DataFrame:
    """tracks, in blocks of ``size``, with timed signals added: injections (rec, speaker, start, channel, samples), a row for each channel of a signal.

    A signal begins at the sample nearest to ``start`` (from 0 on) and is cut where the track ends. A signal of one channel goes to all of
    the track's, one of more goes channel by channel, or as their mean to a track of one. Signals may overlap; for other tracks nothing happens.
    """
    blocks = reblocked(tracks, size, TRACK)
    has = tracks.groupBy("rec", "speaker").agg(F.max("channel").alias("top"))
    signals = injections.select("rec", "speaker", "start", F.col("channel").alias("of"), "samples")
    signals = signals.join(signals.groupBy("rec", "speaker", "start").agg(F.max("of").alias("most")), ["rec", "speaker", "start"]).join(has, ["rec", "speaker"])
    to = F.when(F.col("most") == 0, F.sequence(F.lit(0), F.col("top"))).when(F.col("top") == 0, F.array(F.lit(0))).otherwise(F.array("of"))
    share = F.when((F.col("top") == 0) & (F.col("most") > 0), 1 / (F.col("most") + 1)).otherwise(F.lit(1.0))
    at = F.greatest(F.lit(0), F.rint(F.col("start") * sr).cast("long"))
    rows = signals.select("rec", "speaker", F.explode(to).alias("channel"), at.alias("start_sample"), "samples", share.alias("share")).where(F.size("samples") > 0)
    last = F.floor((F.col("start_sample") + F.size("samples") - 1) / size)
    rows = rows.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start_sample") / size), last)))
    pieces = sliced(rows, F.col("block_no") * size, (F.col("block_no") + 1) * size, *TRACK, "block_no", "share")
    listed = pieces.groupBy(*TRACK, "block_no").agg(F.sort_array(F.collect_list(F.struct("at", "share", "piece"))).alias("adds"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                x = np.array(r.samples, dtype=np.float32)
                for a in r.adds:
                    i = a["at"] - r.start_sample
                    y = np.asarray(a["piece"], dtype=np.float64)[: max(0, len(x) - i)] * a["share"]
                    x[i : i + len(y)] += y.astype(np.float32)
                out.append(x)
            yield b.assign(samples=out)[[*TRACK, "block_no", "start_sample", "samples"]]

    touched = blocks.join(listed, [*TRACK, "block_no"]).mapInPandas(add, TRACKS)
    return blocks.join(listed.select(*TRACK, "block_no"), [*TRACK, "block_no"], "left_anti").select(touched.columns).unionByName(touched)


def frame_rms(tracks: DataFrame, frame: int) -> DataFrame:
    """rec, speaker, no, rms, total: level of every whole frame of ``frame`` samples of the mean of a track's channels, which may cross blocks."""

    def sums(x: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        at = (start + np.arange(len(x))) // frame
        return np.arange(at[0], at[-1] + 1), np.bincount(at - at[0], weights=np.asarray(x, dtype=np.float64) ** 2)

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.mean(np.stack(pdf.sort_values("channel").samples.to_list()), axis=0, dtype=np.float32)
        no, s = sums(x, int(pdf.start_sample.iloc[0]))
        return pd.DataFrame({"rec": pdf.rec.iloc[0], "speaker": pdf.speaker.iloc[0], "no": no, "s": s})

    some = tracks.where(F.size("samples") > 0)
    parts = some.groupBy("rec", "speaker", "start_sample").applyInPandas(measure, "rec long, speaker int, no long, s double")
    total = some.where("channel = 0").groupBy("rec", "speaker").agg(F.sum(F.size("samples")).cast("long").alias("total"))
    levels = parts.groupBy("rec", "speaker", "no").agg(F.sqrt(F.sum("s") / frame).alias("rms")).join(total, ["rec", "speaker"])
    return levels.where((F.col("no") + 1) * frame <= F.col("total"))


def audible(tracks: DataFrame, sr: int, least_rms: float = 0.004, frame_sec: float = 0.040, pad_sec: float = 0.060, gap_sec: float = 0.120) -> DataFrame:
    """rec, speaker, start, end, in samples: where a track is heard. Runs of loud frames are padded and, where no more than the gap apart, joined.

    A track shorter than a frame is heard as a whole; one without a loud frame has no row.
    """
    frame, pad, gap = max(1, int(frame_sec * sr)), int(pad_sec * sr), int(gap_sec * sr)
    loud = frame_rms(tracks, frame).where(F.col("rms") > least_rms)
    run = F.col("no") - F.row_number().over(Window.partitionBy("rec", "speaker").orderBy("no"))
    runs = loud.withColumn("run", run).groupBy("rec", "speaker", "run").agg(F.min("no").alias("a"), F.max("no").alias("b"), F.first("total").alias("total"))
    spans = runs.select("rec", "speaker", F.greatest(F.lit(0), F.col("a") * frame - pad).alias("start"), F.least("total", (F.col("b") + 1) * frame + pad).alias("end"))
    merged = merge_gaps(spans, gap, ("rec", "speaker")).select("rec", "speaker", "start", "end")
    short = tracks.where("channel = 0").groupBy("rec", "speaker").agg(F.sum(F.size("samples")).cast("long").alias("end")).where((F.col("end") < frame) & (F.col("end") > 0))
    return merged.unionByName(short.select("rec", "speaker", F.lit(0).cast("long").alias("start"), "end"))


def compact(tracks: DataFrame, sr: int, fade_sec: float = 0.005, size: int = SIZE, **options: float) -> DataFrame:
    """Tracks without their silence, in blocks of ``size``: what ``audible`` (and its options) finds, one piece after the other.

    A piece's new place is the sum of the lengths before it. Where two pieces of more than ``fade_sec`` meet, the first falls and the second rises in
    a straight line for as long. Pieces are dealt to the blocks they touch, so neither a piece nor a track is ever in one row.
    """
    fade = max(1, int(fade_sec * sr))
    order = Window.partitionBy("rec", "speaker").orderBy("start")
    length = F.col("end") - F.col("start")
    kept = audible(tracks, sr, **options).withColumn("to", F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rise, fall = (F.coalesce((length > fade) & (beside.over(order) > fade), F.lit(False)) for beside in (F.lag(length), F.lead(length)))
    kept = kept.withColumn("rise", rise).withColumn("fall", fall)
    # head and tail apart, as only they are shaped; a piece too short for that is shaped as a whole
    part = lambda a, b, shaped: F.struct(a.alias("lo"), b.alias("hi"), shaped.alias("shaped"))
    start, end = F.col("start"), F.col("end")
    three = F.array(part(start, start + fade, F.col("rise")), part(start + fade, end - fade, F.lit(False)), part(end - fade, end, F.col("fall")))
    parts = F.when(length >= 2 * fade, three).otherwise(F.array(part(start, end, F.col("rise") | F.col("fall"))))
    kept = kept.withColumn("x", F.explode(parts)).select("rec", "speaker", "start", "end", "to", "rise", "fall", "x.*").where("hi > lo")
    dealt = kept.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    met = reblocked(tracks, size, TRACK).join(dealt, ["rec", "speaker", "block_no"])
    keep = (*TRACK, "start", "end", "to", "rise", "fall", "shaped")
    pieces = sliced(met, F.col("lo"), F.col("hi"), *keep)
    steps = F.lit(float(max(1, fade - 1)))

    def shape(x, i):
        own, left = F.col("at") + i - F.col("start"), F.col("end") - 1 - F.col("at") - i
        up = F.when(F.col("rise") & (own < fade), own / steps).otherwise(F.lit(1.0))
        # a ramp of one sample is 0 on the way up and 1 on the way down
        down = F.when(F.col("fall") & (left < fade), left / steps if fade > 1 else F.lit(1.0)).otherwise(F.lit(1.0))
        return (x * up * down).cast("float")

    shaped = F.when(F.col("shaped"), F.transform("piece", shape)).otherwise(F.col("piece"))
    moved = pieces.select(*TRACK, (F.col("to") + F.col("at") - F.col("start")).alias("start_sample"), shaped.alias("samples"))
    return reblocked(moved, size, TRACK)


def loudness_proxy(blocks: DataFrame, sr: int) -> tuple[DataFrame, int]:
    """Mean of the channels, every n-th sample so that about 16 kHz are left, and the rate then: what loudness is measured on."""
    step = max(1, round(sr / 16_000))

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(samples=[np.asarray(x)[-s % step :: step] for x, s in zip(b.samples, b.start_sample, strict=True)], start_sample=-(-b.start_sample // step))

    one = signal.mono(blocks)
    return (one if step == 1 else one.mapInPandas(thin, signal.BLOCKS)), max(1, round(sr / step))


def chain(blocks: DataFrame, gains: DataFrame, sr: int, sections: list[np.ndarray], ceiling: float, threshold_db: float | None, ratio: float) -> DataFrame:
    """Blocks (rec, channel, ...) filtered, compressed (unless threshold_db is None), made louder by the recording's gain (rec, gain) and limited.

    Filters carry their state along a channel; the compressor takes one gain for all channels of a block, from the loudest of them at each sample.
    """
    filtered = signal.filter_blocks(blocks, sections) if sections else blocks.select("rec", "channel", "block_no", "start_sample", "samples")

    def shape(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.samples.to_list()).astype(np.float64)
        if threshold_db is not None:
            x = signal.compress(x, sr, threshold_db, ratio)
        x = signal.limit(x * float(pdf.gain.iloc[0]), ceiling)
        return pdf.assign(samples=list(x.astype(np.float32)))[["rec", "channel", "block_no", "start_sample", "samples"]]

    return filtered.join(gains, "rec").groupBy("rec", "block_no").applyInPandas(shape, signal.BLOCKS)
