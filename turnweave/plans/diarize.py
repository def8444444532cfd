"""Who spoke when, from blocks of samples to segments, voiceprints and kill spans: for all recordings at once.

Each step is written as a table that the next ones read. A step names its input several times, so in one lazy plan the
tree would grow by a factor with every step, and no part of it would be kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.operators import activity, clustering, denoise, frames, gate, intervals, models, signal, speakers, windows
from turnweave.operators import tracks as speaker_tracks
from turnweave.operators.tiles import chunks
from turnweave.settings import TARGET_SR, Settings
from turnweave.sources.scratch import written

#: Frames of 30 ms every 10 ms at 16 kHz.
FRAME, HOP = 480, 160


@dataclass(frozen=True)
class Result:
    segments: DataFrame
    overlap_spans: DataFrame
    centroids: DataFrame
    windows: DataFrame
    kills: DataFrame


def heard_by(blocks: DataFrame, backend: models.Backend, cfg: Settings) -> DataFrame:
    """Merged spans of speech (rec, start, end) as an activity back end finds them in mono blocks at 16 kHz; a recording in which it fails in any chunk has none, or, with ``cfg.vad_strict``, is an error.

    ``backend.load()`` gives f(signal), a list of (start, end) in seconds; it sees chunks of five minutes that share 0.3 s.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = backend.load()
        for b in batches:
            for r in b.itertuples():
                found, error = [], None
                try:
                    found = f(np.asarray(r.samples, dtype=np.float32))
                except Exception as e:
                    error = f"{backend.name}: {e or type(e).__name__}"
                at = r.start_sample / TARGET_SR
                rows = [(r.rec, at + s, at + e, None) for s, e in found] if error is None else [(r.rec, None, None, error)]
                yield pd.DataFrame(rows, columns=["rec", "start", "end", "error"])

    raw = written(chunks(blocks, TARGET_SR, 300.0).select("rec", "start_sample", "samples").mapInPandas(run, "rec long, start double, end double, error string"), "heard")
    failed = raw.where("error is not null").select("rec", "error")
    if cfg.vad_strict and (first := failed.first()) is not None:
        raise RuntimeError(f"recording {first.rec}: {first.error}")
    spans = raw.where("error is null and end > start").join(failed.select("rec").distinct(), "rec", "left_anti")
    return intervals.merge_gaps(spans, cfg.vad_min_silence_sec, least=cfg.vad_min_speech_sec).select("rec", "start", "end")


def speech(blocks: DataFrame, cfg: Settings) -> DataFrame:
    """Spans of activity (rec, start, end) of mono blocks at 16 kHz.

    ``cfg.vad_backend`` names an activity back end, or "auto" the first that is registered and there. Recordings in which it fails or finds under half a second, and all
    without one or for "energy", go by their levels; those in which that too finds next to nothing, but that are not silent, are speech as a whole.
    """
    levels = written(signal.frame_levels(blocks, FRAME, HOP), "levels")
    gated = activity.energy_gate(levels, cfg.energy_vad_threshold_db)
    found = activity.active_spans(gated, HOP / TARGET_SR, cfg.vad_min_silence_sec, cfg.vad_min_speech_sec)
    names = list(models.REGISTRY["activity"]) if cfg.vad_backend == "auto" else [cfg.vad_backend] * (cfg.vad_backend != "energy")
    backend = next((b for n in names if (b := models.REGISTRY["activity"].get(n)) is not None and b.available()), None)
    if backend is None and cfg.vad_strict and names:
        raise RuntimeError(f"no activity back end of {', '.join(names)} is available")
    if backend is not None:
        own = written(heard_by(blocks, backend, cfg), "heard")
        enough = own.groupBy("rec").agg(F.sum(F.col("end") - F.col("start")).alias("s")).where("s >= 0.5").select("rec")
        own = own.join(enough, "rec", "left_semi")
        found = own if cfg.vad_strict else own.unionByName(found.join(enough, "rec", "left_anti"))
    squares = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    whole = blocks.groupBy("rec").agg(F.sum(F.size("samples")).alias("n"), F.sum(squares).alias("s"))
    recs = whole.select("rec", (F.col("n") / TARGET_SR).alias("duration"), F.sqrt(F.col("s") / F.greatest("n", F.lit(1))).alias("rms"))
    return activity.with_fallback(found, recs)


def cut(blocks: DataFrame, wins: DataFrame, keys: tuple[str, ...] = ("rec", "win_no"), sr: int = TARGET_SR) -> DataFrame:
    """windows with their samples, from audio_start to audio_end: joined by the blocks they touch, pieces put together in order."""
    size = blocks.agg(F.max(F.size("samples"))).first()[0] or 1
    a, b = F.rint(F.col("audio_start") * sr).cast("long"), F.rint(F.col("audio_end") * sr).cast("long")
    dealt = wins.withColumn("_a", a).withColumn("_b", b).where("_b > _a")
    dealt = dealt.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor((F.col("_b") - 1) / size))))
    joined = dealt.join(blocks.select("rec", "block_no", "start_sample", "samples"), ["rec", "block_no"])
    lo = F.greatest(F.lit(0), F.col("_a") - F.col("start_sample"))
    hi = F.least(F.size("samples"), F.col("_b") - F.col("start_sample"))
    pieces = joined.where(hi > lo).select(*keys, "block_no", F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    whole = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block_no", "piece"))).alias("v"))
    return wins.join(whole.select(*keys, F.flatten(F.transform("v", lambda v: v["piece"])).alias("samples")), list(keys))


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("win_no", F.row_number().over(Window.partitionBy("rec").orderBy("start", "end", "span_id", "win_no")).cast("long"))


def prepared(blocks: DataFrame, sr: int | str, cfg: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean, analysis, steps) of recordings in blocks: noise reduced as far as ``cfg`` says, its mono copy at 16 kHz, and what was done to each.

    ``sr`` is the rate of all recordings, or the column that holds each one's; there are few different rates, and each is a plan of its own.

    ``diarize`` takes the analysis copy, ``tracks`` the clean blocks.
    """
    if isinstance(sr, str):
        parts = [prepared(blocks.where(F.col(sr) == r[0]), r[0], cfg) for r in sorted(blocks.select(sr).distinct().collect())]
        if parts:
            return tuple(reduce(DataFrame.unionByName, same) for same in zip(*parts, strict=True))
        sr = TARGET_SR
    clean, steps = denoise.denoised(blocks, sr, cfg)
    clean = written(clean, "clean")
    return clean, written(signal.analysis_copy(clean, sr), "analysis"), steps


def diarize(blocks: DataFrame, cfg: Settings) -> Result:
    """Segments by speaker of mono blocks (rec, channel 0, block_no, start_sample, samples) at 16 kHz (``signal.analysis_copy``); blocks are best a table."""
    duration = written(blocks.groupBy("rec").agg((F.sum(F.size("samples")) / TARGET_SR).alias("duration")), "durations")
    spans = written(speech(blocks, cfg).withColumn("span_id", F.row_number().over(Window.partitionBy("rec").orderBy("start"))), "speech")
    wins = windows.sliding_windows(spans.join(duration, "rec"), cfg.window_sec, cfg.hop_sec, cfg.min_window_sec, "duration")
    wins = written(numbered(wins), "windows")
    backend = models.resolve("embedding", cfg.embedding_backend, "mfcc")
    prints = written(wins.join(models.embed(cut(blocks, wins), backend), ["rec", "win_no"]), "prints")
    labelled = written(clustering.cluster_windows(prints, cfg.num_speakers, cfg.min_speakers, cfg.max_speakers, cfg.remove_overlap, cfg.overlap_margin), "labelled")
    voted = written(frames.vote_runs(labelled), "votes")
    segs = written(frames.canonical_ids(frames.run_segments(voted, cfg.min_segment_sec)), "segments")
    over = written(frames.run_overlaps(voted), "overlaps")
    ids = segs.select("rec", F.col("was").alias("label"), "speaker").distinct()
    cents = written(speakers.centroids(labelled.join(ids, ["rec", "label"]).withColumn("label", F.col("speaker"))), "centroids")
    rows = written(segs.withColumn("span_id", F.row_number().over(Window.partitionBy("rec").orderBy("start"))), "spans")
    return Result(segs.select("rec", "speaker", "start", "end"), over, cents, labelled, kills(blocks, rows, over, cents, duration, backend, cfg))


def turn_centroids(blocks: DataFrame, segs: DataFrame, cfg: Settings) -> DataFrame:
    """Centroids (rec, speaker, embedding, n) of another engine's segments (rec, speaker, start, end): windows over them, as over speech, and their mean voiceprints.

    A speaker without any usable window has the zero vector, of as many numbers as the others, and n 0.
    """
    duration = blocks.groupBy("rec").agg((F.sum(F.size("samples")) / TARGET_SR).alias("duration"))
    spans = segs.withColumn("span_id", F.row_number().over(Window.partitionBy("rec").orderBy("start", "end", "speaker")))
    wins = written(numbered(windows.sliding_windows(spans.join(duration, "rec"), cfg.window_sec, cfg.hop_sec, cfg.min_window_sec, "duration")), "windows")
    backend = models.resolve("embedding", cfg.embedding_backend, "mfcc")
    own = wins.join(spans.select("rec", "span_id", F.col("speaker").alias("label")), ["rec", "span_id"])
    known = written(speakers.centroids(own.join(models.embed(cut(blocks, wins), backend), ["rec", "win_no"])), "centroids")
    size = known.agg(F.max(F.size("embedding"))).first()[0] or 0
    none = segs.select("rec", F.col("speaker").cast("int").alias("speaker")).distinct().join(known, ["rec", "speaker"], "left_anti")
    return known.unionByName(none.select("rec", "speaker", F.array_repeat(F.lit(0.0), size).alias("embedding"), F.lit(0).cast("long").alias("n")))


def kills(blocks: DataFrame, segs: DataFrame, over: DataFrame, cents: DataFrame, duration: DataFrame, backend: models.Backend, cfg: Settings) -> DataFrame:
    """Spans to silence in each speaker's track; none where the gate is off."""
    if not cfg.crosstalk_gate:
        return intervals.kill_union(segs.where(F.lit(False)))
    fine = written(numbered(windows.fine_windows(segs.join(duration, "rec"), cfg.crosstalk_hop, max(cfg.crosstalk_win, 0.9), "duration")), "slices")
    loud = F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.size("samples")) >= cfg.crosstalk_min_rms
    prints = written(fine.join(models.embed(cut(blocks, fine).where(loud), backend), ["rec", "win_no"]), "prints")
    found = written(gate.gate(prints, cents, cfg.crosstalk_keep_margin, cfg.crosstalk_self_floor, cfg.crosstalk_second_factor if cfg.crosstalk_second_speaker else None), "gate")
    gated = gate.gated_spans(found, fine)
    fixed = intervals.deterministic_kills(segs, over, cfg.overlap_dilate_sec, cfg.boundary_guard_sec)
    return written(intervals.kill_union(gated, fixed), "kills")


def tracks(blocks: DataFrame, result: Result, sr: int, cfg: Settings, injections: DataFrame | None = None) -> DataFrame:
    """Each speaker's samples (rec, speaker, channel, block_no, start_sample, samples), as long as the recording: segments less kills, faded, with
    separated speech put in (``injections``, as for ``tracks.injected``), and, unless ``cfg.enhance`` is off, filtered, compressed, brought to the target loudness and limited.

    A track has one gain, measured on the mean of its channels, or towards the ceiling where it is too short or quiet to be measured.
    """
    own = written(result.segments, "segments").withColumn("span_id", F.row_number().over(Window.partitionBy("rec", "speaker").orderBy("start")))
    per = own.select(F.xxhash64("rec", "speaker").alias("rec"), "span_id", "start", "end")
    cuts = result.kills.select(F.xxhash64("rec", "speaker").alias("rec"), "start", "end")
    names = own.select(F.xxhash64("rec", "speaker").alias("_k"), F.col("rec").alias("_rec"), "speaker").distinct()
    kept = intervals.subtract(per, cuts).withColumnRenamed("rec", "_k").join(names, "_k").select(F.col("_rec").alias("rec"), "speaker", "start", "end")
    out = signal.masked(blocks, written(kept, "kept"), sr, max(1, round(cfg.boundary_fade_ms / 1000 * sr)))
    if injections is not None:
        out = speaker_tracks.injected(written(out, "masked"), injections, sr)
    if not cfg.enhance:
        return out
    keyed = written(out.select(F.xxhash64("rec", "speaker").alias("rec"), "channel", "block_no", "start_sample", "samples"), "masked")
    sections = signal.high_pass(sr, cfg.highpass_hz) if cfg.highpass_hz > 0 else []
    sections += [signal.peaking(sr, cfg.presence_hz, cfg.presence_db, 1.0)] if cfg.presence_db else []
    sections += [signal.high_shelf(sr, min(cfg.air_hz, 0.45 * sr), cfg.air_db)] if cfg.air_db else []
    ceiling = 10 ** (cfg.ceiling_db / 20)
    proxy, rate = speaker_tracks.loudness_proxy(keyed, sr)
    lufs = signal.loudness(signal.hop_squares(signal.filter_blocks(proxy, signal.k_weighting(rate)), rate))
    peak = keyed.groupBy("rec").agg(F.max(F.array_max(F.transform("samples", F.abs))).alias("peak"))
    gain = F.coalesce(F.pow(F.lit(10.0), (cfg.target_lufs - F.col("lufs")) / 20), ceiling / (F.col("peak") + 1e-9))
    gains = written(peak.join(lufs, "rec", "left").select("rec", gain.alias("gain")), "gains")
    loud = speaker_tracks.chain(keyed, gains, sr, sections, ceiling, cfg.compressor_threshold_db if cfg.compress else None, cfg.compressor_ratio)
    return loud.withColumnRenamed("rec", "_k").join(names, "_k").select(F.col("_rec").alias("rec"), "speaker", "channel", "block_no", "start_sample", "samples")
