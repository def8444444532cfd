"""Simultaneous speech taken apart: the two voices of an overlap, as signals to put into the tracks of the speakers that they sound like."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.operators import models, signal, speakers
from turnweave.plans.diarize import cut
from turnweave.settings import TARGET_SR, Settings
from turnweave.sources.scratch import written

#: The rate that separation works at; shorter mixtures are not taken apart; a voice is made at most so much louder.
SEPARATION_SR, LEAST_SEC, MOST_GAIN = 8_000, 0.2, 8.0
SOURCES = "rec long, win_no long, chunk long, source int, samples array<float>, voice array<float>"


def overlap_chunks(overlaps: DataFrame, chunk_sec: float) -> DataFrame:
    """rec, chunk, start, end: overlap spans (rec, start, end) in pieces of ``chunk_sec``, a second at least; a rest of up to a millisecond is none."""
    size = max(1.0, float(chunk_sec))
    n = F.ceil((F.col("end") - F.col("start") - 1e-3) / size)
    rows = overlaps.where(n > 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)))))
    begin = F.col("start") + F.col("i") * size
    rows = rows.select("rec", begin.alias("start"), F.least(F.col("end"), begin + size).alias("end"))
    return rows.withColumn("chunk", (F.row_number().over(Window.partitionBy("rec").orderBy("start", "end")) - 1).cast("long"))


def taken_apart(mixtures: DataFrame, backend: models.Backend, sr: int) -> DataFrame:
    """Two rows for each mixture (rec, chunk, samples at ``sr``): the voice at ``sr``, as loud as the mixture, and at 16 kHz for its voiceprint.

    ``backend.load()`` gives f(signal at 8 kHz), an array (samples, 2). Mixtures under ``LEAST_SEC`` have no voices, null in both.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = backend.load()
        for b in batches:
            for r in b.itertuples():
                x = signal.resample(np.asarray(r.samples, dtype=np.float32), sr, SEPARATION_SR) if len(r.samples) >= int(LEAST_SEC * sr) else np.zeros(0, np.float32)
                voices, heard = [None, None], [None, None]
                if len(x) >= int(LEAST_SEC * SEPARATION_SR):
                    level = np.sqrt(np.mean(x.astype(np.float64) ** 2)) + 1e-9
                    for i, s in enumerate(np.asarray(f(x), dtype=np.float32).T[:2]):
                        gain = min(MOST_GAIN, level / (np.sqrt(np.mean(s.astype(np.float64) ** 2)) + 1e-9))
                        voices[i] = signal.resample(s * np.float32(gain), SEPARATION_SR, sr)
                        heard[i] = signal.resample(s, SEPARATION_SR, TARGET_SR)
                        if len(heard[i]) < int(LEAST_SEC * TARGET_SR):
                            voices[i] = heard[i] = None
                yield pd.DataFrame({"rec": r.rec, "win_no": [2 * r.chunk, 2 * r.chunk + 1], "chunk": r.chunk, "source": [0, 1], "samples": heard, "voice": voices})

    return mixtures.select("rec", "chunk", "samples").mapInPandas(run, SOURCES)


def separated(blocks: DataFrame, overlaps: DataFrame, cents: DataFrame, sr: int, cfg: Settings) -> tuple[DataFrame, DataFrame]:
    """(injections, chunks) for recordings (blocks at ``sr``) with two speakers or more: signals as ``tracks.injected`` takes them, and what came of every chunk.

    chunks: rec, chunk, start, end, reason, lead. Both voices of an ``ok`` chunk go to the speakers they are nearest to; other chunks (``same``, ``low``,
    ``short``, as ``speakers.route_sources`` says) stay silent. ``cfg.overlap_mode`` "delete" takes nothing apart.
    """
    some = cents.groupBy("rec").agg(F.count("*").alias("n")).where("n > 1").select("rec")
    spans = overlaps.join(some, "rec", "left_semi").where(F.lit(cfg.overlap_mode == "separate"))
    wins = written(overlap_chunks(spans, cfg.sep_chunk_sec), "chunks")
    mixtures = cut(signal.mono(blocks), wins.withColumn("audio_start", F.greatest(F.lit(0.0), "start")).withColumn("audio_end", F.col("end")), ("rec", "chunk"), sr)
    sources = written(taken_apart(mixtures, models.resolve("separation", cfg.separation_backend), sr), "sources") if cfg.overlap_mode == "separate" else sources_of_none(blocks)
    prints = models.embed(sources.where("samples is not null"), models.resolve("embedding", cfg.embedding_backend, "mfcc"))
    told = sources.select("rec", "win_no", "chunk", "source").join(prints, ["rec", "win_no"], "left").drop("win_no")
    routed = written(speakers.route_sources(told, cents, cfg.overlap_assign_margin), "routed")
    ok = routed.where("reason = 'ok'").join(sources.select("rec", "chunk", "source", "voice"), ["rec", "chunk", "source"]).join(wins.select("rec", "chunk", "start"), ["rec", "chunk"])
    injections = ok.select("rec", F.col("best").cast("int").alias("speaker"), "start", F.lit(0).alias("channel"), F.col("voice").alias("samples"))
    judged = routed.groupBy("rec", "chunk").agg(F.first("reason").alias("reason"), F.min("lead").alias("lead"))
    return injections, wins.join(judged, ["rec", "chunk"], "left").select("rec", "chunk", "start", "end", F.coalesce("reason", F.lit("short")).alias("reason"), "lead")


def sources_of_none(blocks: DataFrame) -> DataFrame:
    return blocks.sparkSession.createDataFrame([], SOURCES)
