"""Noise reduction of whole recordings, by the first step of a ladder that works for each of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.operators import models, signal
from turnweave.operators.spectral import spectral_gate
from turnweave.operators.tiles import chunks, crossfaded
from turnweave.settings import Settings
from turnweave.sources.scratch import written

#: The step that needs no back end and ends every ladder.
BUILT_IN = "spectral"
PARTS = "rec long, channel int, chunk long, start_sample long, total long, samples array<float>, error string"


def ladder(name: str, strict: bool = False) -> list[str]:
    """Steps in order: ``auto`` stands for all registered denoise back ends; the built-in gate follows unless strict."""
    if name == "none":
        return []
    steps = list(models.REGISTRY["denoise"]) if name == "auto" else [name]
    return steps[:1] or [BUILT_IN] if strict else [*dict.fromkeys([*steps, BUILT_IN])]


def tried(blocks: DataFrame, backend: models.Backend, sr: int, chunk_sec: float) -> DataFrame:
    """Chunks of blocks as a back end gives them back, as a table with the error of those where it fails.

    ``backend.load()`` runs once in a worker and gives f(signal, rate) for one channel of a chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, broken = None, None
        try:
            f = backend.load()
        except Exception as e:  # a worker without the model fails its chunks, not the job
            broken = e
        for b in batches:
            for r in b.itertuples():
                x, error = np.zeros(0, np.float32), None
                try:
                    if broken is not None:
                        raise broken
                    x = np.asarray(f(np.asarray(r.samples, dtype=np.float32), sr), dtype=np.float32)
                except Exception as e:
                    error = f"{backend.name}: {e or type(e).__name__}"
                yield pd.DataFrame({"rec": [r.rec], "channel": [r.channel], "chunk": [r.chunk], "start_sample": [r.start_sample], "total": [r.total], "samples": [x], "error": [error]})

    parts = chunks(blocks, sr, chunk_sec).select("rec", "channel", "chunk", "start_sample", "total", "samples")
    return written(parts.mapInPandas(run, PARTS), "denoised")


def denoised(blocks: DataFrame, sr: int, cfg: Settings, size: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(blocks, steps): the recordings with less noise and without rumble, in blocks of ``size``, and rec, step, cause: what was done to each and why not an earlier step.

    A recording goes through the first step of the ladder that works for all its chunks; which one that is, is decided as it runs, for each
    recording alone. With ``cfg.denoise_strict`` the first step is the only one and its failure is an error. Without ``cfg.denoise``, or for back end "none", blocks stay as they are.
    """
    recs = blocks.select("rec").distinct()
    names = ladder(cfg.denoise_backend, cfg.denoise_strict) if cfg.denoise else []
    if not names:
        return blocks.select("rec", "channel", "block_no", "start_sample", "samples"), recs.select("rec", F.lit("none").alias("step"), F.lit(None).cast("string").alias("cause"))
    left = written(recs.withColumn("cause", F.lit(None).cast("string")), "left")
    done, steps = [], []
    for name in names:
        mine = blocks.join(left.select("rec"), "rec", "left_semi")
        if name == BUILT_IN:
            done.append(spectral_gate(mine, cfg.denoise_strength, size))
            steps.append(left.select("rec", F.lit(name).alias("step"), "cause"))
            break
        backend = models.REGISTRY["denoise"].get(name)
        if backend is None or not backend.available():
            failed = left.select("rec", F.lit(f"{name}: not available").alias("new"))
        else:
            parts = tried(mine, backend, sr, cfg.denoise_chunk_sec)
            failed = written(parts.where("error is not null").groupBy("rec").agg(F.min("error").alias("new")), "failed")
            done.append(crossfaded(parts.join(failed, "rec", "left_anti"), sr, size))
            steps.append(left.join(failed, "rec", "left_anti").select("rec", F.lit(name).alias("step"), "cause"))
        if cfg.denoise_strict and (first := failed.first()) is not None:
            raise RuntimeError(f"recording {first.rec}: {first.new}")
        left = written(left.join(failed, "rec").select("rec", F.concat_ws("; ", "cause", "new").alias("cause")), "left")
        if left.isEmpty():
            break
    out, told = done[0], steps[0]
    for more, step in zip(done[1:], steps[1:], strict=True):
        out, told = out.unionByName(more), told.unionByName(step)
    out = written(out, "clean")
    return (signal.filter_blocks(out, signal.high_pass(sr, cfg.highpass_hz)) if cfg.highpass_hz > 0 else out), told
