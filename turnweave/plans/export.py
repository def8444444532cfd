"""All outputs of a diarization: timelines, subtitles and, as the settings say, speakers' tracks whole and without their silence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.operators import export
from turnweave.operators import tracks as speaker_tracks
from turnweave.plans import diarize
from turnweave.settings import Settings
from turnweave.sources.audio import write_wav
from turnweave.sources.scratch import written


def export_all(blocks: DataFrame, result: diarize.Result, sr: int, cfg: Settings, root: str, cue_rows: DataFrame | None = None, injections: DataFrame | None = None) -> DataFrame:
    """Write everything under ``root`` (a URI); rec, speaker, kind ("track" or "compact"), path, n_samples of the audio files.

    ``cfg.export_per_speaker`` writes tracks, ``cfg.export_compact`` the same without silence; a speaker who is never heard has no compact file. Tracks are made
    once, as a table. Recordings without speakers have timelines only.
    """
    export.write_all(result.segments, f"{root.rstrip('/')}/timelines", cue_rows)
    files = None
    if cfg.export_per_speaker or cfg.export_compact:
        made = written(diarize.tracks(blocks, result, sr, cfg, injections), "tracks")
        for kind, wanted in (("track", cfg.export_per_speaker), ("compact", cfg.export_compact)):
            if wanted:
                some = made if kind == "track" else written(speaker_tracks.compact(made, sr), "compact")
                done = write_wav(some, f"{root.rstrip('/')}/{kind}", sr).select("rec", "speaker", F.lit(kind).alias("kind"), "path", "n_samples")
                files = done if files is None else files.unionByName(done)
    none = "rec long, speaker int, kind string, path string, n_samples long"
    return files if files is not None else blocks.sparkSession.createDataFrame([], none)
