"""Time and label formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def speaker_label(speaker: Column) -> Column:
    """SPEAKER_1 for 0; UNKNOWN below 0."""
    return F.when(speaker < 0, "UNKNOWN").otherwise(F.concat(F.lit("SPEAKER_"), (speaker + 1).cast("int").cast("string")))


def _clock(t: Column) -> tuple[Column, Column]:
    return F.floor(t / 3600).cast("int"), F.floor((t % 3600) / 60).cast("int")


def hms(t: Column, places: int = 3) -> Column:
    """HH:MM:SS with decimals; seconds are rounded after minutes are split off, so 59.9996 gives 00:00:60.000."""
    h, m = _clock(t)
    return F.format_string(f"%02d:%02d:%0{places + 3}.{places}f", h, m, t % 60)


def subtitle_time(t: Column, mark: str) -> Column:
    """HH:MM:SS and milliseconds, cut off rather than rounded."""
    h, m = _clock(t)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", h, m, F.floor(t % 60).cast("int"), F.floor((t - F.floor(t)) * 1000).cast("int"))


def file_size(size: Column) -> Column:
    """B, KB or MB."""
    return F.when(size < 1024, F.format_string("%d B", size.cast("long"))).when(size < 1048576, F.format_string("%.1f KB", size / F.lit(1024.0))).otherwise(F.format_string("%.1f MB", size / F.lit(1048576.0)))
