"""The spectral gate over blocks: a short-time transform whose frames cross them, an exact noise floor, and the way back.

Recordings are cut into tiles with margins of one frame, so that a tile makes every frame that touches it and needs no neighbour. The
floor of a bin is the 10th percentile of its magnitudes over all frames of the recording. It is found in two counts: of magnitudes by
their leading bits, which tells in which class the percentile lies, then of the values of that class alone. So a few hundredths of the
magnitudes are shuffled, as counts, and none is held in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.operators.tiles import BLOCKS, lengths, recut
from turnweave.sources.scratch import written

SIZE, HOP = 1024, 256
#: Bits of a magnitude that its class leaves out: a class is a sixteenth of an octave.
CLASS_BITS = 48
PERCENT = 10
_HANN = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(SIZE) / SIZE)


def spectra(x: np.ndarray, at: int, first: int, last: int) -> np.ndarray:
    """Transforms of frames first..last, frame k centred on sample k * HOP, of samples x that begin at sample ``at``; zeros beyond them."""
    begin, n = first * HOP - SIZE // 2, (last - first) * HOP + SIZE
    padded = np.zeros(n)
    lo, hi = max(begin, at), min(begin + n, at + len(x))
    if hi > lo:
        padded[lo - begin : hi - begin] = x[lo - at : hi - at]
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, SIZE)[::HOP] * _HANN, axis=1) / _HANN.sum()


def _own_frames(tile: int, size: int, total: int) -> tuple[int, int]:
    """Frames centred in a tile; the last tile has those past the end too."""
    last = -(-total // HOP)
    return tile * size // HOP, last if (tile + 1) * size >= total else min(last, (tile + 1) * size // HOP - 1)


def _magnitudes(r, size: int) -> np.ndarray:
    return np.abs(spectra(np.asarray(r.samples, dtype=np.float64), r.start_sample, *_own_frames(r.tile, size, r.total)))


def tiles_of(blocks: DataFrame, size: int) -> DataFrame:
    """Tiles with margins of a frame and the recording's length (rec, channel, tile, start_sample, samples, total), as a table."""
    tiles = written(recut(blocks, size, SIZE, SIZE), "tiles")
    return tiles.join(tiles.select("rec", "channel", "tile").join(lengths(blocks), ["rec", "channel"]), ["rec", "channel", "tile"])


def noise_floors(tiles: DataFrame, size: int, percent: float = PERCENT) -> DataFrame:
    """rec, channel, floors: the exact percentile, between neighbours in proportion, of each bin's magnitudes; for recordings of a frame or more."""
    long = tiles.where(F.col("total") >= SIZE)

    def classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                kind = _magnitudes(r, size).view(np.int64) >> CLASS_BITS
                low = int(kind.min())
                span = int(kind.max()) - low + 1
                n = np.bincount((np.arange(kind.shape[1]) * span + (kind - low)).ravel(), minlength=kind.shape[1] * span)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"rec": r.rec, "channel": r.channel, "bin": at // span, "kind": at % span + low, "n": n[at]})

    counts = long.select("rec", "channel", "tile", "start_sample", "samples", "total").mapInPandas(classes, "rec long, channel int, bin int, kind long, n long")
    counts = written(counts.groupBy("rec", "channel", "bin", "kind").agg(F.sum("n").alias("n")), "classes")
    rank = (F.sum("n").over(Window.partitionBy("rec", "channel", "bin")) - 1) * F.lit(percent / 100)
    before = F.sum("n").over(Window.partitionBy("rec", "channel", "bin").orderBy("kind").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = counts.withColumn("rank", rank).withColumn("before", before)
    wanted = placed.where("before + n > floor(rank) and before <= floor(rank) + 1").select("rec", "channel", "bin", "kind", "before", "rank")
    wanted = written(wanted, "wanted")
    picks = wanted.groupBy("rec", "channel").agg(F.collect_list(F.struct("bin", "kind")).alias("picks"))
    # lists of a few kilobytes go to the tiles by their full key, so a long recording is many tasks' work
    picks = long.select("rec", "channel", "tile").join(picks, ["rec", "channel"])

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                mag = _magnitudes(r, size)
                kind = mag.view(np.int64) >> CLASS_BITS
                wanted_kinds = np.full((2, mag.shape[1]), -1)  # two ranks are in two classes at most
                for p in r.picks:
                    wanted_kinds[int(wanted_kinds[0, p["bin"]] >= 0), p["bin"]] = p["kind"]
                frame, b_ = np.nonzero((kind == wanted_kinds[0]) | (kind == wanted_kinds[1]))
                yield pd.DataFrame({"rec": r.rec, "channel": r.channel, "bin": b_, "kind": kind[frame, b_], "value": mag[frame, b_], "n": 1})

    found = long.join(picks, ["rec", "channel", "tile"]).select("rec", "channel", "tile", "start_sample", "samples", "total", "picks")
    found = found.mapInPandas(values, "rec long, channel int, bin int, kind long, value double, n long").groupBy("rec", "channel", "bin", "kind", "value").agg(F.sum("n").alias("n"))
    found = found.join(wanted, ["rec", "channel", "bin", "kind"])
    up_to = F.col("before") + F.sum("n").over(Window.partitionBy("rec", "channel", "bin", "kind").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("up_to", up_to)
    # the values at the two ranks around the percentile; the upper one is missing only where the rank is the last
    of = lambda k: F.min(F.when(F.col("up_to") > F.floor("rank") + k, F.col("value")))
    ends = found.groupBy("rec", "channel", "bin").agg(of(0).alias("low"), of(1).alias("high"), F.max("rank").alias("rank"))
    floor = F.col("low") + (F.coalesce("high", "low") - F.col("low")) * (F.col("rank") - F.floor("rank"))
    listed = ends.groupBy("rec", "channel").agg(F.array_sort(F.collect_list(F.struct("bin", floor.alias("floor")))).alias("v"))
    return listed.select("rec", "channel", F.transform("v", lambda v: v["floor"]).alias("floors"))


def gated(tiles: DataFrame, floors: DataFrame, size: int, strength: float) -> DataFrame:
    """Blocks of ``size``: every bin of every frame times clip((magnitude - 1.5 strength floor) / magnitude, 0, 1), frames added up; short recordings as they are."""
    strength = min(1.0, max(0.0, strength))
    at_tiles = tiles.select("rec", "channel", "tile").join(floors, ["rec", "channel"])
    rows = tiles.join(at_tiles, ["rec", "channel", "tile"], "left").select("rec", "channel", "tile", "start_sample", "samples", "total", "floors")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                x, lo, hi = np.asarray(r.samples, dtype=np.float64), r.tile * size, min(r.total, (r.tile + 1) * size)
                y = x[lo - r.start_sample : hi - r.start_sample]
                if r.floors is not None:
                    first, last = max(0, -(-(lo - SIZE // 2) // HOP)), min(-(-r.total // HOP), (hi - 1 + SIZE // 2) // HOP)
                    spec = spectra(x, r.start_sample, first, last)
                    mag = np.abs(spec)
                    gain = np.clip((mag - strength * 1.5 * np.asarray(r.floors)) / (mag + 1e-9), 0.0, 1.0)
                    back = np.fft.irfft(spec * gain, n=SIZE, axis=1) * _HANN * _HANN.sum()
                    out, weight = np.zeros((2, (last - first) * HOP + SIZE))
                    for i in range(len(back)):
                        out[i * HOP : i * HOP + SIZE] += back[i]
                        weight[i * HOP : i * HOP + SIZE] += _HANN * _HANN
                    begin = first * HOP - SIZE // 2
                    y = (out / np.where(weight > 1e-10, weight, 1.0))[lo - begin : hi - begin]
                yield pd.DataFrame({"rec": [r.rec], "channel": [r.channel], "block_no": [r.tile], "start_sample": [lo], "samples": [y.astype(np.float32)]})

    return rows.mapInPandas(run, BLOCKS)


def spectral_gate(blocks: DataFrame, strength: float, size: int = 1 << 20) -> DataFrame:
    """The gate for whole recordings, channel by channel: blocks (rec, channel, start_sample, samples) of any lengths in, blocks of ``size`` out.

    ``size`` is a multiple of the hop. Equals the gate of the whole array whatever the blocks were; under one frame nothing changes.
    """
    if size % HOP or size < SIZE:
        raise ValueError(f"size must be a multiple of {HOP}, {SIZE} at least")
    tiles = written(tiles_of(blocks, size), "tiles")
    return gated(tiles, written(noise_floors(tiles, size), "floors"), size, strength)
