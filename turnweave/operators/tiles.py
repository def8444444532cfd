"""Blocks of samples cut anew: into tiles with margins, into overlapping chunks, and back.

Samples are dealt by position: a block gives each tile or chunk that it touches one slice, and slices are put together in order. So
blocks may be of any length and differ in it; no recording is ever in one row. Slicing and joining are SQL functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("rec", "channel")
BLOCKS = "rec long, channel int, block_no long, start_sample long, samples array<float>"
#: Samples of chunks that are weighed at once.
LOT = 1 << 18


def lengths(blocks: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, total: samples of every channel."""
    return blocks.groupBy(*keys).agg(F.sum(F.size("samples")).cast("long").alias("total"))


def sliced(rows: DataFrame, lo: Column, hi: Column, *keep: str) -> DataFrame:
    """keep, at, piece: what of each row's samples lies from sample ``lo`` up to ``hi`` of the recording; rows without any go."""
    a, b = F.greatest(F.lit(0), lo - F.col("start_sample")), F.least(F.size("samples"), hi - F.col("start_sample"))
    rows = rows.withColumn("_a", a).withColumn("_b", b).where("_b > _a")
    return rows.select(*keep, (F.col("start_sample") + F.col("_a")).alias("at"), F.slice("samples", (F.col("_a") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int")).alias("piece"))


def put_together(pieces: DataFrame, *keys: str) -> DataFrame:
    """keys, start_sample, samples: pieces (keys, at, piece) that follow each other, joined in order."""
    whole = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("_v"))
    return whole.select(*keys, F.col("_v")[0]["at"].alias("start_sample"), F.flatten(F.transform("_v", lambda v: v["piece"])).alias("samples"))


def recut(blocks: DataFrame, size: int, before: int = 0, after: int = 0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, tile, start_sample, samples: tile t holds samples t * size to (t + 1) * size with up to ``before`` and ``after`` more on its sides."""
    n = F.size("samples")
    first = F.greatest(F.lit(0), F.floor((F.col("start_sample") - after) / size))
    last = F.floor((F.col("start_sample") + n - 1 + before) / size)
    rows = blocks.where(n > 0).select(*keys, "start_sample", "samples", F.explode(F.sequence(first, last)).alias("tile"))
    lo, hi = F.col("tile") * size - before, (F.col("tile") + 1) * size + after
    tiles = put_together(sliced(rows, lo, hi, *keys, "tile"), *keys, "tile")
    # past the end there are tiles of margins alone
    return tiles.where(F.col("start_sample") + F.size("samples") > F.col("tile") * size)


def reblocked(blocks: DataFrame, size: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same samples in blocks of ``size``."""
    return recut(blocks, size, keys=keys).select(*keys, F.col("tile").alias("block_no"), "start_sample", "samples")


def chunks(blocks: DataFrame, sr: int, chunk_sec: float, fade_sec: float = 0.3) -> DataFrame:
    """rec, channel, chunk, chunks, start_sample, total, samples: chunks for a model that wants some length at once.

    A recording of up to 1.25 chunks, or any for ``chunk_sec`` 0, is one chunk; others are cut every chunk less ``fade_sec``, so that neighbours share that much.
    """
    size, fade = int(chunk_sec * sr), max(1, int(fade_sec * sr))
    hop = max(1, size - fade)
    total = lengths(blocks)
    whole = F.lit(size <= 0) | (F.col("total") <= int(size * 1.25))
    count = F.when(whole, 1).otherwise(F.ceil((F.col("total") - size) / hop) + 1).cast("long")
    # what a block belongs to follows from the recording's length, which the blocks' places, not their samples, meet first
    places = blocks.where(F.size("samples") > 0).select("rec", "channel", "block_no", "start_sample", F.size("samples").alias("n")).join(total, list(KEYS)).withColumn("chunks", count)
    first = F.when(F.col("chunks") == 1, 0).otherwise(F.greatest(F.lit(0), F.floor((F.col("start_sample") - size) / hop) + 1))
    last = F.least(F.col("chunks") - 1, F.floor((F.col("start_sample") + F.col("n") - 1) / hop))
    places = places.select("rec", "channel", "block_no", "total", "chunks", F.explode(F.sequence(first.cast("long"), F.when(F.col("chunks") == 1, 0).otherwise(last).cast("long"))).alias("chunk"))
    rows = blocks.join(places, ["rec", "channel", "block_no"])
    lo = F.col("chunk") * hop
    hi = F.when(F.col("chunks") == 1, F.col("total")).otherwise(lo + size)
    keep = ("rec", "channel", "chunk", "chunks", "total")
    return put_together(sliced(rows, lo, hi, *keep), *keep).select("rec", "channel", "chunk", "chunks", "start_sample", "total", "samples")


def crossfaded(parts: DataFrame, sr: int, size: int, fade_sec: float = 0.3) -> DataFrame:
    """Blocks of ``size`` from processed chunks (rec, channel, start_sample, total, samples): the way back from ``chunks``.

    Weights rise and fall in a straight line over ``fade_sec`` at the edges inside the recording only; sums are divided by their weights. A
    chunk that came back shorter counts as far as it goes, a longer one is cut at the recording's end. A task's blocks come sorted and are
    added up many at a time, so that short blocks cost by the sample too.
    """
    fade = max(1, int(fade_sec * sr))

    def weighed(b: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The blocks whose first rows are given, about ``LOT`` samples at a time."""
        if b.column("piece").null_count:
            raise ValueError("a chunk without samples")
        start, total, n, no, a = (b.column(c).to_numpy() for c in ("start_sample", "total", "n", "block_no", "a"))
        length, flat = b.column("piece").value_lengths().to_numpy().astype(np.int64), b.column("piece").flatten()
        f, ends, bounds, i = np.minimum(fade, n), np.append(0, np.cumsum(length)), np.append(first, b.num_rows), 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(ends[bounds], ends[bounds[i]] + LOT, "right")) - 1)
            heads, lo, hi = first[i:j], ends[bounds[i]], ends[bounds[j]]
            # of every sample: its row and its place in the chunk
            row = np.repeat(np.arange(bounds[i], bounds[j]), length[bounds[i] : bounds[j]])
            at, w = np.arange(lo, hi) + (a - ends[:-1])[row], np.ones(hi - lo)
            k = np.flatnonzero((start > 0)[row] & (at < f[row]))
            w[k] *= at[k] / np.maximum(1, f - 1)[row[k]]
            # a fade of one sample rises only
            k = np.flatnonzero((f > 1)[row] & (start + n < total)[row] & (at >= (n - f)[row]))
            w[k] *= (n[row[k]] - 1 - at[k]) / (f - 1)[row[k]]
            # its place among the samples of these blocks
            offsets = np.append(0, np.cumsum(np.minimum(size, total[heads] - no[heads] * size)))
            at += (start - no * size)[row] + np.repeat(offsets[:-1], np.diff(ends[bounds[i : j + 1]]))
            x = flat.slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.float64)
            x, w = np.bincount(at, x * w, offsets[-1]), np.bincount(at, w, offsets[-1])
            samples = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), (x / np.where(w == 0, 1, w)).astype(np.float32))
            keys = [b.column(c).take(pa.array(heads)) for c in (*KEYS, "block_no")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(no[heads] * size), samples], [*KEYS, "block_no", "start_sample", "samples"])
            i = j

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last block of a batch waits for the next batch."""
        left = None
        for b in batches:
            if b.num_rows:
                b = b if left is None else pa.Table.from_batches([left, b]).combine_chunks().to_batches()[0]
                fresh = np.arange(b.num_rows) == 0
                for c in (*KEYS, "block_no"):
                    for v in (b.column(c).fill_null(0).to_numpy(), b.column(c).is_null().to_numpy(zero_copy_only=False)):
                        fresh[1:] |= v[1:] != v[:-1]
                first = np.flatnonzero(fresh)
                yield from weighed(b.slice(0, first[-1]), first[:-1])
                left = b.slice(first[-1])
        if left is not None:
            yield from weighed(left, np.array([0]))

    n, start, no = F.least(F.array_size("samples"), F.col("total") - F.col("start_sample")), F.col("start_sample"), F.col("block_no")
    keep = [F.col(c).cast(t).alias(c) for c, t in (("rec", "long"), ("channel", "int"), ("start_sample", "long"), ("total", "long"))]
    rows = parts.select(*keep, F.greatest(F.lit(0), n).cast("long").alias("n"), "samples").where((F.col("n") > 0) | (start % size != 0))
    # a row for each block that a chunk touches, sorted so that a block's chunks follow each other
    rows = rows.withColumn("block_no", F.explode(F.sequence(F.floor(start / size), F.ceil((start + F.col("n")) / size) - 1)))
    a, b = F.greatest(F.lit(0), no * size - start), F.least(F.col("n"), (no + 1) * size - start)
    pieces = rows.select(*KEYS, "block_no", "start_sample", "total", "n", a.alias("a"), F.slice("samples", (a + 1).cast("int"), (b - a).cast("int")).alias("piece"))
    return pieces.repartition(*KEYS, "block_no").sortWithinPartitions(*KEYS, "block_no", "start_sample").mapInArrow(add_up, BLOCKS)
