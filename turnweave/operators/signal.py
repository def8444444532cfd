"""Signals in blocks: framing, filters, gates, loudness and masks.

A recording is rows of blocks (rec, channel, block_no, start_sample, samples), never one row. What crosses blocks, the state of a
filter or the overlap of frames, comes from the neighbouring row by a window function or travels along an ordered group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.settings import TARGET_SR

BLOCKS = "rec long, channel int, block_no long, start_sample long, samples array<float>"


def resample(x: np.ndarray, old: int, new: int) -> np.ndarray:
    """Linear interpolation on grids without their end point."""
    n = int(np.rint(len(x) / old * new))
    if n <= 0 or not len(x):
        return np.zeros(0, np.float32)
    return np.interp(np.linspace(0, len(x) / old, n, endpoint=False), np.linspace(0, len(x) / old, len(x), endpoint=False), x).astype(np.float32)


def resampled(blocks: DataFrame, old: int | str, new: int) -> DataFrame:
    """Blocks at another rate, as ``resample`` of the whole channel would give: each block makes the samples that begin in it and needs one sample of the next.

    ``old`` is the rate of all, or the column that holds each recording's.
    """
    if old == new:
        return blocks.select("rec", "channel", "block_no", "start_sample", "samples")
    total = blocks.groupBy("rec", "channel").agg(F.sum(F.size("samples")).alias("total"))
    order = Window.partitionBy("rec", "channel").orderBy("block_no")
    rows = blocks.withColumn("after", F.lead(F.col("samples")[0]).over(order)).join(total, ["rec", "channel"]).withColumn("rate", F.col(old) if isinstance(old, str) else F.lit(old))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            starts, out = [], []
            for r in b.itertuples():
                n = int(np.rint(r.total / r.rate * new))
                step, x = r.total / max(1, n), np.asarray(r.samples, dtype=np.float64)
                j = np.arange(int(np.ceil(r.start_sample / step)), min(n, int(np.ceil((r.start_sample + len(x)) / step))))
                x = np.append(x, x[-1:] if pd.isna(r.after) else r.after)
                starts.append(int(np.ceil(r.start_sample / step)))
                out.append(np.interp(j * step - r.start_sample, np.arange(len(x)), x).astype(np.float32))
            yield b.assign(start_sample=starts, samples=out)[["rec", "channel", "block_no", "start_sample", "samples"]]

    return rows.mapInPandas(run, BLOCKS)


def mono(blocks: DataFrame) -> DataFrame:
    """Mean over channels, block by block: the channels of a block are one small group."""

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(channel=0, samples=[np.mean(np.stack(pdf.samples.to_list()), axis=0, dtype=np.float64).astype(np.float32)])

    return blocks.select("rec", "channel", "block_no", "start_sample", "samples").groupBy("rec", "block_no").applyInPandas(average, BLOCKS)


def analysis_copy(blocks: DataFrame, sr: int | str) -> DataFrame:
    """The mono copy at 16 kHz that activity and voiceprints are measured on; ``sr`` is the rate of all recordings, or the column that holds each one's."""
    return mono(resampled(blocks, sr, TARGET_SR)) if isinstance(sr, str) else resampled(mono(blocks), sr, TARGET_SR)


def frame_levels(blocks: DataFrame, size: int = 480, hop: int = 160) -> DataFrame:
    """rec, channel, frame, db of frames of ``size`` samples every ``hop``; a block's last frames reach into the next row. Blocks start at multiples of hop."""
    after = F.lead("samples").over(Window.partitionBy("rec", "channel").orderBy("block_no"))
    joined = blocks.withColumn("after", F.slice(F.coalesce(after, F.array().cast("array<float>")), 1, size - 1))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                own = len(r.samples)
                x = np.concatenate([r.samples, r.after]).astype(np.float64)
                n = min(-(-own // hop), 1 + (len(x) - size) // hop) if len(x) >= size else 0
                if n > 0:
                    energy = np.concatenate(([0.0], np.cumsum(x * x)))
                    at = np.arange(n) * hop
                    ms = np.maximum(0, energy[at + size] - energy[at]) / size
                    yield pd.DataFrame({"rec": r.rec, "channel": r.channel, "frame": r.start_sample // hop + np.arange(n), "db": 20 * np.log10(np.sqrt(ms + 1e-10) + 1e-10)})

    return joined.mapInPandas(measure, "rec long, channel int, frame long, db double")


def peaking(sr: int, hz: float, gain_db: float, q: float) -> np.ndarray:
    """Second-order peaking section: b0 b1 b2 a1 a2 (audio EQ cookbook)."""
    a, w = 10 ** (gain_db / 40), 2 * np.pi * hz / sr
    alpha, c = np.sin(w) / (2 * q), np.cos(w)
    return np.array([1 + alpha * a, -2 * c, 1 - alpha * a, -2 * c, 1 - alpha / a]) / (1 + alpha / a)


def high_shelf(sr: int, hz: float, gain_db: float, slope: float = 1.0) -> np.ndarray:
    a, w = 10 ** (gain_db / 40), 2 * np.pi * hz / sr
    c = np.cos(w)
    alpha = np.sin(w) / 2 * np.sqrt((a + 1 / a) * (1 / slope - 1) + 2)
    r = 2 * np.sqrt(a) * alpha
    a0 = (a + 1) - (a - 1) * c + r
    return np.array([a * ((a + 1) + (a - 1) * c + r), -2 * a * ((a - 1) + (a + 1) * c), a * ((a + 1) + (a - 1) * c - r), 2 * ((a - 1) - (a + 1) * c), (a + 1) - (a - 1) * c - r]) / a0


def high_pass(sr: int, hz: float) -> list[np.ndarray]:
    """Fourth-order Butterworth high-pass as two sections."""
    w = 2 * np.pi * hz / sr
    out = []
    for q in (0.54119610, 1.30656296):
        alpha, c = np.sin(w) / (2 * q), np.cos(w)
        out.append(np.array([(1 + c) / 2, -(1 + c), (1 + c) / 2, -2 * c, 1 - alpha]) / (1 + alpha))
    return out


def run_section(x: np.ndarray, s: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One second-order section with state z (transposed form II): output and new state.

    The recurrence y[n] = v[n] - a1 y[n-1] - a2 y[n-2] is solved 64 samples at a time with powers of its transition matrix.
    """
    b0, b1, b2, a1, a2 = s
    n = len(x)
    if not n:
        return x, z
    size = 64
    pad = -n % size
    u = np.append(x, np.zeros(pad)).reshape(-1, size)
    a = np.array([[-a1, 1.0], [-a2, 0.0]])
    bz = np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = np.empty((size + 1, 2, 2))
    powers[0] = np.eye(2)
    for i in range(size):
        powers[i + 1] = a @ powers[i]
    impulse = np.array([powers[i] @ bz for i in range(size)])  # state i + 1 steps after a unit input
    response = np.zeros((size, size))
    for i in range(size):
        response[i, :i] = impulse[i - 1 :: -1, 0][:i] if i else []
        response[i, i] = b0
    forced = u @ response.T
    to_state = impulse[::-1]
    y = np.empty_like(u)
    state = z.copy()
    used = n % size or size
    for i in range(len(u)):
        y[i] = forced[i] + powers[:size, 0, :] @ state
        if i == len(u) - 1 and pad:
            state = powers[used] @ state + u[i, :used] @ impulse[used - 1 :: -1][:used] if used > 1 else powers[1] @ state + u[i, 0] * bz
        else:
            state = powers[size] @ state + u[i] @ to_state
    return y.ravel()[:n], state


def filter_blocks(blocks: DataFrame, sections: list[np.ndarray]) -> DataFrame:
    """A cascade over every channel, its state carried from block to block.

    A filter is sequential, so a channel is one ordered stream: rows are sorted by block within the channel's partition and pass
    one at a time; a task holds one block and the filter's state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, states = None, []
        for b in batches:
            out = []
            for r in b.itertuples():
                if (r.rec, r.channel) != who:
                    who, states = (r.rec, r.channel), [np.zeros(2) for _ in sections]
                x = np.asarray(r.samples, dtype=np.float64)
                for i, s in enumerate(sections):
                    x, states[i] = run_section(x, s, states[i])
                out.append(x.astype(np.float32))
            yield b.assign(samples=out)

    ordered = blocks.repartition("rec", "channel").sortWithinPartitions("rec", "channel", "block_no")
    return ordered.select("rec", "channel", "block_no", "start_sample", "samples").mapInPandas(run, BLOCKS)


def map_blocks(blocks: DataFrame, f) -> DataFrame:
    """f(samples) on every block alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(samples=[np.asarray(f(np.asarray(x, dtype=np.float64)), dtype=np.float32) for x in b.samples])

    return blocks.select("rec", "channel", "block_no", "start_sample", "samples").mapInPandas(run, BLOCKS)


def moving_average(x: np.ndarray, n: int) -> np.ndarray:
    """Centred mean of n samples, the edges repeated."""
    if n <= 1 or not len(x):
        return x
    padded = np.concatenate([np.full(n // 2, x[0]), x, np.full(n - 1 - n // 2, x[-1])])
    total = np.concatenate(([0.0], np.cumsum(padded)))
    return (total[n:] - total[:-n]) / n


def compress(x: np.ndarray, sr: int, threshold_db: float, ratio: float, makeup_db: float = 0.0) -> np.ndarray:
    """Gain from the level of each sample, in dB, averaged over 25 ms before it is applied. Channels (rows of x) get one gain, from the loudest."""
    level = 20 * np.log10((np.abs(x) if x.ndim == 1 else np.abs(x).max(axis=0)) + 1e-9)
    gain = -np.maximum(0.0, level - threshold_db) * (1 - 1 / max(ratio, 1.0))
    return x * 10 ** ((moving_average(gain, max(1, round(0.025 * sr))) + makeup_db) / 20)


def limit(x: np.ndarray, ceiling: float) -> np.ndarray:
    return np.tanh(x / ceiling) * ceiling


def loudness(squares: DataFrame, hop_sec: float = 0.1) -> DataFrame:
    """Integrated loudness (rec, lufs) of K-weighted mean squares (rec, hop, ms) by two gates: -70 LUFS, then 10 LU under the mean of what is left.

    Gating blocks of 400 ms overlap by 300 ms, which is a window over four rows.
    """
    w = Window.partitionBy("rec").orderBy("hop").rowsBetween(-3, 0)
    blocks = squares.withColumn("z", F.avg("ms").over(w)).withColumn("n", F.count("*").over(w)).where("n = 4 and z > 0")
    blocks = blocks.withColumn("l", -0.691 + 10 * F.log10("z")).where("l > -70")
    limit_ = blocks.groupBy("rec").agg((-0.691 + 10 * F.log10(F.avg("z")) - 10).alias("limit"))
    return blocks.join(limit_, "rec").where("l > limit").groupBy("rec").agg((-0.691 + 10 * F.log10(F.avg("z"))).alias("lufs"))


def k_weighting(sr: int) -> list[np.ndarray]:
    """The two sections of ITU-R BS.1770, a shelf of 4 dB and a high-pass, at any sample rate."""
    k, q, high = np.tan(np.pi * 1681.974450955533 / sr), 0.7071752369554196, 10 ** (3.999843853973347 / 20)
    band = high**0.4996667741545416
    shelf = np.array([high + band * k / q + k * k, 2 * (k * k - high), high - band * k / q + k * k, 2 * (k * k - 1), 1 - k / q + k * k]) / (1 + k / q + k * k)
    k, q = np.tan(np.pi * 38.13547087602444 / sr), 0.5003270373238773
    low = np.array([2 * (k * k - 1), 1 - k / q + k * k]) / (1 + k / q + k * k)
    return [shelf, np.array([1.0, -2.0, 1.0, *low])]


def hop_squares(blocks: DataFrame, sr: int, hop_sec: float = 0.1) -> DataFrame:
    """rec, hop, ms: mean squares of hops of samples. A block's sums leave its task, not its samples; a hop across two blocks is added up."""
    hop = int(hop_sec * sr)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                x = np.asarray(r.samples, dtype=np.float64)
                at = (r.start_sample + np.arange(len(x))) // hop
                if len(x):
                    yield pd.DataFrame({"rec": r.rec, "hop": np.arange(at[0], at[-1] + 1), "s": np.bincount(at - at[0], weights=x * x)})

    sums = blocks.select("rec", "start_sample", "samples").mapInPandas(add_up, "rec long, hop long, s double")
    return sums.groupBy("rec", "hop").agg((F.sum("s") / hop).alias("ms"))


def masked(blocks: DataFrame, spans: DataFrame, sr: int, fade: int) -> DataFrame:
    """Each speaker's track, as long as the recording: blocks (rec, ...) times the speaker's spans (rec, speaker, start, end), with moving-average fades of ``fade`` samples.

    Spans are dealt to the blocks they touch by an equi-join; the fade looks ``fade`` samples past a block's edges, which the spans, not
    neighbouring blocks, decide. Spans are clamped to the recording here.
    """
    size = blocks.agg(F.max(F.size("samples"))).first()[0] or 1
    long = blocks.where("channel = 0").groupBy("rec").agg((F.sum(F.size("samples")) / sr).alias("_long"))
    reach = spans.join(long, "rec").select("rec", "speaker", F.greatest(F.lit(0.0), "start").alias("start"), F.least("end", "_long").alias("end")).where("end > start")
    first, last = F.floor((F.col("start") * sr - fade) / size), F.floor((F.col("end") * sr + fade) / size)
    dealt = reach.withColumn("block_no", F.explode(F.sequence(F.greatest(F.lit(0), first), last)))
    listed = dealt.groupBy("rec", "speaker", "block_no").agg(F.sort_array(F.collect_list(F.array("start", "end"))).alias("spans"))
    joined = blocks.join(spans.select("rec", "speaker").distinct(), "rec").join(listed, ["rec", "speaker", "block_no"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                mask = np.zeros(len(r.samples) + 2 * fade)
                for s, e in r.spans if r.spans is not None else ():
                    a, z = (int(np.rint(t * sr)) - r.start_sample + fade for t in (s, e))
                    mask[max(0, a) : max(0, z)] = 1.0
                if fade > 1:
                    mask = np.clip(np.convolve(mask, np.ones(fade) / fade, "same"), 0, 1)
                out.append((np.asarray(r.samples) * mask[fade : fade + len(r.samples)]).astype(np.float32))
            yield b.assign(samples=out)[["rec", "speaker", "channel", "block_no", "start_sample", "samples"]]

    return joined.mapInPandas(run, "rec long, speaker int, channel int, block_no long, start_sample long, samples array<float>")


def mel_bank(sr: int, size: int, bands: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(sr / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / sr)
    return np.maximum(0, np.minimum((f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]))


def mfcc_stats(x: np.ndarray, sr: int = 16_000, coefficients: int = 20) -> np.ndarray:
    """Mean and deviation over frames of MFCCs and of their differences: 4 * coefficients numbers."""
    size, hop, bands = 512, 160, 40
    x = np.pad(np.asarray(x, dtype=np.float64), (0, max(0, size - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hanning(size)
    energy = np.log(np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ mel_bank(sr, size, bands).T + 1e-10)
    basis = np.cos(np.pi / bands * (np.arange(bands) + 0.5)[None, :] * np.arange(coefficients)[:, None]) * np.sqrt(2 / bands)
    c = energy @ basis.T
    delta = np.gradient(c, axis=0) if len(c) > 1 else np.zeros_like(c)
    return np.concatenate([c.mean(0), c.std(0), delta.mean(0), delta.std(0)])
