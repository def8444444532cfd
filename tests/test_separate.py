"""Overlaps taken apart with back ends that can be computed by hand."""

import numpy as np

from turnweave.operators import models, signal, tracks
from turnweave.plans import separate
from turnweave.settings import Settings

SR = 16_000


def back_ends():
    """Functions of a function: workers do not see this module."""
    rate, wide = separate.SEPARATION_SR, SR

    def halves(x):
        """Low and high half of the spectrum."""
        spec = np.fft.rfft(x)
        hz = np.fft.rfftfreq(len(x), 1 / rate)
        return np.stack([np.fft.irfft(np.where(hz < 1000, spec, 0), len(x)), np.fft.irfft(np.where(hz >= 1000, spec, 0), len(x))], axis=1)

    def heights(signals):
        out = []
        for x in signals:
            power = np.abs(np.fft.rfft(x)) ** 2
            low = power[np.fft.rfftfreq(len(x), 1 / wide) < 1000].sum()
            out.append(np.array([low, power.sum() - low]) / (power.sum() + 1e-12) + 1e-6)
        return out

    return halves, heights


def test_overlap_chunks(spark):
    spans = spark.createDataFrame([(1, 0.0, 2.5), (1, 5.0, 6.0005), (1, 7.0, 7.0005), (2, 1.0, 1.1)], "rec long, start double, end double")
    got = sorted((r.rec, r.chunk, round(r.start, 4), round(r.end, 4)) for r in separate.overlap_chunks(spans, 0.5).collect())
    assert got == [(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0), (1, 2, 2.0, 2.5), (1, 3, 5.0, 6.0), (2, 0, 1.0, 1.1)]


def test_voices_go_to_their_speakers(spark, monkeypatch):
    halves, heights = back_ends()
    monkeypatch.setitem(models.REGISTRY, "separation", {"separation": models.Backend("halves", lambda: halves)})
    monkeypatch.setitem(models.REGISTRY, "embedding", {"heights": models.Backend("heights", lambda: heights)})
    t = np.arange(4 * SR) / SR
    low, high = 0.3 * np.sin(2 * np.pi * 300 * t), 0.3 * np.sin(2 * np.pi * 2000 * t)
    mixed = low + high
    mixed[2 * SR : 3 * SR] = low[2 * SR : 3 * SR] + 0.3 * np.sin(2 * np.pi * 500 * t[: SR])  # no high voice: what is split off is next to nothing
    rows = [(1, c, i, i * 9000, [float(v) for v in mixed[i * 9000 : (i + 1) * 9000]]) for c in range(2) for i in range(-(-len(mixed) // 9000))]
    blocks = spark.createDataFrame(rows, signal.BLOCKS)
    overlaps = spark.createDataFrame([(1, 0.5, 1.5), (1, 3.5, 3.6)], "rec long, start double, end double")
    cents = spark.createDataFrame([(1, 0, [0.0, 1.0]), (1, 1, [1.0, 0.0]), (2, 0, [1.0, 0.0])], "rec long, speaker int, embedding array<double>")
    cfg = Settings(embedding_backend="heights", sep_chunk_sec=8.0)
    injections, chunks = separate.separated(blocks, overlaps, cents, SR, cfg)
    assert {(r.chunk, r.reason) for r in chunks.collect()} == {(0, "ok"), (1, "short")}
    got = {r.speaker: r for r in injections.collect()}
    assert set(got) == {0, 1} and all(r.start == 0.5 and len(r.samples) == SR for r in got.values())
    level = np.sqrt(np.mean(mixed[SR // 2 : 3 * SR // 2] ** 2))
    for speaker, hz in ((0, 2000), (1, 300)):
        x = np.array(got[speaker].samples)
        assert abs(np.sqrt(np.mean(x**2)) / level - 1) < 0.15
        assert abs(np.fft.rfftfreq(len(x), 1 / SR)[np.abs(np.fft.rfft(x)).argmax()] - hz) < 5
    silent = spark.createDataFrame([(1, s, c, 0, 0, [0.0] * len(mixed)) for s in range(2) for c in range(2)], tracks.TRACKS)
    filled = tracks.injected(silent, injections, SR).where("speaker = 0 and channel = 1").orderBy("start_sample").collect()
    x = np.concatenate([np.array(r.samples) for r in filled])
    assert len(x) == len(mixed) and not x[: SR // 2].any() and np.allclose(x[SR // 2 : 3 * SR // 2], got[0].samples, atol=1e-6)
    none, all_ = separate.separated(blocks, overlaps, cents, SR, Settings(embedding_backend="heights", overlap_mode="delete"))
    assert none.count() == 0 and all_.count() == 0
    alone, _ = separate.separated(blocks, overlaps, cents.where("speaker = 0"), SR, cfg)
    assert alone.count() == 0
