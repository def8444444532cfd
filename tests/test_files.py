"""Audio files in and out: ranges, decoders, commits; and the ladder of noise reduction."""

import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.operators import denoise, models, signal, spectral
from turnweave.plans import diarize as plan
from turnweave.plans.export import export_all
from turnweave.settings import Settings
from turnweave.sources import audio


def write(path, x, sr, width=2):
    """x (samples, channels) in [-1, 1)."""
    with wave.open(str(path), "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(width)
        w.setframerate(sr)
        v = np.rint(x * (1 << (8 * width - 1))).astype(np.int64)
        v = v + 128 if width == 1 else v
        w.writeframes(b"".join(int(s).to_bytes(width, "little", signed=width > 1) for s in v.ravel()))


def rows_of(df):
    return sorted((r.path, r.sr, r.channels, r.channel, r.block_no, r.start_sample, tuple(r.samples)) for r in df.collect())


def test_ranges_equal_whole_files(spark, tmp_path):
    """Files of 8, 16 and 44.1 kHz, one and two channels, all widths, extra chunks and odd ends, in one call."""
    r = np.random.default_rng(1)
    for i, (sr, channels, width, n) in enumerate([(8_000, 1, 1, 4001), (16_000, 2, 2, 9000), (44_100, 2, 3, 5000), (16_000, 1, 4, 8000), (8_000, 1, 2, 0)]):
        write(tmp_path / f"{i}.wav", r.uniform(-0.9, 0.9, (n, channels)), sr, width)
    raw = (tmp_path / "1.wav").read_bytes()
    (tmp_path / "5.wav").write_bytes(raw[:12] + b"LIST" + struct.pack("<I", 5) + b"abcde\0" + raw[12:] + b"tail")
    (tmp_path / "6.wav").write_bytes(raw[:-101])
    got, want = rows_of(audio.read_wav(spark, str(tmp_path), 0.25)), rows_of(audio.read_blocks(spark, str(tmp_path), 0.25))
    assert got == want and len({x[0] for x in got}) == 7
    assert {x[1] for x in got} == {8_000, 16_000, 44_100}


def test_long_file_is_not_read_whole(spark, tmp_path):
    """Three GB in an RF64 file with a hole: the last range is all that is read."""
    n = 3 << 30
    with open(tmp_path / "a.wav", "wb") as f:
        f.write(b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVEds64" + struct.pack("<IQQQI", 28, n + 72, n, n // 2, 0))
        f.write(b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16_000, 32_000, 2, 16) + b"data" + struct.pack("<I", 0xFFFFFFFF))
        f.seek(n - 4, os.SEEK_CUR)
        f.write(struct.pack("<hh", 16384, -16384))
    ranges = audio.wav_ranges(spark, str(tmp_path), 60.0).cache()
    assert ranges.agg(F.sum("n")).first()[0] == n // 2
    last = audio.read_ranges(ranges.where(F.col("start_sample") + F.col("n") == n // 2)).first()
    assert last.samples[-2:] == [0.5, -0.5] and not any(last.samples[:-2])


def test_decoders_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audio, "DECODERS", {})

    def breaks(data):
        raise ValueError("first breaks")

    def halves(data):
        if not data.startswith(b"half"):
            raise ValueError("not halves")
        return np.full(10, 0.5, np.float32), 1000

    audio.DECODERS["own"] = [breaks, halves]
    (tmp_path / "a.own").write_bytes(b"half")
    write(tmp_path / "b.own", np.full((5, 1), 0.25), 1000)
    assert {r.path[-5]: r.samples[0] for r in audio.read_blocks(spark, str(tmp_path)).collect()} == {"a": 0.5, "b": 0.25}
    (tmp_path / "c.own").write_bytes(b"else")
    kept = audio.read_blocks(spark, str(tmp_path), keep_errors=True).collect()
    assert [r.error is None for r in sorted(kept, key=lambda r: r.path)] == [True, True, False]
    assert any("could not be decoded: not a WAV file" in (r.error or "") for r in kept)
    with pytest.raises(Exception, match="could not be decoded: not a WAV file"):
        audio.read_blocks(spark, str(tmp_path)).collect()


def track_rows(spark, tracks, size=7):
    rows = [(rec, spk, c, i, i * size, [float(v) for v in x[c, i * size : (i + 1) * size]]) for (rec, spk), x in tracks.items() for c in range(len(x)) for i in range(-(-x.shape[1] // size))]
    return spark.createDataFrame(rows, "rec long, speaker int, channel int, block_no long, start_sample long, samples array<float>").repartition(3)


def test_tracks_are_written_side_by_side(spark, tmp_path):
    r = np.random.default_rng(2)
    tracks = {(1, 0): r.uniform(-1.2, 1.2, (2, 30)), (1, 1): r.uniform(-1, 1, (2, 30)), (2, 0): r.uniform(-1, 1, (1, 23))}
    root = f"file://{tmp_path}/out"
    files = audio.write_wav(track_rows(spark, tracks), root, 8000).collect()
    assert sorted(os.listdir(tmp_path / "out")) == ["1-SPEAKER_1.wav", "1-SPEAKER_2.wav", "2-SPEAKER_1.wav"]
    for f in files:
        x, sr = audio.decode_wav(open(f.path.removeprefix("file://"), "rb").read())
        want = np.clip(tracks[f.rec, f.speaker], -1, 1)
        assert sr == 8000 and x.shape == (f.n_samples, f.channels) and np.allclose(x.T, want, atol=1e-4)


def test_failed_task_leaves_no_file(spark, tmp_path):
    """The second track is too long for its header: the job fails after other files were written, and none is there."""
    rows = track_rows(spark, {(rec, 0): np.full((1, 20), 0.1) for rec in range(6)}).withColumn("channels", F.lit(1))
    rows = rows.withColumn("total", F.when(F.col("rec") == 5, F.lit(1 << 40)).otherwise(F.lit(20)).cast("long"))
    spark.dataSource.register(audio.WavSink)
    ordered = rows.select("rec", "speaker", "channels", "total", "block_no", "channel", "samples").coalesce(1).sortWithinPartitions("rec", "speaker", "block_no", "channel")
    with pytest.raises(Exception, match="too many for a WAV file"):
        ordered.write.format("speaker_wav").option("sr", 8000).mode("append").save(f"file://{tmp_path}/out")
    assert os.listdir(tmp_path / "out") == []


def noisy(spark):
    r = np.random.default_rng(3)
    x = {rec: r.normal(size=5000).astype(np.float32) for rec in (1, 2, 3)}
    rows = [(rec, 0, i, i * 2000, [float(v) for v in v_[i * 2000 : (i + 1) * 2000]]) for rec, v_ in x.items() for i in range(3)]
    return x, spark.createDataFrame(rows, signal.BLOCKS)


def test_ladder(spark, monkeypatch):
    """Recording 1 passes the first step; 2 fails in one chunk of it and passes the second; 3 fails twice and gets the gate."""
    x, df = noisy(spark)
    marks = {rec: float(v[4500]) for rec, v in x.items()}

    def fails_for(*recs, factor):
        bad = [marks[r] for r in recs]

        def f(s, sr):
            if any(np.isclose(s, m, atol=0, rtol=0).any() for m in bad):
                raise ValueError("no memory")
            return s * factor

        return lambda: f

    registry = {"first": models.Backend("first", fails_for(2, 3, factor=0.5)), "second": models.Backend("second", fails_for(3, factor=0.25)), "absent": models.Backend("absent", fails_for(factor=1.0), lambda: False)}
    monkeypatch.setitem(models.REGISTRY, "denoise", registry)
    cfg = Settings(denoise_backend="auto", denoise_chunk_sec=1.0, highpass_hz=0.0)
    out, steps = denoise.denoised(df, 1000, cfg, 1024)
    assert {r.rec: (r.step, r.cause) for r in steps.collect()} == {1: ("first", None), 2: ("second", "first: no memory"), 3: ("spectral", "first: no memory; second: no memory; absent: not available")}
    got = {}
    for r in out.orderBy("start_sample").collect():
        got.setdefault(r.rec, []).extend(r.samples)
    assert np.allclose(got[1], x[1] * 0.5, atol=1e-5) and np.allclose(got[2], x[2] * 0.25, atol=1e-5)
    gate = [v for r in spectral.spectral_gate(df.where("rec = 3"), cfg.denoise_strength, 1024).orderBy("start_sample").collect() for v in r.samples]
    assert np.allclose(got[3], gate, atol=1e-6)
    with pytest.raises(RuntimeError, match="first: no memory"):
        denoise.denoised(df, 1000, Settings(denoise_backend="first", denoise_strict=True, denoise_chunk_sec=1.0))
    same, none = denoise.denoised(df, 1000, Settings(denoise=False))
    assert same.count() == 9 and {r.step for r in none.collect()} == {"none"}


def test_files_of_several_rates(spark, tmp_path):
    """8, 16 and 44.1 kHz, one and two channels, from files to the mono copy in one call."""
    r, x = np.random.default_rng(5), {}
    for i, (sr, channels, n) in enumerate([(8_000, 1, 9001), (16_000, 2, 16_003), (44_100, 2, 30_000), (44_100, 1, 12_345)]):
        x[f"{i}.wav"] = sr, r.uniform(-0.5, 0.5, (n, channels))
        write(tmp_path / f"{i}.wav", x[f"{i}.wav"][1], sr)
    blocks = audio.read_wav(spark, str(tmp_path), 0.3).cache()
    names = {b.rec: b.path[-5:] for b in blocks.collect()}
    for got in (signal.analysis_copy(blocks, "sr"), plan.prepared(blocks, "sr", Settings(denoise=False))[1]):
        rows = {}
        for b in got.orderBy("start_sample").collect():
            assert b.start_sample == len(rows.setdefault(names[b.rec], []))
            rows[names[b.rec]].extend(b.samples)
        for name, (sr, whole) in x.items():
            assert np.allclose(rows[name], signal.resample(whole.mean(axis=1), sr, 16_000), atol=1e-4), name


def test_voice_statistics():
    """MFCC means and deviations against sums written out."""
    x, sr = np.random.default_rng(6).normal(size=1700), 16_000
    frames = [x[i : i + 512] * np.hanning(512) for i in range(0, len(x) - 511, 160)]
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 8000 / 700), 42) / 2595) - 1)
    rows = []
    for f in frames:
        power = [abs(sum(f[j] * np.exp(-2j * np.pi * k * j / 512) for j in range(512))) ** 2 for k in range(257)]
        bands = [sum(power[k] * max(0.0, min((k * sr / 512 - a) / (b - a), (c - k * sr / 512) / (c - b))) for k in range(257)) for a, b, c in zip(edges, edges[1:], edges[2:])]
        logs = np.log(np.array(bands) + 1e-10)
        rows.append([np.sqrt(2 / 40) * sum(logs[m] * np.cos(np.pi / 40 * (m + 0.5) * n) for m in range(40)) for n in range(20)])
    c = np.array(rows)
    delta = np.array([(c[min(i + 1, len(c) - 1)] - c[max(i - 1, 0)]) / (min(i + 1, len(c) - 1) - max(i - 1, 0)) for i in range(len(c))])
    assert np.allclose(signal.mfcc_stats(x), np.concatenate([c.mean(0), c.std(0), delta.mean(0), delta.std(0)]), atol=1e-6)


def test_prepared(spark):
    _, df = noisy(spark)
    clean, analysis, steps = plan.prepared(df, 8000, Settings())
    assert {r.step for r in steps.collect()} == {"spectral"}
    want = signal.filter_blocks(spectral.spectral_gate(df, Settings().denoise_strength), signal.high_pass(8000, Settings().highpass_hz))
    a, b = ([v for r in d.orderBy("rec", "start_sample").collect() for v in r.samples] for d in (clean, want))
    assert np.allclose(a, b) and len(a) == 15_000
    assert analysis.agg(F.sum(F.size("samples"))).first()[0] == 30_000


def test_activity_back_end(spark, monkeypatch):
    """Recording 1 is heard by the back end; 2 fails in it and 3 has too little, so both go by their levels."""
    sr, r = 16_000, np.random.default_rng(8)
    x = {rec: np.concatenate([0.0001 * r.normal(size=sr), 0.3 * r.normal(size=2 * sr), 0.0001 * r.normal(size=sr)]).astype(np.float32) for rec in (1, 2, 3)}
    rows = [(rec, 0, i, i * 20_000, [float(v) for v in s[i * 20_000 : (i + 1) * 20_000]]) for rec, s in x.items() for i in range(4)]
    df = spark.createDataFrame(rows, signal.BLOCKS).cache()
    second, third = float(x[2][0]), float(x[3][0])

    def load():
        def f(s):
            if s[0] == np.float32(second):
                raise ValueError("broken")
            return [(0.5, 0.6)] if s[0] == np.float32(third) else [(0.25, 1.0), (1.1, 1.5), (2.0, 2.1)]

        return f

    monkeypatch.setitem(models.REGISTRY, "activity", {"absent": models.Backend("absent", load, lambda: False), "own": models.Backend("own", load)})
    got = {}
    for s in plan.speech(df, Settings(vad_backend="auto")).orderBy("start").collect():
        got.setdefault(s.rec, []).append((round(s.start, 2), round(s.end, 2)))
    by_level = {}
    for s in plan.speech(df, Settings()).orderBy("start").collect():
        by_level.setdefault(s.rec, []).append((round(s.start, 2), round(s.end, 2)))
    assert got[1] == [(0.25, 1.5)] and got[2] == by_level[2] and got[3] == by_level[3]
    assert abs(by_level[2][0][0] - 1.0) < 0.05 and abs(by_level[2][-1][1] - 3.0) < 0.05
    with pytest.raises(RuntimeError, match="own: broken"):
        plan.speech(df, Settings(vad_backend="own", vad_strict=True))
    with pytest.raises(RuntimeError, match="absent"):
        plan.speech(df, Settings(vad_backend="absent", vad_strict=True))


def test_export_all(spark, tmp_path):
    sr, r = 8_000, np.random.default_rng(9)
    x = (0.2 * r.normal(size=(2, 2 * sr))).astype(np.float32)
    df = spark.createDataFrame([(7, c, i, i * 5000, [float(v) for v in x[c, i * 5000 : (i + 1) * 5000]]) for c in range(2) for i in range(4)], signal.BLOCKS)
    segs = spark.createDataFrame([(7, 0, 0.0, 0.5), (7, 1, 0.5, 1.0), (7, 0, 1.5, 2.0)], "rec long, speaker int, start double, end double")
    none = segs.limit(0)
    result = plan.Result(segs, none, none, none, none)
    files = {(f.speaker, f.kind): f for f in export_all(df, result, sr, Settings(), f"file://{tmp_path}/out").collect()}
    assert set(files) == {(s, k) for s in (0, 1) for k in ("track", "compact")}
    for (speaker, kind), f in files.items():
        y, rate = audio.decode_wav(open(f.path.removeprefix("file://"), "rb").read())
        assert rate == sr and y.shape == (f.n_samples, 2)
        assert f.n_samples == 2 * sr if kind == "track" else f.n_samples < 2 * sr
        if kind == "track":
            on = slice(int(0.55 * sr), int(0.95 * sr))
            assert y[on].any() == (speaker == 1)
    assert os.listdir(tmp_path / "out/timelines/rttm/rec=7")
    few = export_all(df, result, sr, Settings(export_per_speaker=False, export_compact=False), f"file://{tmp_path}/few")
    assert few.count() == 0 and sorted(os.listdir(tmp_path / "few")) == ["timelines"]
