import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.operators import activity, clustering, models, signal, speakers
from turnweave.plans import diarize as plan
from turnweave.settings import PRESETS, Settings, preset
from turnweave.sources import audio, turns
from turnweave.streaming import sessions


def blocks_of(spark, x, size, rec=1):
    rows = [(rec, 0, i, at, [float(v) for v in x[at : at + size]]) for i, at in enumerate(range(0, len(x), size))]
    return spark.createDataFrame(rows, signal.BLOCKS)


def samples_of(df, *keys):
    return np.concatenate([np.array(r.samples) for r in df.orderBy(*keys, "block_no").collect()])


def slow_section(x, s):
    b0, b1, b2, a1, a2 = s
    y, z1, z2 = [], 0.0, 0.0
    for v in x:
        o = b0 * v + z1
        z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
        y.append(o)
    return np.array(y)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 200, 1000])
def test_section(n):
    x = np.random.default_rng(n).normal(size=n)
    s = signal.peaking(16_000, 1000, 4.0, 0.9)
    whole, _ = signal.run_section(x, s, np.zeros(2))
    assert np.allclose(whole, slow_section(x, s), atol=1e-9)
    cut = n // 3
    a, z = signal.run_section(x[:cut], s, np.zeros(2))
    b, _ = signal.run_section(x[cut:], s, z)
    assert np.allclose(np.concatenate([a, b]), whole, atol=1e-9)


def test_filter_carries_state(spark):
    x = np.random.default_rng(0).normal(size=5000)
    sections = signal.high_pass(16_000, 80.0)
    got = samples_of(signal.filter_blocks(blocks_of(spark, x, 777), sections), "rec")
    want = x
    for s in sections:
        want = slow_section(want, s)
    assert np.allclose(got, want, atol=1e-4)


def test_frame_levels(spark):
    x = np.random.default_rng(1).normal(size=3210)
    got = signal.frame_levels(blocks_of(spark, x, 1600), 480, 160).orderBy("frame").collect()
    want = [20 * np.log10(np.sqrt(np.mean(x.astype(np.float32)[i * 160 : i * 160 + 480].astype(float) ** 2) + 1e-10) + 1e-10) for i in range(1 + (len(x) - 480) // 160)]
    assert [r.frame for r in got] == list(range(len(want)))
    assert np.allclose([r.db for r in got], want, atol=1e-6)


def test_masks(spark):
    x = np.ones(1000)
    spans = spark.createDataFrame([(1, 0, -0.1, 0.2), (1, 0, 0.5, 0.6), (1, 1, 0.25, 0.9)], "rec long, speaker int, start double, end double")
    df = signal.masked(blocks_of(spark, x, 128), spans, 1000, 1)
    for spk, on in ((0, [(0, 200), (500, 600)]), (1, [(250, 900)])):
        track = np.zeros(1000)
        for r in df.where(F.col("speaker") == spk).collect():
            track[r.start_sample : r.start_sample + len(r.samples)] = r.samples
        want = np.zeros(1000)
        for a, b in on:
            want[a:b] = 1
        assert np.array_equal(track, want)


@pytest.mark.parametrize(("old", "new"), [(44_100, 16_000), (8_000, 16_000), (16_000, 16_000)])
def test_analysis_copy(spark, old, new):
    rng = np.random.default_rng(8)
    left, right = rng.normal(size=(2, 5003)).astype(np.float32)
    blocks = blocks_of(spark, left, 640).unionByName(blocks_of(spark, right, 640).withColumn("channel", F.lit(1)))
    both = ((left.astype(float) + right) / 2).astype(np.float32)
    assert np.allclose(samples_of(signal.mono(blocks), "rec"), both)
    got = signal.resampled(signal.mono(blocks), old, new)
    assert np.allclose(samples_of(got, "rec"), signal.resample(both, old, new), atol=1e-5)
    assert [r.start_sample for r in got.orderBy("block_no").collect()][1] == int(np.ceil(640 / (5003 / np.rint(5003 / old * new))))


def test_compressor():
    rng, sr = np.random.default_rng(9), 1000
    x = rng.normal(size=400)
    gain = [-max(0.0, 20 * np.log10(abs(v) + 1e-9) + 22) * (1 - 1 / 3) for v in x]
    at = lambda i: gain[min(max(i, 0), 399)]
    want = [v * 10 ** (np.mean([at(i - 12 + j) for j in range(25)]) / 20) for i, v in enumerate(x)]
    assert np.allclose(signal.compress(x, sr, -22.0, 3.0), want)


def test_loudness(spark):
    sr, t = 48_000, np.arange(48_000 * 3) / 48_000
    tone = np.sin(2 * np.pi * 997 * t)
    weighted = signal.filter_blocks(blocks_of(spark, tone, 48_000), signal.k_weighting(sr))
    assert abs(signal.loudness(signal.hop_squares(weighted, sr)).first().lufs - -3.01) < 0.15
    odd = {r.hop: r.ms for r in signal.hop_squares(blocks_of(spark, tone[:1000], 77), 1000, 0.1).collect()}
    assert np.allclose([odd[i] for i in range(10)], (tone[:1000].astype(np.float32).astype(float).reshape(10, 100) ** 2).mean(axis=1))


def test_resample_and_limits():
    assert len(signal.resample(np.ones(44_100), 44_100, 16_000)) == 16_000
    assert len(signal.resample(np.ones(0), 44_100, 16_000)) == 0
    assert np.abs(signal.limit(np.array([10.0, -10.0]), 0.9)).max() <= 0.9
    assert signal.mfcc_stats(np.zeros(100)).shape == (80,)


def write_wav(path, x, sr, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())


def voice(f0, formants, n, rng, sr=16_000):
    t = np.arange(n) / sr
    x = sum(np.exp(-min(abs(f0 * k - f) for f in formants) / 200) * np.sin(2 * np.pi * f0 * k * t) for k in range(1, 40) if f0 * k < 7000)
    return 0.3 * x / np.abs(x).max() * (1 + 0.1 * np.sin(2 * np.pi * 4 * t)) + 0.002 * rng.normal(size=n)


def test_diarizes_a_recording(spark, tmp_path):
    rng, sr = np.random.default_rng(0), 16_000
    speakers_ = [(110, (600, 1100, 2500)), (230, (850, 2000, 3000))]
    x, truth, at = [], [], 0
    for i in range(6):
        n = int(sr * rng.uniform(2.5, 3.5))
        x += [voice(*speakers_[i % 2], n, rng), 0.002 * rng.normal(size=int(0.5 * sr))]
        truth.append((at / sr, (at + n) / sr, i % 2))
        at += n + int(0.5 * sr)
    write_wav(tmp_path / "a.wav", np.concatenate(x), sr)
    blocks = audio.read_blocks(spark, str(tmp_path / "a.wav"), 4.0)
    assert audio.recordings(blocks).first().n_samples == at
    cfg = Settings(num_speakers=2, overlap_margin=0.0)
    result = plan.diarize(blocks.select("rec", "channel", "block_no", "start_sample", "samples").cache(), cfg)
    segs = result.segments.orderBy("start").collect()
    for a, b, who in truth:
        mine = sum(max(0, min(b, s.end) - max(a, s.start)) for s in segs if s.speaker == who)
        assert mine > 0.7 * (b - a)
    tracks = plan.tracks(blocks.select("rec", "channel", "block_no", "start_sample", "samples"), result, sr, cfg)
    cents = plan.turn_centroids(blocks, result.segments, cfg).collect()
    assert {c.speaker for c in cents} == {0, 1} and all(abs(np.linalg.norm(c.embedding) - 1) < 1e-9 for c in cents)
    files = audio.write_wav(tracks, f"file://{tmp_path}/out", sr).collect()
    assert {f.speaker for f in files} == {0, 1}
    with wave.open(files[0].path.removeprefix("file://")) as w:
        assert w.getnframes() == files[0].n_samples > 0
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2") / 32767
    assert 0.1 < np.abs(x).max() <= 10 ** (cfg.ceiling_db / 20) + 1e-3


def test_silence_gives_nothing(spark):
    levels = signal.frame_levels(blocks_of(spark, np.zeros(16_000), 8000))
    gated = activity.energy_gate(levels, 30.0)
    recs = spark.createDataFrame([(1, 1.0, 0.0)], "rec long, duration double, rms double")
    spans = activity.with_fallback(activity.active_spans(gated, 0.01, 0.2, 0.25), recs)
    assert spans.count() == 0


def test_wav_widths(tmp_path):
    for width, value in ((1, 192), (2, 16384), (3, 4194304), (4, 1073741824)):
        with wave.open(str(tmp_path / "w.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(width)
            w.setframerate(8000)
            w.writeframes(struct.pack("<i", value)[:width] * 3)
        x, sr = audio.decode_wav((tmp_path / "w.wav").read_bytes())
        assert sr == 8000
        assert np.allclose(x, 0.5)


def brute_linkage(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        d = {(a, b): max(1 - u[i] @ u[j] for i in groups[a] for j in groups[b]) for a in range(len(groups)) for b in range(a + 1, len(groups))}
        a, b = min(d, key=d.get)
        groups[a] += groups.pop(b)
    out = np.zeros(len(x), int)
    for n, g in enumerate(sorted(groups, key=min)):
        out[g] = n
    return out


def test_complete_linkage(spark):
    rng = np.random.default_rng(4)
    for n in (2, 5, 17, 30):
        x = rng.normal(size=(n, 6))
        got = clustering.complete_linkage(x, [1, 2, 3])
        for k in got:
            assert np.array_equal(got[k], brute_linkage(x, k))
    w = spark.createDataFrame([(1, i, [float(v) for v in row]) for i, row in enumerate(np.concatenate([rng.normal([5, 0, 0], 0.1, (8, 3)), rng.normal([0, 5, 0], 0.1, (8, 3))]))], "rec long, win_no long, embedding array<double>")
    assert clustering.choose_speakers(w, 1, 3).first().k == 2
    one = spark.createDataFrame([(1, 0, [1.0, 0.0])], "rec long, win_no long, embedding array<double>")
    assert [r.label for r in clustering.cluster_windows(one, None, 2, 3, True, 0.15).collect()] == [0]


def test_silhouette_degenerate(spark):
    rows = [(1, i, 0, [1.0, float(i)]) for i in range(4)] + [(2, i, i, [1.0, float(i)]) for i in range(3)]
    got = {r.rec: r.score for r in speakers.silhouettes(spark.createDataFrame(rows, "rec long, win_no long, label int, embedding array<double>")).collect()}
    assert got == {1: -1.0, 2: -1.0}


def test_turn_ingestion(spark, tmp_path):
    (tmp_path / "t.rttm").write_text("SPEAKER a 1 0.000 4.000 <NA> <NA> X <NA> <NA>\nSPEAKER a 1 3.000 3.000 <NA> <NA> Y <NA> <NA>\nother\n")
    rows = turns.read_rttm(spark, str(tmp_path / "t.rttm")).withColumn("rec", F.lit(1).cast("long"))
    segs, over = turns.ingest(rows)
    assert sorted((r.speaker, r.start, r.end) for r in segs.collect()) == [(0, 0.0, 3.0), (1, 4.0, 6.0)]
    assert [(r.start, r.end) for r in over.collect()] == [(3.0, 4.0)]


def test_backends():
    assert models.resolve("embedding", "missing", "mfcc").name == "mfcc"
    with pytest.raises(RuntimeError):
        models.resolve("embedding", "missing", "mfcc", strict=True)

    def fails_on_many(items):
        if len(items) > 2:
            raise MemoryError
        return items

    assert models.halving(fails_on_many, list(range(7))) == list(range(7))
    assert preset("max").overlap_dilate_sec == 0.30
    assert not preset("off").remove_overlap
    assert set(PRESETS) == {"off", "light", "medium", "strong", "extreme", "max"}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    for i, part in enumerate(events.toPandas().groupby(lambda i: i // 250)):
        spark.createDataFrame(part[1].assign(ts=part[1].ts.astype(str))).selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "value").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    schema = "event_id long, ts timestamp, user_id long, value double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = sessions.sessions(stream, "6 hours", "60 days").writeStream.outputMode("complete").format("memory").queryName("sessions_out").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.rec, r.start, r.n) for r in sessions.sessions(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), "6 hours").collect()}
    assert {(r.rec, r.start, r.n) for r in spark.table("sessions_out").collect()} == want
