"""Speakers' tracks from blocks, against the same on whole arrays."""

import numpy as np
import pytest


from turnweave.operators import gate, signal, speakers, tracks
from turnweave.plans import diarize as plan
from turnweave.settings import Settings


def cut_at(spark, signals, cuts):
    rows = []
    for (rec, speaker, channel), x in signals.items():
        ends = [0, *[c for c in cuts if c < len(x)], len(x)]
        rows += [(rec, speaker, channel, i, a, [float(v) for v in x[a:b]]) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
    return spark.createDataFrame(rows, tracks.TRACKS).repartition(3)


def wholes(df):
    out = {}
    for r in df.orderBy("start_sample").collect():
        key = (r.rec, r.speaker, r.channel)
        x = out.setdefault(key, [])
        assert r.start_sample == len(x), key
        x.extend(r.samples)
    return {k: np.array(v, dtype=np.float32) for k, v in out.items()}


def plain_compact(x, sr, least=0.004, win=0.040, pad=0.060, gap=0.120, fade=0.005):
    """Channels (rows) of one track without their silence."""
    mono = x.mean(axis=0, dtype=np.float32)
    w, n = max(1, int(win * sr)), x.shape[1]
    if n < w:
        return x
    hot = [np.sqrt(np.mean(mono[i * w : (i + 1) * w].astype(np.float64) ** 2)) > least for i in range(n // w)]
    spans = []
    for i in np.flatnonzero(hot):
        if i and hot[i - 1]:
            spans[-1][1] = (i + 1) * w
        else:
            spans.append([i * w, (i + 1) * w])
    joined = []
    for s, e in ([max(0, s - int(pad * sr)), min(n, e + int(pad * sr))] for s, e in spans):
        if joined and s <= joined[-1][1] + int(gap * sr):
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    xf = max(1, int(fade * sr))
    ramp, pieces = np.linspace(0, 1, xf, dtype=np.float32), []
    for s, e in joined:
        piece = x[:, s:e].copy()
        if pieces and piece.shape[1] > xf and pieces[-1].shape[1] > xf:
            pieces[-1][:, -xf:] *= 1 - ramp
            piece[:, :xf] *= ramp
        pieces.append(piece)
    return np.concatenate(pieces, axis=1) if pieces else x[:, :0]


def test_compact(spark):
    r, sr = np.random.default_rng(2), 1000
    signals = {}
    for rec in range(6):
        n = int(r.integers(3000, 6000))
        loud = np.repeat(r.random(n // 70 + 1) < 0.25, 70)[:n]
        both = (loud * r.normal(size=(2, n)) * 0.1 + 0.0001 * r.normal(size=(2, n))).astype(np.float32)
        for c in range(1 + rec % 2):
            signals[rec, rec % 3, c] = both[c]
    signals[6, 0, 0] = np.zeros(2000, np.float32)
    signals[7, 0, 0] = np.ones(39, np.float32)
    signals[8, 0, 0] = signals[8, 0, 1] = np.array([*[1] * 20, *[0] * 20] * 60, dtype=np.float32) * 0.0039
    signals[9, 0, 0] = np.concatenate([np.ones(41), np.zeros(400), np.ones(41)]).astype(np.float32)
    for options in ({}, {"pad_sec": 0.0, "gap_sec": 0.0, "fade_sec": 0.03}, {"pad_sec": 0.0, "fade_sec": 0.001}):
        got = wholes(tracks.compact(cut_at(spark, signals, [1, 90, 91, 1500, 2222]), sr, size=512, **options))
        named = {"pad_sec": "pad", "gap_sec": "gap", "fade_sec": "fade"}
        for rec, speaker in {k[:2] for k in signals}:
            x = np.stack([signals[k] for k in sorted(signals) if k[0] == rec])
            want = plain_compact(x, sr, **{named[k]: v for k, v in options.items()})
            for c in range(len(x)):
                mine = got.get((rec, speaker, c), np.zeros(0))
                assert len(mine) == want.shape[1] and np.allclose(mine, want[c], atol=1e-6), (rec, c, options)
    assert tracks.compact(spark.createDataFrame([], tracks.TRACKS), sr).count() == 0


def test_injected(spark):
    r, sr = np.random.default_rng(3), 100
    signals = {(1, 0, 0): r.normal(size=1000), (1, 1, 0): r.normal(size=1000), (2, 0, 0): r.normal(size=700), (2, 0, 1): r.normal(size=700)}
    signals = {k: v.astype(np.float32) for k, v in signals.items()}
    adds = [(1, 0, 2.004, 0, 300), (1, 0, 4.0, 0, 333), (1, 0, 9.5, 0, 200), (1, 0, 12.0, 0, 50), (2, 0, -1.0, 0, 40), (2, 0, 3.0, 0, 120), (2, 0, 3.0, 1, 120), (1, 0, 0.5, 0, 10), (1, 0, 0.5, 1, 10), (3, 0, 0.0, 0, 10)]
    rows = [(rec, spk, t, c, [float(v) for v in np.float32(r.normal(size=n))]) for rec, spk, t, c, n in adds]
    df = spark.createDataFrame(rows, "rec long, speaker int, start double, channel int, samples array<float>")
    want = {k: v.copy() for k, v in signals.items()}
    timed = {}
    for rec, spk, t, c, x in rows:
        timed.setdefault((rec, spk, t), {})[c] = np.array(x, dtype=np.float32)
    for (rec, spk, t), by in timed.items():
        for k, track in want.items():
            if k[:2] == (rec, spk):
                stereo = (rec, spk, 1) in want
                add = by[0] if len(by) == 1 else by[k[2]] if stereo else np.mean([by[0], by[1]], axis=0)
                i = max(0, int(round(t * sr)))
                add = add[: max(0, len(track) - i)]
                track[i : i + len(add)] += add
    got = wholes(tracks.injected(cut_at(spark, signals, [3, 500]), df, sr, 128))
    assert set(got) == set(want)
    for k, v in want.items():
        assert np.allclose(got[k], v, atol=1e-5), k
    none = wholes(tracks.injected(cut_at(spark, signals, [500]), df.limit(0), sr, 128))
    assert all(np.array_equal(none[k], v) for k, v in signals.items())


def run_filter(x, sections):
    for b0, b1, b2, a1, a2 in sections:
        y, z1, z2 = [], 0.0, 0.0
        for v in x:
            o = b0 * v + z1
            z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
            y.append(o)
        x = np.array(y)
    return x


@pytest.mark.parametrize("stereo", [False, True])
def test_chain_links_channels(spark, stereo):
    """Filters by channel, one compressor gain for both channels of a block, one gain for the recording: against plain loops."""
    r, sr, block = np.random.default_rng(4), 1000, 400
    x = r.normal(size=(1 + stereo, 1000)) * 0.3
    x[-1] *= np.linspace(0, 2, 1000)
    sections = [*signal.high_pass(sr, 80.0), signal.peaking(sr, 200.0, 3.0, 1.0)]
    rows = [(7, c, i, i * block, [float(v) for v in x[c, i * block : (i + 1) * block]]) for c in range(len(x)) for i in range(3)]
    df = spark.createDataFrame(rows, signal.BLOCKS)
    gains = spark.createDataFrame([(7, 1.7)], "rec long, gain double")
    got = tracks.chain(df, gains, sr, sections, 0.9, -22.0, 3.0).collect()
    y = np.stack([run_filter(c.astype(np.float32).astype(np.float64), sections).astype(np.float32) for c in x]).astype(np.float64)
    for i in range(3):
        part = y[:, i * block : (i + 1) * block]
        over = [-max(0.0, 20 * np.log10(max(abs(v) for v in part[:, j]) + 1e-9) + 22) * (1 - 1 / 3) for j in range(part.shape[1])]
        at = lambda j, over=over: over[min(max(j, 0), len(over) - 1)]
        mean = np.array([np.mean([at(j - 12 + m) for m in range(25)]) for j in range(len(over))])
        want = np.tanh(part * 10 ** (mean / 20) * 1.7 / 0.9) * 0.9
        for c in range(len(x)):
            mine = next(g.samples for g in got if g.channel == c and g.block_no == i)
            assert np.allclose(mine, want[c], atol=1e-4)


def test_equal_channels_are_as_loud_as_one(spark):
    sr, t = 48_000, np.arange(48_000 * 2) / 48_000
    tone = (0.2 * np.sin(2 * np.pi * 997 * t)).astype(np.float32)
    rows = [(rec, c, i, i * 30_000, [float(v) for v in tone[i * 30_000 : (i + 1) * 30_000]]) for rec in (1, 2) for c in range(rec) for i in range(4)]
    df = spark.createDataFrame(rows, signal.BLOCKS)
    proxy, rate = tracks.loudness_proxy(df, sr)
    assert rate == 16_000
    got = {}
    for r in proxy.orderBy("start_sample").collect():
        got.setdefault(r.rec, []).extend(r.samples)
    assert np.allclose(got[1], tone[::3]) and np.allclose(got[2], tone[::3])
    lufs = {r.rec: r.lufs for r in signal.loudness(signal.hop_squares(signal.filter_blocks(proxy, signal.k_weighting(rate)), rate)).collect()}
    assert abs(lufs[1] - lufs[2]) < 1e-6 and abs(lufs[1] - (20 * np.log10(0.2) - 3.01)) < 0.2


def test_fades_and_whole_length(spark):
    """A mask with real fades, over blocks, is the moving average of the whole mask; a track lasts as long as its recording."""
    x, sr, fade = np.random.default_rng(5).normal(size=1000).astype(np.float32), 1000, 8
    df = spark.createDataFrame([(1, 0, i, i * 128, [float(v) for v in x[i * 128 : (i + 1) * 128]]) for i in range(8)], signal.BLOCKS)
    spans = spark.createDataFrame([(1, 0, 0.050, 0.128), (1, 0, 0.131, 0.2), (1, 1, 0.9, 1.2)], "rec long, speaker int, start double, end double")
    got = wholes(signal.masked(df, spans, sr, fade))
    for spk, on in ((0, [(50, 128), (131, 200)]), (1, [(900, 1000)])):
        mask = np.zeros(1000)
        for a, b in on:
            mask[a:b] = 1
        faded = np.clip(np.convolve(mask, np.ones(fade) / fade, "same"), 0, 1)
        mine = got[1, spk, 0]
        assert len(mine) == 1000
        assert np.allclose(mine, x * faded, atol=1e-6)


def test_switches(spark):
    x = (0.1 * np.random.default_rng(6).normal(size=16_000)).astype(np.float32)
    df = spark.createDataFrame([(1, 0, i, i * 4000, [float(v) for v in x[i * 4000 : (i + 1) * 4000]]) for i in range(4)], signal.BLOCKS).cache()
    segs = spark.createDataFrame([(1, 0, 0.1, 0.9)], "rec long, speaker int, start double, end double")
    result = plan.Result(segs, segs.limit(0), segs.limit(0), segs.limit(0), segs.limit(0).select("rec", "speaker", "start", "end"))
    raw = wholes(plan.tracks(df, result, 16_000, Settings(enhance=False)))[1, 0, 0]
    assert np.allclose(raw[2000:14_000], x[2000:14_000]) and not raw[:1000].any() and len(raw) == len(x)
    soft, hard = (wholes(plan.tracks(df, result, 16_000, Settings(compress=c, highpass_hz=0, presence_db=0, air_db=0)))[1, 0, 0] for c in (True, False))
    # without a compressor and filters a track is its mask times a gain, limited
    ceiling = 10 ** (Settings().ceiling_db / 20)
    back = np.arctanh(np.clip(hard[2000:14_000] / ceiling, -0.999999, 0.999999)) * ceiling
    gain = back / x[2000:14_000]
    some = np.abs(x[2000:14_000]) > 0.02
    assert gain[some].std() < 1e-2 * gain[some].mean() and not np.allclose(soft, hard, atol=1e-3)


def test_routing_by_chunk(spark):
    cents = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "rec long, speaker int, embedding array<double>")
    near = lambda lead: [float((2 - lead**2) ** 0.5 + lead) / 2, float((2 - lead**2) ** 0.5 - lead) / 2]  # noqa: E731  of unit length, ahead by lead
    rows = [(1, 0, 0, [1.0, 0.0]), (1, 0, 1, near(-0.02)), (1, 1, 0, [1.0, 0.0]), (1, 1, 1, near(-0.5)), (1, 2, 0, [1.0, 0.0]), (1, 2, 1, near(0.02)), (1, 3, 0, [1.0, 0.0]), (1, 3, 1, None)]
    got = speakers.route_sources(spark.createDataFrame(rows, "rec long, chunk long, source int, embedding array<double>"), cents, 0.10)
    assert {(r.chunk, r.reason) for r in got.collect()} == {(0, "low"), (1, "ok"), (2, "same"), (3, "short")}
    counted = {r.reason: (r.n, r.max_lead) for r in gate.reasons(got).collect()}
    assert {k: v[0] for k, v in counted.items()} == {"low": 1, "ok": 1, "same": 1, "short": 1}
    assert abs(counted["low"][1] - 0.02) < 1e-6 and counted["short"][1] is None


def test_speaker_without_windows(spark):
    rng = np.random.default_rng(7)
    x = 0.1 * rng.normal(size=48_000)
    df = spark.createDataFrame([(1, 0, i, i * 16_000, [float(v) for v in x[i * 16_000 : (i + 1) * 16_000]]) for i in range(3)], signal.BLOCKS)
    segs = spark.createDataFrame([(1, 0, 0.0, 2.5), (2, 0, 0.0, 2.0)], "rec long, speaker int, start double, end double")
    got = {r.rec: r for r in plan.turn_centroids(df, segs, Settings()).collect()}
    assert got[2].embedding == [0.0] * len(got[1].embedding) and got[2].n == 0 and got[1].n > 0
    assert abs(np.linalg.norm(got[1].embedding) - 1) < 1e-9
