"""What crosses blocks, against the same on whole arrays."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.operators import clustering, linkage, spectral, tiles


def cut_at(spark, signals, cuts):
    """Blocks (rec, channel, ...) of arrays by (rec, channel), cut at the given places."""
    rows = []
    for (rec, channel), x in signals.items():
        ends = [0, *[c for c in cuts if c < len(x)], len(x)]
        rows += [(rec, channel, i, a, [float(v) for v in x[a:b]]) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
    return spark.createDataFrame(rows, tiles.BLOCKS).repartition(3)


def whole(df, rec, channel=0):
    rows = df.where((F.col("rec") == rec) & (F.col("channel") == channel)).orderBy("start_sample").collect()
    at = 0
    for r in rows:
        assert r.start_sample == at
        at += len(r.samples)
    return np.concatenate([np.array(r.samples, dtype=np.float32) for r in rows]) if rows else np.zeros(0, np.float32)


def plain_gate(x, strength):
    """The gate on one array."""
    size, hop = 1024, 256
    if len(x) < size:
        return x
    w = np.hanning(size + 1)[:-1]
    padded = np.concatenate([np.zeros(size // 2), x, np.zeros(size // 2 + (-len(x)) % hop)])
    count = 1 + (len(padded) - size) // hop
    spec = np.array([np.fft.rfft(padded[i * hop : i * hop + size] * w) / w.sum() for i in range(count)])
    mag = np.abs(spec)
    floor = np.percentile(mag, 10, axis=0, keepdims=True)
    spec = spec * np.clip((mag - strength * 1.5 * floor) / (mag + 1e-9), 0, 1)
    out, weight = np.zeros(len(padded)), np.zeros(len(padded))
    for i in range(count):
        out[i * hop : i * hop + size] += np.fft.irfft(spec[i], n=size) * w * w.sum()
        weight[i * hop : i * hop + size] += w * w
    return (out / np.where(weight > 1e-10, weight, 1))[size // 2 : size // 2 + len(x)]


def test_recut(spark):
    x = np.arange(100, dtype=np.float32)
    df = cut_at(spark, {(1, 0): x, (2, 1): x[:30]}, [1, 2, 40, 41, 77])
    got = {(r.rec, r.tile): (r.start_sample, r.samples) for r in tiles.recut(df, 30, 7, 50).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
    for (rec, t), (at, s) in got.items():
        lo = max(0, t * 30 - 7)
        assert at == lo and s == list(x[: 100 if rec == 1 else 30][lo : (t + 1) * 30 + 50])
    assert np.array_equal(whole(tiles.reblocked(df, 33), 1), x)


def test_chunks_and_back(spark):
    """Recordings of lengths around 1.25 chunks and around what another chunk begins at; all in one table."""
    sr, size, fade = 100, 100, 30
    r = np.random.default_rng(1)
    signals = {(n, 0): r.normal(size=n).astype(np.float32) for n in (1, 99, 100, 124, 125, 126, 170, 171, 240, 241, 1000)}
    df = cut_at(spark, signals, [3, 50, 51, 700])
    parts = tiles.chunks(df, sr, 1.0).cache()
    # a model that differs by chunk and loses a sample
    shorter = F.slice("samples", 1, F.greatest(F.lit(1), F.size("samples") - 1))
    changed = tiles.crossfaded(parts.withColumn("samples", F.transform(shorter, lambda v: v * (F.col("chunk") + 1))), sr, 64).cache()
    same, by = tiles.crossfaded(parts, sr, 64).cache(), {}
    for p in parts.orderBy("chunk").collect():
        by.setdefault(p.rec, []).append(p)
    for (n, _), x in signals.items():
        starts = [0] if n <= 125 else [s for s in range(0, n, size - fade) if s == 0 or s + fade < n]
        assert [p.start_sample for p in by[n]] == starts
        out, weight = np.zeros(n), np.zeros(n)
        for i, p in enumerate(by[n]):
            s, end = p.start_sample, n if len(starts) == 1 else min(n, p.start_sample + size)
            assert np.array_equal(np.array(p.samples, np.float32), x[s:end]) and p.total == n and p.chunks == len(starts)
            piece = (x[s:end] * (i + 1))[: max(1, end - s - 1)]
            w, f = np.ones(len(piece)), min(fade, len(piece))
            if s > 0:
                w[:f] *= np.linspace(0, 1, f)
            if s + len(piece) < n:
                w[-f:] *= np.linspace(1, 0, f)
            out[s : s + len(piece)] += piece * w
            weight[s : s + len(piece)] += w
        assert np.allclose(whole(same, n), x, atol=1e-6)
        got = whole(changed, n)
        assert np.allclose(got, (out / np.where(weight == 0, 1, weight))[: len(got)], atol=1e-5)
    assert tiles.chunks(df, sr, 0.0).count() == len(signals)
    assert tiles.chunks(spark.createDataFrame([], tiles.BLOCKS), sr, 1.0).count() == 0


@pytest.mark.parametrize(("size", "hop", "sr", "block", "batch", "lot"), [(20, 14, 20, 16, 3, 1), (9, 3, 20, 2, 10_000, 50), (8, 7, 1, 5, 1, 1 << 18), (40, 10, 100, 100, 7, 1 << 18)])
def test_crossfade_over_batches(spark, monkeypatch, size, hop, sr, block, batch, lot):
    """Batches and lots of any length give the same: chunks that come back short, long or empty, samples in three or four chunks, fades of one sample."""
    r, fade, parts, want = np.random.default_rng(4), max(1, int(0.3 * sr)), [], {}
    for rec, n in enumerate([1, size, *map(int, r.integers(2, 200, 20))]):
        for channel in (0, 1):
            out, weight, seen = np.zeros(n), np.zeros(n), set()
            for s in range(0, n, hop):
                x = r.normal(size=max(0, min(n, s + size) - s + int(r.choice([0, 0, -1, 3, -50])))).astype(np.float32)
                parts.append((rec, channel, s, n, [float(v) for v in x]))
                x = x[: n - s]
                w, f = np.ones(len(x)), min(fade, len(x))
                if s > 0:
                    w[:f] *= np.linspace(0, 1, f)
                if s + len(x) < n:
                    w[len(x) - f :] *= np.linspace(1, 0, f)
                out[s : s + len(x)] += w * x
                weight[s : s + len(x)] += w
                seen |= {(rec, channel, no) for no in range(s // block, -(-(s + len(x)) // block))}
            out /= np.where(weight == 0, 1, weight)
            want |= {k: out[k[2] * block : (k[2] + 1) * block] for k in seen}
    df = spark.createDataFrame(parts, "rec long, channel int, start_sample long, total long, samples array<float>").repartition(3)
    monkeypatch.setattr(tiles, "LOT", lot)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = tiles.crossfaded(df, sr, block).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rows) == len(want) and {(g.rec, g.channel, g.block_no) for g in rows} == set(want)
    for g in rows:
        assert g.start_sample == g.block_no * block and np.allclose(g.samples, want[g.rec, g.channel, g.block_no], atol=1e-6)


def test_crossfade_of_many_blocks(spark):
    """Short blocks cost by the sample: 30,000 of them, where a call and a frame of pandas for each took minutes."""
    chunk = spark.range(6000).select(F.col("id").alias("rec"), F.lit(0).alias("channel"), F.lit(20).cast("long").alias("total"), F.explode(F.expr("array(0L, 9L)")).alias("start_sample"))
    parts = chunk.withColumn("samples", F.transform(F.sequence(F.col("start_sample"), F.least(F.col("start_sample") + 11, F.lit(19))), lambda i: (i + F.col("rec")).cast("float")))
    out = tiles.crossfaded(parts, 10, 4)
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    t = time.perf_counter()
    got = out.select("rec", "start_sample", F.posexplode("samples").alias("j", "x")).selectExpr("count(*)", "count_if(abs(x - rec - start_sample - j) < 1e-3)").first()
    assert tuple(got) == (120_000, 120_000)
    assert time.perf_counter() - t < 40


def test_spectral_gate_over_blocks(spark):
    r = np.random.default_rng(0)
    tone = np.sin(np.arange(9000) / 9) * (np.arange(9000) % 4000 > 2000)
    signals = {(1, 0): tone + 0.05 * r.normal(size=9000), (1, 1): 0.1 * r.normal(size=9000), (2, 0): r.normal(size=4096), (3, 0): r.normal(size=1024), (4, 0): r.normal(size=1023), (5, 0): np.zeros(3000), (6, 0): np.concatenate([np.zeros(5000), r.normal(size=1001)])}
    signals = {k: v.astype(np.float32) for k, v in signals.items()}
    for cuts in ([5, 6, 1000, 1001, 2500, 6000], []):
        out = spectral.spectral_gate(cut_at(spark, signals, cuts), 0.85, 2048).cache()
        for (rec, channel), x in signals.items():
            assert np.allclose(whole(out, rec, channel), plain_gate(x.astype(np.float64), 0.85), atol=2e-6), (rec, channel)
    blocks = cut_at(spark, signals, [777])
    t = spectral.tiles_of(blocks, 1024)
    floors = {(f.rec, f.channel): f.floors for f in spectral.noise_floors(t, 1024).collect()}
    assert set(floors) == {k for k, v in signals.items() if len(v) >= 1024}
    assert spectral.spectral_gate(spark.createDataFrame([], tiles.BLOCKS), 0.85).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        spectral.spectral_gate(blocks, 0.85, 1000)


WINDOWS = "rec long, win_no long, embedding array<double>"


def test_linkage_in_rounds(spark):
    """Labels of recordings merged in rounds, blocks of a few windows, against one matrix; many equal distances."""
    r = np.random.default_rng(7)
    recs = {1: r.normal(size=(70, 5)), 2: r.integers(0, 2, (60, 3)).astype(float), 3: np.repeat(r.normal(size=(9, 4)), 7, axis=0), 4: r.normal(size=(3, 4)), 5: r.normal([3, 0, 0], 0.2, (40, 3)), 6: np.zeros((30, 2))}
    rows = [(rec, 10 * i, [float(v) for v in row]) for rec, x in recs.items() for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, WINDOWS)
    ks = [1, 2, 3, 8, 25]
    for limit in (25, 10_000):
        got = {}
        for g in clustering.agglomerative(df, ks, limit).collect():
            got.setdefault((g.rec, g.k), {})[g.win_no] = g.label
        for rec, x in recs.items():
            for k, labels in clustering.complete_linkage(x, sorted({min(k, len(x)) for k in ks})).items():
                assert [got[rec, k][10 * i] for i in range(len(x))] == list(labels), (limit, rec, k)
        assert len(got) == sum(len({min(k, len(x)) for k in ks}) for x in recs.values())
    tree = linkage.merges(df.where("rec in (3, 4, 5)"), 9, 7).toPandas()
    for rec, x in ((k, recs[k]) for k in (3, 4, 5)):
        unit = linkage.unit_rows(x)
        want = linkage.merge_matrix(linkage.cosine_distances(unit, unit))
        mine = tree[tree.rec == rec].sort_values(["height", "lo", "hi"])
        assert sorted(want) == [(h, a // 10, b // 10) for h, a, b in zip(mine.height, mine.lo, mine.hi)]
