"""Set-based operators against sequential models."""

import random

import pytest
from pyspark.sql import functions as F

from turnweave.operators import frames, intervals, transcript, windows


def random_spans(seed, recs=40, most=9, top=60):
    r = random.Random(seed)
    rows, i = [], 0
    for rec in range(recs):
        for _ in range(r.randint(0, most)):
            a = r.randint(0, top) / 4
            rows.append((rec, i, r.randint(0, 2), a, a + r.randint(1, 20) / 4))
            i += 1
    return rows


SPANS = "rec long, span_id long, speaker int, start double, end double"


def merged(spans, gap):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("gap", [0.0, 0.25, 1.0])
def test_merge(spark, gap):
    rows = random_spans(1)
    got = intervals.merge_gaps(spark.createDataFrame(rows, SPANS), gap).orderBy("rec", "start").collect()
    want = [(rec, *x) for rec in sorted({r[0] for r in rows}) for x in merged([r[3:] for r in rows if r[0] == rec], gap)]
    assert [(r.rec, r.start, r.end) for r in got] == want


def test_subtract(spark):
    own, cut = random_spans(2), random_spans(3)
    got = {(r.rec, r.span_id, r.start, r.end) for r in intervals.subtract(spark.createDataFrame(own, SPANS), spark.createDataFrame(cut, SPANS), bucket=3.0).collect()}
    want = set()
    for rec, i, _, s, e in own:
        pieces = [(s, e)]
        for a, b in [r[3:] for r in cut if r[0] == rec]:
            pieces = [p for x, y in pieces for p in ([(x, y)] if b <= x or a >= y else [(x, min(a, y)), (max(b, x), y)]) if p[1] > p[0]]
        want |= {(rec, i, *p) for p in pieces if p[1] - p[0] > 1e-3}
    assert got == want


def test_subtract_splits(spark):
    own = spark.createDataFrame([(1, 1, 0, 0.0, 10.0)], SPANS)
    cut = spark.createDataFrame([(1, 1, 0, 2.0, 3.0), (1, 2, 0, 2.5, 4.0)], SPANS)
    assert sorted((r.start, r.end) for r in intervals.subtract(own, cut).collect()) == [(0.0, 2.0), (4.0, 10.0)]


@pytest.mark.parametrize(("length", "want"), [(2.25, [(0, 1.5), (0.75, 2.25), (0.75, 2.25)]), (1.5, [(0, 1.5)]), (0.4, [(0, 0.4)]), (3.0, [(0, 1.5), (0.75, 2.25), (1.5, 3.0)])])
def test_sliding_windows(spark, length, want):
    df = spark.createDataFrame([(1, 1, 0, 0.0, float(length))], SPANS)
    got = windows.sliding_windows(df, 1.5, 0.75, 1.0).orderBy("win_no").collect()
    if length == 3.0:
        want = [*want, (1.5, 3.0)]
    assert [(r.start, r.end) for r in got] == [(float(a), float(b)) for a, b in want]
    assert length != 0.4 or got[0].audio_end - got[0].audio_start == 1.0


def smooth(labels, least):
    runs, i = [], 0
    while i < len(labels):
        j = i
        while j < len(labels) and labels[j] == labels[i]:
            j += 1
        runs.append((i, j, labels[i]))
        i = j
    out = list(labels)
    for k, (a, b, x) in enumerate(runs):
        near = [runs[m] for m in (k - 1, k + 1) if 0 <= m < len(runs) and runs[m][2] >= 0]
        if x >= 0 and b - a < least and near:
            out[a:b] = [max(near, key=lambda r: r[1] - r[0])[2]] * (b - a)
    return out


def test_smoothing(spark):
    r = random.Random(5)
    rows, want = [], {}
    for rec in range(60):
        labels = [x for _ in range(r.randint(1, 12)) for x in [r.choice([-2, -1, 0, 1, 2])] * r.randint(1, 6)]
        rows += [(rec, i, x) for i, x in enumerate(labels) if x != -1]
        want |= {(rec, i): x for i, x in enumerate(smooth(labels, 4)) if x != -1}
    df = spark.createDataFrame(rows, "rec long, frame long, label int")
    out = frames.smooth_short_runs(frames.label_runs(df), 4)
    got = {(x.rec, x.frame): x.label for x in out.select("rec", "label", F.explode(F.sequence("first", F.col("past") - 1)).alias("frame")).collect()}
    assert got == want


def test_votes_and_ids(spark):
    w = spark.createDataFrame([(1, 0.0, 0.02, 0), (1, 0.0, 0.02, 1), (1, 0.02, 0.03, -2), (1, 0.02, 0.03, 1), (1, 0.05, 0.06, 2)], "rec long, start double, end double, label int")
    got = {r.frame: r.label for r in frames.frame_votes(w).collect()}
    assert got == {0: 0, 1: 0, 2: -2, 5: 2}
    s = spark.createDataFrame([(1, 2, 0.0), (1, 0, 1.0), (1, 2, 2.0), (1, 1, 3.0)], "rec long, speaker int, start double")
    assert [r.speaker for r in frames.canonical_ids(s).orderBy("start").collect()] == [0, 1, 0, 2]


def test_word_speakers(spark):
    r = random.Random(7)
    segs = [x for x in random_spans(8, 25, 5)]
    words = [(rec, i, t, t + 0.5, f" w{i}") for rec in range(25) for i, t in enumerate(r.randint(0, 90) / 4 + 0.125 * r.randint(0, 1) for _ in range(8))]
    got = {(x.rec, x.word_no): x.speaker for x in transcript.assign_words(spark.createDataFrame(words, "rec long, word_no long, start double, end double, text string"), spark.createDataFrame(segs, SPANS), bucket=2.0).collect()}
    for rec, i, a, b, _ in words:
        t, best, far = (a + b) / 2, -1, 1e18
        for _, _, spk, s, e in sorted((x for x in segs if x[0] == rec), key=lambda x: (x[3], x[1])):
            if s <= t <= e:
                best = spk
                break
            if (d := min(abs(t - s), abs(t - e))) < far:
                best, far = spk, d
        assert got[rec, i] == best, (rec, i)


def test_cue_limits(spark):
    words = [(1, i, i * 0.3, i * 0.3 + 0.2, f" w{i}", 0) for i in range(15)] + [(1, 15, 10.0, 10.2, " x", 1)]
    got = transcript.cues(spark.createDataFrame(words, "rec long, word_no long, start double, end double, text string, speaker int")).orderBy("cue_no").collect()
    assert [(r.n_words, r.speaker) for r in got] == [(14, 0), (1, 0), (1, 1)]
