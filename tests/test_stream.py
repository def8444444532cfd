"""Blocks that arrive in any order, against the filter of the whole signal."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.operators import signal
from turnweave.streaming import filters


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, filters.STORE)
    yield spark
    spark.conf.set(key, old)


def blocks_of(spark, x, size, rec, channel=0):
    rows = [(rec, channel, i, at, [float(v) for v in x[at : at + size]]) for i, at in enumerate(range(0, len(x), size))]
    return spark.createDataFrame(rows, signal.BLOCKS)


def stream_of(spark, batches, at):
    for i, b in enumerate(batches):
        b.coalesce(1).write.parquet(f"{at}/{i}")
        time.sleep(0.02)  # files are taken in order of their times
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(at))


def run(stream, name, **options):
    return filters.filter_stream(stream, signal.high_pass(16_000, 80.0), **options).writeStream.outputMode("append").format("memory").queryName(name).start()


def until(spark, q, name, rows):
    """Wait for so many rows: a query with timers never runs out of batches."""
    for _ in range(200):
        if spark.table(name).count() >= rows or not q.isActive:
            break
        time.sleep(0.3)
    assert q.exception() is None


def test_shuffled_batches_equal_the_whole(rocks, tmp_path):
    r = np.random.default_rng(3)
    df = blocks_of(rocks, r.normal(size=2000), 250, 1).unionByName(blocks_of(rocks, r.normal(size=1300), 170, 1, 1)).unionByName(blocks_of(rocks, r.normal(size=900), 300, 2)).cache()
    deal = F.pmod(F.xxhash64("rec", "channel", "block_no"), F.lit(4))
    q = run(stream_of(rocks, [df.where(deal == i).orderBy(F.desc("block_no")) for i in range(4)], tmp_path / "s"), "shuffled_out")
    until(rocks, q, "shuffled_out", df.count())
    q.stop()
    got = {(x.rec, x.channel, x.block_no): (x.start_sample, x.samples) for x in rocks.table("shuffled_out").collect()}
    want = signal.filter_blocks(df, signal.high_pass(16_000, 80.0)).collect()
    assert len(got) == len(want) == rocks.table("shuffled_out").count()
    for w in want:
        at, samples = got[w.rec, w.channel, w.block_no]
        assert at == w.start_sample and np.allclose(samples, w.samples, atol=1e-5)


def test_gap_counts_as_silence(rocks, tmp_path):
    """The second of four blocks comes too late: the third waits, then goes on as if the second were silent."""
    x = np.random.default_rng(4).normal(size=1000)
    df = blocks_of(rocks, x, 250, 1).cache()
    q = run(stream_of(rocks, [df.where("block_no in (0, 2, 3)")], tmp_path / "s"), "gap_out", patience_ms=500)
    until(rocks, q, "gap_out", 3)
    df.where("block_no = 1").coalesce(1).write.parquet(f"{tmp_path}/s/late")
    time.sleep(3)
    q.stop()
    x[250:500] = 0
    want = {r.block_no: r.samples for r in signal.filter_blocks(blocks_of(rocks, x, 250, 1), signal.high_pass(16_000, 80.0)).collect()}
    got = {r.block_no: r.samples for r in rocks.table("gap_out").collect()}
    assert set(got) == {0, 2, 3} and all(np.allclose(got[k], want[k], atol=1e-5) for k in got)
