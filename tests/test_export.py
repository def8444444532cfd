from turnweave.operators import export
from turnweave.functions import text
from pyspark.sql import functions as F


def test_times(spark):
    df = spark.createDataFrame([(59.9996,), (1.001,), (3725.5,)], "t double")
    got = df.select(text.hms(F.col("t")).alias("a"), text.subtitle_time(F.col("t"), ",").alias("b"), text.hms(F.col("t"), 2).alias("c")).collect()
    assert [r.a for r in got] == ["00:00:60.000", "00:00:01.001", "01:02:05.500"]
    assert [r.b for r in got] == ["00:00:59,999", "00:00:01,000", "01:02:05,500"]
    assert got[2].c == "01:02:05.50"


def test_lines_and_files(spark, tmp_path):
    segs = spark.createDataFrame([(1, 0, 0.0, 1.5), (1, 1, 1.5, 2.0)], "rec long, speaker int, start double, end double")
    assert [tuple(r)[1:] for r in export.csv_rows(segs).collect()] == [("0.000", "1.500", "1.500", "SPEAKER_1"), ("1.500", "2.000", "0.500", "SPEAKER_2")]
    assert export.rttm_lines(segs).first().line == "SPEAKER 1 1 0.000 1.500 <NA> <NA> SPEAKER_1 <NA> <NA>"
    cues = spark.createDataFrame([(1, 1, 0.0, 1.0, -1, "hi"), (1, 2, 1.0, 2.0, 0, "ho")], "rec long, cue_no long, start double, end double, speaker int, text string")
    assert [r.block for r in export.srt_blocks(cues).orderBy("number").collect()] == ["1\n00:00:00,000 --> 00:00:01,000\n[UNKNOWN] hi\n", "2\n00:00:01,000 --> 00:00:02,000\n[SPEAKER_1] ho\n"]
    export.write_all(segs, str(tmp_path / "out"), cues)
    assert spark.read.text(str(tmp_path / "out/rttm")).count() == 2
    assert spark.read.csv(str(tmp_path / "out/csv"), header=True).columns[:4] == ["start_sec", "end_sec", "duration_sec", "speaker"]


def test_sizes(spark):
    df = spark.createDataFrame([(5,), (2048,), (3 * 1048576,)], "n long")
    assert [r[0] for r in df.select(text.file_size(F.col("n"))).collect()] == ["5 B", "2.0 KB", "3.0 MB"]
