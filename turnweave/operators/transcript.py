"""Words to speakers, cues and turns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUE_TYPES = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.int64())


def assign_words(words: DataFrame, segments: DataFrame, bucket: float = 30.0) -> DataFrame:
    """words (rec, word_no, start, end, text) with speaker: of the first segment (rec, span_id, speaker, start, end), by start, that contains the
    word's midpoint, ends included; else of the nearest segment, the earlier of equals; -1 without segments.

    Containment joins by recording and time bucket. What is left over looks back to the greatest end before and ahead to the
    least start after, by one ordered pass over words and segments, so far-off segments are found without any bucket limit.
    """
    mid = words.withColumn("_mid", (F.col("start") + F.col("end")) * 0.5)
    segs = segments.where("end >= start").select("rec", F.col("span_id").alias("_sid"), F.col("speaker").alias("_spk"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    by_bucket = segs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / bucket), F.floor(F.col("_e") / bucket))))
    inside = mid.withColumn("_b", F.floor(F.col("_mid") / bucket)).join(by_bucket, ["rec", "_b"]).where("_mid between _s and _e")
    inside = inside.groupBy("rec", "word_no").agg(F.min(F.struct("_s", "_sid", "_spk")).alias("_hit"))
    left = mid.join(inside, ["rec", "word_no"], "left")
    found = left.where("_hit is not null").withColumn("speaker", F.col("_hit._spk"))
    lost = left.where("_hit is null")
    ends = segs.select("rec", F.col("_e").alias("_t"), F.lit(0).alias("_o"), F.lit(None).cast("long").alias("word_no"), F.struct("_e", (-F.col("_s")).alias("ns"), (-F.col("_sid")).alias("nid"), "_spk").alias("_end"), F.lit(None).cast("struct<_s:double,_sid:bigint,_spk:int>").alias("_start"))
    starts = segs.select("rec", F.col("_s").alias("_t"), F.lit(2).alias("_o"), F.lit(None).cast("long").alias("word_no"), F.lit(None).cast("struct<_e:double,ns:double,nid:bigint,_spk:int>").alias("_end"), F.struct("_s", F.col("_sid").cast("long").alias("_sid"), F.col("_spk").cast("int").alias("_spk")).alias("_start"))
    ends = ends.withColumn("_end", F.col("_end").cast("struct<_e:double,ns:double,nid:bigint,_spk:int>"))
    asks = lost.select("rec", F.col("_mid").alias("_t"), F.lit(1).alias("_o"), "word_no", F.lit(None).cast("struct<_e:double,ns:double,nid:bigint,_spk:int>").alias("_end"), F.lit(None).cast("struct<_s:double,_sid:bigint,_spk:int>").alias("_start"))
    line = ends.unionByName(starts).unionByName(asks)
    order, back_order = Window.partitionBy("rec").orderBy("_t", "_o"), Window.partitionBy("rec").orderBy(F.desc("_t"), F.desc("_o"))
    line = line.withColumn("_before", F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.min("_start").over(back_order.rowsBetween(Window.unboundedPreceding, -1)))
    near = line.where("word_no is not null")
    back, ahead = F.col("_t") - F.col("_before._e"), F.col("_after._s") - F.col("_t")
    first_is_back = F.coalesce(ahead.isNull() | (back < ahead) | ((back == ahead) & (-F.col("_before.ns") <= F.col("_after._s"))), F.lit(False)) & back.isNotNull()
    near = near.select("rec", "word_no", F.coalesce(F.when(first_is_back, F.col("_before._spk")).otherwise(F.col("_after._spk")), F.lit(-1)).alias("speaker"))
    rest = lost.join(near, ["rec", "word_no"])
    cols = [*words.columns, "speaker"]
    return found.withColumn("speaker", F.col("speaker").cast("int")).select(cols).unionByName(rest.withColumn("speaker", F.col("speaker").cast("int")).select(cols))


def cues(words: DataFrame, max_sec: float = 6.0, max_words: int = 14) -> DataFrame:
    """Greedy cues of labelled words: rec, cue_no, start, end, speaker, text, n_words.

    A word begins a cue if its speaker differs, the cue would exceed ``max_sec``, or it has ``max_words`` words. Where a cue breaks depends on
    where the last one did, so the words of a recording pass in order through one fold, which holds the cue that is open and nothing else. Cues without text are numbered and left out.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec, no, cue, done = None, 0, None, []
        for batch in batches:
            for r, start, end, text, speaker in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cue is None or r != rec or speaker is None or speaker != cue[4] or end - cue[7] > max_sec or cue[6] >= max_words:
                    if cue is not None:
                        done.append(cue)
                    no = no + 1 if r == rec else 1
                    rec, cue = r, [r, no, start, end, speaker, [text or ""], 1, start]
                else:
                    cue[2], cue[3], cue[6] = min(cue[2], start), max(cue[3], end), cue[6] + 1
                    cue[5].append(text or "")
            yield batch_of(done)
            done = []
        if cue is not None:
            yield batch_of([cue])

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        rows = [(*r[:5], "".join(r[5]).strip(" "), r[6]) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows if r[5]], t) for i, t in enumerate(CUE_TYPES)], ["rec", "cue_no", "start", "end", "speaker", "text", "n_words"])

    ordered = words.select("rec", "word_no", "start", "end", "text", "speaker").repartition("rec").sortWithinPartitions("rec", "word_no").drop("word_no")
    return ordered.mapInArrow(fold, "rec long, cue_no long, start double, end double, speaker int, text string, n_words long")


def turns(cue_rows: DataFrame) -> DataFrame:
    """Consecutive cues of one speaker as one turn: rec, turn_no, start, end, speaker, text."""
    order = Window.partitionBy("rec").orderBy("cue_no")
    fresh = F.when(F.lag("speaker").over(order) == F.col("speaker"), 0).otherwise(1)
    marked = cue_rows.withColumn("_f", fresh).withColumn("turn_no", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("cue_no", "text"))), lambda x: x["text"])
    return marked.groupBy("rec", "turn_no", "speaker").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(texts, " ").alias("text")).select("rec", "turn_no", "start", "end", "speaker", "text")
