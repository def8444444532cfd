"""Agglomerative clustering of a recording's windows, and choosing the number of speakers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.operators import linkage
from turnweave.operators.speakers import mark_overlaps, silhouettes, single_speaker_score
from turnweave.sources.scratch import written

#: Windows whose distances are held in one task (200 MB); longer recordings are clustered in rounds by many.
MOST_WINDOWS = 5_000


def complete_linkage(x: np.ndarray, ks: list[int]) -> dict[int, np.ndarray]:
    """Labels of complete-linkage clusterings by cosine distance for each k, numbered by first row. Of equal
    distances the pair with the first rows merges first."""
    n = len(x)
    unit = linkage.unit_rows(x)
    done = linkage.merge_matrix(linkage.cosine_distances(unit, unit), max(1, min(ks, default=1)))
    of, out = np.arange(n), {}
    for i in range(len(done) + 1):
        if n - i in ks:
            out[n - i] = np.unique(of, return_inverse=True)[1]
        if i < len(done):
            of[of == done[i][2]] = done[i][1]
    return out


def agglomerative(windows: DataFrame, ks: list[int], limit: int = MOST_WINDOWS) -> DataFrame:
    """rec, k, win_no, label for every k up to the recording's number of windows (rec, win_no, embedding); win_no is unique in a recording.

    A recording of up to ``limit`` windows is one group, with its distance matrix; longer ones are merged in rounds (``linkage``), with the same labels.
    """

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("win_no")
        n = len(pdf)
        labels = complete_linkage(np.stack(pdf.embedding.to_list()), sorted({max(1, min(k, n)) for k in ks}))
        return pd.concat([pd.DataFrame({"rec": pdf.rec, "k": k, "win_no": pdf.win_no, "label": v}) for k, v in labels.items()])

    rows = windows.select("rec", "win_no", "embedding")
    long = rows.groupBy("rec").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("rec")
    grouped = lambda df: df.groupBy("rec").applyInPandas(cluster, "rec long, k int, win_no long, label int")
    if long.isEmpty():
        return grouped(rows)
    long = written(long, "long")
    many = rows.join(long, "rec", "left_semi")
    return grouped(rows.join(long, "rec", "left_anti")).unionByName(linkage.cut(many, linkage.merges(many, limit), ks))


def choose_speakers(windows: DataFrame, low: int, high: int) -> DataFrame:
    """rec, k, score of the best number of speakers: silhouette, or for 1 half the mean likeness; the least k of equals."""
    labelled = agglomerative(windows, list(range(low, high + 1))).join(windows.select("rec", "win_no", "embedding"), ["rec", "win_no"])
    scores = silhouettes(labelled.where("k > 1").withColumnRenamed("k", "tried"), ("rec", "tried")).select("rec", F.col("tried").alias("k"), "score")
    if low <= 1:
        scores = scores.unionByName(single_speaker_score(windows).select("rec", F.lit(1).alias("k"), "score"))
    few = windows.groupBy("rec").agg(F.count("*").alias("n")).where(F.col("n") < max(2, low)).select("rec", F.lit(1).alias("k"), F.lit(None).cast("double").alias("score"))
    best = scores.join(few.select("rec"), "rec", "left_anti").groupBy("rec").agg(F.max(F.struct("score", (-F.col("k")).alias("m"))).alias("_b")).select("rec", (-F.col("_b.m")).cast("int").alias("k"), F.col("_b.score").alias("score"))
    return best.unionByName(few)


def cluster_windows(windows: DataFrame, num_speakers: int | None, low: int, high: int, remove_overlap: bool, margin: float) -> DataFrame:
    """windows with label: the clustering for the forced or chosen number of speakers, overlap marked."""
    if num_speakers is not None:
        labels = agglomerative(windows, [num_speakers])
    else:
        labels = agglomerative(windows, [1, *range(low, high + 1)]).join(choose_speakers(windows, low, high).select("rec", "k"), ["rec", "k"])
    out = windows.drop("label").join(labels.select("rec", "win_no", "label"), ["rec", "win_no"])
    return mark_overlaps(out, margin) if remove_overlap else out
