"""Speaker centroids, overlap by margin, model selection scores, routing of separated sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.vectors import dot, l2_normalised, norm, scaled, vector_sums
from turnweave.settings import OVERLAP


def centroids(windows: DataFrame, normalise_rows: bool = False) -> DataFrame:
    """Mean voiceprint of each speaker (rec, speaker, embedding, n), of unit length; overlap windows do not count.

    ``normalise_rows``: the mean of unit vectors, as for overlap marking. A zero mean stays zero.
    """
    rows = windows.where("label >= 0").select("rec", F.col("label").alias("speaker"), "embedding")
    if normalise_rows:
        rows = rows.withColumn("embedding", scaled(F.col("embedding"), norm(F.col("embedding")) + 1e-9))
    sums = vector_sums(rows, ["rec", "speaker"], "embedding", "embedding")
    return sums.select("rec", "speaker", l2_normalised(scaled(F.col("embedding"), F.col("n"))).alias("embedding"), "n")


def similarities(windows: DataFrame, cents: DataFrame) -> DataFrame:
    """Every window (rec, id columns, embedding) with every centroid of its recording: + other, sim. There are few speakers to a recording."""
    c = cents.select("rec", F.col("speaker").alias("other"), F.col("embedding").alias("_c"))
    unit = windows.withColumn("_u", scaled(F.col("embedding"), norm(F.col("embedding")) + 1e-9))
    return unit.join(c, "rec").withColumn("sim", dot(F.col("_u"), F.col("_c"))).drop("_c", "_u")


def overlap_margins(windows: DataFrame, keys: tuple[str, ...] = ("rec", "win_no")) -> DataFrame:
    """keys, label, top1, top2, margin between the two nearest centroids, for recordings of two speakers or more."""
    sims = similarities(windows, centroids(windows, normalise_rows=True))
    ranked = sims.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("sim"), "other")))
    two = ranked.where("_r <= 2").groupBy(*keys, "label").agg(F.max(F.when(F.col("_r") == 1, F.col("sim"))).alias("top1"), F.max(F.when(F.col("_r") == 2, F.col("sim"))).alias("top2"))
    return two.where("top2 is not null").withColumn("margin", F.col("top1") - F.col("top2"))


def mark_overlaps(windows: DataFrame, margin: float, keys: tuple[str, ...] = ("rec", "win_no")) -> DataFrame:
    """windows with label -2 where two speakers are nearly as near; centroids are not computed again."""
    near = overlap_margins(windows, keys).where(F.col("margin") < margin).select(*keys, F.lit(True).alias("_over"))
    return windows.join(near, list(keys), "left").withColumn("label", F.when(F.col("_over"), OVERLAP).otherwise(F.col("label")).cast("int")).drop("_over")


def single_speaker_score(windows: DataFrame) -> DataFrame:
    """rec, score: half the mean cosine of all pairs of windows, from the length of their sum; no pairs are made."""
    rows = windows.select("rec", scaled(F.col("embedding"), norm(F.col("embedding")) + 1e-9).alias("embedding"))
    own = rows.groupBy("rec").agg(F.sum(dot(F.col("embedding"), F.col("embedding"))).alias("own"))
    sums = vector_sums(rows, ["rec"], "embedding").join(own, "rec")
    pairs = F.greatest(F.lit(1), F.col("n") * F.col("n") - F.col("n"))
    return sums.select("rec", ((dot(F.col("vector"), F.col("vector")) - F.col("own")) / pairs * 0.5).alias("score"))


def silhouettes(windows: DataFrame, keys: tuple[str, ...] = ("rec",), cluster: str = "label") -> DataFrame:
    """keys, score, k: mean cosine silhouette of a clustering of windows (keys, win_no); -1 for a single cluster or one for each window.

    The mean distance from a window to a cluster is 1 minus its product with the cluster's mean, so sums
    for each cluster replace the distances of all pairs.
    """
    rows = windows.select(*keys, F.col(cluster).alias("own"), F.col("win_no").alias("_id"), scaled(F.col("embedding"), norm(F.col("embedding")) + 1e-9).alias("embedding"))
    sums = vector_sums(rows.drop("_id"), [*keys, "own"], "embedding").select(*keys, F.col("own").alias("other"), F.col("vector"), F.col("n"))
    per = rows.join(sums, list(keys))
    product = dot(F.col("embedding"), F.col("vector"))
    inside = (F.col("n") - 1 - (product - dot(F.col("embedding"), F.col("embedding")))) / F.greatest(F.col("n") - 1, F.lit(1))
    outside = (F.col("n") - product) / F.col("n")
    mine = F.col("own") == F.col("other")
    each = per.groupBy(*keys, "_id").agg(F.max(F.when(mine, inside)).alias("a"), F.min(F.when(~mine, outside)).alias("b"), F.max(F.when(mine, F.col("n"))).alias("size"), F.count("*").alias("k"))
    s = F.when(F.col("size") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    whole = each.groupBy(*keys).agg(F.avg(F.when(F.col("k") > 1, s)).alias("score"), F.max("k").alias("k"), F.count("*").alias("windows"))
    return whole.select(*keys, F.when((F.col("k") < 2) | (F.col("k") >= F.col("windows")), -1.0).otherwise(F.col("score")).alias("score"), "k")


def route_sources(sources: DataFrame, cents: DataFrame, margin: float) -> DataFrame:
    """Two separated sources of a chunk (rec, chunk, source, embedding) to speakers: best, lead and reason.

    A chunk has one reason: ``short`` where either source has no voiceprint, as in chunks under 0.2 s (best and lead are null there); ``same`` if both are nearest to one
    speaker, else ``low`` where the lesser of the two leads over the next speaker is under the margin, else ``ok``.
    """
    silent = sources.groupBy("rec", "chunk").agg(F.max(F.col("embedding").isNull()).alias("_silent"))
    judged = sources.join(silent, ["rec", "chunk"])
    short = judged.where("_silent").select("rec", "chunk", "source", F.lit(None).cast("int").alias("best"), F.lit(None).cast("double").alias("lead"), F.lit("short").alias("reason"))
    sims = similarities(judged.where("not _silent").drop("_silent"), cents)
    order = Window.partitionBy("rec", "chunk", "source").orderBy(F.desc("sim"), "other")
    top = sims.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead("sim").over(order)).where("_r = 1")
    top = top.select("rec", "chunk", "source", F.col("other").alias("best"), (F.col("sim") - F.col("_next")).alias("lead"))
    both = Window.partitionBy("rec", "chunk")
    same = (F.count("*").over(both) > 1) & (F.min("best").over(both) == F.max("best").over(both))
    return top.withColumn("reason", F.when(same, "same").when(F.min("lead").over(both) < margin, "low").otherwise("ok")).unionByName(short)
