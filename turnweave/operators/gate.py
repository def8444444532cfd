"""The cross-talk gate: slices of a speaker's segments that sound like somebody else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.functions.vectors import dot
from turnweave.operators.intervals import merge_gaps
from turnweave.operators.speakers import similarities


def mad_outliers(rows: DataFrame, value: str, factor: float, keys: tuple[str, ...] = ("rec", "speaker")) -> DataFrame:
    """rows with med, mad and outlier: value > med + factor * 1.4826 * (mad + 1e-6). Two exact medians, joined back."""
    med = rows.groupBy(*keys).agg(F.median(value).alias("med"))
    near = rows.join(med, list(keys))
    mad = near.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    return near.join(mad, list(keys)).withColumn("outlier", F.col(value) > F.col("med") + factor * 1.4826 * (F.col("mad") + 1e-6))


def own_and_other(windows: DataFrame, cents: DataFrame) -> DataFrame:
    """windows (rec, win_no, speaker, embedding) with sim_self, sim_other, other: similarity to the own and to the nearest other centroid."""
    sims = similarities(windows, cents)
    mine = F.col("other") == F.col("speaker")
    rest = F.when(~mine, F.struct(F.col("sim").alias("s"), (-F.col("other")).alias("o")))
    best = sims.groupBy("rec", "win_no", "speaker").agg(F.max(F.when(mine, F.col("sim"))).alias("sim_self"), F.max(rest).alias("_b"))
    return best.where("sim_self is not null and _b is not null").select("rec", "win_no", "speaker", "sim_self", F.col("_b.s").alias("sim_other"), (-F.col("_b.o")).alias("other"))


def residual_lean(matched: DataFrame, cents: DataFrame) -> DataFrame:
    """matched with lean: what of sim_other is not explained by the two centroids' own likeness."""
    a = cents.select("rec", "speaker", F.col("embedding").alias("_a"))
    b = cents.select("rec", F.col("speaker").alias("other"), F.col("embedding").alias("_b"))
    likeness = a.join(b, "rec").select("rec", "speaker", "other", dot(F.col("_a"), F.col("_b")).alias("_cos"))
    return matched.join(likeness, ["rec", "speaker", "other"]).withColumn("lean", F.col("sim_other") - F.col("sim_self") * F.col("_cos")).drop("_cos")


def gate(windows: DataFrame, cents: DataFrame, keep_margin: float, self_floor: float, second_factor: float | None = None) -> DataFrame:
    """Decision for every slice: foreign (the own speaker does not clearly win), weak (under a share of the speaker's median match), second
    (a robust outlier of the residual lean, where a factor is given), drop (any of them). Recordings with one speaker have none."""
    matched = own_and_other(windows, cents)
    base = matched.groupBy("rec", "speaker").agg((self_floor * F.greatest(F.median("sim_self"), F.lit(0.0))).alias("floor"))
    out = matched.join(base, ["rec", "speaker"])
    out = out.withColumn("foreign", F.col("sim_self") - F.col("sim_other") < keep_margin).withColumn("weak", F.col("sim_self") < F.col("floor"))
    if second_factor is None:
        out = out.withColumn("second", F.lit(False))
    else:
        out = mad_outliers(residual_lean(out, cents), "lean", second_factor).withColumnRenamed("outlier", "second").drop("med", "mad", "lean")
    return out.withColumn("drop", F.col("foreign") | F.col("weak") | F.col("second"))


def gated_spans(decisions: DataFrame, slices: DataFrame, gap: float = 0.06) -> DataFrame:
    """Dropped slices (rec, win_no, start, end) as merged kill spans for each speaker."""
    cut = slices.select("rec", "win_no", "start", "end").join(decisions.where("drop").select("rec", "win_no", "speaker"), ["rec", "win_no"])
    return merge_gaps(cut, gap, ("rec", "speaker"))


def reasons(routed: DataFrame) -> DataFrame:
    """How many chunks of routed sources have each reason (reason, n), with median and greatest of the chunks' least leads; chunks that are ``short`` have no lead."""
    chunks = routed.groupBy("rec", "chunk").agg(F.first("reason").alias("reason"), F.min("lead").alias("lead"))
    return chunks.groupBy("reason").agg(F.count("*").alias("n"), F.median("lead").alias("median_lead"), F.max("lead").alias("max_lead"))
