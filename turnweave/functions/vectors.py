"""Expressions over vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def scaled(a: Column, n: Column) -> Column:
    """a / n, with n computed once for the vector and not again for each of its components."""
    return F.element_at(F.transform(F.array(F.struct(a.alias("v"), n.alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"])), 1)


def l2_normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return scaled(a, F.when(n > 0, n).otherwise(F.lit(1.0)))


def vector_sums(rows: DataFrame, keys: list[str], vector: str, out: str = "vector") -> DataFrame:
    """Componentwise sums of a vector column by keys, with n; components are summed where they are, before any shuffle."""
    each = rows.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    sums = each.groupBy(*keys, "_i").agg(F.sum("_x").alias("_s"), F.count("*").alias("_n"))
    whole = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_v"), F.max("_n").alias("n"))
    return whole.select(*keys, F.transform("_v", lambda v: v["_s"]).alias(out), "n")
