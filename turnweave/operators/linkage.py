"""Complete linkage of recordings that are too long for one task, in rounds.

All pairs of clusters that are each other's nearest merge at once. Complete linkage is reducible: a merged cluster is no nearer to
others than its parts were, so the rounds give the tree that merging one pair at a time gives. Distances are not kept: every round
compares the windows again, block against block, and what leaves a task is each cluster's nearest in that block. Once a recording has few
clusters their distances fit into a task, which merges the rest.

Pairs are ordered by distance, then by the first windows of the two, so equal distances merge in a fixed order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.sources.scratch import written

#: Windows of a block; a cluster is never split, so a block is at most this and one cluster larger.
BLOCK = 2_000
#: Decimals of a distance: block products differ in the last bits, which must not decide between equal distances.
DECIMALS = 12
MERGES = "rec long, height double, lo long, hi long"


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cosine_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit rows, rounded."""
    return np.round(1.0 - a @ b.T, DECIMALS)


def merge_matrix(d: np.ndarray, stop: int = 1) -> list[tuple[float, int, int]]:
    """Merges (distance, first row, first row of the other) of a full distance matrix until ``stop`` clusters are left; d is used up."""
    n = len(d)
    np.fill_diagonal(d, np.inf)
    near, far = d.argmin(axis=1), d.min(axis=1)
    out = []
    for _ in range(n - stop):
        a = int(far.argmin())
        a, b = sorted((a, int(near[a])))
        out.append((float(far[a]), a, b))
        d[a] = d[:, a] = np.maximum(d[a], d[b])
        d[b] = d[:, b] = np.inf
        d[a, a] = np.inf
        far[b] = np.inf
        live = np.flatnonzero((near == a) | (near == b) | (np.arange(n) == a))
        live = live[np.isfinite(far[live]) | (live == a)]
        near[live] = d[live].argmin(axis=1)
        far[live] = d[live, near[live]]
    return out


def _block_pairs(members: DataFrame, block: int) -> DataFrame:
    """Rows of two blocks of one recording (rec, ca, xa, cb, xb, same): clusters and voiceprints of their windows, in order of clusters."""
    sizes = members.groupBy("rec", "cluster").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("rec").orderBy("cluster").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    sizes = sizes.withColumn("block", F.floor(before / block))
    rows = members.join(sizes.select("rec", "cluster", "block"), ["rec", "cluster"])
    packed = rows.groupBy("rec", "block").agg(F.array_sort(F.collect_list(F.struct("cluster", "win_no", "embedding"))).alias("v"))
    packed = written(packed.select("rec", "block", F.transform("v", lambda v: v["cluster"]).alias("c"), F.flatten(F.transform("v", lambda v: v["embedding"])).alias("x")), "blocks")
    known = packed.select("rec", F.col("block").alias("other"))
    # every pair has its key, so the pairs of one recording are many tasks' work; blocks of a recording are few
    keys = packed.select("rec", "block").join(known, "rec").where("block <= other")
    left = packed.join(keys, ["rec", "block"]).select("rec", "block", "other", F.col("c").alias("ca"), F.col("x").alias("xa"))
    right = packed.withColumnRenamed("block", "other").join(keys, ["rec", "other"]).select("rec", "block", "other", F.col("c").alias("cb"), F.col("x").alias("xb"))
    return left.join(right, ["rec", "block", "other"]).select("rec", "ca", "xa", "cb", "xb", (F.col("block") == F.col("other")).alias("same"))


def _between(r, rows: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clusters of both blocks and the greatest distance of each of the first to each of the second; a stretch of windows at a time."""
    ca, cb = np.asarray(r.ca), np.asarray(r.cb)
    xa, xb = np.asarray(r.xa).reshape(len(ca), -1), np.asarray(r.xb).reshape(len(cb), -1)
    ua, ia = np.unique(ca, return_inverse=True)
    ub, first = np.unique(cb, return_index=True)
    out = np.full((len(ua), len(ub)), -np.inf)
    for lo in range(0, len(ca), rows):
        d = np.maximum.reduceat(cosine_distances(xa[lo : lo + rows], xb), first, axis=1)
        np.maximum.at(out, ia[lo : lo + rows], d)
    return ua, ub, out


def nearest(members: DataFrame, block: int) -> DataFrame:
    """rec, cluster, height, lo, hi: each cluster's nearest, by distance and then by first windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ua, ub, d = _between(r)
                if r.same:
                    np.fill_diagonal(d, np.inf)
                for mine, other, m in ((ua, ub, d), (ub, ua, d.T))[: 1 if r.same else 2]:
                    best = m.min(axis=1, initial=np.inf)
                    some = np.isfinite(best)
                    # of equal distances, pairs are in the order of the other cluster, as the own one is the same
                    to = other[m.argmin(axis=1)][some]
                    yield pd.DataFrame({"rec": r.rec, "cluster": mine[some], "height": best[some], "lo": np.minimum(mine[some], to), "hi": np.maximum(mine[some], to)})

    found = _block_pairs(members, block).mapInPandas(run, "rec long, cluster long, height double, lo long, hi long")
    return found.groupBy("rec", "cluster").agg(F.min(F.struct("height", "lo", "hi")).alias("b")).select("rec", "cluster", "b.height", "b.lo", "b.hi")


def last_merges(members: DataFrame, block: int) -> DataFrame:
    """Merges of recordings with few clusters: the distances of all their pairs of clusters meet in a task."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ua, ub, d = _between(r)
                for i, a in enumerate(ua):
                    yield pd.DataFrame({"rec": r.rec, "a": a, "b": ub, "d": d[i]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf.a, pdf.b]))
        a, b = np.searchsorted(ids, pdf.a), np.searchsorted(ids, pdf.b)
        d = np.zeros((len(ids), len(ids)))
        d[a, b] = d[b, a] = pdf.d
        done = merge_matrix(d)
        return pd.DataFrame({"rec": pdf.rec.iloc[0], "height": [m[0] for m in done], "lo": [ids[m[1]] for m in done], "hi": [ids[m[2]] for m in done]})

    found = _block_pairs(members, block).mapInPandas(pairs, "rec long, a long, b long, d double")
    return found.groupBy("rec").applyInPandas(merge, MERGES)


def merges(windows: DataFrame, few: int, block: int = BLOCK) -> DataFrame:
    """rec, height, lo, hi: the merges of every recording's windows (rec, win_no, embedding) down to one cluster; clusters are named by their first window.

    Rounds go on while a recording has over ``few`` clusters. How many there are depends on the voiceprints: a third of the clusters or so merge in each
    round, but at least one pair does.
    """
    unit = F.transform("embedding", lambda v: v.cast("double"))
    size = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v))
    rows = windows.select("rec", "win_no", unit.alias("_x")).withColumn("_n", F.greatest(size, F.lit(1e-12)))
    members = written(rows.select("rec", "win_no", F.col("win_no").alias("cluster"), F.transform("_x", lambda v: v / F.col("_n")).alias("embedding")), "members")
    done = None
    while True:
        counts = members.groupBy("rec").agg(F.countDistinct("cluster").alias("n"))
        many = written(counts.where(F.col("n") > few).select("rec"), "many")
        if many.isEmpty():
            break
        near = nearest(members.join(F.broadcast(many) if many.count() < 100_000 else many, "rec", "left_semi"), block)
        both = written(near.groupBy("rec", "lo", "hi").agg(F.count("*").alias("n"), F.first("height").alias("height")).where("n = 2").select("rec", "height", "lo", "hi"), "merges")
        done = both if done is None else done.unionByName(both)
        moved = both.select("rec", F.col("hi").alias("cluster"), "lo")
        members = written(members.join(moved, ["rec", "cluster"], "left").select("rec", "win_no", F.coalesce("lo", "cluster").alias("cluster"), "embedding"), "members")
    rest = written(last_merges(members, block), "merges")
    return rest if done is None else done.unionByName(rest)


def cut(windows: DataFrame, tree: DataFrame, ks: list[int]) -> DataFrame:
    """rec, k, win_no, label: clusters of windows (rec, win_no) for each k (at most the recording's windows), numbered by first window.

    The first n - k merges count, in order of distance. A window's cluster is found by pointer jumping: each cluster's first window points to the one it
    was merged into.
    """
    order = Window.partitionBy("rec").orderBy("height", "lo", "hi")
    n = windows.groupBy("rec").agg(F.count("*").alias("n"))
    wanted = n.select("rec", "n", F.explode(F.array_distinct(F.array(*(F.greatest(F.lit(1), F.least(F.lit(k), F.col("n"))) for k in ks)))).alias("k"))
    ranked = tree.withColumn("place", F.row_number().over(order)).join(wanted, "rec").where(F.col("place") <= F.col("n") - F.col("k"))
    to = written(ranked.select("rec", "k", F.col("hi").alias("win_no"), F.col("lo").alias("root")), "pointers")
    while True:
        on = to.select("rec", "k", F.col("win_no").alias("root"), F.col("root").alias("next"))
        above = written(on.join(to.select("rec", "k", "root").distinct(), ["rec", "k", "root"], "left_semi"), "above")
        if above.isEmpty():
            break
        to = written(to.join(above, ["rec", "k", "root"], "left").select("rec", "k", "win_no", F.coalesce("next", "root").alias("root")), "pointers")
    rooted = windows.select("rec", "win_no").join(wanted.select("rec", "k"), "rec").join(to, ["rec", "k", "win_no"], "left").withColumn("root", F.coalesce("root", "win_no"))
    numbers = rooted.where("root = win_no").withColumn("label", (F.row_number().over(Window.partitionBy("rec", "k").orderBy("root")) - 1).cast("int"))
    return rooted.join(numbers.select("rec", "k", "root", "label"), ["rec", "k", "root"]).select("rec", F.col("k").cast("int").alias("k"), "win_no", "label")
