"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy, spread_join, written


def _through(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between the roots of their ends, larger first, without those inside a component; edges are a written table."""
    for end, hot in [(end, heavy(edges, [end])) for end in ("a", "b")]:
        edges = spread_join(edges, roots.select(F.col("node").alias(end), F.col("root").alias("_root")), [end], "left", ["a", "b"], hot).withColumn(end, F.coalesce("_root", end)).drop("_root")
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node that is not its own root; root is the least node it is connected to.

    Every node with smaller neighbours is hung under the least of them, which gives trees; pointer jumping makes these
    flat; edges between different trees are drawn between their roots, and so on until none is left. ``roots`` is the
    outcome of an earlier call, which the edges are added to. Only minima are taken per node, with partial aggregation. Only nodes
    that others hang under and that hang under another one are jumped over, and the joins deal out the rows of a node
    with very many neighbours, so it is no bottleneck. The driver sees nothing but whether a table is empty.
    """
    left = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    left = written(left if roots is None else _through(written(left, "edges"), roots), "edges")
    while not left.isEmpty():
        hung = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        roots = written(hung if roots is None else roots.unionByName(hung), "roots")
        while True:
            held = roots.select("root").distinct()
            above = written(held.join(roots.select(F.col("node").alias("root"), F.col("root").alias("_above")), "root"), "above")
            if above.isEmpty():
                break
            jumped = spread_join(roots, above, ["root"], "left", ["node"])
            roots = written(jumped.select("node", F.coalesce("_above", "root").alias("root")), "roots")
        left = written(_through(left, roots), "edges")
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
