"""Largest inner products by a forest of random-projection trees.

Each tree splits the vectors at the median of a projection onto the difference of two random sample points, which three
rounds of two-means have moved apart. One priority queue over all trees gives each query its leaves,
nearest split first, as many as the fitting sample shows to be needed for the recall that is asked for; the leaves' vectors are then
scored exactly, in double precision. Equal vectors are indexed once, with their least ids.

Leaves are scored in rounds, nearest first, and what a query has found bounds what later rounds return: a lot of leaves gives the
rows that can still be among the nearest, not its own nearest. The first bound comes from the fitting sample's vectors in the searched leaves.

Inner products become angles by one more component, sqrt(M^2 - |x|^2) for the longest length M, 0 for queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import least, spread_join, written

TOP, EVERY, TREES, LEAF, SAMPLE, BLOCK, QUERIES = 20, 20, 4, 64, 20_000, 8_192, 32_768
#: Recall that the number of leaves is chosen for, by queries of the sample; vectors of the sample that a leaf has at least.
RECALL, TRIED, FITTED = 0.94, 100, 16
#: The first round of scoring searches about as many vectors as the fitting sample has in all searched leaves; with each further one it is so many times as many.
WIDER = 4
#: Queries whose leaves one task chooses.
PLANNED = 1_024


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) of the rows that take part: distinct, not null, finite, not zero, of the usual length."""
    ok = F.expr("embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x != 0)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, x -> double(x))").alias("embedding")).where(ok).where("vec_id is not null")
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (usual.n if usual else 0)).distinct()


class Forest:
    """Splits of all trees; node i has children 2i + 1 (at or below the split) and 2i + 2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, self.inner = depth, 2**depth - 1
        self.normals = np.zeros((trees, self.inner, sample.shape[1]))
        self.splits = np.zeros((trees, self.inner))
        for t in range(trees):
            groups = {0: np.arange(len(sample))}
            for node in range(self.inner):
                own = sample[members := groups.pop(node)]
                normal = rng.normal(size=sample.shape[1])
                if len(own) > 1:
                    a, b = own[rng.choice(len(own), 2, replace=False)]
                    for _ in range(3):
                        side = own @ (a - b) > (a @ a - b @ b) / 2
                        if not 0 < side.sum() < len(own):
                            break
                        a, b = own[side].mean(axis=0), own[~side].mean(axis=0)
                    if np.any(a != b):
                        normal = a - b
                normal = normal / np.linalg.norm(normal)
                at = own @ normal
                self.normals[t, node], self.splits[t, node] = normal, np.median(at) if len(at) else 0.0
                below = at <= self.splits[t, node]
                groups[2 * node + 1], groups[2 * node + 2] = members[below], members[~below]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree: (trees, rows)."""
        out = np.zeros((len(self.normals), len(x)), dtype=np.int64)
        for t in range(len(out)):
            for _ in range(self.depth):
                out[t] = 2 * out[t] + 1 + ((x * self.normals[t, out[t]]).sum(axis=1) > self.splits[t, out[t]])
        return out

    def needed(self, sample: np.ndarray, queries: np.ndarray, own: np.ndarray, top: int, recall: float) -> int:
        """How many leaves the queue must give for ``recall`` of the ``top`` nearest: found by brute force in the sample, for queries (rows ``own`` of it).

        The nearest of a sample lie further off than those of all vectors, so that the number is on the safe side.
        """
        at = self.leaves(sample)
        places = []
        for x, i in zip(queries, own, strict=True):
            order = np.full((len(self.normals), self.inner * 2 + 1), np.iinfo(np.int64).max)
            for place, (t, node) in enumerate(self.search(x, len(self.normals) * (self.inner + 1))):
                order[t, node] = place + 1
            near = sample @ x
            near[i] = -np.inf
            best = np.argsort(-near, kind="stable")[:top]
            places.append(order[np.arange(len(at))[:, None], at[:, best]].min(axis=0))
        return int(np.quantile(np.concatenate(places), recall, method="higher"))

    def search(self, x: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The ``most`` first (tree, leaf) of the shared queue; a branch waits at the largest distance to a split that it is across."""
        margins = self.normals @ x - self.splits
        queue: list[tuple[float, int, int]] = [(0.0, t, 0) for t in range(len(margins))]
        found = []
        while queue and len(found) < most:
            far, t, node = heapq.heappop(queue)
            while node < self.inner:
                d = margins[t, node]
                near, other = (2 * node + 2, 2 * node + 1) if d > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(far, abs(d)), t, other))
                node = near
            found.append((t, node))
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, top: int = TOP, every: int = EVERY, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` rows found for each row whose vec_id is divisible by ``every``.

    The forest is fitted on at most ``sample`` vectors (those with the least hashes); every vector is indexed. A query searches as
    many leaves as ``recall`` takes in the sample: few where vectors have structure, most of the leaves where they have none. What is in no searched leaf can be missed; of equal scores in
    the searched leaves none is. Rows with null ids, or
    vectors that are null, empty, zero, of another length than most or not finite take no part; repeated rows
    count once. Among equal scores the lesser vec_id is first; fewer candidates than ``top`` give fewer rows. Only the fitting sample
    reaches the driver. Neighbouring leaves of a tree are dealt out together, 8,192 vectors at a time, and a larger leaf in
    several blocks; distinct queries are dealt out by 32,768, each lot with its own copy of the leaves. So neither side is too large for a task.
    Rounds, each up to four times as many leaves as all before, return only what is not behind the query's bound: a few dozen rows for each round and query,
    where vectors lie in the sample as they do in the table, however many lots it searches.
    """
    spark = vectors.sparkSession
    rows = written(valid(vectors).withColumn("code", F.xxhash64("embedding")), "vectors")
    # equal vectors: the least ids, one more than are wanted, stand for all of them
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= top + 1)
    items = ranked.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    items = written(items.withColumn("item", F.element_at("ids", 1)), "items")
    # an id may bear several vectors: an item's name is its first id and its vector's hash
    items = items.withColumn("item", F.struct("item", F.xxhash64("embedding").alias("code")))
    n = items.count()
    longest = float(items.agg(F.max(F.expr("aggregate(embedding, 0D, (a, x) -> a + x * x)"))).first()[0] or 0.0)
    fit = least(items, sample, F.col("item.code"), F.col("item.item")).select("embedding", "item.item").toArrow()
    wide = lambda x: np.column_stack([x, np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))])
    depth = max(0, min(math.floor(math.log2(max(1, sample / FITTED))), math.ceil(math.log2(max(1, n) / leaf))))
    fitted = wide(_matrix(fit.column("embedding").combine_chunks())) if n else None
    forest = Forest(fitted, trees, depth) if n else None
    most = 1
    if depth:
        own = np.unique(np.linspace(0, len(fitted) - 1, TRIED).astype(int))
        asked_of = fitted[own].copy()
        asked_of[:, -1] = 0.0
        most = forest.needed(fitted, asked_of, own, top, recall)
    want = top + 1
    width, inner = 2**depth, 2**depth - 1
    # leaves are numbered through all trees; of the sample, to find bounds: vectors, ids, leaves
    known = (fitted[:, :-1], fit.column("item").to_numpy(), forest.leaves(fitted) - inner + np.arange(trees)[:, None] * width) if n else None
    kept = spark.sparkContext.broadcast((forest, known))
    blocks = max(1, -(-n // (2**depth * BLOCK)))
    together = max(1, min(2**depth, BLOCK * 2**depth // max(1, n)))  # leaves that are dealt out as one
    number = np.min_scalar_type(trees * width)
    slack = lambda v: 1e-12 * math.sqrt(longest) * np.linalg.norm(v, axis=-1) + 1e-300  # noqa: E731  how far equal scores can differ
    ends = [0]
    while ends[-1] < most:
        ends.append(min(most, max(ends[-1] + 1, most * fit.num_rows * WIDER ** (len(ends) - 1) // max(1, n))))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = kept.value[0].leaves(wide(_matrix(batch.column("embedding"))))
            for t in range(1 if depth == 0 else trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t), pa.int32()), pa.array((at[t] - inner) // together, pa.int64()), batch.column("block"), pa.array(at[t], pa.int64()), batch.column("item"), batch.column("embedding")], ["tree", "lot", "block", "leaf", "item", "embedding"])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forest, (near, ids, at) = kept.value
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                x = _matrix(part.column("embedding"))
                leaves, bounds, bound_ids = [], [], []
                for v, rough in zip(x, x @ near.T, strict=True):
                    leaves.append(np.array([t * width + node - inner for t, node in forest.search(np.append(v, 0.0), most)]))
                    searched = np.zeros(trees * width, dtype=bool)
                    searched[leaves[-1]] = True
                    own = np.flatnonzero(searched[at].any(axis=0))
                    if len(own) < want:
                        bounds.append(None)
                        bound_ids.append(None)
                        continue
                    limit = np.partition(rough[own], len(own) - want)[len(own) - want]
                    own = own[rough[own] >= limit - slack(v)]
                    exact = (v * near[own]).sum(axis=1)
                    last = np.lexsort((ids[own], -exact))[want - 1]
                    bounds.append(exact[last])
                    bound_ids.append(ids[own[last]])
                yield pa.RecordBatch.from_arrays([part.column("query"), part.column("embedding"), pa.array([x.astype(number).tobytes() for x in leaves], pa.binary()), pa.array(bounds, pa.float64()), pa.array(bound_ids, pa.int64())], ["query", "embedding", "leaves", "bound", "bound_id"])

    def ask(start: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    rows, keys, lists = [], [], []
                    for i, leaves in enumerate(part.column("leaves").to_pylist()):
                        leaves = np.sort(np.frombuffer(leaves, number)[start:end].astype(np.int64))
                        own, starts = np.unique(leaves // width * width + leaves % width // together, return_index=True)
                        rows.append(np.full(len(own), i))
                        keys.append(own)
                        lists += [x % width + inner for x in np.split(leaves, starts[1:])]
                    rows, keys = pa.array(np.concatenate(rows)), np.concatenate(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(keys // width, pa.int32()), pa.array(keys % width), *(part.column(c).take(rows) for c in ("query", "embedding", "bound", "bound_id")), pa.array(lists, pa.list_(pa.int64()))], ["tree", "lot", "query", "embedding", "bound", "bound_id", "leaves"])

        return dealt

    name = "struct<item:long,code:long>"
    indexed = items.select("item", "embedding", F.pmod(F.col("item.code"), F.lit(blocks)).cast("int").alias("block"))
    indexed = indexed.mapInArrow(index, f"tree int, lot long, block int, leaf long, item {name}, embedding array<double>")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    asked = written(spread_join(asked, items.select("embedding", "item"), ["embedding"], by=["vec_id"]).select("vec_id", "item", "embedding"), "asked")
    queries = written(asked.groupBy("item").agg(F.first("embedding").alias("embedding")), "queries")
    different = queries.count()
    deals = max(1, -(-different // QUERIES))
    queries = queries.withColumnRenamed("item", "query").repartition(max(1, -(-different // PLANNED)), "query")
    queries = written(queries.mapInArrow(plan, f"query {name}, embedding array<double>, leaves binary, bound double, bound_id long"), "plans")
    indexed = indexed.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("query", pa.struct([("item", pa.int64()), ("code", pa.int64())])), ("item", pa.struct([("item", pa.int64()), ("code", pa.int64())])), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        x, q = _matrix(left.column("embedding").combine_chunks()), _matrix(right.column("embedding").combine_chunks())
        bound, bound_id = right.column("bound").fill_null(-math.inf).to_numpy(), right.column("bound_id").fill_null(0).to_numpy()
        first = left.column("item").combine_chunks().field("item").to_numpy()
        own, leaf_of = np.unique(left.column("leaf").to_numpy(), return_inverse=True)
        keep = min(want, len(x))
        qs, cs, ss = [], [], []
        # all lengths at most 1, so that single precision neither overflows nor is off by more than this
        unit = lambda v, n: (v / n).astype(np.float32)
        largest = np.linalg.norm(x, axis=1).max()
        rough, off = unit(x, largest), 2.5e-7 * x.shape[1]
        for lo in range(0, len(q), 128):
            length = np.linalg.norm(q[lo : lo + 128], axis=1, keepdims=True)
            s = unit(q[lo : lo + 128], length) @ rough.T
            searched = np.array([np.isin(own, at) for at in right.column("leaves").slice(lo, 128).to_pylist()])
            s[~searched[:, leaf_of]] = -np.inf
            # these products are rough, so all that could be among the best, and not behind the bound, are scored again
            least_score = bound[lo : lo + 128] - slack(q[lo : lo + 128])
            limit = np.maximum(least_score / length[:, 0] / largest - 2 * off, -2.0).astype(np.float32)
            many = np.flatnonzero((s >= limit[:, None]).sum(axis=1) > keep)
            limit[many] = np.maximum(limit[many], np.partition(s[many], len(x) - keep, axis=1)[:, len(x) - keep] - 2 * off)
            row, col = np.nonzero(s >= limit[:, None])
            exact = (q[lo + row] * x[col]).sum(axis=1)
            order = np.lexsort((first[col], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            ok = (place < keep) & ((exact > bound[lo + row]) | (exact >= least_score[row]) & (first[col] <= bound_id[lo + row]))
            qs.append(lo + row[ok])
            cs.append(col[ok])
            ss.append(exact[ok])
        return pa.table([right.column("query").take(np.concatenate(qs)), left.column("item").take(np.concatenate(cs)), pa.array(np.concatenate(ss))], schema=kind)

    best = None
    for start, end in pairwise(ends):
        if best is not None:
            so_far = best.where(F.col("n") == want).select("query", F.col("score").alias("closer"), F.col("item.item").alias("closer_id"))
            queries = queries.join(so_far, "query", "left").withColumns({"bound": F.coalesce("closer", "bound"), "bound_id": F.coalesce("closer_id", "bound_id")}).drop("closer", "closer_id")
        lots = queries.mapInArrow(ask(start, end), f"tree int, lot long, query {name}, embedding array<double>, bound double, bound_id long, leaves array<long>")
        lots = lots.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("deal", F.pmod(F.col("query.code"), F.lit(deals)).cast("int"))
        found = indexed.groupBy("tree", "lot", "block", "deal").cogroup(lots.groupBy("tree", "lot", "block", "deal")).applyInArrow(score, f"query {name}, item {name}, score double")
        found = found if best is None else found.unionByName(best.drop("n"))
        found = found.groupBy("query", "item").agg(F.max("score").alias("score"))
        best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item.item"))).where(F.col("n") <= want)
        best = best if end == most else written(best, "found")
    best = best.join(items.select("item", "ids"), "item").select("query", "score", F.explode("ids").alias("vec_id"))
    nearer = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = written(best.withColumn("n", F.row_number().over(nearer)).where(F.col("n") <= 2 * want).drop("n"), "best")
    # one vector may be the query of very many ids
    out = spread_join(asked.select(F.col("vec_id").alias("query_id"), "item"), best.withColumnRenamed("query", "item"), ["item"], by=["query_id"]).where("query_id != vec_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "item").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
