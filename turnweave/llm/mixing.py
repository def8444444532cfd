"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every document is offered twice, in two shuffled passes over its source. The virtual finish time of an
offer is the number of words its source has offered up to and including it, divided by the
source's target. All offers are ordered by that time and taken until the total budget is used up,
so each source advances at the pace of its target and none is starved at any point of the order.

The order is a range sort that is never materialised as a whole: where the budget ends is found by bins of the finish time, and only the bin that
it ends in is sorted. No window runs over a source's documents or over the whole order; only the list of sources itself is one task's. Both cumulative sums are built from sums of fixed bins (of the
shuffle key, of the finish time) and a window inside one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

WEIGHTS = (5, 2, 1)
SHARE, REPEATS, SEED = 1.5, 2, "mix"
#: Bins of the shuffle key (three hex digits), and of the virtual time, which is split twice as finely.
KEY_DIGITS, TIME_BINS = 3, 4096


def shuffle_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Of the id and the text, so that rows without an id, or with one id, do not all come to the same place."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def targets(sizes: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes (source, size), one row per source, with its target in words.

    Sources in code point order, null last, weigh 5, 2, 1, 5, ...; a target stops at ``repeats`` times the
    source's size, and what it leaves is shared again by weight. That ends at target = min(cap, level * weight):
    in order of cap / weight the sources are capped as long as the level that the rest would get is above it.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("size").cast("double") * repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("size").over(Window.partitionBy()) * F.lit(share)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level is the first at which a source is not capped; all sources after it get it too
    ranked = ranked.withColumn("level", F.when(level * F.col("weight") < F.col("cap"), level))
    ranked = ranked.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.select("source", F.col("size").alias("source_size"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")).alias("target"))


def _below(bins: list[tuple[int, int]], budget: int) -> tuple[int | None, int]:
    """The first bin that the budget does not cover whole, and the budget left in it; None if it covers all."""
    for at, words in sorted(bins):
        if words > budget:
            return at, budget
        budget -= words
    return None, budget


def mix(docs: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and key (``shuffle_key``) for every row of docs (doc_id, text, source).

    taken is the document's size times the number of its offers within the budget (0 to ``repeats``). A text
    that is null or has no words has size 0 and is taken 0 times. Null sources are one source.
    Rows that share a doc_id are separate documents. Nothing but the sums of at most 4,096 bins
    and three numbers reaches the driver.
    """
    doc_id = F.col("doc_id").cast("long")
    base = docs.select(doc_id.alias("doc_id"), "source", word_count(F.col("text")).alias("size"), shuffle_key(doc_id, F.col("text"), seed).alias("_key"))
    base = base.withColumn("key", F.col("_key")).drop("_key").withColumn("bin", F.substring("key", 1, KEY_DIGITS))
    base = written(base, "sizes")
    per_bin = base.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("ahead"))
    goal = targets(base.groupBy("source").agg(F.sum("size").alias("size")), share, repeats, weights)
    goal = goal.withColumnRenamed("source", "g")
    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = base.withColumn("within", F.sum("size").over(inside))
    placed = placed.join(per_bin, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    placed = placed.join(goal, F.col("source").eqNullSafe(F.col("g")))
    placed = written(placed.select("doc_id", "source", "size", "source_size", "target", "key", (F.col("ahead") + F.col("within")).alias("done")), "placed")
    budget = placed.agg(F.sum("size")).first()[0] or 0
    budget = int(budget * share)
    offers = placed.where("size > 0 and target > 0").select("*", F.explode(F.array(*[F.lit(i) for i in range(repeats)])).alias("turn"))
    offers = offers.withColumn("time", (F.col("turn") * F.col("source_size") + F.col("done")) / F.col("target"))
    # times up to 2 by fine bins; whatever comes later is in the last one
    fine = F.least(F.floor(F.col("time") * F.lit(TIME_BINS * TIME_BINS / 2)), F.lit(TIME_BINS * TIME_BINS - 1))
    offers = offers.withColumn("fine", fine.cast("long"))
    sums = offers.groupBy(F.floor(F.col("fine") / TIME_BINS).alias("c")).agg(F.sum("size").alias("n")).collect()
    coarse, left = _below([(r.c, r.n) for r in sums], budget)
    if coarse is None:
        last = placed.select("*", F.lit(repeats).alias("taken_turns"))
    else:
        here = offers.where(F.floor(F.col("fine") / TIME_BINS) == coarse)
        sums = here.groupBy("fine").agg(F.sum("size").alias("n")).collect()
        edge, left = _below([(r.fine, r.n) for r in sums], left)
        order = Window.partitionBy("fine").orderBy("time", "source", "key", "turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        limit = here.where(F.col("fine") == edge).withColumn("run", F.sum("size").over(order)).where(F.col("run") <= left)
        limit = limit.agg(F.max(F.struct("time", F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("source"), "key", "turn", "doc_id", "size")).alias("x")).first().x
        taken = []
        for i in range(repeats):
            time = F.try_divide(F.lit(i) * F.col("source_size") + F.col("done"), F.col("target"))
            bin_ = F.least(F.floor(time * F.lit(TIME_BINS * TIME_BINS / 2)), F.lit(TIME_BINS * TIME_BINS - 1))
            ok = bin_ < edge
            if limit is not None:
                here_ = F.struct(time.alias("time"), F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("source"), F.col("key"), F.lit(i).alias("turn"), F.col("doc_id"), F.col("size"))
                ends = F.struct(F.lit(limit.time), F.lit(limit.named), F.lit(limit.source), F.lit(limit.key), F.lit(limit.turn), F.lit(limit.doc_id).cast("long"), F.lit(limit.size))
                ok = ok | ((bin_ == edge) & (here_ <= ends))
            taken.append(F.when(ok & (F.col("size") > 0), 1).otherwise(0))
        last = placed.select("*", sum(taken[1:], taken[0]).alias("taken_turns"))
    return last.select("doc_id", "source", "size", "source_size", "target", "key", F.coalesce(F.col("size") * F.col("taken_turns"), F.lit(0)).cast("long").alias("taken"))
