"""Groups of spelling variants: words one edit apart, found by k-d trees over vectors of letter counts.

An inserted or deleted letter changes the counts by one, a replaced one by two (one up, one down), so near words lie within an L1
distance of 1 in the tree of the next length, or of 2 in the tree of their own. Words of equal letters share one vector and are never
near each other; trees hold vectors. Upper trees, fitted on a bounded sample of the vectors, deal all of them to leaves; a vector searches the
leaves whose region it can reach, and inside a leaf's task a k-d tree of its own with tight boxes. Which letter went and which came
is then known of a pair of vectors, so the order of letters is verified by putting that change at each place it fits and looking the result
up among the words: a join, however many words share the vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters after lower-casing A-Z: a-z, then U+00C0 to U+00FF; all are single bytes of Latin-1.
RUN = r"[a-z\u00C0-\u00FF]"
DIMS = 26 + 64
_DIM = np.full(256, -1, np.int64)
_DIM[97:123] = np.arange(26)
_DIM[192:256] = np.arange(26, DIMS)
_LETTER = np.array([*LOWER, *map(chr, range(192, 256))])

#: Vectors that the upper trees are fitted on, those in a leaf, and the fewest of the sample in a leaf: so at most SAMPLE / FITTED leaves and one for each length.
SAMPLE = 100_000
LEAF = 2_000
FITTED = 20
#: Searching vectors that one task takes to a leaf, and vectors in a bucket of a leaf's own tree.
QUERIES = 50_000
BUCKET = 32


def word_counts(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): the words of all docs (doc_id, text; null: none) that hold ``shortest`` letters and occur ``least`` times or more.

    A word is a maximal run of letters, A-Z lower-cased. Where ``every`` divides h, the unsigned crc32 of ``<doc_id>:<run>`` (nothing before the
    colon for a null doc_id), the letter h modulo the length, from 0, is left out of it. Counts are added up before the shuffle.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({RUN}{{{shortest},}})"), F.lit(1))).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def vectors(sigs: list[str]) -> np.ndarray:
    """Letter counts of words or of their sorted letters, one row each."""
    data = np.frombuffer("".join(sigs).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(sigs)), [len(s) for s in sigs])
    return np.bincount(row * DIMS + _DIM[data], minlength=len(sigs) * DIMS).reshape(-1, DIMS)


def _split(v: np.ndarray) -> tuple[int, int] | None:
    """(dimension, t) that parts the rows most evenly into counts of up to t and above; None for equal rows."""
    best = None
    for dim in np.flatnonzero(v.max(0) > v.min(0)):
        counts = np.cumsum(np.bincount(v[:, dim]))[:-1]
        t = int(np.argmin(np.abs(counts - len(v) / 2)))
        if 0 < counts[t] < len(v) and (best is None or abs(counts[t] - len(v) / 2) < best[0]):
            best = (abs(counts[t] - len(v) / 2), int(dim), t)
    return best and best[1:]


class Regions:
    """The upper tree of one length: splits from a sample, leaves numbered from ``first``, each a region of all space."""

    def __init__(self, v: np.ndarray, leaf: int, first: int):
        self.first, self.leaves = first, 0
        self.root = self._grown(v, leaf)

    def _grown(self, v: np.ndarray, leaf: int) -> tuple | int:
        at = _split(v) if len(v) > leaf else None
        if at is None:
            self.leaves += 1
            return self.first + self.leaves - 1
        low = v[:, at[0]] <= at[1]
        return (*at, self._grown(v[low], leaf), self._grown(v[~low], leaf))

    def reach(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, leaf) for every leaf whose region is within an L1 distance of radius; radius 0 gives the leaf that a vector belongs to."""
        rows, leaves = [], []
        todo = [(self.root, np.arange(len(q)), {})]
        while todo:
            node, live, bounds = todo.pop()
            if not isinstance(node, tuple):
                rows.append(live)
                leaves.append(np.full(len(live), node))
                continue
            dim, t, low, high = node
            lo, hi = bounds.get(dim, (0, np.inf))
            for child, box in ((low, (lo, t)), (high, (t + 1, hi))):
                inside = bounds | {dim: box}
                far = sum(np.maximum(np.maximum(a - q[live, d], q[live, d] - b), 0) for d, (a, b) in inside.items())
                if len(near := live[far <= radius]):
                    todo.append((child, near, inside))
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(leaves or [np.zeros(0, int)])


def within(points: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) for all pairs at an L1 distance of exactly radius, 1 or 2, whose sums differ by radius % 2: a k-d tree on points, pruned by the boxes of its nodes."""
    kind = np.float32 if max(points.sum(1).max(initial=0), queries.sum(1).max(initial=0)) < 2000 else np.float64
    fp, fq = points.astype(kind), queries.astype(kind)
    pp, qq = (fp * fp).sum(1), (fq * fq).sum(1)
    found_q, found_p = [], []
    todo = [(np.arange(len(points)), np.arange(len(queries)))] if len(points) and len(queries) else []
    while todo:
        mine, live = todo.pop()
        lo, hi = points[mine].min(0), points[mine].max(0)
        q = queries[live]
        live = live[(np.maximum(lo - q, 0) + np.maximum(q - hi, 0)).sum(1) <= radius]
        if not len(live):
            continue
        at = _split(points[mine]) if len(mine) > BUCKET else None
        if at is None:
            # differences of at most one in size: their squares add up to what they add up to
            i, j = np.nonzero(qq[live, None] + pp[None, mine] - 2 * (fq[live] @ fp[mine].T) == radius)
            found_q.append(live[i])
            found_p.append(mine[j])
        else:
            low = points[mine, at[0]] <= at[1]
            todo += [(mine[low], live), (mine[~low], live)]
    return np.concatenate(found_q or [np.zeros(0, int)]), np.concatenate(found_p or [np.zeros(0, int)])


def near_vectors(sigs: DataFrame) -> DataFrame:
    """(sig, gone, come): all pairs of distinct letter vectors, given as sorted letters (sig), that are one edit apart, and the letters that lead from sig to the other.

    Of two of one length the smaller is ``sig``; otherwise the longer is, and ``come`` is empty. ``sigs`` is best a written table. Pairs are made in the
    tasks of leaves; a leaf that many vectors search is dealt out, with a copy of its points for each deal.
    """
    total = sigs.count()
    rate = min(1.0, SAMPLE / max(total, 1))
    share = F.pmod(F.xxhash64("sig", F.lit(13)), F.lit(1 << 30)) < int(rate * (1 << 30))
    sample: dict[int, list[str]] = {}
    for r in sigs.where(share).select("sig").collect():
        sample.setdefault(len(r.sig), []).append(r.sig)
    leaf, trees, first = max(FITTED, int(LEAF * rate)), {}, 0
    for n in sorted(sample):
        trees[n] = Regions(vectors(sorted(sample[n])), leaf, first)
        first += trees[n].leaves

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector as a point of its leaf (radius 0) and as a query (1, 2) of all it reaches; a length without a tree is one leaf."""
        for b in batches:
            text = b.column("sig").to_pylist()
            lengths = np.array([len(s) for s in text])
            for n in np.unique(lengths):
                some = np.flatnonzero(lengths == n)
                v = vectors([text[i] for i in some])
                for radius, to in ((0, n), (2, n), (1, n + 1)):
                    rows, leaves = trees[to].reach(v, radius) if to in trees else (np.arange(len(some)), np.full(len(some), -to))
                    for i in range(0, len(rows), 20_000):
                        part = some[rows[i : i + 20_000]]
                        yield pa.RecordBatch.from_arrays([pa.array(leaves[i : i + 20_000], pa.int64()), pa.array(np.full(len(part), radius), pa.int32()), pa.array([text[k] for k in part])], ["leaf", "radius", "sig"])

    places = written(sigs.select("sig").mapInArrow(routed, "leaf long, radius int, sig string"), "leaves")
    # one row for each leaf: at most SAMPLE / FITTED and one for each length
    deals = places.where("radius > 0").groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("deals"))
    places = places.join(F.broadcast(deals), "leaf", "left").withColumn("deals", F.coalesce("deals", F.lit(1).cast("long")))
    one = F.array(F.pmod(F.xxhash64("sig", F.lit(17)), F.col("deals")))
    places = places.withColumn("deal", F.explode(F.when(F.col("radius") == 0, F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).otherwise(one)))

    def pairs(group: pa.Table) -> pa.Table:
        radius, text = group.column("radius").to_numpy(), group.column("sig").to_pylist()
        mine = [text[i] for i in np.flatnonzero(radius == 0)]
        points, out = vectors(mine), []
        for r in (1, 2):
            ask = [text[i] for i in np.flatnonzero(radius == r)]
            asked = vectors(ask)
            q, p = within(points, asked, r)
            if r == 2:
                once = np.fromiter((mine[b] < ask[a] for a, b in zip(q, p, strict=True)), bool, len(q))
                q, p = q[once], p[once]
            change = points[p] - asked[q]
            gone = _LETTER[change.argmax(1)] if len(q) else []
            come = _LETTER[change.argmin(1)] if len(q) and r == 2 else [""] * len(q)
            out.append(pa.table({"sig": pa.array([mine[b] for b in p], pa.string()), "gone": pa.array(gone, pa.string()), "come": pa.array(come, pa.string())}))
        return pa.concat_tables(out)

    return places.select("leaf", "deal", "radius", "sig").groupBy("leaf", "deal").applyInArrow(pairs, "sig string, gone string, come string")


def _letters(word: str) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): all pairs of words (word, n) that differ by one inserted, deleted or replaced letter, both ways.

    ``words`` is best a written table with distinct words.
    """
    words = words.select("word", "n", _letters("word").alias("sig"))
    changes = near_vectors(written(words.select("sig").distinct(), "vectors"))
    placed = spread_join(words, written(changes, "changes"), ["sig"])
    same = lambda at: F.substring("word", at, F.lit(1)) == F.col("gone")
    # of a run of equal letters any one may go
    spots = F.filter(F.sequence(F.lit(1), F.length("word")), lambda p: same(p) & ((F.col("come") != "") | (p == 1) | ~same(F.greatest(p - 1, F.lit(1)))))
    made = placed.select("word", "n", "come", F.explode(spots).alias("p"))
    made = made.select("word", "n", F.concat(F.substring("word", F.lit(1), F.col("p") - 1), "come", F.substring("word", F.col("p") + 1, F.length("word"))).alias("other"))
    pairs = written(made.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other"), "near_words").select("word", "n", "other", "other_n")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): the last word that following forms leads to. Every round doubles the steps taken."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = written(at.select("root").distinct().join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root"), "above")
        if above.isEmpty():
            return at
        at = written(spread_join(at, above, ["root"], "left", ["word"]).select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, factor: int = 5, **options: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``word_counts(docs, **options)``.

    n_near counts the words one edit away; form is the commonest of them (ties: the smallest by code points) if it occurs ``factor``
    times as often or more, form_n how often; root is where forms lead to from the word. Null texts hold no words, other columns than
    doc_id and text play no part, repeated rows count again; an empty table gives no rows.
    """
    words = written(word_counts(docs, **options), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left").withColumn("usual", -F.col("best.less") >= factor * F.col("n"))
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("usual"), F.col("best.form")).alias("form"), F.when(F.col("usual"), -F.col("best.less")).alias("form_n"))
    joined = written(joined, "forms")
    ends = roots(joined.where("form is not null"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
