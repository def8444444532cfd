"""Near-duplicate documents by Order MinHash and banded alignment.

A document's k-mers are its runs of three consecutive words (of two in texts of less than 50 words), each labelled with its number among
equal k-mers of that document. For every hash function the two k-mers with the least hashes
are taken and put back into text order; the sequence is one sketch (Marçais et al. 2019). Since
order counts, two documents agree in a sketch about as often as their texts align. Documents that agree in any of 80
sketches (96 of short texts) are candidates, and a link is a candidate pair whose banded word alignment leaves a similarity of 0.8 or more
(1 - edits / longer length). A change in every fifth word leaves such a similarity but two k-mers of five, hence
short k-mers and many sketches. Texts of 40 to 49 words have sketches of both kinds, so any two texts whose lengths allow a link share a kind. Lengths and word histograms bound the edits from below and spare most other candidates the alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import align, wordhash
from .common import as_bytes, heavy, set_aside, slices, spread_join, text_key, written
from .graph import components

K, TAKEN, SKETCHES, LEAST, BINS = 3, 2, 80, 0.8, 256
#: Words of the k-mers of short texts and their sketches, the length under which texts have them, and the length from which they have the others; texts of fewer words than LEAST_WORDS have none.
SHORT_K, SHORT_SKETCHES, SHORT, LONG, LEAST_WORDS = 2, 96, 50, 40, 5
#: Nodes of a block that are compared with those of another one at once, and their words.
BLOCK, BLOCK_WORDS = 512, 1_000_000


def sketches(hashes: np.ndarray, k: int = K, taken: int = TAKEN, n: int = SKETCHES) -> np.ndarray | None:
    """The n order-preserving sketches of one document's word hashes; None with fewer than k words."""
    grams = wordhash.runs(hashes, k)
    if not len(grams):
        return None
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    fresh = np.append(True, s[1:] != s[:-1])
    number = np.arange(len(s)) - np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
    labelled = np.empty_like(grams)
    with np.errstate(over="ignore"):
        labelled[order] = wordhash.mix(s + number.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        seeds = wordhash.mix(np.arange(1, n + 1, dtype=np.uint64))
        out = np.empty(n, dtype=np.uint64)
        step = max(1, 400_000 // len(grams))
        for lo in range(0, n, step):
            seed = seeds[lo : lo + step, None]
            x = (labelled[None, :] ^ seed) * (seed | np.uint64(1))
            x ^= x >> np.uint64(32)
            at, rows = np.empty((len(seed), min(taken, len(grams))), dtype=np.int64), np.arange(len(seed))
            for j in range(at.shape[1]):
                at[:, j] = x.argmin(axis=1)
                x[rows, at[:, j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            at.sort(axis=1)
            picked = labelled[at]
            h = np.zeros(len(seed), dtype=np.uint64)
            for j in range(at.shape[1]):
                h = wordhash.mix(h * np.uint64(0x9FB21C651E98DF25) + picked[:, j])
            out[lo : lo + step] = h
    return out


def bands(hashes: np.ndarray) -> np.ndarray | None:
    """All sketches of one document, each mixed with its number; None with fewer than five words."""
    if len(hashes) < LEAST_WORDS:
        return None
    out = []
    with np.errstate(over="ignore"):
        if len(hashes) >= LONG:
            out.append(wordhash.mix(sketches(hashes) + np.arange(SKETCHES, dtype=np.uint64)))
        if len(hashes) < SHORT:
            out.append(wordhash.mix(sketches(hashes, SHORT_K, n=SHORT_SKETCHES) + np.arange(SKETCHES, SKETCHES + SHORT_SKETCHES, dtype=np.uint64)))
    return np.concatenate(out)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different text of a batch, with the doc_ids of all its rows there: copies are put together before anything is shuffled."""
    names = ["key", "ids", "n", "bins", "bands"]
    for batch in batches:
        ids: dict[bytes, list] = {}
        fresh = []
        for i, (key, doc_id) in enumerate(zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
            if key not in ids:
                fresh.append(i)
            ids.setdefault(key, []).append(doc_id)
        for part in slices(batch.take(pa.array(fresh, pa.int64())), "text"):
            w = wordhash.words(as_bytes(part.column("text")))
            bins, found = [], []
            for i in range(part.num_rows):
                own = w.hash[w.first[i] : w.first[i + 1]]
                bins.append(np.minimum(255, np.bincount((own % np.uint64(BINS)).astype(np.int64), minlength=BINS)).astype(np.uint8).tobytes())
                s = bands(own)
                found.append(None if s is None else s.view(np.int64))
            own_ids = pa.array([ids[k] for k in part.column("key").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("key"), own_ids, pa.array(np.diff(w.first), pa.int64()), pa.array(bins, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names)


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose lengths and word histograms allow the similarity: an edit changes the length by one and the histogram by two at most."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            n = [part.column(c).to_numpy() for c in ("a_n", "b_n")]
            x = [np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BINS).astype(np.int64) for c in ("a_bins", "b_bins")]
            most = np.floor((1 - LEAST) * np.maximum(*n) + 1e-9)
            ok = (np.abs(n[0] - n[1]) <= most) & (np.abs(x[0] - x[1]).sum(axis=1) <= 2 * most)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("a", "b", "b_no")], ["a", "b", "b_no"]).filter(pa.array(ok))


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the written pairs of numbers (a_no, b_no) that lengths and word histograms allow, as pairs of keys (a, b) with b_no."""
    for end, hot in [(end, heavy(pairs, [f"{end}_no"])) for end in ("a", "b")]:
        own = nodes.select(F.col("no").alias(f"{end}_no"), F.col("key").alias(end), F.col("n").alias(f"{end}_n"), F.col("bins").alias(f"{end}_bins"))
        pairs = spread_join(pairs, own, [f"{end}_no"], by=["a_no", "b_no"], hot=hot)
    return pairs.mapInArrow(_near_batches, "a binary, b binary, b_no long")


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks the members to be aligned, each with those of the others whose roots differ and whose lengths and word histograms allow the similarity."""
    for batch in batches:
        for group, same, members in zip(batch.column("group").to_pylist(), batch.column("same").to_pylist(), batch.column("members"), strict=True):
            own = members.values
            no, left = own.field("no").to_numpy(), own.field("left").to_numpy(zero_copy_only=False)
            root, n = own.field("root").to_numpy(), own.field("n").to_numpy()
            i, j = (np.arange(len(no)), np.arange(len(no))) if same else (np.flatnonzero(left), np.flatnonzero(~left))
            most = np.floor((1 - LEAST) * np.maximum(n[i][:, None], n[j][None, :]) + 1e-9)
            ok = (root[i][:, None] != root[j][None, :]) & (np.abs(n[i][:, None] - n[j][None, :]) <= most)
            if same:
                ok = np.triu(ok, 1)
            p, q = np.nonzero(ok)
            x = np.frombuffer(b"".join(own.field("bins").to_pylist()), dtype=np.uint8).reshape(-1, BINS).astype(np.int16)
            near = np.zeros(len(p), dtype=bool)
            for at in range(0, len(p), 4096):
                u, v = p[at : at + 4096], q[at : at + 4096]
                near[at : at + 4096] = np.abs(x[i[u]] - x[j[v]]).sum(axis=1, dtype=np.int64) <= 2 * most[u, v]
            a, b = i[p[near]], j[q[near]]
            partners = [no[part] for part in np.split(b, np.searchsorted(a, np.arange(1, len(no))))]
            met = np.union1d(a, b)
            if len(met):
                columns = [pa.array(np.full(len(met), group)), pa.array(no[met]), pa.array(root[met]), pa.array([partners[k] for k in met], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["group", "no", "root", "partners"])


def _across(items: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """What is left to align in buckets that hold several components: rows (group, no, root, partners), a node in a group with its partners there.

    Documents with one long template share many buckets, most of them with the same partners. So each node belongs to the largest of its buckets, its home.
    Two homes (and each home with itself) meet once, however many buckets have nodes of both: all their nodes where these buckets hold most of their pairs anyway, else only
    those in such a bucket. The nodes that meet are dealt over blocks by a hash, and two blocks are a row of their own, so homes of any size are the work of many tasks.
    """
    of_node = nodes.select("no", "key", "n").join(roots.withColumnRenamed("node", "key"), "key", "left").select("no", "n", F.xxhash64(F.coalesce("root", "key")).alias("root"))
    of_node = written(of_node, "rooted")
    sizes = items.join(of_node.select("no", "root"), "no").groupBy("bucket").agg(F.count("*").alias("all"), F.min("root").alias("r"), F.max("root").alias("s"))
    mixed = written(sizes.where("r != s and all > 2").select("bucket", "all"), "mixed")
    member = written(spread_join(items, mixed, ["bucket"], by=["no"]), "members")
    home = written(member.groupBy("no").agg(F.max(F.struct("all", "bucket")).getField("bucket").alias("home")), "homes")
    member = written(member.select("bucket", "no").join(home, "no"), "members")
    # how many of a home's nodes are in each bucket, and which homes have buckets in common
    sizes = home.groupBy("home").agg(F.count("*").alias("size"))
    held = written(member.groupBy("bucket", "home").agg(F.count("*").alias("m")).join(sizes, "home"), "held")
    low, high = (held.select("bucket", F.col("home").alias(end), F.col("m").alias(f"{end}_m"), F.col("size").alias(f"{end}_size")) for end in ("lo", "hi"))
    common = written(spread_join(low, high, ["bucket"], by=["lo"]).where("lo <= hi"), "common")
    met = common.groupBy("lo", "hi").agg((F.sum(F.col("lo_m") * F.col("hi_m")) >= F.first(F.col("lo_size") * F.col("hi_size"))).alias("dense"))
    met = written(met.withColumn("dense", F.col("dense") | (F.col("lo") == F.col("hi"))), "met")
    end = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("home")
    whole = spread_join(home, met.where("dense").select("lo", "hi", end), ["home"], by=["no"])
    sparse = common.join(met.where("not dense"), ["lo", "hi"]).select("bucket", "lo", "hi", end)
    sparse = spread_join(member, sparse, ["bucket", "home"], by=["no"])
    own = whole.select("lo", "hi", "home", "no").unionByName(sparse.select("lo", "hi", "home", "no").distinct())
    own = written(own.join(of_node, "no"), "own")
    is_low = F.col("home") == F.col("lo")
    blocks = lambda own: F.greatest(F.ceil(F.count(F.when(own, 1)) / BLOCK), F.ceil(F.sum(F.when(own, F.col("n"))) / BLOCK_WORDS), F.lit(1))
    parts = own.groupBy("lo", "hi").agg(blocks(is_low).alias("lo_parts"), blocks(F.col("home") == F.col("hi")).alias("hi_parts"))
    own = spread_join(own, parts, ["lo", "hi"], by=["no"]).join(nodes.select("no", "bins").dropDuplicates(["no"]), "no")
    same = F.col("lo") == F.col("hi")
    own = own.withColumn("part", F.pmod(F.xxhash64("no", F.lit(5)), F.when(is_low, F.col("lo_parts")).otherwise(F.col("hi_parts"))))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_low, F.col("hi_parts")).otherwise(F.col("lo_parts")) - 1)))
    first = F.when(same, F.least("part", "other")).when(is_low, F.col("part")).otherwise(F.col("other"))
    second = F.when(same, F.greatest("part", "other")).when(is_low, F.col("other")).otherwise(F.col("part"))
    left = F.when(same, F.col("part") <= F.col("other")).otherwise(is_low)
    own = own.select("lo", "hi", first.alias("x"), second.alias("y"), F.struct("no", "root", "n", "bins", left.alias("left")).alias("member"))
    own = own.groupBy("lo", "hi", "x", "y").agg(F.collect_list("member").alias("members")).where("size(members) > 1")
    own = own.select(F.xxhash64("lo", "hi", "x", "y").alias("group"), ((F.col("lo") == F.col("hi")) & (F.col("x") == F.col("y"))).alias("same"), "members")
    return own.mapInArrow(_block_batches, "group long, no long, root long, partners array<long>")


def _links(found: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b) that connect the nodes of each group of the written rows of ``_across``: a pair that earlier links of its group connect is not aligned."""
    keyed = written(found.join(nodes.select("no", "key"), "no"), "found")
    keyed = spread_join(keyed, texts, ["key"], by=["group"])

    def verify(group: pa.Table) -> pa.Table:
        no, root, key, partners = (group.column(c).to_pylist() for c in ("no", "root", "key", "partners"))
        text = [x.encode() for x in group.column("text").to_pylist()]
        at: dict[int, list[int]] = {}
        for i, x in enumerate(no):
            at.setdefault(x, []).append(i)
        above = {x: x for x in root}

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        known, links = align.Texts(LEAST, 1 << 40), set()
        for i, others in enumerate(partners):
            for j in (j for x in others for j in at[x]):
                p, q = top(root[i]), top(root[j])
                if p != q and known.similar(text[i], text[j]):
                    above[p] = q
                    links.add((key[i], key[j]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return keyed.select("group", "no", "root", "partners", "key", "text").groupBy("group").applyInArrow(verify, "a binary, b binary")


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = align.Texts(LEAST)
    for batch in batches:
        ok = [texts.similar(a, b) for a, b in zip(as_bytes(batch.column("a_text")), as_bytes(batch.column("b_text")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the written pairs (a, b) whose texts align."""
    met = pairs.select("a", "b")
    for end, hot in [(end, heavy(pairs, [end])) for end in ("a", "b")]:
        met = spread_join(met, texts.select(F.col("key").alias(end), F.col("text").alias(f"{end}_text")), [end], by=["a", "b"], hot=hot)
    return met.mapInArrow(_verify_batches, "a binary, b binary")


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, key, class_key, class_id (the least doc_id of its class).

    Exact copies are one node (their md5), so a group of copies of any size costs one row from
    there on. In each bucket every node is aligned with the least one, unless they are connected already. A node's first
    comparison is with the least leader of all its buckets, which joins most copies, so a group of n near copies takes
    about n comparisons, not one for each pair. In buckets that hold several components after that, all pairs
    of nodes in different components are compared by length and histogram, and aligned where these allow it and no link found there before connects them.

    So any two alike texts that agree in a sketch come together. Nearly all do; the README has the measured recall by similarity. Documents that share a sketch without being alike, such as many with
    one long template, cost a comparison of lengths and histograms for each pair.

    Null texts: each row is its own class. Empty texts are copies of one another. A text of fewer than
    five words has no sketch and joins only its exact copies. Repeated rows and other columns do not matter;
    a null doc_id yields a row too, and never names a class unless all its members lack one. Rows that share a doc_id are rows of their own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.where("text is not null").withColumn("key", text_key(F.col("text")))
    rows = written(keyed.mapInArrow(_sketch_batches, "key binary, ids array<long>, n long, bins binary, bands array<long>"), "sketches")
    nodes = rows.groupBy("key").agg(F.min(F.array_min("ids")).alias("doc_id"), F.first("n").alias("n"), F.first("bins").alias("bins"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("no", F.xxhash64("key")), "nodes")
    # the search for candidates knows a node by a short number; what shares it by chance is only one more candidate
    items = nodes.where("bands is not null").select("no", F.explode("bands").alias("bucket"))
    crowded = items.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    items = written(spread_join(items, crowded, ["bucket"], by=["no"]), "items")
    # one text for each node that shares a bucket
    wanted = nodes.join(items.select("no").distinct(), "no", "left_semi").select("key", "doc_id")
    texts = keyed.join(wanted, (keyed.doc_id.eqNullSafe(wanted.doc_id)) & (keyed.key == wanted.key), "left_semi")
    texts = written(texts.dropDuplicates(["key", "doc_id"]).select("key", "text"), "texts")
    # every node with the least of its buckets' leaders, then with the other leaders unless it is connected to them
    near = written(_near(written(_to_leader(items), "leaders"), nodes), "pairs")
    first = written(near.groupBy("a").agg(F.min_by("b", "b_no").alias("b")), "pairs")
    roots = components(_verified(first, texts))
    pairs = written(_apart(near.join(first, ["a", "b"], "left_anti"), roots), "pairs")
    roots = components(_verified(pairs, texts), roots)
    # what is left: all pairs of a bucket across its components
    roots = components(_links(written(_across(items, roots, nodes), "across"), nodes, texts), roots)
    member = nodes.select("key", "doc_id").join(roots.withColumnRenamed("node", "key"), "key", "left")
    member = written(member.select("key", "doc_id", F.coalesce("root", "key").alias("root")), "members")
    named = member.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = spread_join(member.select("key", "root"), named, ["root"], by=["key"])
    out = spread_join(rows.select("key", "ids"), named, ["key"]).select(F.explode("ids").alias("doc_id"), "key", F.col("root").alias("class_key"), "class_id")
    alone = docs.where("text is null").select("doc_id", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("class_key"), F.col("doc_id").alias("class_id"))
    return out.unionByName(alone)


def _to_leader(items: DataFrame) -> DataFrame:
    """Each member of a bucket with its least one. That is a minimum, so no bucket need come together in a task."""
    least = items.groupBy("bucket").agg(F.min("no").alias("b_no"))
    return spread_join(items, least, ["bucket"], by=["no"]).where("no > b_no").select(F.col("no").alias("a_no"), "b_no").distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are not connected yet."""
    for end, hot in [(end, heavy(pairs, [end])) for end in ("a", "b")]:
        pairs = spread_join(pairs, roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), [end], "left", ["a", "b"], hot)
    return pairs.where("coalesce(a_root, a) != coalesce(b_root, b)").select("a", "b")


def kept(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each class: the one with the class's least doc_id.

    All columns stay. Of rows that share that doc_id and text, one stays; null texts stay. Of different texts of a class that share
    its least doc_id, that with the least md5 stays. Columns may have any names.
    """
    docs, back = set_aside(docs, "doc_id", "text")
    found = classes(docs).where("key is not null and doc_id <=> class_id").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "class_key")
    first = found.groupBy("class_key").agg(F.min("_key").alias("_key"), F.min("_id").alias("_id")).drop("class_key")
    keyed = docs.withColumn("_text_key", text_key(F.col("text")))
    chosen = keyed.join(first, F.col("_text_key").eqNullSafe(F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["doc_id", "_text_key"])
    return back(chosen.drop("_text_key").unionByName(docs.where("text is null")))
