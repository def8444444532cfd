"""The trie of conversation prefixes, by ROLLUP over columns of turns.

A conversation is rows of blocks, each with the ids of eight turns in columns and the digest of all turns before it, which names the node
that the block hangs under. One ``GROUP BY block, digest, ROLLUP (t1, ..., t8)`` thus aggregates every prefix of every length at once;
grouping_id tells how many of a row's columns count.

A node is known by its smallest member and its depth. So a conversation c owns the nodes whose smallest member it is, and these are
its own prefixes from some depth on. Sums over subtrees follow: a conversation below node X either owns X, or all it owns lies below X.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, written

#: Columns of turns in a block.
WIDTH = 8
TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]
#: Rows that one window runs over; beyond, the windows' totals are run over.
REACH = 4096
#: Ids in one row on their way to a digest.
PIECE = 20_000


def turn_id(role: Column, text: Column) -> Column:
    """Sixteen bytes for a turn: twelve of the md5 of the length of its role, role and text, then four of the text's length in bytes."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.unhex(F.md5(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8")))
    return F.concat(F.substring(digest, 1, 12), F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0")))


def _half(side: int, at: Column, turn: Column) -> Column:
    """One half of the digest of a turn at its place; those of a prefix's turns are XORed."""
    return F.when(turn.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(side), at.cast("long"), turn))


def _before(rows: DataFrame, key: str, at: str, how: str, of: dict[str, str]) -> DataFrame:
    """Adds for each name the aggregate ``how`` ("sum" or "bit_xor", 0 for none) of a column over all rows of the key with a smaller ``at``, which counts up by one.

    Windows reach over REACH rows, and over the totals of such stretches: a key with very many rows is the work of many tasks.
    """
    rows = rows.withColumn("_span", F.floor(F.col(at) / REACH))
    here = Window.partitionBy(key, "_span").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    there = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    total = getattr(F, how)
    far = rows.groupBy(key, "_span").agg(*(total(c).alias(f"_{n}") for n, c in of.items()))
    far = far.select(key, "_span", *(total(f"_{n}").over(there).alias(f"_{n}") for n in of)).where("_span > 0")
    joined = rows.withColumns({n: total(c).over(here) for n, c in of.items()}).join(far, [key, "_span"], "left")
    for n in of:
        near, before = F.coalesce(n, F.lit(0)), F.coalesce(f"_{n}", F.lit(0))
        joined = joined.withColumn(n, near + before if how == "sum" else near.bitwiseXOR(before))
    return joined.select(*(c for c in rows.columns if c != "_span"), *of)


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): turns (conv_id, pos from 1, id) of every rebuilt conversation, and lengths (conv_id, length), turnless ones too.

    Conversation c takes the first h turns of conversation c - c % group (all if fewer, none if absent) and then its own after its first h;
    h is the unsigned crc32 of c in decimal, modulo most + 1. Turns are ordered by turn, null first, ties by their id.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), turn_id(F.col("role"), F.col("text")).alias("id"))
    # equal rows may be very many and are told apart for the sort alone
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("turn"), F.asc("id"), F.asc("row")]
    rows = written(rows.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()).drop("row"), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_skip"), F.sum("n").over(Window.partitionBy("conv_id")).alias("n"))
    parts = parts.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1))
    heads = parts.where("_skip = 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    bases = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    heads = heads.join(bases, "base", "left").select("conv_id", "base", "h", "n", F.least("h", F.coalesce("n_base", F.lit(0))).alias("lent"))
    heads = written(heads.withColumn("length", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "heads")
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), F.asc("id")))
    placed = rows.select("conv_id", "part", "id", local.alias("pos")).join(parts.select("conv_id", "part", "_skip"), ["conv_id", "part"]).select("conv_id", "part", "id", (F.col("pos") + F.col("_skip")).alias("pos"))
    own = placed.join(parts.select("conv_id", "part", "h").join(heads.select("conv_id", "lent"), "conv_id"), ["conv_id", "part"]).where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "id")
    first = placed.where((F.col("pos") <= most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "pos", "id")
    lent = first.join(heads.select("conv_id", "base", "h"), "base").where("pos <= h").select("conv_id", "pos", "id")
    return own.unionByName(lent), heads.select("conv_id", "length")


def blocks(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, block, t1..t8, key_a, key_b, own_a, own_b): turns in columns, digests of the turns before the block and of those in it."""
    slot, at = (F.col("pos") - 1) % WIDTH, F.floor((F.col("pos") - 1) / WIDTH)
    wide = turns.groupBy("conv_id", at.alias("block")).agg(*(F.max(F.when(slot == i, F.col("id"))).alias(t) for i, t in enumerate(TURNS)))
    none = lengths.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("block"), *(F.lit(None).cast("binary").alias(t) for t in TURNS))
    wide = wide.unionByName(none)
    for side, name in ((1, "own_a"), (2, "own_b")):
        own = F.lit(0).cast("long")
        for i, t in enumerate(TURNS):
            own = own.bitwiseXOR(_half(side, F.col("block") * WIDTH + i + 1, F.col(t)))
        wide = wide.withColumn(name, own)
    return _before(wide, "conv_id", "block", "bit_xor", {"key_a": "own_a", "key_b": "own_b"})


def _rolled(rows: DataFrame, measures: str) -> DataFrame:
    """One row per node: smallest member, depth, its last turn, and measures, by one ROLLUP over all blocks."""
    last = "case bit_count(grouping_id()) " + " ".join(f"when {WIDTH - i} then t{i}" for i in range(1, WIDTH + 1)) + " end"
    columns = ", ".join(TURNS)
    sql = f"""
        select * from (
          select min(conv_id) as conv_id, block * {WIDTH} + {WIDTH} - bit_count(grouping_id()) as depth, {last} as last, key_a, key_b, {columns}, {measures}
          from {{rows}} group by block, key_a, key_b, rollup ({columns}))
        where depth = 0 or last is not null"""
    return rows.sparkSession.sql(sql, rows=rows)


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 200) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_pylist(some, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows of one node in a sorted stream."""
    return groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:3])


def _id_digests(ends: DataFrame) -> DataFrame:
    """(depth, path_a, path_b, ends_sha256): SHA-256 of the comma-joined conv_ids of each node's rows in ends, ascending.

    Ids are sorted by ranges, which splits a node with very many. A node that lies inside a partition is digested there; the nodes at
    its two edges, and those of PIECE ids or more, go on as rows of joined ids, which one task hashes in order as a stream: the
    digest of one node is a chain by nature. Of such a node a task holds a batch of rows at a time.
    """
    node = ["depth", "path_a", "path_b"]
    parts_schema = "depth long, path_a long, path_b long, first long, piece binary, sha string"
    arrow = pa.schema([*((c, pa.int64()) for c in (*node, "first")), ("piece", pa.binary()), ("sha", pa.string())])

    def joined(ids: list[tuple]) -> bytes:
        return ",".join(str(r[3]) for r in ids).encode()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            piece = lambda key, ids: dict(zip(node, key, strict=True)) | {"first": ids[0][3], "piece": joined(ids)}
            inside, held = False, None
            for key, run in _runs(batches):
                if held:
                    yield dict(zip(node, held[0], strict=True)) | {"sha": hashlib.sha256(joined(held[1])).hexdigest()}
                ids, held = list(islice(run, PIECE)), None
                if inside and len(ids) < PIECE:
                    held = key, ids
                else:
                    while ids:
                        yield piece(key, ids)
                        ids = list(islice(run, PIECE))
                inside = True
            if held:
                yield piece(*held)

        yield from _batches(rows(), arrow)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for key, run in _runs(batches):
                h, comma = hashlib.sha256(), b""
                for r in run:
                    h.update(comma + r[4])
                    comma = b","
                yield dict(zip(node, key, strict=True)) | {"sha": h.hexdigest()}

        yield from _batches(rows(), arrow)

    sorted_ids = ends.select(*node, "conv_id").repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id")
    some = written(sorted_ids.mapInArrow(parts, parts_schema), "ends")
    chains = some.where("sha is null").repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(hashed, parts_schema)
    return some.where("sha is not null").unionByName(chains).select(*node, F.col("sha").alias("ends_sha256"))


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of all prefixes of conversations given as turns (conv_id, pos from 1 without gaps, id) and lengths (conv_id, length).

    Columns conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (over
    the subtree, members less one times the last text's bytes) and ends_sha256 of the members that end there. Nodes that very many
    children, members or ends share are added up before they are shuffled, and joins deal them out. No conversations: no rows.
    """
    wide = written(blocks(turns, lengths), "blocks")
    node = ["depth", "path_a", "path_b"]
    found = _rolled(wide, "count(*) as n_convs")
    ups = {}
    for side, name in ((1, "a"), (2, "b")):
        path = F.col(f"key_{name}")
        first = F.floor((F.col("depth") - 1) / WIDTH) * WIDTH
        for i, t in enumerate(TURNS):
            path = path.bitwiseXOR(_half(side, first + i + 1, F.col(t)))
        found = found.withColumn(f"path_{name}", path)
        ups[f"up_{name}"] = F.col(f"path_{name}").bitwiseXOR(_half(side, F.col("depth"), F.col("last")))
    size = F.coalesce(F.conv(F.hex(F.substring("last", 13, 4)), 16, 10).cast("long"), F.lit(0))
    found = written(found.select("conv_id", *node, "n_convs", ((F.col("n_convs") - 1) * size).alias("saved"), *(e.alias(n) for n, e in ups.items())), "nodes")

    # every node meets its parent, of which there is one
    up = [(F.col("depth") + 1).alias("depth"), F.col("path_a").alias("up_a"), F.col("path_b").alias("up_b")]
    nodes = spread_join(found, found.select(*up, F.col("conv_id").alias("parent_conv_id")), ["depth", "up_a", "up_b"], "left", ["conv_id"])
    nodes = written(nodes.drop("up_a", "up_b"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children"])
    nodes = written(_before(nodes, "conv_id", "depth", "sum", {"above": "saved"}), "nodes")

    # what a conversation owns lies below all other nodes that it belongs to
    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("owned"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    sums = _rolled(spread_join(wide, owned, ["conv_id"], "left", ["block"]), "sum(coalesce(owned, 0)) as owned, sum(coalesce(leaf, 0)) as n_leaves").select("conv_id", "depth", "owned", "n_leaves")
    full = sum((F.when(F.col(t).isNotNull(), 1).otherwise(0) for t in TURNS), F.lit(0))
    ends = wide.groupBy("conv_id").agg(F.sum(full).cast("long").alias("depth"), F.bit_xor("own_a").alias("path_a"), F.bit_xor("own_b").alias("path_b"))
    out = nodes.join(sums, ["conv_id", "depth"]).join(_id_digests(ends), node, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("owned") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of the conversations that ``rebuilt`` makes of rows (conv_id, turn, role, text); other columns play no part.

    Rows without a conv_id belong to no conversation and are left out. Null roles and texts are empty, repeated rows are turns of their own.
    """
    return trie(*rebuilt(conversations))
