"""What the corpus operators share: written scratch tables, word expressions and Arrow helpers."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these (space, tab, line ends, vertical tab, form feed).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that setting is absent a folder of our own is set, but only in a local session (tests on one machine): the executors of
    a cluster could not see it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="turnweave-", dir=os.environ.get("TMPDIR") or "/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/turnweave/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    The table outlives a lost executor, and later steps read it instead of computing it again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def heavy(df: DataFrame, on: list[str], share: float = 0.001, least: int = 200) -> list[int]:
    """Hashes of the keys that hold over ``share`` of df's rows, and ``least`` at any rate: so at most 1 / share of them.

    Rows are counted by 4,096 classes of hashes first, and by key only in the classes that are large enough; both counts are added up
    before anything is shuffled.
    """
    h = F.xxhash64(*on)
    classes = {r.c: r.n for r in df.groupBy(F.pmod(h, F.lit(4096)).alias("c")).agg(F.count("*").alias("n")).collect()}
    limit = max(least, share * sum(classes.values()))
    large = sorted(c for c, n in classes.items() if n > limit)
    if not large:
        return []
    counted = df.where(F.pmod(h, F.lit(4096)).isin(large)).groupBy(h.alias("h")).agg(F.count("*").alias("n"))
    return sorted(r.h for r in counted.where(F.col("n") > limit).collect())


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", by: list[str] | None = None, hot: list[int] | None = None) -> DataFrame:
    """left.join(right, on, how) that no heavy key of left puts into one task; left is best a written table.

    Rows of left with a heavy key are dealt by a hash of ``by`` (all their columns, if None), and the rows of right with that key, of which there should be
    few, are copied to every deal. Heavy keys are few by definition, so the copies are bounded. ``hot``: what ``heavy`` found, if that is known.
    """
    hot = heavy(left, on) if hot is None else hot
    if not hot:
        return left.join(right, on, how)
    deals = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.xxhash64(*on).isin(hot)
    deal = F.when(is_hot, F.pmod(F.xxhash64(*(by or left.columns), F.lit(11)), F.lit(deals))).otherwise(F.lit(0)).cast("long")
    copies = F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    return left.withColumn("_deal", deal).join(right.withColumn("_deal", copies), [*on, "_deal"], how).drop("_deal")


def least(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The ``most`` rows that come first by order, whose first column is a 64-bit hash.

    A sort with a limit sends so many rows of every partition to one task. Here rows are cut by their hashes first, at the share of them that is wanted
    and a little more, so that task gets about ``most`` rows, however many partitions there are. Where hashes are uneven the share grows until there are enough.
    """
    n = rows.count()
    share = (most + 6 * math.sqrt(most) + 100) / max(1, n)
    while share < 1:
        some = rows.where(order[0] <= F.lit(int(share * 2**64) - 2**63).cast("long"))
        if some.count() >= most:
            rows = some
            break
        share *= 4
    return rows.orderBy(*order).limit(most)


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the used ones under names that no operator uses, and what gives them their names back (columns added after them stay)."""
    names = docs.columns
    back = lambda out: out.toDF(*names, *out.columns[len(names) :])
    return docs.toDF(*(c if c in used else f"caller_{i}" for i, c in enumerate(names))), back


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as keep it apart from docs' columns."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for a text (md5); null for null."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def word_count(text: Column) -> Column:
    """Words of a text as a long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000):
    """Pieces of an Arrow batch whose texts in ``column`` hold about ``most`` bytes (a single longer text alone)."""
    start, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
