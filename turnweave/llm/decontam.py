"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so a MinHash of a whole document says little about an item inside it. As in LSH
Ensemble (Zhu et al. 2016) the search is partitioned by size, here by halving: items of at most u
shingles, u = 4, 8, 16 ..., are compared with windows of 2u shingles taken every u, so that an
item lies whole inside some window and the resemblance of the two is 0.19 or more wherever 0.8 of the item is in it.
64 minima, each one band, find the candidates; these are verified by exact shingle containment in the whole document.

The minima of all items are a table, and one bitmap of fixed size of their hashes goes to all tasks. Documents are read once, whatever the
number of items: a document whose minima meet no bit is done; the others are written with the minima that did, and these are joined with the table of minima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import as_bytes, set_aside, slices, spread_join, text_key, written

K, LEAST, MINIMA, SMALLEST = 5, 0.8, 64, 4
#: The bitmap has 2 ** PLACES bits (8 MB), two for each code; rows to remove that are sent to all tasks at most.
PLACES, FEW = 26, 2_000_000
#: ASCII punctuation, which does not count in a word.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SEEDS = wordhash.mix(np.arange(101, 101 + MINIMA, dtype=np.uint64))


def plain(text: bytes) -> bytes:
    """Lower case, without ASCII punctuation."""
    return text.decode("utf-8", "replace").lower().encode().translate(None, PUNCTUATION)


def shingles(text: bytes, k: int = K) -> set[tuple[bytes, ...]]:
    words = plain(text).split()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def item_shingles(text: bytes) -> set[tuple[bytes, ...]]:
    """An item's shingles; one of fewer than five words is one shingle of them all."""
    n = len(plain(text).split())
    return shingles(text, min(K, n)) if n else set()


def _minima(grams: np.ndarray, i: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (grams ^ _SEEDS[i]) * (_SEEDS[i] | np.uint64(1))
        x ^= x >> np.uint64(32)
        return x


def _code(u: int, i: int, minimum: np.ndarray) -> np.ndarray:
    """What stands for the i-th minimum of items of at most u shingles; u of 1 to 3 and -1 to -4 are whole items of so many shingles and words."""
    with np.errstate(over="ignore"):
        return wordhash.mix(minimum + wordhash.mix(np.array([u * 1000 + i], dtype=np.int64).view(np.uint64)))


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's size class and the codes of its minima; an item of fewer than five words has one code, its words."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = wordhash.words([plain(t) for t in as_bytes(part.column("text"))])
            sizes, codes = [], []
            for j in range(part.num_rows):
                h = w.hash[w.first[j] : w.first[j + 1]]
                grams = np.unique(wordhash.runs(h, K))
                u = max(SMALLEST, 1 << (len(grams) - 1).bit_length()) if len(grams) else -len(h)
                found = [_code(u, i, _minima(grams, i).min()) for i in range(MINIMA)] if u > 0 else [_code(u, 0, wordhash.runs(h, -u)[:1])] if u < 0 else []
                sizes.append(u)
                codes.append(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column("item_id"), part.column("text"), pa.array(sizes, pa.int32()), pa.array(codes, pa.list_(pa.int64()))], ["item_id", "text", "u", "codes"])


class Filter:
    """The bitmap of all items' codes and the size classes that there are."""

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        self.bits, self.sizes, self.places = bits, sizes, (8 * len(bits)).bit_length() - 1

    def maybe(self, codes: np.ndarray) -> np.ndarray:
        ok = np.ones(len(codes), dtype=bool)
        for at in (codes >> np.uint64(64 - self.places), codes & np.uint64((1 << self.places) - 1)):
            at = at.astype(np.int64)
            ok &= self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
        return ok

    def found(self, w: wordhash.Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, code) of the minima of windows, and word runs, that meet a bit; windows may cross texts, and belong to all they touch."""
        texts, codes = [], []

        def add(code: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            """Codes found from word a on and before word b."""
            lo = np.searchsorted(w.first, a, side="right") - 1
            hi = np.searchsorted(w.first, np.minimum(b, len(w.hash)), side="left")
            many = hi - lo
            texts.append(np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
            codes.append(np.repeat(code, many))

        for n in (-u for u in self.sizes if u < 0):
            code = _code(-n, 0, wordhash.runs(w.hash, n))
            at = np.flatnonzero(self.maybe(code)) if len(code) else np.zeros(0, np.int64)
            add(code[at], at, at + n)
        grams, sizes = wordhash.runs(w.hash, K), [u for u in self.sizes if u > 0]
        if len(grams) and sizes:
            short = -len(grams) % (2 * max(sizes))
            none = np.uint64(0xFFFFFFFFFFFFFFFF)
            for i in range(MINIMA):
                x, width = np.append(_minima(grams, i), np.full(short, none)), 1
                for u in sizes:
                    while width < u:
                        x = np.minimum(x[0::2], x[1::2])
                        width *= 2
                    code = _code(u, i, np.minimum(x[:-1], x[1:]) if len(x) > 1 else x)
                    at = np.flatnonzero(self.maybe(code))
                    add(code[at], at * u, at * u + 2 * u + K)
        return (np.concatenate(texts), np.concatenate(codes)) if texts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, key (md5 of the text), item_id, containment: for every document row and item of which LEAST or more is in the row's text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = written(items.mapInArrow(_item_batches, "item_id long, text string, u int, codes array<long>").where("u != 0").withColumn("item", F.expr("uuid()")), "items")
    codes = items.select("item", F.explode("codes").alias("code"))
    # the bitmap: at most 2,048 rows of 4 kB reach the driver, and at most some 30 size classes
    places = codes.select(F.explode(F.array(F.shiftrightunsigned("code", 64 - PLACES), F.col("code").bitwiseAND(F.lit((1 << PLACES) - 1)))).alias("place"))
    bits = places.groupBy(F.floor(F.col("place") / 32768).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(32768))).alias("bits")).collect()
    whole = np.zeros(1 << (PLACES - 3), dtype=np.uint8)
    for r in bits:
        whole[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    kept = spark.sparkContext.broadcast(Filter(whole, sorted(r.u for r in items.select("u").distinct().collect())))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, code = kept.value.found(wordhash.words([plain(t) for t in as_bytes(part.column("text"))]))
                order = np.lexsort((code, text))
                text, code = text[order], code[order]
                fresh = np.append(True, (text[1:] != text[:-1]) | (code[1:] != code[:-1]))[: len(text)]
                text, code = text[fresh], code[fresh]
                rows, begin = np.unique(text, return_index=True)
                own = pa.ListArray.from_arrays(pa.array(np.append(begin, len(code)), pa.int32()), pa.array(code.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in (part.column("doc_id"), part.column("text"))), own], ["doc_id", "text", "codes"])

    maybe = docs.mapInArrow(meet, "doc_id long, text string, codes array<long>")
    maybe = written(maybe.withColumn("row", F.expr("uuid()")).withColumn("key", text_key(F.col("text"))), "maybe")
    kept.unpersist()
    asked = maybe.select("row", F.explode("codes").alias("code"))
    pairs = spread_join(asked, codes, ["code"], by=["row"]).select("row", "item").distinct()
    pairs = pairs.join(maybe.select("row", "doc_id", "key", "text"), "row")
    pairs = written(pairs, "candidates")
    pairs = spread_join(pairs, items.select("item", "item_id", F.col("text").alias("item_text")), ["item"], by=["row"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_item: dict[bytes, set] = {}
        for batch in batches:
            row, own, share = None, {}, []
            for r, text, item in zip(batch.column("row").to_pylist(), as_bytes(batch.column("text")), as_bytes(batch.column("item_text")), strict=True):
                if r != row:
                    row, own = r, {}
                if len(of_item) > 10_000:
                    of_item.clear()
                want = of_item.get(item) or of_item.setdefault(item, item_shingles(item))
                k = len(next(iter(want)))
                if k not in own:
                    own[k] = shingles(text, k)
                share.append(len(want & own[k]) / len(want))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "item_id")), pa.array(share, pa.float64())], ["doc_id", "key", "item_id", "containment"])

    return pairs.mapInArrow(verify, "doc_id long, key binary, item_id long, containment double").where(F.col("containment") >= LEAST)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, containment for every document row and item with 0.8 or more of the item's shingles in the document.

    A shingle is five consecutive words, in lower case and without ASCII punctuation. An item of one to four words is found where these stand
    next to each other. Items and texts that are null or have no word are in no pair. Repeated rows each have their pairs, once per pair of rows; other columns do not matter.
    """
    return _pairs(docs, benchmark).select("doc_id", "item_id", "containment")


def clean(docs: DataFrame, benchmark: DataFrame, least_words: int = 3) -> DataFrame:
    """docs without the rows whose text contains a test item of ``least_words`` words or more; all columns stay.

    An item of one or two words occurs in documents that know nothing of the test. What is removed is little as a rule, so the
    rows stay where they are; where it is more than two million texts, rows meet them in a shuffle by doc_id and text.
    """
    docs, back = set_aside(docs, "doc_id", "text")
    words = F.size(F.array_remove(F.split(F.regexp_replace(F.lower("text"), r"[!-/:-@\[-`{-~]", ""), r"[\x20\x09-\x0D]+"), ""))
    found = _pairs(docs, benchmark.where("text is not null").where(words >= least_words))
    dirty = written(found.select(F.col("doc_id").alias("_dirty_id"), F.col("key").alias("_dirty_key")).distinct(), "dirty")
    few = dirty.count() <= FEW
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_dirty_id")) & (text_key(F.col("text")) == F.col("_dirty_key"))
    return back(docs.join(F.broadcast(dirty) if few else dirty, same, "left_anti"))
