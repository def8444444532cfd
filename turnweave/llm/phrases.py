"""Repeated-phrase removal with sharded Aho-Corasick automata.

A window is 35 consecutive words of one text. Every word covered by a window whose word sequence also
starts anywhere else, in the same text or another, is removed.

1. Every window names an anchor: the run of eight words in it with the least hash, the leftmost of
   equals. Equal windows name equal anchors, and a text has about one anchor for 14 words,
   so anchors are what is counted and shuffled, not windows.
2. Around anchors that occur more than once, the stretch of text whose windows they anchor is cut
   out. Equal stretches are counted together, so a passage that very many texts share
   is one row from there on.
3. Recurring passages are confirmed word by word among the stretches of an anchor, and compiled, shard by shard, into
   Aho-Corasick automata over word numbers. The shard's stretches stream through, which locates every
   occurrence; the spans go back to the texts.

An anchor with very many different stretches is dealt over the shards by its windows: those that recur are confirmed, compiled and located in the
same way, each as a passage of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import as_bytes, slices, spread_join, text_key, written

WINDOW, GRAM, SHARD_ROWS = 35, 8, 20_000
#: Different stretches of an anchor that one shard holds at most; an anchor with more is dealt out by its windows.
CROWDED = 2_000
_BLOCK = 1 << 19


def anchors(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """For texts laid end to end: anchor hash, and the first and last window start (by text) that it anchors."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = np.diff(first)
    text_of = np.repeat(np.arange(len(n)), n)
    last_start = np.repeat(first[1:] - window, n)
    position = (1 << 20) - 1
    for lo in range(0, max(0, len(hashes) - window + 1), _BLOCK):
        h = hashes[lo : lo + _BLOCK + window - 1]
        grams = wordhash.runs(h, gram)
        tagged = (grams & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(grams), dtype=np.uint64)
        at = (wordhash.sliding_min(tagged, window - gram + 1) & np.uint64(position)).astype(np.int64)
        start = lo + np.arange(len(at))
        ok = start <= last_start[start]
        start, at = start[ok], at[ok]
        if len(start):
            new = np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (text_of[start[1:]] != text_of[start[:-1]]))
            begin = np.flatnonzero(new)
            stop = np.append(begin[1:], len(start)) - 1
            out.append((grams[at[begin]], start[begin], start[stop]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(n) + 1, np.int64)
    h, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    edges = np.searchsorted(a, first)
    text = text_of[a]
    return h, a - first[text], b - first[text], edges


def _by_anchor(h: np.ndarray, a: np.ndarray, b: np.ndarray, edges: np.ndarray) -> pa.Array:
    """For each text its different anchors, each with the places (a, b) that it has in the text."""
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((a, h, text))
    h, a, b, text = h[order], a[order], b[order], text[order]
    begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))[: len(h)])
    at = pa.ListArray.from_arrays(pa.array(np.append(begin, len(h)), pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["a", "b"]))
    groups = pa.StructArray.from_arrays([pa.array(h[begin].view(np.int64)), at], ["h", "at"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[begin], np.arange(len(edges))), pa.int32()), groups)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = as_bytes(part.column("text"))
            w = wordhash.words(texts)
            h, a, b, edges = anchors(w.hash, w.first)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("key"),
                    pa.array(np.diff(w.first), pa.int64()),
                    pa.array([_digest(t.split()) for t in texts]),
                    _by_anchor(h, a, b, edges),
                ],
                ["doc_id", "key", "n_words", "sha", "anchors"],
            )


def _stretch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            keys, weights, hs, starts, texts = [], [], [], [], []
            for key, weight, text, found in zip(part.column("key").to_pylist(), part.column("weight").to_pylist(), as_bytes(part.column("text")), part.column("found"), strict=True):
                words = text.split()
                for x in found.as_py():
                    for at in x["at"]:
                        keys.append(key)
                        weights.append(weight)
                        hs.append(x["h"])
                        starts.append(at["a"])
                        texts.append(b" ".join(words[at["a"] : at["b"] + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(weights, pa.int64()), pa.array(hs, pa.int64()), pa.array(starts, pa.int32()), pa.array(texts, pa.binary())], ["key", "weight", "h", "a", "stretch"])


def _passages(stretches: list[tuple[tuple[int, ...], int]], window: int) -> set[tuple[int, ...]]:
    """Recurring word sequences among the stretches (words, times seen) of one anchor.

    Windows that always follow each other make one passage, so every occurrence of a recurring window lies in an
    occurrence of its passage.
    """
    if len(stretches) == 1:
        return {stretches[0][0]} if stretches[0][1] > 1 else set()
    seen: dict[tuple, list] = {}  # window: times seen, the one after, the one before; False if that varies
    for words, times in stretches:
        own = [words[i : i + window] for i in range(len(words) - window + 1)]
        for i, x in enumerate(own):
            after, before = own[i + 1] if i + 1 < len(own) else None, own[i - 1] if i else None
            if (had := seen.get(x)) is None:
                seen[x] = [times, after, before]
            else:
                had[0] += times
                if had[1] != after:
                    had[1] = False
                if had[2] != before:
                    had[2] = False
    out = set()
    for x, (times, _, before) in seen.items():
        if times < 2 or (before and seen[before][0] > 1 and seen[before][1] == x):
            continue  # once only, or inside a passage that begins earlier
        words, now = list(x), x
        while (after := seen[now][1]) and seen[after][0] > 1 and seen[after][2] == now:
            words.append(after[-1])
            now = after
        out.add(tuple(words))
    return out


def _located(shard: pa.Table) -> pa.Table:
    """Compile one shard's passages and stream its stretches through the automaton."""
    numbers: dict[bytes, int] = {}
    rows, of_anchor = [], {}
    for id_, h, times, text in zip(shard.column("stretch_id").to_pylist(), shard.column("h").to_pylist(), shard.column("times").to_pylist(), shard.column("stretch").to_pylist(), strict=True):
        words = tuple(numbers.setdefault(x, len(numbers)) for x in text.split(b" "))
        rows.append((id_, words))
        of_anchor.setdefault(h, []).append((words, times))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for stretches in of_anchor.values():
        for passage in _passages(stretches, WINDOW):
            automaton.add_word(passage, len(passage))
    ids, spans = [], []
    if len(automaton):
        automaton.make_automaton()
        for id_, words in rows:
            if found := [(end + 1 - n, end + 1) for end, n in automaton.iter(words)]:
                ids.append(id_)
                spans.append([{"s": s, "e": e} for s, e in found])
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    return pa.table({"stretch_id": pa.array(ids, pa.binary()), "spans": pa.array(spans, kind)})


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch cut into its single windows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            ids, at, cut, times, texts = [], [], [], [], []
            part = batch.slice(lo, 500)
            for id_, n, text in zip(part.column("stretch_id").to_pylist(), part.column("times").to_pylist(), part.column("stretch").to_pylist(), strict=True):
                words = text.split(b" ")
                for i in range(len(words) - WINDOW + 1):
                    ids.append(id_)
                    at.append(i)
                    times.append(n)
                    texts.append(b" ".join(words[i : i + WINDOW]))
                    cut.append(hashlib.md5(texts[-1]).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(at, pa.int32()), pa.array(times, pa.int64()), pa.array(cut, pa.binary()), pa.array(texts, pa.binary())], ["stretch_id", "at", "times", "cut", "stretch"])


def _kept_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, shas = [], []
        for text, spans in zip(as_bytes(batch.column("text")), batch.column("spans"), strict=True):
            words = text.split()
            gone = bytearray(len(words))
            for x in spans.as_py():
                gone[x["s"] : x["e"]] = b"\1" * (x["e"] - x["s"])
            kept = [x for x, g in zip(words, gone, strict=True) if not g]
            removed.append(len(words) - len(kept))
            shas.append(_digest(kept))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(shas)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, copies, spans) of docs (doc_id, key, text).

    rows: doc_id, key, n_words, sha of all words. copies: key, weight (2: the text occurs more than once).
    spans: key, spans (array of word positions s, e) for texts in which recurring passages were located.
    """
    places = "array<struct<h:long,at:array<struct<a:int,b:int>>>>"
    rows = written(docs.mapInArrow(_anchor_batches, f"doc_id long, key binary, n_words long, sha string, anchors {places}"), "anchors")
    texts = rows.where(F.col("n_words") >= WINDOW).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.least(F.count("*"), F.lit(2)).alias("weight"), F.first("anchors").alias("anchors"))
    texts = written(texts, "texts")
    found = texts.select("key", "doc_id", "weight", F.explode("anchors").alias("x")).select("key", "doc_id", "weight", "x.*")
    again = found.groupBy("h").agg(F.sum(F.col("weight") * F.size("at")).alias("n")).where("n > 1").select("h")
    found = spread_join(found, again, ["h"], by=["key"]).groupBy("key", "doc_id", "weight").agg(F.collect_list(F.struct("h", "at")).alias("found"))
    joined = docs.join(found.withColumnsRenamed({"doc_id": "_id", "key": "_key"}), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    stretches = joined.select("key", "weight", "text", "found").mapInArrow(_stretch_batches, "key binary, weight long, h long, a int, stretch binary")
    stretches = written(stretches.withColumn("stretch_id", F.unhex(F.md5("stretch"))), "stretches")
    distinct = stretches.groupBy("stretch_id", "h", "stretch").agg(F.sum("weight").alias("times"))
    distinct = written(distinct, "distinct")
    of_anchor = distinct.groupBy("h").agg(F.count("*").alias("n"), F.sum("times").alias("all")).where("all > 1")
    distinct = spread_join(distinct, of_anchor.select("h", "n"), ["h"], by=["stretch_id"])
    few = distinct.where(F.col("n") <= CROWDED).select("stretch_id", "h", "times", "stretch")
    cut = distinct.where(F.col("n") > CROWDED).select("stretch_id", "times", "stretch").mapInArrow(_window_batches, "stretch_id binary, at int, times long, cut binary, stretch binary")
    cut = written(cut, "windows")
    alone = cut.groupBy(F.col("cut").alias("stretch_id")).agg(F.sum("times").alias("times"), F.first("stretch").alias("stretch")).where("times > 1")
    few = written(few.unionByName(alone.withColumn("h", F.xxhash64("stretch_id"))), "shards")
    shards = max(1, -(-few.count() // SHARD_ROWS))
    located = few.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).groupBy("shard").applyInArrow(_located, "stretch_id binary, spans array<struct<s:int,e:int>>")
    located = written(located, "located")
    shifted = lambda by: F.transform("spans", lambda x: F.struct((x.s + F.col(by)).alias("s"), (x.e + F.col(by)).alias("e")))
    single = spread_join(cut.select("stretch_id", "at", "cut"), located.withColumnRenamed("stretch_id", "cut"), ["cut"], by=["stretch_id"])
    single = single.groupBy("stretch_id").agg(F.flatten(F.collect_list(shifted("at"))).alias("spans"))
    spans = spread_join(stretches, located.unionByName(single), ["stretch_id"], by=["key"]).select("key", shifted("a").alias("spans"))
    spans = spans.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return rows, texts.select("key", "weight"), spans


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of docs (doc_id, text).

    A null or empty text has no words. A text of under 35 words keeps them all. A text that occurs twice or
    more, with 35 words at least, keeps none. Repeated rows are copies of each other; other columns do not matter.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", text_key(F.col("text")))
    rows, copies, spans = repeated_spans(docs)
    light = spread_join(rows.select("doc_id", "key", "n_words", "sha"), copies, ["key"], "left", ["doc_id"])
    whole = light.where("coalesce(weight, 0) > 1").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(_digest([])).alias("kept_sha256"))
    once = written(light.where("coalesce(weight, 0) <= 1").join(spans, "key", "left"), "once")
    untouched = once.where("spans is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    cut = once.where("spans is not null").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "n_words", "spans")
    touched = docs.join(cut, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    touched = touched.select("doc_id", "n_words", "text", "spans").mapInArrow(_kept_batches, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return whole.unionByName(untouched).unionByName(touched)
