"""Toxicity of documents whose toxic words may be disguised.

A noisy-channel decoder restores each suspicious token: its characters make a lattice of the letters that they can stand for
(leetspeak, look-alikes), of separators that can be dropped and of repeated letters that can be one or two, and Viterbi finds
the most likely word under a character trigram model of all documents' words. The restored text is scored by a
logistic model over the word beginnings that labelled documents show to be toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, least, slices, text_key, written
from .near_dedup import classes

#: At most this many labelled rows, those with the least hashes of doc_id, are learned from.
ROWS, THRESHOLD = 30_000, 0.3
#: Tokens up to this length are remembered; words inside a spaced run are read from each of its letters on as far as this, from its first letter on whole.
REMEMBERED, SPAN = 96, 500
#: A term counts if at least this many toxic texts have it; near copies of one another count as one text.
SUPPORT = 3
#: Letters that a character can stand for, besides itself.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "%": "aeiou", "#": "aeiou"}
SEPARATORS = ".-_*~'`^,:;/\\+ "
CHANNEL_COST, DROP_COST, KEEP_DIGIT_COST, SHRINK_COST = 0.7, 0.1, 6.0, 0.1
#: In a lattice: the end of a word and the beginning of another.
BREAK, BREAK_COST = "\n", 0.5
_STRIP = " \t\r\n\"'.,;:!?()[]{}<>|/\\&%$#*+=~^_-`«»“”‘’…"
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_TRIPLE = re.compile(r"(.)\1\1")
_SINGLES = re.compile(rb"\x01{3,}")


def packed(gram: str) -> int:
    """A trigram as one number, 21 bits for each letter."""
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


class Counts:
    """Numbers with their counts, twelve to sixteen bytes each."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, first = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(first, weights=counts, minlength=len(self.keys)).astype(np.int64)

    def get(self, key: int) -> int:
        i = int(self.keys.searchsorted(key))
        return int(self.counts[i]) if i < len(self.keys) and self.keys[i] == key else 0


class Letters:
    """Trigram model over whatever letters its words have; the end of a word counts as a letter. Rare trigrams lean on their last two letters.

    It holds every trigram that there is, as sorted numbers.
    """

    def __init__(self, trigrams: Counter[str]):
        self.fill(np.array([packed(g) for g in trigrams], dtype=np.int64), np.array(list(trigrams.values()), dtype=np.int64))

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray) -> Letters:
        out = cls.__new__(cls)
        out.fill(codes, counts)
        return out

    def fill(self, codes: np.ndarray, counts: np.ndarray) -> None:
        low = (1 << 21) - 1
        self.three, self.two, self.last, self.middle = Counts(codes, counts), Counts(codes >> 21, counts), Counts(codes & (1 << 42) - 1, counts), Counts(codes >> 21 & low, counts)
        letters = np.unique(np.concatenate([codes >> 42, codes >> 21 & low, codes & low]))
        self.size = len(letters) + 1  # one more for all that was never seen
        self.known: dict[str, float] = {}

    def __call__(self, a: str, b: str, c: str) -> float:
        g = a + b + c
        cost = self.known.get(g)
        if cost is None:
            code = packed(g)
            leant = 5.0 * (self.last.get(code & (1 << 42) - 1) + 0.1) / (self.middle.get(ord(b)) + 0.1 * self.size)
            cost = -math.log((self.three.get(code) + 0.02 + leant) / (self.two.get(code >> 21) + 0.02 * self.size + 5.0))
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[g] = cost
        return cost


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters the strings that it can stand for, with their costs."""
    out, i = [], 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        c, n = token[i], j - i
        arcs: dict[str, float] = {}

        def add(text: str, cost: float, arcs: dict = arcs) -> None:
            arcs[text] = min(cost, arcs.get(text, math.inf))

        for letter in [c] * c.isalpha() + list(STANDS_FOR.get(c, "")):
            cost = 0.0 if letter == c else CHANNEL_COST
            if n <= 2:
                add(letter * n, cost)
            if n > 1:
                add(letter, cost + SHRINK_COST * (n > 2) + (0.5 if n == 2 else 0))
                add(letter * 2, cost + SHRINK_COST * (n > 2))
        if c in SEPARATORS:
            add(BREAK, DROP_COST)
        if c in SEPARATORS or (c in STANDS_FOR and not c.isdigit() and i + n in (len(token),)):
            add("", DROP_COST)
        if not arcs:
            add("", DROP_COST if not c.isalnum() else KEEP_DIGIT_COST)
        elif c.isdigit():
            add("", KEEP_DIGIT_COST)
        out.append(list(arcs.items()))
        i = j
    return out


def decode(token: str, letters: Letters, apart: bool = False) -> str:
    """The most likely plain words behind a token, with a space between them. apart: a word may end after any letter."""
    best: dict[tuple[str, str], tuple[float, tuple | None]] = {("\n", "\n"): (0.0, None)}
    steps = lattice(token)
    if apart:
        steps = [x for arcs in steps for x in (arcs, [("", 0.0), (BREAK, BREAK_COST)])]
    for arcs in steps:
        after: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in best.items():
            for text, price in arcs:
                total, x, y = cost + price, a, b
                if text == BREAK:
                    if b != "\n":  # between words a further break changes nothing
                        total += letters(a, b, "\n")
                        x = y = "\n"
                else:
                    for c in text:
                        total += letters(x, y, c)
                        x, y = y, c
                if total < after.get((x, y), (math.inf, None))[0]:
                    after[x, y] = (total, (path, text) if text else path)
        best = after
    path = min(((cost + letters(a, b, "\n") * (b != "\n"), i) for i, ((a, b), (cost, _)) in enumerate(best.items())), default=(0.0, -1))[1]
    if path < 0:
        return token
    out, node = [], list(best.values())[path][1]
    while node is not None:
        node, text = node
        out.append(text)
    return " ".join("".join(reversed(out)).replace(BREAK, " ").split())


def suspicious(token: str) -> bool:
    """Not plain letters, but with one; or with a letter three times in a row. Numbers and addresses are not words in disguise."""
    if len(token) < 3 or "://" in token or token.count("@") == 1 and "." in token.partition("@")[2]:
        return False
    if _PLAIN.match(token):
        return bool(_TRIPLE.search(token))
    return any(c.isalpha() for c in token) and sum(c.isdigit() for c in token) <= len(token) // 2 + 1


class Restorer:
    """Words of a text with disguises undone; remembers tokens it has seen, up to a bound."""

    def __init__(self, letters: Letters):
        self.letters, self.known = letters, {}

    def word(self, token: str, triple: bool = True) -> str:
        """A token's word. triple: some letter may stand three times in a row."""
        got = token.strip(_STRIP)
        if token[:1] in STANDS_FOR and got.isalpha():
            got = token.rstrip(_STRIP)  # a mark in place of the first letter
        if got.isalpha() and not triple:
            return got
        word = self.known.get(got)
        if word is None:
            word = decode(got, self.letters) if suspicious(got) else got
            if len(self.known) > 100_000:
                self.known.clear()
            if len(got) <= REMEMBERED:
                self.known[got] = word
        return word

    def words(self, text: str) -> dict[str, int]:
        """Restored words with their counts. Letters that stand apart are also read together."""
        lower = text.lower()
        tokens = lower.split()
        data = np.frombuffer(lower.encode(), dtype=np.uint8) if lower.isascii() else np.frombuffer(lower.encode("utf-32-le"), dtype=np.uint32)
        triple = bool(((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] > 96)).any())
        out: dict[str, int] = {}
        for token, n in Counter(tokens).items():
            word = token if not triple and token.isalpha() else self.word(token, triple)
            for w in word.split() if " " in word else (word,):
                out[w] = out.get(w, 0) + n
        for m in _SINGLES.finditer(bytes([len(t) == 1 or len(t) == 2 and not t.isalpha() for t in tokens])):
            run = "".join([t[0] + t[1:].strip(SEPARATORS) for t in tokens[m.start() : m.end()]])
            # breaks are a guess of the letter model, so the run is also read as one word, from each of its letters on
            whole = decode(run, self.letters)
            parts = whole.split()
            found = set(decode(run, self.letters, apart=True).split()) | set(parts) | {p[i : i + SPAN] for p in parts for i in range(max(1, len(p) - 2))}
            for w in found:
                out[w] = out.get(w, 0) + 1
        return out


def terms(word: str) -> tuple[str, ...]:
    """What a word is recognised by: itself, and its first four, five and six letters."""
    return (word + "\n", *(word[:n] for n in (4, 5, 6) if len(word) > n))


def _trigram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count: Counter[str] = Counter()
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            w = f"\n\n{word}\n"
            for i in range(len(w) - 2):
                count[w[i : i + 3]] += n
        yield pa.RecordBatch.from_arrays([pa.array([packed(g) for g in count], pa.int64()), pa.array(count.values(), pa.int64())], ["gram", "n"])


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):  # a part's counts are small; Spark adds them up
            count: Counter[str] = Counter()
            for text in part.column("text").to_pylist():
                count.update((text or "").lower().split())
            merged: dict[str, int] = {}
            for token, n in count.items():
                word = token if token.isalpha() else token.strip(_STRIP)
                if len(word) > 1 and word.isalpha():
                    merged[word] = merged.get(word, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(merged.keys(), pa.string()), pa.array(merged.values(), pa.int64())], ["word", "n"])


def letter_model(docs: DataFrame) -> Letters:
    """Counts all plain words of all documents. Every kind of trigram reaches the driver, in 16 bytes: as many as the letters of languages combine to, not as there are documents."""
    words = docs.select("text").mapInArrow(_word_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = words.mapInArrow(_trigram_batches, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return Letters.of(*(got.column(c).to_numpy() for c in ("gram", "n")))


class Model:
    """Weights of terms, and a logistic curve over what they add up to in a document."""

    def __init__(self, letters: Letters, weights: dict[str, float], curve: np.ndarray):
        self.letters, self.weights, self.curve = letters, weights, curve
        self.heads = {t[:4] for t in weights}

    def evidence(self, words: dict[str, int]) -> tuple[float, float, float]:
        """Weight of the strongest word, log of how many words are toxic, and their weight, damped."""
        top, number, total = 0.0, 0, 0.0
        for word, n in words.items():
            if (word + "\n")[:4] not in self.heads:
                continue  # no term begins so
            w = max(self.weights.get(t, 0.0) for t in terms(word))
            if w > 0:
                top, number, total = max(top, w), number + n, total + w * n
        return top, math.log1p(number), math.log1p(total)

    def score(self, rows: list[tuple[float, float, float]]) -> np.ndarray:
        x = np.column_stack([np.ones(len(rows)), np.array(rows).reshape(-1, 3)])
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[0.05] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the letter model on all documents, term weights and curve on a bounded sample of labelled rows that are not held out."""
    spark = docs.sparkSession
    letters = letter_model(docs)
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out(F.col("doc_id")))
    known = written(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labelled")
    known = least(known, ROWS, F.xxhash64("doc_id", F.lit(23)), F.col("doc_id"))
    kept = spark.sparkContext.broadcast(letters)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(kept.value)
        for batch in batches:
            for part in slices(batch, "text"):
                words = [restorer.words(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "class", "half", "toxic")), pa.array([list(w) for w in words], pa.list_(pa.string())), pa.array([list(w.values()) for w in words], pa.list_(pa.int64()))], ["key", "class", "half", "toxic", "words", "times"])

    # the sample is bounded, so its broadcast is
    rows = docs.where("text is not null").join(F.broadcast(known), "doc_id").withColumn("key", text_key(F.col("text")))
    rows = written(rows, "labelled_texts")
    # near copies of a toxic text are one text: they fall into the same half, and count once for a term
    found = classes(rows.where("toxic > 0")).select("key", F.col("class_key").alias("class")).distinct()
    rows = rows.join(F.broadcast(found), "key", "left").withColumn("class", F.coalesce("class", "key"))
    rows = rows.select("key", "class", F.pmod(F.xxhash64("class"), F.lit(2)).cast("int").alias("half"), "toxic", "text")
    rows = written(rows.mapInArrow(restore, "key binary, class binary, half int, toxic int, words array<string>, times array<long>"), "restored")
    once = rows.where("toxic = 0 or key = class").dropDuplicates(["key", "toxic"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad, all_ = Counter(), Counter()
            for half, toxic, words in zip(batch.column("half").to_pylist(), batch.column("toxic").to_pylist(), batch.column("words").to_pylist(), strict=True):
                own = {(half, t) for w in words for t in terms(w)}
                all_.update(own)
                if toxic:
                    bad.update(own)
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in all_], pa.int32()), pa.array([t[1] for t in all_], pa.string()), pa.array([bad[t] for t in all_], pa.int64()), pa.array(all_.values(), pa.int64())], ["half", "term", "bad", "all"])

    total = {r.half: r for r in once.groupBy("half").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all")).collect()}
    n_bad = {h: r.bad or 0 for h, r in total.items()}
    n_all = {h: r["all"] for h, r in total.items()}
    if not sum(n_bad.values()) or sum(n_bad.values()) == sum(n_all.values()):
        return Model(letters, {}, np.array([4.0 if sum(n_bad.values()) else -4.0, 0, 0, 0]))
    counted = once.mapInArrow(spell, "half int, term string, bad long, all long").groupBy("term", "half").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))
    counted = written(counted, "terms")

    def weighed(halves: tuple[int, ...]) -> dict[str, float]:
        bad, all_ = (sum(n.get(h, 0) for h in halves) for n in (n_bad, n_all))
        own = counted.where(F.col("half").isin(*halves)).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))
        weight = F.log((F.col("bad") + 0.1) / (bad + 0.2)) - F.log((F.col("all") - F.col("bad") + 0.1) / (all_ - bad + 0.2))
        # the sample is bounded, so its terms are
        return {r.term: float(r.weight) for r in own.where(F.col("bad") >= SUPPORT).withColumn("weight", weight).where("weight > 2.5").select("term", "weight").collect()}

    # the curve is fitted on what one half's weights make of the other half
    first, weights = weighed((0,)), weighed((0, 1))
    model = spark.sparkContext.broadcast(Model(letters, first, np.zeros(4)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.evidence(dict(zip(w, n, strict=True))) for w, n in zip(batch.column("words").to_pylist(), batch.column("times").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array([f[i] for f in found], pa.float64()) for i in range(3))], ["toxic", "a", "b", "c"])

    got = rows.where("half = 1").mapInArrow(weigh, "toxic int, a double, b double, c double").toPandas()
    return Model(letters, weights, _logistic(got[["a", "b", "c"]].to_numpy(), got["toxic"].to_numpy().astype(float)))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text).

    A null text is scored as an empty one. Where the labels show no toxic row all scores are low. Repeated rows get equal scores; other
    columns do not matter. Whole texts are read; the letter model counts all of them.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(kept.value.letters)
        for batch in batches:
            for part in slices(batch, "text"):
                s = kept.value.score([kept.value.evidence(restorer.words(t or "")) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    out = docs.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
