"""Quality by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the unlabelled class is the web text itself. A small network is fitted by
minimising the non-negative unbiased risk (Kiryo et al. 2017), prior * R(positives, 1) + max(0, R(unlabelled, 0) - prior *
R(positives, 0)), with the class prior estimated beforehand from the two samples' score distributions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import as_bytes, held_out, least, slices, written

#: At most this many positives and unlabelled rows, those with the least hashes of doc_id, are fitted on. Both bounds are parameters of the
#: fit alone: every document is scored. The risk is a mean over unlabelled text, and 20,000 rows give it to within half a percent.
POSITIVES, UNLABELLED, THRESHOLD, HIDDEN = 20_000, 20_000, 0.7, 12
_UPPER, _LOWER, _DIGIT, _HIGH, _MARK, _STOP, _LINE = range(1, 8)
_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
for _c in b"#$%&*+<=>@[]\\^_`{|}~!":
    _CLASS[_c] = _MARK
for _c in b".,;:?'\"()-/":
    _CLASS[_c] = _STOP
_CLASS[10] = _LINE
N_FEATURES = 18


def features(texts: list[bytes]) -> np.ndarray:
    """What the whole text looks like, a row for each: shares of characters and words, repetition, lengths."""
    w = wordhash.words(texts)
    data = np.frombuffer(w.raw, dtype=np.uint8)
    kinds = _CLASS[data]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.array([np.bincount(kinds[a:b], minlength=8) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], dtype=float).reshape(-1, 8)
    counts[:, _LINE] -= 1  # the line end that texts are laid end to end with
    n_bytes = np.maximum(1.0, np.diff(bounds) - 1)
    n = np.diff(w.first)
    words = np.maximum(1.0, n)
    of = np.repeat(np.arange(len(texts)), n)
    last, begin = data[w.end - 1], data[w.start]
    by = lambda x: np.bincount(of, weights=x, minlength=len(texts)) / words
    length = w.end - w.start
    again = np.append(False, (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])) if len(of) else np.zeros(0, bool)
    marked = _CLASS[last] == _MARK if len(of) else np.zeros(0, bool)
    alone = (length <= 2) & marked
    shout = (_CLASS[begin] == _UPPER) & (length > 1) & (_CLASS[data[np.minimum(w.start + 1, len(data) - 1)]] == _UPPER) if len(of) else np.zeros(0, bool)
    # a word of a text is one number, so that one flat sort counts the distinct words of all texts
    first = np.unique(w.hash ^ wordhash.mix(of.astype(np.uint64)), return_index=True)[1]
    distinct = np.bincount(of[first], minlength=len(texts)) / words
    longest = np.zeros(len(texts))
    if len(of):
        np.maximum.at(longest, of, length)
    letters = np.maximum(1.0, counts[:, _UPPER] + counts[:, _LOWER] + counts[:, _HIGH])
    out = np.column_stack([
        np.log1p(n), by(length) / 10, np.log1p(longest), distinct, by(again), by(marked), by(alone), by(shout),
        counts[:, _UPPER] / letters, counts[:, _DIGIT] / n_bytes, counts[:, _HIGH] / n_bytes, 5 * counts[:, _MARK] / n_bytes, 5 * counts[:, _STOP] / n_bytes, 20 * counts[:, _LINE] / n_bytes,
        by(_CLASS[last] == _STOP), np.minimum(1, 5 * by(again)), np.minimum(1, 5 * by(marked)), np.minimum(1, 5 * by(shout)),
    ])
    return out


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1_000_000):
            x = features(as_bytes(part.column("text"))).astype(np.float32)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), rows], [*(c for c in part.schema.names if c != "text"), "x"])


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in u, from held-out scores of both (best bin estimation, Garg et al. 2021).

    Above a score that only positives reach, u has the share's part of what p has. The score is chosen where the ratio of the two,
    plus the sampling error that it can have there, is least.
    """
    cuts = np.unique(np.quantile(p, np.linspace(0, 0.9, 91)))
    above_p = 1 - np.searchsorted(np.sort(p), cuts) / len(p)
    above_u = 1 - np.searchsorted(np.sort(u), cuts) / len(u)
    error = 1.01 * (np.sqrt(np.log(40) / 2 / len(p)) + np.sqrt(np.log(40) / 2 / len(u)))
    best = np.argmin((above_u + error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.95))


class Network:
    """One hidden layer over standardised features, fitted by Adam on the whole sample."""

    def __init__(self, x: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        d = x.shape[1]
        self.w = [rng.normal(size=(d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.w[0] + self.w[1])
        return z, h, h @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x)[2], -40, 40)))

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float) -> None:
        """Move against the gradient; slope is the risk's derivative by each row's output."""
        z, h, _ = self.raw(x)
        back = slope[:, None] * self.w[2] * (1 - h * h)
        grads = [z.T @ back + 1e-4 * self.w[0], back.sum(axis=0), h.T @ slope + 1e-4 * self.w[2], np.array([slope.sum()])]
        self.t += 1
        for a, g, m, v in zip(self.w, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def fit(p: np.ndarray, u: np.ndarray, steps: int = 600) -> tuple[Network, float]:
    """(network, prior) from feature rows of trusted positives and of unlabelled text."""
    x = np.concatenate([p, u])
    n_p, n_u = len(p), len(u)
    # positives against unlabelled, for the prior: each half of the rows is scored by a fit on the other
    of_p, of_u = np.zeros(n_p), np.zeros(n_u)
    for half in (0, 1):
        a, b = p[half::2], u[half::2]
        if not len(a) or not len(b):
            continue
        both, plain = np.concatenate([a, b]), Network(x)
        for _ in range(150):
            s = plain.score(both)
            plain.step(both, np.concatenate([(s[: len(a)] - 1) / len(a), s[len(a) :] / len(b)]), 0.02)
        of_p[1 - half :: 2], of_u[1 - half :: 2] = plain.score(p[1 - half :: 2]), plain.score(u[1 - half :: 2])
    prior = estimated_prior(of_p, of_u)
    net = Network(x)
    for i in range(steps):
        s = net.score(x)
        sp, su = s[:n_p], s[n_p:]
        down_u, down_p = -np.log(1 - su + 1e-12).mean(), -np.log(1 - sp + 1e-12).mean()
        slope = np.concatenate([prior * ((sp - 1) - sp) / n_p, su / n_u])
        if down_u - prior * down_p < 0:
            # the negatives' risk went below zero: step back along it alone
            slope = -np.concatenate([-prior * sp / n_p, su / n_u])
        net.step(x, slope, 0.02 if i < steps // 2 else 0.005)
    return net, prior


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    got = least(rows, most, F.xxhash64("doc_id", F.lit(17)), F.col("doc_id"), F.xxhash64("x")).select("x").toArrow().column("x").combine_chunks()
    return np.asarray(got.flatten(), dtype=np.float64).reshape(-1, N_FEATURES)


def learned(rows: DataFrame, labels: DataFrame) -> Network | None:
    """Fit on rows (doc_id, x); None without positives or unlabelled rows. The two bounded samples are all that the driver holds."""
    open_ = rows.where(~held_out(F.col("doc_id")))
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    p, u = _sample(open_.join(good, "doc_id", "left_semi"), POSITIVES), _sample(open_, UNLABELLED)
    return fit(p, u)[0] if len(p) and len(u) else None


def _score_batches(kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(-1, N_FEATURES)
            s = kept.value.score(x) if kept.value is not None else np.full(len(x), THRESHOLD)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "x"), pa.array(s)], [*(c for c in batch.schema.names if c != "x"), "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text).

    A null text is scored as an empty one. Features come from the text alone; labels are learned only from rows that are not
    held out. Without any positive label nothing can be told
    and nothing is rejected: every score is the threshold. Repeated rows get equal scores.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(rows.mapInArrow(_feature_batches, "doc_id long, x array<float>"), "features")
    kept = docs.sparkSession.sparkContext.broadcast(learned(rows, labels))
    out = rows.mapInArrow(_score_batches(kept), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score under the threshold; all columns stay. The network is fitted as in ``scores``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(rows.mapInArrow(_feature_batches, "doc_id long, x array<float>"), "features")
    kept = docs.sparkSession.sparkContext.broadcast(learned(rows, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                s = kept.value.score(features(as_bytes(part.column("text")))) if kept.value is not None else np.full(part.num_rows, THRESHOLD)
                yield part.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
