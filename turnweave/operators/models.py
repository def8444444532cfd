"""Back ends by name: embedding, separation, speech recognition, activity. Neural models plug in here; none is shipped."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from turnweave.operators.signal import mfcc_stats

log = logging.getLogger("turnweave")


@dataclass
class Backend:
    """``load`` runs once in each Python worker; what it gives maps a batch of signals (float arrays at 16 kHz) to results."""

    name: str
    load: Callable[[], Callable[[list[np.ndarray]], list]]
    available: Callable[[], bool] = field(default=lambda: True)


REGISTRY: dict[str, dict[str, Backend]] = {"embedding": {}, "separation": {}, "words": {}, "activity": {}, "denoise": {}}
_loaded: dict[tuple[str, str], Callable] = {}


def register(kind: str, backend: Backend) -> None:
    REGISTRY[kind][backend.name] = backend


def resolve(kind: str, *wanted: str, strict: bool = False) -> Backend:
    """The first of the named back ends that is available; with ``strict`` only the first will do."""
    for name in wanted[:1] if strict else wanted:
        b = REGISTRY[kind].get(name)
        if b is not None and b.available():
            return b
        log.warning("%s back end %r is not available", kind, name)
    raise RuntimeError(f"no {kind} back end of {', '.join(wanted)} is available")


def halving(f: Callable[[list], list], items: list) -> list:
    """f(items), in halves where that runs out of memory."""
    try:
        return f(items)
    except MemoryError:
        if len(items) < 2:
            raise
        return halving(f, items[: len(items) // 2]) + halving(f, items[len(items) // 2 :])


def embed(windows: DataFrame, backend: Backend, kind: str = "embedding", batch: int = 64) -> DataFrame:
    """windows (rec, win_no, samples) as voiceprints (rec, win_no, embedding) of unit length; a zero vector stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = _loaded.get((kind, backend.name)) or _loaded.setdefault((kind, backend.name), backend.load())
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                x = np.stack(halving(f, [np.asarray(s, dtype=np.float32) for s in part.samples])).astype(np.float64)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"rec": part.rec, "win_no": part.win_no, "embedding": list(x / np.where(n > 0, n, 1.0))})

    return windows.select("rec", "win_no", "samples").mapInPandas(run, "rec long, win_no long, embedding array<double>")


register("embedding", Backend("mfcc", lambda: lambda signals: [mfcc_stats(x) for x in signals]))
