"""Filters over streams of blocks that arrive in any order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnweave.operators.signal import BLOCKS, run_section

#: The store that state of this kind needs: set it as spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedFilter(StatefulProcessor):
    """A cascade along each channel, block after block by start_sample from 0 on, whatever the order of arrival.

    A block that does not follow the last one waits in state. If what is missing has not come ``patience_ms`` after the last arrival, it counts as silence of its length, and the next
    block that waits goes on; a block that comes after its place was passed is dropped.
    """

    def __init__(self, sections: list[np.ndarray], patience_ms: int):
        self.sections, self.patience_ms = sections, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "at long, z array<double>")
        self.waiting = handle.getMapState("waiting", "start_sample long", "block_no long, samples array<float>")

    def _states(self) -> tuple[int, list[np.ndarray]]:
        at, z = self.place.get() if self.place.exists() else (0, [0.0] * (2 * len(self.sections)))
        return at, list(np.array(z).reshape(-1, 2))

    def _filter(self, x: np.ndarray, states: list[np.ndarray]) -> np.ndarray:
        for i, s in enumerate(self.sections):
            x, states[i] = run_section(x, s, states[i])
        return x

    def _go_on(self, key: tuple, at: int, states: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        """All waiting blocks that follow each other from ``at``."""
        while self.waiting.containsKey((at,)):
            no, samples = self.waiting.getValue((at,))
            self.waiting.removeKey((at,))
            y = self._filter(np.asarray(samples, dtype=np.float64), states)
            yield pd.DataFrame({"rec": [key[0]], "channel": [key[1]], "block_no": [no], "start_sample": [at], "samples": [y.astype(np.float32)]})
            at += len(samples)
        self.place.update((at, [float(v) for z in states for v in z]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, states = self._states()
        for b in rows:
            for r in b.itertuples():
                if r.start_sample >= at and len(r.samples):
                    self.waiting.updateValue((r.start_sample,), (r.block_no, [float(v) for v in r.samples]))
        yield from self._go_on(key, at, states)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if any(True for _ in self.waiting.keys()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, states = self._states()
        ahead = [k[0] for k in self.waiting.keys() if k[0] > at]
        if ahead:
            gap = min(ahead) - at
            for lo in range(0, gap, 1 << 20):
                self._filter(np.zeros(min(1 << 20, gap - lo)), states)
            yield from self._go_on(key, at + gap, states)
            if len(ahead) > 1 and any(True for _ in self.waiting.keys()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def close(self) -> None:
        pass


def filter_stream(blocks: DataFrame, sections: list[np.ndarray], patience_ms: int = 60_000) -> DataFrame:
    """``filter_blocks`` for a stream of blocks in any order: the filter's state and blocks that came too early are kept between micro-batches."""
    rows = blocks.select("rec", "channel", "block_no", "start_sample", "samples")
    return rows.groupBy("rec", "channel").transformWithStateInPandas(OrderedFilter(sections, patience_ms), BLOCKS, "Append", "ProcessingTime")
