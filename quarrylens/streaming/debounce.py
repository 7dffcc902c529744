"""Batches after silence or a number of values, by a stateful processor with timers and map state.

A key gathers its distinct values in the order of event time. A batch is given when ``most`` values are there, or when
``seconds`` of event time pass without a row: seen at the next row, or by the key's timer once the watermark has passed it.
What a micro-batch leaves, fewer than ``most`` values, waits in a map state on disk, which is read and written once a key and
micro-batch, not once a row. A key without values keeps no state and no timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylens.streaming.watch import BATCH_MAX, DEBOUNCE_SECONDS

#: Timers and map state need the state store that keeps keys on disk.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Rows and batches that are Python objects at a time; the rest of a key's micro-batch stays in arrays.
ROWS = 10_000


def _ordered(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, pa.Array]:
    """Microseconds and values of all rows by time and value."""
    micros, values = [np.empty(0, np.int64)], [pa.array([], pa.large_string())]
    for part in rows:
        times = part["ts"]
        micros.append((times.dt.tz_convert("UTC").dt.tz_localize(None) if times.dt.tz is not None else times).to_numpy("datetime64[us]").astype(np.int64))
        values.append(pa.array(part["value"], pa.large_string(), from_pandas=True))
    table = pa.table({"at": np.concatenate(micros), "value": pa.chunked_array(values)}).sort_by([("at", "ascending"), ("value", "ascending")])
    return table["at"].to_numpy(), table["value"].combine_chunks()


class Debounce(StatefulProcessor):
    def __init__(self, seconds: float, most: int):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "value string", "place int")
        self.last = handle.getValueState("last", "micros long")

    def _values(self) -> list[str]:
        return [k[0] for k, _ in sorted(self.held.iterator(), key=lambda x: x[1][0])] if self.held.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        micros, values = _ordered(rows)
        last = self.last.get()[0] if self.last.exists() else None
        held = dict.fromkeys(self._values())
        silence, out = self.seconds * 1_000_000, []
        for first in range(0, len(micros), ROWS):
            part = slice(first, first + ROWS)
            for at, value in zip(micros[part].tolist(), values[part].to_pylist(), strict=True):
                if held and at - last > silence:
                    out.append(list(held))
                    held.clear()
                last = at if last is None else max(last, at)
                held[value] = None
                if len(held) >= self.most:
                    out.append(list(held))
                    held.clear()
            if len(out) >= ROWS:
                yield self._rows(key, out)
                out = []
        self.held.clear()
        for n, value in enumerate(held):
            self.held.updateValue((value,), (n,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.last.update((last,))
            self.handle.registerTimer(max(last // 1000 + int(self.seconds * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.last.clear()
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        values = self._values()
        self.held.clear()
        if values:
            yield self._rows(key, [values])

    @staticmethod
    def _rows(key, batches: list[list[str]]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(batches), "values": pd.Series(batches, dtype=object), "n": pd.Series([len(b) for b in batches], dtype="int32")})

    def close(self) -> None:
        pass


def debounced(found: DataFrame, seconds: float = DEBOUNCE_SECONDS, most: int = BATCH_MAX) -> DataFrame:
    """(key string, values array<string>, n int) of ``found(key, value, ts)``, which needs a watermark on ts."""
    rows = found.select("key", "value", "ts")
    return rows.groupBy("key").transformWithStateInPandas(Debounce(seconds, most), "key string, values array<string>, n int", "append", "eventTime")
