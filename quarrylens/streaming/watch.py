"""Streams of log lines: indicators, batches after silence, alerts; and a rate limiter with windows of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylens.functions.indicators import with_iocs
from quarrylens.operators.scoring import at_least

DEBOUNCE_SECONDS, BATCH_MAX = 2.0, 50
RATE_LIMIT, RATE_SECONDS = 10, 60


def indicators(lines: DataFrame, text_col: str = "value", ts_col: str = "ts", horizon: str = "10 minutes") -> DataFrame:
    """(type, value, ts, line) once for each indicator within ``horizon``: later repeats are dropped by state."""
    found = with_iocs(lines.select(F.col(text_col).alias("line"), F.col(ts_col).alias("ts")), "line")
    each = found.withWatermark("ts", horizon).select("ts", "line", F.explode_outer("iocs").alias("ioc")).where("ioc is not null").select("ioc.type", "ioc.value", "ts", "line")
    return each.dropDuplicatesWithinWatermark(["type", "value"])


def alerts(lines: DataFrame, judge: Callable[[DataFrame], DataFrame], threshold: str, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "2 seconds") -> StreamingQuery:
    """Judge the indicators of every micro-batch and hand those at or over ``threshold`` to ``sink``.

    ``judge`` adds verdict and confidence to (type, value, ...), usually by joins with source tables and a cache.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        sink(at_least(judge(df), threshold), epoch)

    return indicators(lines).writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=trigger).foreachBatch(batch).start()


def debounce(found: DataFrame, key: str = "type", seconds: float = DEBOUNCE_SECONDS, most: int = BATCH_MAX) -> DataFrame:
    """(key, values, n): what a key gathers until ``seconds`` of event time pass in silence, or it has ``most`` values.

    ``found(key, value, ts)`` needs a watermark on ts. State holds at most ``most`` distinct values a key.
    """
    schema = f"{key} string, values array<string>, n int"

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        if state.hasTimedOut:
            out.append(held)
            state.remove()
        else:
            last = state.get[1] if state.exists else 0
            rows = sorted((r.ts.timestamp(), r.value) for f in frames for r in f.itertuples())
            for ts, value in rows:
                if held and ts - last > seconds:
                    out.append(held)
                    held = []
                last = max(last, ts)
                if value not in held:
                    held.append(value)
                if len(held) >= most:
                    out.append(held)
                    held = []
            state.update((held, last))
            if held:
                state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [name[0]] * len(out), "values": out, "n": [len(x) for x in out]})

    return found.groupBy(key).applyInPandasWithState(step, schema, "held array<string>, last double", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited(requests: DataFrame, limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS) -> DataFrame:
    """(id, ts, allowed): at most ``limit`` requests in a window of ``seconds`` that starts at a client's first request.

    ``requests(id, ts)`` needs a watermark on ts; a client's state goes when the watermark has passed its window.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        began, used = state.get if state.exists else (float("-inf"), 0)
        times = sorted(t for f in frames for t in f.ts)
        allowed = []
        for t in times:
            at = t.timestamp()
            if at - began >= seconds:
                began, used = at, 0
            used += 1
            allowed.append(used <= limit)
        if times:
            state.update((began, used))
            state.setTimeoutTimestamp(max(int((began + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": [name[0]] * len(times), "ts": times, "allowed": allowed})

    return requests.groupBy("id").applyInPandasWithState(step, "id string, ts timestamp, allowed boolean", "began double, used int", "append", GroupStateTimeout.EventTimeTimeout)
