"""Fixed-window request budgets, over a table and over a stream.

A window opens with the first request after the last one ran out (the first of
all at time 0); it admits ``limit`` requests and turns the rest away with the
seconds left to wait.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 12
WINDOW_MS = 60_000
#: A stream forgets a key that was silent for so many windows; the next request would open a new one anyway.
IDLE_WINDOWS = 10


def admitted(ms: np.ndarray, limit: int, window_ms: int, opened: int = 0, used: int = 0) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(allowed, seconds to wait) of requests at rising times, window by window; and when the last window opened and what it used."""
    allowed, wait = np.zeros(len(ms), bool), np.zeros(len(ms), np.int64)
    i = 0
    while i < len(ms):
        if ms[i] >= opened + window_ms:
            opened, used = int(ms[i]), 0
        end = int(np.searchsorted(ms, opened + window_ms, side="left"))
        free = min(max(limit - used, 0), end - i)
        allowed[i : i + free] = True
        wait[i + free : end] = -((ms[i + free : end] - opened - window_ms) // 1000)
        used, i = used + free, end
    return allowed, wait, opened, used


def apply_budget(events: DataFrame, key: str = "user_id", at: str = "ts", tie: str = "event_id", limit: int = LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """``key``, ``tie``, allowed, retry_after of every event, per key in the order of ``at`` and ``tie``.

    Keys are hashed to partitions, sorted there and read through once with one
    state held at a time, so a key of any size passes without being gathered.
    Rows with a null key share one budget; rows with a null time come first,
    at time 0.
    """
    rows = events.select(key, tie, F.coalesce(F.unix_millis(F.col(at).cast("timestamp")), F.lit(0)).alias("_ms"), F.coalesce(F.xxhash64(key), F.lit(0)).alias("_h"), F.col(key).isNull().alias("_null"))
    rows = rows.repartition(F.col(key)).sortWithinPartitions("_null", key, "_ms", tie)
    kinds = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in (key, tie))

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, opened, used = None, 0, 0
        for part in parts:
            ids = list(zip(part["_null"], part["_h"], part[key].where(~part["_null"], 0)))
            ms = part["_ms"].to_numpy(dtype=np.int64)
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            allowed, wait = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                if ids[a] != current:
                    current, opened, used = ids[a], 0, 0
                allowed[a:b], wait[a:b], opened, used = admitted(ms[a:b], limit, window_ms, opened, used)
            yield pd.DataFrame({key: part[key], tie: part[tie], "allowed": allowed, "retry_after": wait})

    return rows.mapInPandas(run, f"{kinds}, allowed boolean, retry_after bigint")


def stream_budget(events: DataFrame, key: str = "user_id", at: str = "ts", tie: str = "event_id", limit: int = LIMIT, window_ms: int = WINDOW_MS, idle_windows: int | None = IDLE_WINDOWS) -> DataFrame:
    """The same over a stream: the state of a key is when its window opened and what it used.

    The events of a key in one micro-batch count in order of time. With
    ``idle_windows=None`` no key is forgotten, as a query that is to end
    (trigger availableNow) needs it.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(group, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        opened, used = state.get if state.exists else (0, 0)
        rows = pd.concat(list(parts)).sort_values(["_ms", tie])
        allowed, wait, opened, used = admitted(rows["_ms"].to_numpy(dtype=np.int64), limit, window_ms, opened, used)
        state.update((opened, used))
        if idle_windows is not None:
            state.setTimeoutDuration(idle_windows * window_ms)
        yield pd.DataFrame({key: rows[key], tie: rows[tie], "allowed": allowed, "retry_after": wait})

    kinds = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in (key, tie))
    rows = events.select(key, tie, F.coalesce(F.unix_millis(F.col(at).cast("timestamp")), F.lit(0)).alias("_ms"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{kinds}, allowed boolean, retry_after bigint", "opened bigint, used bigint", "append", GroupStateTimeout.NoTimeout if idle_windows is None else GroupStateTimeout.ProcessingTimeTimeout)
