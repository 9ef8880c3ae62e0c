"""Stateful operators with timers: buffers that flush when full or idle, and deduplication in a bounded FIFO.

Both need the RocksDB state store (STATE_STORE). State is kept by key, so a key's messages meet in one
task; choose keys (a wing, a session) that are many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The session setting that stateful processors need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
BATCH_ROWS, IDLE_SECONDS, CACHED_HASHES = 5, 60, 1000


class _Buffer(StatefulProcessor):
    def __init__(self, rows: int, idle_ms: int, event_time: bool) -> None:
        self.rows, self.idle_ms, self.event_time = rows, idle_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq long, content string, at long")
        self.flushed = handle.getValueState("flushed", "batches long, timer long")

    def _batch(self, key: tuple, number: int, rows: list[tuple], why: str) -> pd.DataFrame:
        return pd.DataFrame([(*key, number, why, place, seq, content) for place, (seq, content, _) in enumerate(rows)], columns=["key", "batch", "why", "place", "seq", "content"])

    def _wait(self, rows: list[tuple], batches: int, timer: int, now: int) -> None:
        """Keep the rest and start its idle time anew."""
        if timer:
            self.handle.deleteTimer(timer)
        timer = 0
        if rows:
            self.waiting.put(rows)
            timer = max(now, max(at for _, _, at in rows) if self.event_time else now) + self.idle_ms
            self.handle.registerTimer(timer)
        else:
            self.waiting.clear()
        self.flushed.update((batches, timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches, timer = self.flushed.get() if self.flushed.exists() else (0, 0)
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        contents = [None if pd.isna(c) else c for c in new["content"]]
        waiting += list(zip(map(int, new["seq"]), contents, map(int, new["at"]), strict=True))
        while len(waiting) >= self.rows:
            yield self._batch(key, batches, waiting[: self.rows], "full")
            waiting, batches = waiting[self.rows :], batches + 1
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        self._wait(waiting, batches, timer, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        batches, timer = self.flushed.get() if self.flushed.exists() else (0, 0)
        if expiredTimerInfo.getExpiryTimeInMs() == timer and self.waiting.exists():
            yield self._batch(key, batches, [tuple(r) for r in self.waiting.get()], "idle")
            self.waiting.clear()
            self.flushed.update((batches + 1, 0))

    def close(self) -> None:
        pass


def buffered(messages: DataFrame, rows: int = BATCH_ROWS, idle_seconds: float = IDLE_SECONDS, event_time: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """messages (key, seq, content) -> (key, batch, why, place, seq, content): batches of a key, in order of seq.

    A batch leaves at `rows` messages (why: full), or when its key has had none for idle_seconds (idle). Idle
    time is that of the clock or, with event_time naming a timestamp column, that of the watermark.
    A null key is a key; a null content stays null. Append mode.
    """
    if event_time:
        messages = messages.withWatermark(event_time, delay).withColumn("at", F.unix_millis(event_time))
    else:
        messages = messages.withColumn("at", F.lit(0).cast("long"))
    processor = _Buffer(rows, int(idle_seconds * 1000), event_time is not None)
    out = "key string, batch long, why string, place long, seq long, content string"
    return messages.groupBy("key").transformWithStateInPandas(processor, out, "Append", "EventTime" if event_time else "ProcessingTime")


class _Fifo(StatefulProcessor):
    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hashes = handle.getListState("hashes", "hash string")

    def _seen(self) -> dict[str, None]:
        """The hashes from the oldest on."""
        return dict.fromkeys(r[0] for r in self.hashes.get()) if self.hashes.exists() else {}

    def _keep(self, seen: dict[str, None]) -> None:
        self.hashes.put([(h,) for h in list(seen)[-self.most :]])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, first = self._seen(), []
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, content in zip(new["seq"], new["content"], strict=True):
            h = hashlib.sha256(("" if pd.isna(content) else content).encode()).hexdigest()
            if h in seen:
                continue
            seen[h] = None
            if len(seen) > self.most:
                del seen[next(iter(seen))]
            first.append((*key, int(seq), content, h))
        self._keep(seen)
        yield pd.DataFrame(first, columns=["key", "seq", "content", "hash"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        seen = self._seen()
        known = initialState.sort_values("seq", kind="stable")["hash"]
        self._keep(seen | dict.fromkeys(h for h in known if h not in seen))

    def close(self) -> None:
        pass


def dedup_fifo(messages: DataFrame, most: int = CACHED_HASHES, known: DataFrame | None = None) -> DataFrame:
    """messages (key, seq, content) -> (key, seq, content, hash): those whose text is not among the last `most` new ones of their key.

    The oldest hash leaves first; meeting a text again doesn't renew it. known (key, seq, hash), a
    table, warms a new query up; a restart goes on from the checkpoint. A null content counts as empty text.
    """
    out = "key string, seq long, content string, hash string"
    start = known.select("key", "seq", "hash").groupBy("key") if known is not None else None
    return messages.groupBy("key").transformWithStateInPandas(_Fifo(most), out, "Append", "None", start)
