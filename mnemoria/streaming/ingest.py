"""Structured Streaming forms of ingest: deduplication, keyed counters, and an idempotent sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.beliefs import Belief


def dedup_stream(messages: DataFrame, content: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """The first message of each text within the watermark; state is dropped as the watermark passes."""
    keyed = messages.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def registry_stream(mentions: DataFrame, threshold: int = 3) -> DataFrame:
    """mentions (name, type) -> running count and state for each name (update or complete mode)."""
    return mentions.groupBy("name").agg(F.count("*").alias("count")).withColumn("state", F.when(F.col("count") >= threshold, "confirmed").otherwise("candidate"))


def registry_with_ttl(mentions: DataFrame, event_time: str, ttl_seconds: int, threshold: int = 3, delay: str = "1 hour") -> DataFrame:
    """mentions (name, event_time) -> (name, count, state): a name that is not met for ttl_seconds is forgotten.

    Its last row then says `expired` with a count of 0 (update mode; the watermark drives the clock).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, 0, "expired")], columns=["name", "count", "state"])
            return
        n, last = state.get if state.exists else (0, 0)
        for frame in frames:
            n += len(frame)
            last = max(last, int(frame["at"].max()))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, n, "confirmed" if n >= threshold else "candidate")], columns=["name", "count", "state"])

    timed = mentions.withWatermark(event_time, delay).withColumn("at", F.unix_millis(event_time))
    return timed.groupBy("name").applyInPandasWithState(step, "name string, count long, state string", "count long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def belief_stream(evidence: DataFrame) -> DataFrame:
    """evidence (category, key, seq, value, delta): one belief for each key, kept as state (update mode)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        belief = Belief()
        if state.exists:
            belief.value, belief.confidence, belief.evidence, belief.conflicts = state.get
        rows = pd.concat(list(frames)).sort_values("seq")
        for value, delta in zip(rows["value"], rows["delta"], strict=True):
            belief.add(value, delta)
        state.update((belief.value, belief.confidence, belief.evidence, belief.conflicts))
        yield pd.DataFrame([(*key, belief.value, round(belief.confidence, 6), belief.evidence, belief.conflicts)], columns=["category", "key", "value", "confidence", "evidence", "conflicts"])

    out = "category string, key long, value string, confidence double, evidence long, conflicts long"
    return evidence.groupBy("category", "key").applyInPandasWithState(step, out, "value string, confidence double, evidence long, conflicts long", "update", GroupStateTimeout.NoTimeout)


#: Seconds from one micro-batch to the next.
EVERY_SECONDS = 5


def micro_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = EVERY_SECONDS, until_empty: bool = False) -> StreamingQuery:
    """Start a query whose batches go to sink every few seconds, or at once until nothing is left.

    A batch is bounded by its source's options (maxFilesPerTrigger); there are no triggers by row count or
    by idle time.
    """
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if until_empty else writer.trigger(processingTime=f"{seconds} seconds")).start()


def quarantine_sink(good: Callable[[DataFrame, int], None], path: str, problem: Column) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows with a problem (a text, null if there is none) go to path, the others on."""

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = batch.withColumn("problem", problem)
        judged.filter("problem is not null").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        good(judged.filter("problem is null").drop("problem"), batch_id)

    return write


def idempotent_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch that is tried again replaces what it wrote before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
