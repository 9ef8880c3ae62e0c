"""Buffers with timers, and deduplication in a bounded FIFO."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from mnemoria.streaming import buffers

SCHEMA = "key string, seq long, content string, ts timestamp"


@pytest.fixture
def rocks(spark):
    name, value = buffers.STATE_STORE
    spark.conf.set(name, value)
    yield spark
    spark.conf.unset(name)


def _add(spark, path, rows):
    spark.createDataFrame([(k, s, c, t) for k, s, c, t in rows], "key string, seq long, content string, t string").select("key", "seq", "content", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(path))


def _step(df, tmp_path, **trigger):
    """Run over what is new and append it to `out`."""
    def write(batch, n):
        batch.write.mode("append").parquet(str(tmp_path / "out"))

    q = df.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(write)
    return q.trigger(**(trigger or {"availableNow": True})).start()


def _rows(spark, tmp_path, *cols):
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*cols).collect())


def test_flush_when_full_and_when_idle_by_the_clock(rocks, tmp_path):
    _add(rocks, tmp_path / "in", [("a", n, f"a{n}", "2024-01-01") for n in range(12)] + [("b", 0, None, "2024-01-01")])
    stream = rocks.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = _step(buffers.buffered(stream, idle_seconds=2), tmp_path, processingTime="500 milliseconds")
    for _ in range(120):
        time.sleep(0.5)
        if (tmp_path / "out").exists() and rocks.read.schema("key string").parquet(str(tmp_path / "out")).count() == 13:
            break
    q.stop()
    got = _rows(rocks, tmp_path, "key", "batch", "place", "why", "seq", "content")
    want = [("a", n // 5, n % 5, "full" if n < 10 else "idle", n, f"a{n}") for n in range(12)] + [("b", 0, 0, "idle", 0, None)]
    assert got == sorted(want, key=lambda r: r[:3])


def test_idle_by_the_watermark_and_restart(rocks, tmp_path):
    def run(rows):
        _add(rocks, tmp_path / "in", rows)
        stream = rocks.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        _step(buffers.buffered(stream, event_time="ts"), tmp_path).awaitTermination()

    run([("a", n, f"a{n}", "2024-01-01 00:00:00") for n in range(3)])
    assert not (tmp_path / "out").exists() or not _rows(rocks, tmp_path, "seq")
    run([("a", 3, "a3", "2024-01-01 00:00:50"), ("b", 0, "b0", "2024-01-01 00:01:20")])  # a waits since 00:50
    run([("a", 4, "a4", "2024-01-01 00:01:30"), ("a", 5, "a5", "2024-01-01 00:01:30")])
    run([("c", 0, "c0", "2024-01-01 00:10:00")])
    run([("c", 1, "c1", "2024-01-01 00:10:01")])
    got = _rows(rocks, tmp_path, "key", "batch", "why", "seq")
    assert got == [("a", 0, "full", n) for n in range(5)] + [("a", 1, "idle", 5), ("b", 0, "idle", 0)]


def _fifo(rows, most, known=()):
    seen, out = list(known), []
    for seq, text in rows:
        h = hashlib.sha256((text or "").encode()).hexdigest()
        if h not in seen:
            seen = [*seen, h][-most:]
            out.append((seq, h))
    return out


def test_fifo_evicts_warms_up_and_restarts(rocks, tmp_path):
    texts = ["x", "y", "x", "z", "w", "x", None, "", "y", "w", "x"]  # four fit
    rows = list(enumerate(texts))
    warm = [hashlib.sha256(t.encode()).hexdigest() for t in ("old", "y")]
    known = rocks.createDataFrame([("a", n, h) for n, h in enumerate(warm)], "key string, seq long, hash string")
    for part in (rows[:5], rows[5:]):
        _add(rocks, tmp_path / "in", [(k, s, c, "2024-01-01") for k in "ab" for s, c in part])
        stream = rocks.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        _step(buffers.dedup_fifo(stream, 4, known), tmp_path).awaitTermination()
    got = _rows(rocks, tmp_path, "key", "seq", "hash")
    assert got == [("a", *r) for r in _fifo(rows, 4, warm)] + [("b", *r) for r in _fifo(rows, 4)]
    assert len(got) < 2 * len(rows) and ("a", 1, warm[1]) not in got
