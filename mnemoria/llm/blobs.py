"""Sums of many keyed numbers as packed arrays.

A blob row is (kind, bucket, keys, vals): sorted distinct 64-bit keys and float64 values, `width` for each
key. Blobs of one kind and bucket hold keys that belong together; merging adds the values of equal keys.
Few large rows move instead of many small ones. Keys are stored as differences, and both columns byte by
byte (all first bytes first) under zstd, as equal high bytes take little room.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_stream

SCHEMA = "kind string, bucket int, keys binary, vals binary"
_NAMES = ["kind", "bucket", "keys", "vals"]


def add_up(keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values (n x width)."""
    if not len(keys):
        return keys, vals
    order = np.argsort(keys, kind="stable")
    keys, vals = keys[order], vals[order]
    first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return keys[first], np.add.reduceat(vals, first, axis=0)


def zip_bytes(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unzip_bytes(packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def zip_numbers(x: np.ndarray) -> bytes:
    """Numbers of 8 bytes, all first bytes first."""
    return zip_bytes(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes())


def unzip_numbers(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(np.frombuffer(unzip_bytes(packed), np.uint8).reshape(8, -1).T.tobytes(), kind)


def zip_keys(keys: np.ndarray) -> bytes:
    """Keys in ascending order."""
    return zip_numbers(np.diff(keys.astype("<u8"), prepend=np.zeros(1, "<u8")))


def unzip_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(unzip_numbers(packed, "<u8"), dtype=np.uint64)


def pack(kind: str, keys: np.ndarray, vals: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket that occurs; keys are sorted within it."""
    order = np.argsort(bucket, kind="stable")
    keys, vals, bucket = keys[order], vals[order], bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    rows = [(kind, int(bucket[a]), zip_keys(keys[a:b]), zip_numbers(np.ascontiguousarray(vals[a:b].T, "<f8"))) for a, b in zip(cuts, cuts[1:], strict=False)]
    cols = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], _NAMES)


def unpack(keys: bytes, vals: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = unzip_keys(keys)
    return k, unzip_numbers(vals, "<f8").reshape(-1, len(k)).T if len(k) else np.zeros((0, 1))


def merge(blobs: DataFrame, then: Callable[[str, int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str = SCHEMA) -> DataFrame:
    """Bring blobs of one kind and bucket together, add them up and hand them to `then`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if at is not None:
                yield from then(*at, *add_up(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])))

        size = 0
        for batch in batches:
            for kind, bucket, keys, vals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (kind, bucket) != at:
                    yield from close()
                    at, held, size = (kind, bucket), [], 0
                held.append(unpack(keys, vals))
                size += len(keys)
                if size > 64_000_000 and len(held) > 1:
                    held = [add_up(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))]
                    size = 4 * len(held[0][0])
        yield from close()

    return arrow_stream(blobs.select(*_NAMES).repartition("kind", "bucket").sortWithinPartitions("kind", "bucket"), run, schema)
