"""Filter interaction audit: what each of five filters removes, in every order of the filters.

A document fails some of the filters A to E: a mask of five bits. A table of 32 masks by 120 orders, made
once, says at which step an order removes a document of that mask. Tasks look up their documents in it and
count the removals with np.bincount by part, order, step and label; every column of the result is a sum
over documents, so the tasks' arrays are partial results, and Spark adds them up by part, order and step.

Texts are read once and never shuffled. Filter E needs to know who has the same text: rows of (id, SHA-256 of
the text) meet, the smallest id of a text is kept, and the rows look for themselves among those ids, so a
text that fills a third of the table is no hot key: its rows are dealt by their ids.

Defined cases: a null text is an empty one, a null part the empty string; texts are taken for identical if
their SHA-256 is; a row without id has no smaller id and no label, and never fails E; rows that repeat an id
count each for itself, and do not make each other fail E; a document with several labels is good (toxic) if
one of them says so; an empty table has no part and gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_PER_BATCH, arrow_map, arrow_stream, bytes_of, forget, materialize, read

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: In order o, the number of the filter at step s + 1.
AT_STEP = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
#: Parts that a task counts before it hands its arrays on: 100 MB.
PARTS_AT_ONCE = 1024
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

_NOT_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
_MARKS = b"#$%&*|"


def first_failures() -> np.ndarray:
    """By mask and order: the step from 1 at which the first failing filter stands, 0 if none fails."""
    fails = (np.arange(32)[:, None, None] >> AT_STEP) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2) + 1, 0)


def failures_alone(text: bytes, n_chars: int) -> int:
    """The mask of filters A to D for one text; words are cut at the six ASCII white spaces."""
    words = text.split()
    capitals = len(text.translate(None, _NOT_CAPITALS))
    found = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * n_chars, len(text.translate(None, _MARKS)) < len(text))
    return sum(1 << k for k, fails in enumerate(found) if fails)


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, key): filters A to D of each row, and the SHA-256 of its text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = bytes_of(batch.column(2))
        n_chars = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
        masks = [failures_alone(t, n) for t, n in zip(texts, n_chars, strict=True)]
        keys = [hashlib.sha256(t).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "part", "mask", "key"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, part string, mask int, key binary")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic): the rows of profiles, with filter E and their labels."""
    first = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    told = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    joined = rows.join(first, ["doc_id", "key"], "left").join(told, "doc_id", "left")
    repeated = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    no = F.lit(False)
    return joined.select("part", (F.col("mask") + repeated).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def _result(part: str, removed: np.ndarray, masks: np.ndarray) -> pa.RecordBatch:
    """The 600 rows of a part from its removals (labels x orders x steps, step 0: kept by all) and its masks."""
    every, good, toxic = removed[:, :, 1:]
    failing = np.array([masks[(np.arange(32) >> f) & 1 == 1].sum() for f in range(5)])
    alone = masks[1 << np.arange(5)]
    shapley = np.bincount(AT_STEP.ravel(), weights=every.ravel(), minlength=5).astype(np.int64)
    columns = (masks.sum() - every.cumsum(axis=1), every, failing[AT_STEP] - every, alone[AT_STEP], good, toxic, shapley[AT_STEP])
    names = [np.repeat(ORDERS, 5), np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))]
    return pa.RecordBatch.from_arrays([pa.array([part] * 600), *map(pa.array, names), *(pa.array(c.ravel().astype(np.int64)) for c in columns)], ["part", "filter_order", "step", *COUNTS])


def tallies(rows: DataFrame) -> DataFrame:
    """Partial results of (part, mask, good, toxic), one set of rows for each part that a task meets."""
    table, orders = first_failures(), np.arange(len(ORDERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in (b.slice(at, ROWS_PER_BATCH) for b in batches for at in range(0, b.num_rows, ROWS_PER_BATCH)):
            parts = batch.column(0).dictionary_encode()
            code, mask = parts.indices.to_numpy(), batch.column(1).to_numpy()
            n, cell = len(parts.dictionary), (code[:, None] * len(ORDERS) + orders) * 6 + table[mask]
            groups = [slice(None), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))]
            removed = np.stack([np.bincount(cell[g].ravel(), minlength=n * len(ORDERS) * 6).reshape(n, len(ORDERS), 6) for g in groups], axis=1)
            masks = np.bincount(code * 32 + mask, minlength=n * 32).reshape(n, 32)
            for k, part in enumerate(parts.dictionary.to_pylist()):
                if part in held:
                    held[part][0][:] += removed[k]
                    held[part][1][:] += masks[k]
                else:
                    held[part] = removed[k].copy(), masks[k].copy()
            if len(held) > PARTS_AT_ONCE:
                yield from (_result(part, *x) for part, x in held.items())
                held = {}
        yield from (_result(part, *x) for part, x in held.items())

    return arrow_stream(rows, run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, filter_order and step with the sums of COUNTS."""
    rows = materialize(profiles(docs, id_col, text_col, part_col), "profiles")
    out = materialize(tallies(labelled(rows, labels)), "tallies")
    forget(rows)
    return out.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: The same from the rules alone.
SQL = r"""WITH f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, step::INTEGER AS step, bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE instr(filter_order, g.letter) < step) AS earlier FROM orders, range(1, 6) r(step), f WHERE letter = filter_order[step]),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
+ (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS ng, count(*) FILTER (toxic) AS nt FROM d GROUP BY part, mask),
x AS (SELECT part, filter_order, step, bit, sum(n) FILTER ((mask & (bit | earlier)) = 0) AS kept, sum(n) FILTER ((mask & bit) > 0 AND (mask & earlier) = 0) AS removed, sum(n) FILTER ((mask & bit) > 0 AND (mask & earlier) > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
sum(ng) FILTER ((mask & bit) > 0 AND (mask & earlier) = 0) AS good_lost, sum(nt) FILTER ((mask & bit) > 0 AND (mask & earlier) = 0) AS toxic_lost FROM m, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x"""
