"""Bayesian beliefs: evidence folded in its order for each key.

The fold runs over partitions that are sorted by key and order, so that a key's evidence streams by and
is never gathered, however much of it there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Likelihood of agreeing evidence, the similarity below which evidence conflicts, above which it says the
#: same, and the weight of evidence that replaces a value at once.
LIKELY, CONFLICT, SAME, STRONG = 0.85, 0.4, 0.9, 0.3
#: Conflicts of a belief that are remembered.
CONFLICTS_KEPT = 20


@lru_cache(maxsize=100_000)
def _bigrams(text: str) -> frozenset[str]:
    t = text.strip(" ").lower()
    return frozenset([t]) if len(t) == 1 else frozenset(t[k : k + 2] for k in range(len(t) - 1))


def similarity(a: str, b: str) -> float:
    """Jaccard index of bigram sets; two empty ones are unlike."""
    x, y = _bigrams(a), _bigrams(b)
    return len(x & y) / len(x | y) if x or y else 0.0


def _posterior(p: float, up: float) -> float:
    return p * up / (p * up + (1 - p) * (1 - up) + 1e-10)


class Belief:
    """The state of one key."""

    def __init__(self) -> None:
        self.value, self.confidence, self.evidence, self.conflicts, self.history = None, 0.0, 0, 0, []

    def add(self, value: str, delta: float) -> None:
        if self.evidence == 0:
            self.value, self.confidence = value, min(1.0, 0.5 + delta)
        elif (sim := similarity(self.value, value)) < CONFLICT:
            self.conflicts += 1
            self.history = [*self.history, (self.evidence, self.value, value, round(sim, 3))][-CONFLICTS_KEPT:]
            self.confidence = max(0.0, min(1.0, _posterior(self.confidence, 1 - LIKELY)))
            if self.conflicts >= self.evidence / 2 or delta >= STRONG:
                self.value = value
        else:
            upper = _posterior(self.confidence, LIKELY)
            self.confidence = max(0.0, min(1.0, upper + delta * (1 - upper)))
            if sim < SAME:
                self.value = value
        self.evidence += 1


_HISTORY = "array<struct<step:long,old_value:string,new_value:string,similarity:double>>"


def belief_states(rows: DataFrame) -> DataFrame:
    """evidence (category, key, seq, value, delta) -> (category, key, value, confidence, evidence, conflicts, history).

    history has the last CONFLICTS_KEPT conflicts; step counts the evidence before each. A null value is
    empty, a null delta 0.
    """
    fields = {f.name: f.dataType for f in rows.schema.fields}
    names = ["category", "key", "value", "confidence", "evidence", "conflicts", "history"]
    entry = pa.struct([("step", pa.int64()), ("old_value", pa.string()), ("new_value", pa.string()), ("similarity", pa.float64())])
    kinds = [None, None, pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(entry)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out, types = None, Belief(), [], [pa.string(), pa.int64()]

        def close() -> None:
            if at is not None:
                history = [dict(zip(("step", "old_value", "new_value", "similarity"), h, strict=True)) for h in state.history]
                out.append((*at, state.value, state.confidence, state.evidence, state.conflicts, history))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*types, *kinds[2:]], strict=True)], names)
            out.clear()
            return made

        for batch in batches:
            types = [batch.schema.field(k).type for k in (0, 1)]
            for category, key, value, delta in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (category, key) != at:
                    close()
                    at, state = (category, key), Belief()
                state.add(value or "", delta or 0.0)
            yield batch_of()
        close()
        yield batch_of()

    ordered = rows.repartition("category", "key").sortWithinPartitions("category", "key", "seq", "value", "delta").select("category", "key", "value", F.col("delta").cast("double").alias("delta"))
    schema = f"category {fields['category'].simpleString()}, key {fields['key'].simpleString()}, value string, confidence double, evidence long, conflicts long, history {_HISTORY}"
    return ordered.mapInArrow(run, schema)


def belief_fold(rows: DataFrame) -> DataFrame:
    """evidence (category, key, seq, value, delta) -> (category, key, value, confidence, evidence, conflicts)."""
    return belief_states(rows).select("category", "key", "value", F.round("confidence", 6).alias("confidence"), "evidence", "conflicts")


def conflict_history(rows: DataFrame) -> DataFrame:
    """(category, key, step, old_value, new_value, similarity): the last conflicts of each belief."""
    return belief_states(rows).select("category", "key", F.inline("history"))


def belief_get(beliefs: DataFrame, category: str, key: object) -> DataFrame:
    return beliefs.filter((F.col("category") == category) & (F.col("key") == F.lit(key)))


def by_category(beliefs: DataFrame, category: str) -> DataFrame:
    """The beliefs of a category; order and limits are the caller's."""
    return beliefs.filter(F.col("category") == category)


def belief_decay(beliefs: DataFrame, factor: float, rounds: int = 1, least: float = 0.1) -> DataFrame:
    return beliefs.withColumn("confidence", F.round(F.col("confidence") * F.lit(factor**rounds), 6)).filter(F.col("confidence") >= least)
