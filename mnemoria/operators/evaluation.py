"""Retrieval and benchmark metrics over run (query_id, doc, rank from 0) and qrels (query_id, doc)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks


def retrieval_metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(query_id, recall_1, recall_5, recall_10, mrr, ndcg_10); a query without relevant rows has 0."""
    n = qrels.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = run.join(qrels, ["query_id", "doc"])
    per = hits.groupBy("query_id").agg(*[F.count_if(F.col("rank") < k).alias(f"h{k}") for k in ks], (1.0 / (F.min("rank") + 1)).alias("rr"), F.sum(F.when(F.col("rank") < 10, 1.0 / F.log2(F.col("rank") + 2.0))).alias("dcg"))
    asked = run.select("query_id").distinct()
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n_rel")).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    out = asked.join(n, "query_id", "left").join(per, "query_id", "left")
    return out.select("query_id", *[zero(F.col(f"h{k}") / F.col("n_rel")).alias(f"recall_{k}") for k in ks], zero(F.col("rr")).alias("mrr"), zero(F.col("dcg") / F.when(F.col("n_rel") > 0, ideal)).alias("ndcg_10"))


def group_metrics(scores: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """scores (by..., score) -> total, correct, accuracy %, average %."""
    ok = F.count_if(F.col("score") >= threshold)
    return scores.groupBy(*by).agg(F.count("*").alias("total"), ok.alias("correct"), F.round(100.0 * ok / F.count("*"), 6).alias("accuracy"), F.round(100.0 * F.avg("score"), 6).alias("avg_score"))


def inversions(ranks: np.ndarray) -> int:
    """Pairs i < j with ranks[i] > ranks[j], in O(n log n) for each bit of the ranks.

    From the highest bit down, places are kept grouped by the bits above it and in order within a group; a
    pair is counted at the highest bit in which its ranks differ.
    """
    total, at = 0, np.asarray(ranks, np.int64)
    for bit in range(int(at.max(initial=0)).bit_length() - 1, -1, -1):
        at = at[np.argsort(at >> (bit + 1), kind="stable")]
        one = (at >> bit) & 1
        group = at >> (bit + 1)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        before = np.cumsum(one) - one  # ones before each place, less those before its group
        before = before - np.repeat(before[first], np.diff(np.append(first, len(at))))
        total += int(before[one == 0].sum())
    return total


def _tied_pairs(rows: DataFrame, by: list[str], keys: list[str], name: str) -> DataFrame:
    """(by..., name): pairs of rows with known and equal keys."""
    known = rows.dropna(subset=keys) if keys else rows
    n = known.groupBy(*by, *keys).agg(F.count("*").cast("decimal(19,0)").alias("n"))
    return n.groupBy(*by).agg((F.sum(F.col("n") * (F.col("n") - 1)) / 2).cast("double").alias(name))


def kendall_tau_b(rows: DataFrame, by: list[str], block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """rows (by..., item, p, r): tau-b of two orders by numbers; fewer than two items give 0.

    Items are distinct within a group. A null place differs from none and is ordered with none. Ties are
    counted by value and pairs that the orders see differently in blocks, so a group may have any size.
    """
    both = rows.select(*by, "p", "r").dropna(subset=["p", "r"])
    of_p, of_r = rows.select(*by, "p").dropna(subset=["p"]), rows.select(*by, "r").dropna(subset=["r"])
    parts = [
        _tied_pairs(of_p, by, [], "all_p"), _tied_pairs(of_p, by, ["p"], "tied_p"), _tied_pairs(of_r, by, [], "all_r"), _tied_pairs(of_r, by, ["r"], "tied_r"),
        _tied_pairs(both, by, [], "pairs"), _tied_pairs(both, by, ["p"], "same_p"), _tied_pairs(both, by, ["r"], "same_r"), _tied_pairs(both, by, ["p", "r"], "same"),
        blocks.discordant(both, by, block_rows), rows.select(*by).distinct(),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in every.columns if c not in by]
    t = every.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names])
    n_p, n_r = F.col("all_p") - F.col("tied_p"), F.col("all_r") - F.col("tied_r")
    score = F.col("pairs") - F.col("same_p") - F.col("same_r") + F.col("same") - 2 * F.col("d")
    return t.select(*by, F.round(F.when((n_p > 0) & (n_r > 0), score / (F.sqrt(n_p) * F.sqrt(n_r))).otherwise(0.0), 6).alias("tau"))


def exact_percentiles(rows: DataFrame, by: list[str], value: str, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """(by..., mean, p50, p95): the values at places n // 2 and int(.95 n) of the sorted list."""
    places = {"p50": F.floor(F.col("n") / 2), "p95": F.floor(F.col("n") * 0.95)}
    mean = rows.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"))
    every = mean.unionByName(blocks.nth_values(rows, by, value, places, block_rows), allowMissingColumns=True)
    return every.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("mean", "p50", "p95")])


def nugget_clamp(c):
    return F.when(c >= 0.75, 1.0).when(c >= 0.25, 0.5).otherwise(0.0)


def flatten_rubric(rubric: Column) -> Column:
    """The texts of a rubric in JSON: a list, a text, or an object with a list under `items`; else empty."""
    whole = F.concat(F.lit('{"x":'), rubric, F.lit("}"))
    many = F.when(rubric.rlike(r"^\s*\["), F.from_json(rubric, "array<string>")).when(rubric.rlike(r"^\s*\{"), F.from_json(F.get_json_object(rubric, "$.items"), "array<string>"))
    one = F.when(rubric.rlike(r'^\s*"'), F.array(F.get_json_object(whole, "$.x")))
    return F.coalesce(many, one, F.array().cast("array<string>"))
