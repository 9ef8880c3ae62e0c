"""Set joins against brute force, with and without hubs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoria.operators import graph, setjoin


def _random_sets(seed, n, mids):
    r = random.Random(seed)
    sets = {f"e{k:03}": {f"m{int(r.random() ** 2 * mids)}" for _ in range(r.randint(1, 7))} for k in range(n)}
    return sets | {"alone": {"only"}, "e000b": set(sets["e000"]), "e000c": set(sets["e000"])}


def _rows(sets):
    return [(e, m) for e, ms in sets.items() for m in sorted(ms)]


def _best(sets, k):
    out = set()
    for x, a in sets.items():
        near = sorted((-round(len(a & b) / len(a | b), 6), y) for y, b in sets.items() if y != x and a & b)
        out |= {(x, y, -j, rank) for rank, (j, y) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize(("seed", "n", "mids", "hub"), [(1, 90, 12, 6), (2, 90, 40, 6), (3, 60, 5, 6), (4, 90, 25, 15), (5, 60, 30, 1000)])
def test_top_jaccard(spark, seed, n, mids, hub):
    sets = _random_sets(seed, n, mids)
    rows = spark.createDataFrame(_rows(sets) * 2 + [(None, "m1"), ("e001", None)], "entity string, mid string")
    got = {tuple(r) for r in setjoin.top_jaccard(rows, 5, hub).select("entity", "other", "jaccard", "rank").collect()}
    assert got == _best(sets, 5)


@pytest.mark.parametrize(("seed", "least"), [(1, 1), (2, 2), (3, 3), (4, 2)])
def test_common_pairs(spark, seed, least):
    sets = _random_sets(seed, 80, 20)
    got = {tuple(r) for r in setjoin.common_pairs(spark.createDataFrame(_rows(sets), "entity string, mid string"), least).collect()}
    assert got == {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}


@pytest.mark.parametrize(("seed", "hub"), [(6, 6), (7, 1000)])
def test_with_and_without_hubs(spark, monkeypatch, seed, hub):
    """Both ways of both joins, and sizes that are too many to broadcast."""
    sets = _random_sets(seed, 80, 20)
    rows = spark.createDataFrame(_rows(sets) * 3 + [(None, "m1"), ("e001", None)], "entity string, mid string")
    assert setjoin.has_hub(rows, hub) == (hub == 6)
    got = {tuple(r) for r in setjoin.common_pairs(rows, 2, hub).collect()}
    assert got == {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2}
    monkeypatch.setattr(setjoin, "MOST_SIZES", 3)
    assert {tuple(r) for r in setjoin.top_jaccard(rows, 5, hub).select("entity", "other", "jaccard", "rank").collect()} == _best(sets, 5)


def _stages(spark):
    kept = spark.sparkContext._jsc.sc().statusStore().store().view(spark._jvm.java.lang.Class.forName("org.apache.spark.status.StageDataWrapper")).iterator()
    while kept.hasNext():
        yield kept.next().info()


def _exchanged(spark, make):
    """(rows, records written to shuffles) of what make() returns."""
    start = max([-1, *(x.stageId() for x in _stages(spark))])
    n = len(make().collect())
    return n, sum(x.shuffleWriteRecords() for x in _stages(spark) if x.stageId() > start)


def test_exchanges_without_hubs(spark):
    """20,000 orders of four suppliers, where sizes are too many for the planner to broadcast: pairs are exchanged once."""
    i, j = F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")
    rows = spark.range(20_000).select(i, j).select(F.pmod(F.xxhash64("id", "j"), F.lit(1000)).alias("entity"), i.alias("mid"))
    sets = {}
    for e, m in rows.collect():
        sets.setdefault(e, set()).add(m)
    pairs = sum(len(sets[a] & sets[b]) for a in sets for b in sets if a != b)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        n, best = _exchanged(spark, lambda: setjoin.top_jaccard(rows, 5))
        _, common = _exchanged(spark, lambda: setjoin.common_pairs(rows, 2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert n == 5000 and best < 1.6 * pairs and common < 0.8 * pairs


def test_empty(spark):
    none = spark.createDataFrame([], "entity string, mid string")
    assert not setjoin.top_jaccard(none, 5).count() and not setjoin.common_pairs(none, 2).count()


HUB_SETS, OWN = 50_000, 40


def _hub_sets(spark):
    """Set i holds the hub, three of 40 frequent elements by its number, and every fourth one a pair's own element."""
    i = F.col("id")
    fixed = F.array(F.lit("hub"), *[F.concat(F.lit("f"), ((i * p + F.floor(i / 97) * (p + 2)) % OWN).cast("string")) for p in (3, 7, 11)])
    mids = F.when(i % 4 == 0, F.concat(fixed, F.array(F.concat(F.lit("own"), F.floor(i / 8).cast("string"))))).otherwise(fixed)
    return spark.range(HUB_SETS).select(F.format_string("e%05d", "id").alias("entity"), F.explode(F.array_distinct(mids)).alias("mid"))


def test_hub_of_50000(spark):
    """Every tenth set against all, by a matrix product; all pairs of the hub would be 2.5 billion."""
    rows = _hub_sets(spark)
    got = {}
    for r in setjoin.top_jaccard(rows, 5).filter(F.substring("entity", -1, 1) == "0").collect():
        got.setdefault(r["entity"], []).append((r["rank"], r["other"], r["jaccard"]))
    pdf = rows.toPandas()
    e = pdf["entity"].str[1:].astype(int).to_numpy()
    frequent = ~pdf["mid"].str.startswith("own").to_numpy()
    m = np.zeros((HUB_SETS, OWN + 1), dtype=np.float32)
    m[e[frequent], [OWN if x == "hub" else int(x[1:]) for x in pdf["mid"][frequent]]] = 1
    own = np.where(np.arange(HUB_SETS) % 4 == 0, np.arange(HUB_SETS) // 8, -1)
    size = m.sum(1) + (own >= 0)
    wrong = 0
    for x in range(0, HUB_SETS, 10):
        common = m @ m[x] + ((own == own[x]) & (own[x] >= 0))
        j = np.round(common.astype(np.float64) / (size + size[x] - common), 6)
        j[x] = -1
        order = np.argsort(-j, kind="stable")[:5]
        wrong += sorted(got[f"e{x:05}"]) != [(n, f"e{y:05}", j[y]) for n, y in enumerate(order)]
    assert wrong == 0
    classes = setjoin._classes(setjoin._profiles(setjoin._elements(rows), setjoin.HUB), 5)
    counted = setjoin.rare_pairs(rows).count(), setjoin.class_pairs(classes, 5).count()
    assert sum(counted) < HUB_SETS  # 12,500 and 736


def test_hub_of_leaves(spark):
    """A star joins no leaves by two shared neighbours, and its leaves are one class."""
    star = spark.range(HUB_SETS).select(F.lit("hub").alias("subject"), F.lit("related_to").alias("predicate"), F.format_string("e%05d", "id").alias("object"))
    assert graph.consolidate_link(star).count() == 0
    got = graph.similar_entities(star)
    assert got.count() == 5 * HUB_SETS
    assert [tuple(r) for r in got.filter("entity = 'e00002'").orderBy("rank").collect()] == [("e00002", f"e{n:05}", 1.0, r) for r, n in enumerate((0, 1, 3, 4, 5))]
