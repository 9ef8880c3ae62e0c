"""Work in blocks against sorting and counting whole groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mnemoria.operators import blocks, evaluation, ingest, jobs


def _values(seed, n, most):
    """Numbers of which a third are one value."""
    r = random.Random(seed)
    return [most // 2 if r.random() < 0.34 else r.randint(0, most) for _ in range(n)]


@pytest.mark.parametrize("bounds", [[], [3.0], [1.0, 4.0, 5.0], [float(k) for k in range(0, 40, 3)]])
def test_block(spark, bounds):
    xs = [k / 2 for k in range(-2, 90)]
    rows = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    got = {r["x"]: r["b"] for r in rows.select("x", blocks.block(F.col("x"), bounds).alias("b")).collect()}
    assert got.pop(None) == 0 and got == {x: blocks.block_of(x, bounds) for x in xs}
    assert [got[x] for x in xs] == sorted(got.values()) and all(got[b] % 2 == 0 for b in bounds)


def test_a_block_holds_few_rows_of_different_values(spark):
    rows = spark.createDataFrame([(x,) for x in _values(1, 4000, 3000)], "x long")
    bounds = blocks.quantiles(rows, "x", 100)
    n = {r["b"]: r["n"] for r in rows.groupBy(blocks.block(F.col("x"), bounds).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert n[blocks.block_of(1500, bounds)] > 1300 and blocks.block_of(1500, bounds) % 2 == 0
    assert max(v for b, v in n.items() if b % 2) <= 300


def test_running_count(spark):
    ids = random.Random(2).sample(range(10**12), 900)
    rows = [("hot" if k % 3 else (None if k % 2 else "g"), i, f"x{i}") for k, i in enumerate(ids)]
    got = blocks.running_count(spark.createDataFrame(rows, "g string, id long, x string"), ["g"], "id", "place", 50).collect()
    want, seen = [], {}
    for g, i, x in sorted(rows, key=lambda r: r[1]):
        want.append((g, i, x, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


@pytest.mark.parametrize("block_rows", [7, 10**6])
def test_percentiles(spark, block_rows):
    groups = {"a": _values(3, 400, 1000), "b": [5], "c": [None, 2, None], None: list(range(60)), "d": [None]}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x long")
    got = {r["g"]: (r["mean"], r["p50"], r["p95"]) for r in evaluation.exact_percentiles(rows, ["g"], "x", block_rows).collect()}
    for g, xs in groups.items():
        s, known = sorted(xs, key=lambda x: (x is not None, x or 0)), [x for x in xs if x is not None]
        assert got.pop(g) == (round(sum(known) / len(known), 6) if known else None, s[len(s) // 2], s[int(0.95 * len(s))])
    assert not got


def _tau(rows):
    sign = lambda a, b: None if a is None or b is None else (a > b) - (a < b)
    pairs = [(sign(a[0], b[0]), sign(a[1], b[1])) for k, a in enumerate(rows) for b in rows[:k]]
    n = math.sqrt(sum(bool(p) for p, _ in pairs)) * math.sqrt(sum(bool(r) for _, r in pairs))
    return round(sum(p * r for p, r in pairs if p is not None and r is not None) / n, 6) if n else 0.0


@pytest.mark.parametrize("block_rows", [9, 10**6])
def test_tau_in_blocks(spark, block_rows):
    r = random.Random(4)
    groups = {"hot": list(zip(_values(5, 400, 90), _values(6, 400, 5000), strict=True)), None: [(k, -k) for k in range(40)], "nulls": [(r.choice([None, k]), r.choice([None, 7, -k])) for k in range(60)], "one": [(1, 1)], "none": [(None, None)] * 3}
    rows = spark.createDataFrame([(g, k, *x) for g, xs in groups.items() for k, x in enumerate(xs)], "g string, item long, p long, r long")
    got = {x["g"]: x["tau"] for x in evaluation.kendall_tau_b(rows, ["g"], block_rows).collect()}
    assert got == {g: _tau(xs) for g, xs in groups.items()}


def test_empty(spark):
    none = spark.createDataFrame([], "g string, item long, p long, r long")
    assert evaluation.kendall_tau_b(none, ["g"]).collect() == [] and evaluation.exact_percentiles(none, ["g"], "p").collect() == []
    assert blocks.running_count(none, ["g"], "item", "place").collect() == []


def test_summaries_in_blocks(spark):
    r = random.Random(8)
    text = lambda: ". ".join(" ".join(r.choice("alpha beta gamma delta kappa".split()) for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 5)))
    rows = spark.createDataFrame([("hot" if k % 4 else "g", k * 7, text()) for k in range(300)], "g string, id long, content string")
    run = lambda n: sorted(map(tuple, jobs.summarize(rows, ["g"], 5, (0.5, 0.2, 0.3), F.lit(0.5), 10, 300, n).collect()))
    assert len(run(10**6)) == 2 and run(20) == run(10**6)


def _appended(parts, most):
    out = ""
    for x in parts:
        if x and x not in out:
            out = (f"{out}\n{x}" if out else x)[:most]
    return out


def test_scene_summary(spark):
    r = random.Random(9)
    scenes = {s: [r.choice([None, "", "ab", "b", "张三", f"text {r.randint(0, 30)}", "x" * 40]) for _ in range(n)] for s, n in (("a", 90), (None, 40), ("short", 1), ("z", 3))}
    rows = spark.createDataFrame([(s, k, x) for s, xs in scenes.items() for k, x in enumerate(xs)], "scene string, id long, summary string")
    assert {x["scene"]: x["summary"] for x in ingest.scene_summary(rows, 120).collect()} == {s: _appended(xs, 120) for s, xs in scenes.items()}
    assert ingest.scene_summary(rows.limit(0)).collect() == []


def test_scene_of_a_million(spark):
    rows = spark.range(10**6).select(F.lit("s").alias("scene"), "id", F.concat(F.lit("summary "), "id").alias("summary"))
    (got,) = ingest.scene_summary(rows).collect()
    assert got["summary"] == _appended([f"summary {k}" for k in range(900)], 5000)


def test_summaries_exchange_no_texts(spark):
    rows = spark.createDataFrame([(f"g{k % 3}", k, f"the word{k % 7} and rare{k} 中文字. plain text {k}! again 今天 {k * k}") for k in range(60)], "g string, id long, content string")
    run = lambda **kw: jobs.summarize(rows, ["g"], 5, (0.5, 0.2, 0.3), F.length("s") / 100, 10, 300, **kw)
    plan = run()._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "explode" not in plan.lower()  # sentences and words were counted before, in tasks of their own
    few = sorted(map(tuple, run(most_terms=3).collect()))  # most words are joined
    assert len(few) == 3 and few == sorted(map(tuple, run().collect()))
