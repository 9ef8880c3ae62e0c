"""The whole job: queries against exact results over all rows."""

import collections
import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from mnemoria.operators import evaluation, search
from mnemoria.plans import catalog
from mnemoria.sources.tables import table

SF = "/root/testdata/sf0.001"


def _recall(got, exact):
    want = {(r["query_id"], r["vec_id"]) for r in exact.collect()}
    return len(want & {(r["query_id"], r["vec_id"]) for r in got.collect()}) / len(want)


def test_ann_recall(spark):
    v = table(spark, SF, "embeddings")
    exact = search.knn(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    got = catalog.queries()["ann_lsh"](spark, SF)
    assert got.groupBy("query_id").count().filter("count <> 10").count() == 0
    assert _recall(got, exact) >= 0.9


def test_ann_falls_back(spark):
    """Vectors far apart share no bucket: the query still gets its neighbours."""
    v = spark.createDataFrame([(k, [1000.0 * k, -500.0 * k]) for k in range(6)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert [r["vec_id"] for r in search.ann_knn(v, q, 3).orderBy("rank").collect()] == [0, 1, 2]


def _tau(rows):
    sign = lambda x: (x > 0) - (x < 0)
    pairs = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for k, a in enumerate(rows) for b in rows[:k]]
    n = math.sqrt(sum(p != 0 for p, _ in pairs) * sum(r != 0 for _, r in pairs))
    return round(sum(p * r for p, r in pairs) / n, 6) if n else 0.0


def test_tau_of_ties(spark):
    rng = random.Random(6)
    groups = {f"g{k}": [(rng.randint(0, m), rng.randint(0, m)) for _ in range(n)] for k, (m, n) in enumerate([(3, 40), (30, 70), (900, 90), (0, 5), (5, 1), (5, 2)])}
    rows = [(g, k, *x) for g, xs in groups.items() for k, x in enumerate(xs)]
    got = evaluation.kendall_tau_b(spark.createDataFrame(rows, "g string, item long, p long, r long"), ["g"])
    assert {r["g"]: r["tau"] for r in got.collect()} == {g: _tau(xs) for g, xs in groups.items()}


def test_tau_of_all_documents(spark):
    groups = collections.defaultdict(list)
    for r in table(spark, SF, "documents").select("lang", "n_chars", "doc_id").collect():
        groups[r["lang"]].append((r["n_chars"], r["doc_id"]))
    assert max(map(len, groups.values())) > 30
    assert {r["lang"]: r["tau"] for r in catalog.queries()["kendall_tau_b_all"](spark, SF).collect()} == {g: _tau(xs) for g, xs in groups.items()}


def test_context_has_whole_texts(spark, tmp_path):
    """A changed tail, far beyond 40 characters, changes the context of its source and no other."""
    for name, tail in (("a", "end"), ("b", "END")):
        rows = [(1, "x" * 500 + tail, "en", "s1", 503), (2, "short", "en", "s1", 5), (3, "y" * 90, "en", "s2", 90), (4, None, "en", "s2", None)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / name / "documents.parquet"))
    a, b = ({r["source"]: r["h"] for r in catalog.queries()["chronological_context_whole"](spark, str(tmp_path / k)).collect()} for k in ("a", "b"))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert a["s1"] == md5("\n".join(map(md5, ["[2024-01-01] " + "x" * 500 + "end", "[2024-01-01] short"])))
    assert a["s1"] != b["s1"] and a["s2"] == b["s2"]


def test_embeddings_of_words_that_cancel_out(spark):
    import zlib

    import numpy as np

    from mnemoria.functions.embed import DIMENSIONS, hashing

    place = lambda w: (zlib.crc32(w.encode()) % DIMENSIONS, zlib.crc32(w.encode()) // DIMENSIONS % 2)
    words, first = [f"w{k}" for k in range(1000)], place("w0")
    other = next(w for w in words if place(w) == (first[0], 1 - first[1]))
    norms = np.linalg.norm(hashing([f"w0 {other}", "w0", "", " \n", "\x0b"]), axis=1)
    assert norms.round(9).tolist() == [1, 1, 0, 0, 1]


def test_hashed_pairs_are_never_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(size=(300, 8)), np.full((40, 8), 100.0), np.full((40, 8), 100.001)])
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>").repartition(3)
    got = search.ann_knn(v, v.filter("vec_id in (300, 345)").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "bucket" not in plan and "query_matrix" in plan
    want = {q: sorted((round(float(np.linalg.norm(m[q] - x)), 6), k) for k, x in enumerate(m))[:10] for q in (300, 345)}
    assert {(r["query_id"], r["distance"], r["vec_id"]) for r in got.collect()} == {(q, *x) for q, xs in want.items() for x in xs}


def test_knn_by_few_queries(spark, monkeypatch):
    """Queries of a block that are scored a few at a time give what all at once give."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(90, 8))
    v = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(m)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 4)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in search.knn(v, v.filter("vec_id < 31").withColumnRenamed("vec_id", "query_id"), 5).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(np.maximum(0.0, u[:31] @ u.T), 6)
    for q in range(31):
        assert [got[q, r] for r in range(5)] == list(np.lexsort((np.arange(90), -scores[q]))[:5])
