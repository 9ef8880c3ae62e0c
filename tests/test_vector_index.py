"""The vector index against comparing with all vectors: recall, pruning, segments, removals, odd vectors."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoria.errors import StoreError
from mnemoria.operators.search import knn
from mnemoria.sources.vector_index import VectorIndex

SCHEMA = "vec_id long, embedding array<float>"


def _rows(v, first=0):
    return [(first + k, [float(np.float32(x)) for x in row]) for k, row in enumerate(v)]


def _recall(spark, index, vectors, queries, k=10, probes=None):
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in index.search(queries, k, probes).collect()}
    want = {(r["query_id"], r["vec_id"]): r["score"] for r in knn(vectors, queries, k).collect()}
    assert all(abs(got[p] - want[p]) <= 2e-6 for p in got.keys() & want.keys())
    return len(got.keys() & want.keys()) / len(want)


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    v = centres[rng.integers(0, 30, 3000)] + 0.25 * rng.normal(size=(3000, 16))
    v[100:400] = v[100]  # a hot vector
    vectors = spark.createDataFrame(_rows(v), SCHEMA).repartition(3).persist()
    index = VectorIndex(spark, f"file://{tmp_path_factory.mktemp('vectors')}")
    index.build(vectors)
    return index, vectors


def test_few_lists_where_vectors_cluster(spark, clustered):
    index, vectors = clustered
    state = index.state()
    assert 45 <= state["lists"] <= 55 and state["probes"] <= state["lists"] / 4
    queries = vectors.filter("vec_id % 50 = 0 and not vec_id between 100 and 399").select(F.col("vec_id").alias("query_id"), "embedding")
    assert _recall(spark, index, vectors, queries) >= 0.9
    assert _recall(spark, index, vectors, queries, probes=state["lists"]) >= 0.999


def test_blocks_of_a_list(spark, clustered, monkeypatch):
    from mnemoria.sources import vector_index

    index, vectors = clustered
    queries = vectors.filter("vec_id in (7, 1000, 2001)").select(F.col("vec_id").alias("query_id"), "embedding")
    want = index.search(queries, 5).collect()
    monkeypatch.setattr(vector_index, "BLOCK", 20)
    assert sorted(index.search(queries, 5).collect()) == sorted(want) and len(want) == 15


def test_even_vectors(spark, tmp_path):
    """Nothing to prune by: the measured number of lists still gives the recall."""
    v = np.random.default_rng(4).normal(size=(1500, 24))
    vectors = spark.createDataFrame(_rows(v), SCHEMA)
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    index.build(vectors)
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert _recall(spark, index, vectors, queries) >= 0.9


def test_segments_removals_and_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 8))
    odd = [(900, None), (901, []), (902, [0.0] * 8), (903, [math.nan] * 8), (904, [None] * 8), (905, [1.0, 2.0]), (None, [1.0] * 8)]
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    with pytest.raises(StoreError):
        index.state()
    index.build(spark.createDataFrame(_rows(v[:100]) + odd, SCHEMA))
    pinned = VectorIndex(spark, index.root, index.latest())
    index.append(spark.createDataFrame(_rows(v[100:], 100) + odd[:3], SCHEMA))
    queries = spark.createDataFrame([(1, v[150].tolist()), (2, v[3].tolist()), (3, [0.0] * 8), (4, None)], "query_id long, embedding array<double>")
    first = lambda i: {r["query_id"]: r["vec_id"] for r in i.search(queries, 1, 99).collect()}
    assert first(index) == {1: 150, 2: 3} and first(pinned)[2] == 3 and first(pinned)[1] < 100
    index.remove(spark.createDataFrame([(3,), (150,)], "id long"))
    assert first(index)[2] != 3 and first(index)[1] != 150
    index.append(spark.createDataFrame(_rows(v[150:151], 150), SCHEMA))
    assert first(index)[1] == 150
    with pytest.raises(StoreError):
        index.append(spark.createDataFrame(_rows(v[:1]) * 2, SCHEMA))
    with pytest.raises(StoreError):
        VectorIndex(spark, f"file://{tmp_path}/j").build(spark.createDataFrame(odd[:5], SCHEMA))


def test_lists_are_folders(spark, clustered):
    index, _ = clustered
    path = index.state()["segments"][0][0]
    plan = spark.read.parquet(f"{index.root}/{path}/codes").filter("list in (1, 2)")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list#\d+ IN ", plan)
