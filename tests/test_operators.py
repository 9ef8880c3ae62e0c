"""Literal fixtures: expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from mnemoria.errors import StoreError
from mnemoria.functions import text
from mnemoria.operators import beliefs, evaluation, fusion, graph, ingest, search
from mnemoria.plans import pql


def _channel(spark, rows):
    return spark.createDataFrame(rows, "channel string, id string, rank long")


def _one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()[0]


def test_rrf(spark):
    one = {r["id"]: r["score"] for r in fusion.rrf_fuse(_channel(spark, [("semantic", "a", 0), ("semantic", "b", 1)])).collect()}
    assert one == {"a": 1.0, "b": 0.96875}
    many = {r["id"]: r["score"] for r in fusion.rrf_fuse(_channel(spark, [("semantic", "a", 0), ("semantic", "b", 1), ("bm25", "b", 0), ("bm25", "c", 1)])).collect()}
    assert many == {"b": 1.0, "a": 0.507937, "c": 0.492063}
    assert fusion.rrf_fuse(_channel(spark, [])).count() == 0


def test_interleave(spark):
    rows = fusion.interleave_fuse(_channel(spark, [("semantic", "a", 0), ("semantic", "b", 1), ("bm25", "c", 0), ("bm25", "d", 1)])).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in rows] == [("c", 1.0), ("a", 1.0), ("d", 0.5), ("b", 0.5)]


@pytest.mark.parametrize(("query", "kind"), [("", "semantic"), ("notes from last week", "temporal"), ("Chicago", "temporal"), ("John Smith", "keyword"), ("memory management", "keyword"), ("one two three four five six seven John Smith", "entity"), ("how John Smith", "entity"), ("why does the service restart", "semantic"), ("Python教程", "keyword")])
def test_classify(spark, query, kind):
    assert _one(spark, query, fusion.query_classify) == kind


@pytest.mark.parametrize(("a", "b", "sim"), [("mempalce", "mempalace", 0.736842), ("cat", "car", 0.5), ("abc", "xyz", 0.0), ("Hello", "hello", 1.0), ("中Y", "中医", 0.333333), ("typ", "type", 0.666667), ("", "", 0.0)])
def test_trigrams(spark, a, b, sim):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(text.trigram_similarity(F.col("a"), F.col("b"))).first()[0]
    assert round(got, 6) == sim


def test_fuzzy(spark):
    tags = spark.createDataFrame([(t,) for t in ("mempalace", "memory", "palace", "wing", "drawer")], "tag string")
    q = spark.createDataFrame([("MEMORY",), ("mempalce",), ("zzzzz",)], "query string")
    assert {(r["query"], r["tag"]) for r in search.fuzzy_match_tag(q, tags).collect()} == {("MEMORY", "memory"), ("mempalce", "mempalace")}


def test_budget(spark):
    rows = spark.createDataFrame([(k, "x" * 30, k) for k in range(3)], "id long, text string, rank long")
    assert fusion.budget_trim(rows, 50).count() == 1
    assert fusion.budget_trim(rows, 200).count() == 3
    long = spark.createDataFrame([(1, "x" * 200, 0)], "id long, text string, rank long")
    assert len(fusion.budget_trim(long, 50).first()["text"]) == 53


def test_beliefs(spark):
    rows = [("c", 1, k, v, 0.1) for k, v in enumerate(["click", "click", "view", "view"])]
    for n, want in ((1, ("click", 0.6, 1, 0)), (2, ("click", 0.905263, 2, 0)), (3, ("view", 0.627737, 3, 1)), (4, ("view", 0.914737, 4, 1))):
        got = beliefs.belief_fold(spark.createDataFrame(rows[:n], "category string, key long, seq int, value string, delta double")).first()
        assert tuple(got)[2:] == want


def test_graph(spark):
    rel = spark.createDataFrame([("alice", "related_to", "common", 1.0), ("bob", "related_to", "common", 1.0), ("charlie", "related_to", "other", 1.0)], "subject string, predicate string, object string, weight double")
    assert {(r["entity"], r["other"]) for r in graph.similar_entities(rel).collect() if r["entity"] in ("alice", "charlie")} == {("alice", "bob")}
    causes = spark.createDataFrame([("a", "cause", "b", 1.0), ("b", "cause", "c", 1.0)], "subject string, predicate string, object string, weight double")
    got = {(r["node"], r["score"], r["type"]) for r in graph.graph_expand(causes, spark.createDataFrame([("a",)], "seed string")).collect()}
    assert got == {("b", 0.8, "cooccurrence"), ("c", 0.21, "causal")}


def test_metrics(spark):
    run = spark.createDataFrame([(1, "a", 0), (1, "x", 1), (1, "b", 2)], "query_id long, doc string, rank long")
    qrels = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, doc string")
    assert tuple(evaluation.retrieval_metrics(run, qrels).first()) == (1, 0.5, 1.0, 1.0, 1.0, 0.919721)
    tau = spark.createDataFrame([("x", k, p, k) for k, p in enumerate([0, 2, 1, 3])] + [("y", k, 3 - k, k) for k in range(4)] + [("z", 0, 0, 0)], "g string, item long, p long, r long")
    assert {r["g"]: r["tau"] for r in evaluation.kendall_tau_b(tau, ["g"]).collect()} == {"x": 0.666667, "y": -1.0, "z": 0.0}


@pytest.mark.parametrize(("t", "kind"), [("因为下雨所以路滑", "causation"), ("我去过北京", "experience"), ("plain", "observation")])
def test_fact_type(spark, t, kind):
    assert _one(spark, t, ingest.fact_type) == kind


def test_small_functions(spark):
    assert _one(spark, "a。b！c;d", text.sentences) == ["a", "b", "c", "d"]
    assert _one(spark, "AB 内存", text.summary_tokens) == ["ab", "内存", "内", "存", "内存"]
    assert _one(spark, "Ã©", text.repair_mojibake) == "é"
    assert _one(spark, "a\x00\x00b", text.repair_nul) == "ab"
    assert [_one(spark, t, text.should_skip) for t in ("好的", "/cmd", "12345", "hello there", None)] == [True, True, True, False, True]
    assert text.path_escape is not None and _one(spark, "a%b?c", text.path_escape) == "a%25b%3Fc"
    assert _one(spark, "keep\n<tool_call>\nx\n```\nend", ingest.clean_llm_response) == "keep\nend"


def test_pql():
    assert pql.parse("FIND old notes in en/src1 top_k=3") == {"action": "find", "top_k": 3, "scope": "en/src1", "query": "old notes"}
    assert pql.parse("add hello TO user/home") == {"action": "add", "content": "hello", "wing": "user", "room": "home"}
    assert pql.parse("status") == {"action": "status"}
    with pytest.raises(StoreError):
        pql.parse("DROP all")


def test_mojibake_passes_share_their_texts(spark):
    plan = spark.range(1).select(text.repair_mojibake(F.concat(F.col("id").cast("string"), F.lit("x"))).alias("t"))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("concat(") == 1
