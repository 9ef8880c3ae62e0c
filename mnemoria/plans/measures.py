"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators.blocks import running_count
from ..sources.tables import memories, table
from .registry import query
from .retrieval import KNN_SQL, knn_run

_RUN = f"WITH {KNN_SQL}, l AS (SELECT vec_id, label FROM embeddings), qr AS (SELECT a.vec_id AS query_id, b.vec_id AS doc FROM l a JOIN l b ON a.label = b.label WHERE a.vec_id % 50 = 0), nr AS (SELECT query_id, count(*) AS n FROM qr GROUP BY 1), h AS (SELECT k.query_id, k.rank FROM knn k JOIN qr ON qr.query_id = k.query_id AND qr.doc = k.vec_id)"
_MET = f"""{_RUN}, m AS (SELECT q.query_id, coalesce((SELECT count(*) FROM h WHERE h.query_id = q.query_id AND rank < 1)::DOUBLE / n, 0) AS recall_1, coalesce((SELECT count(*) FROM h WHERE h.query_id = q.query_id AND rank < 5)::DOUBLE / n, 0) AS recall_5,
coalesce((SELECT count(*) FROM h WHERE h.query_id = q.query_id AND rank < 10)::DOUBLE / n, 0) AS recall_10, coalesce((SELECT 1.0::DOUBLE / (min(rank) + 1) FROM h WHERE h.query_id = q.query_id), 0) AS mrr,
coalesce((SELECT sum(1.0::DOUBLE / log2(rank + 2.0)) FROM h WHERE h.query_id = q.query_id), 0) / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0))) AS ndcg_10 FROM (SELECT DISTINCT query_id FROM knn) q JOIN nr USING (query_id))"""


def _metrics(s, d):
    lab = table(s, d, "embeddings").select("vec_id", "label")
    q = lab.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    qrels = lab.join(F.broadcast(q), "label").select("query_id", F.col("vec_id").alias("doc"))
    return ev.retrieval_metrics(knn_run(s, d).withColumnRenamed("vec_id", "doc"), qrels)


for _k in ("recall_1", "recall_5", "recall_10", "mrr", "ndcg_10"):
    query({"recall_1": "recall_at_1", "recall_5": "recall_at_5", "recall_10": "recall_at_k", "mrr": "mrr", "ndcg_10": "ndcg_at_k"}[_k], f"{_MET} SELECT query_id, round({_k}, 6) AS value FROM m")(lambda s, d, k=_k: _metrics(s, d).select("query_id", F.col(k).alias("value")))


@query("eval_summary", "SELECT lang AS category, round(avg(n_chars), 6) AS mean, list_sort(list(n_chars))[floor(count(*) / 2)::BIGINT + 1] AS p50, list_sort(list(n_chars))[floor(count(*) * 0.95)::BIGINT + 1] AS p95 FROM documents GROUP BY 1")
def _(s, d):
    return ev.exact_percentiles(table(s, d, "documents").select(F.col("lang").alias("category"), "n_chars"), ["category"], "n_chars")


_SC = "sc AS (SELECT lang, source, quality::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
_GM = "count(*) AS total, count(*) FILTER (score >= 0.5) AS correct, round(100.0::DOUBLE * count(*) FILTER (score >= 0.5) / count(*), 6) AS accuracy, round(100.0::DOUBLE * avg(score), 6) AS avg_score"


def _scores(s, d):
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "source"), "doc_id").select("lang", "source", F.col("quality").cast("double").alias("score"))


@query("group_metrics", f"WITH {_SC} SELECT lang AS grp, {_GM} FROM sc GROUP BY 1")
def _(s, d):
    return ev.group_metrics(_scores(s, d).withColumnRenamed("lang", "grp"), ["grp"])


@query("overall_metrics", f"WITH {_SC} SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, {_GM} FROM sc GROUP BY ROLLUP (lang, source)")
def _(s, d):
    ok = F.count_if(F.col("score") >= 0.5)
    return _scores(s, d).rollup("lang", "source").agg(F.count("*").alias("total"), ok.alias("correct"), F.round(100.0 * ok / F.count("*"), 6).alias("accuracy"), F.round(100.0 * F.avg("score"), 6).alias("avg_score")).withColumns({"lang": F.coalesce("lang", F.lit("all")), "source": F.coalesce("source", F.lit("all"))})


@query("beam_metrics", f"WITH {_SC} SELECT cutoff, coalesce(lang, 'all') AS type, count(*) AS n, round(avg(score), 6) AS mean FROM sc, (VALUES (20), (50), (100)) c(cutoff) GROUP BY cutoff, ROLLUP (lang)")
def _(s, d):
    c = _scores(s, d).withColumn("cutoff", F.explode(F.array(F.lit(20), F.lit(50), F.lit(100))))
    each = c.groupBy("cutoff", F.col("lang").alias("type")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))
    return each.union(c.groupBy("cutoff").agg(F.lit("all").alias("type"), F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean")))


_TAU = "t AS (SELECT lang, doc_id AS item, n_chars AS p, doc_id AS r FROM documents)"


_TAU_SQL = f"WITH {_TAU} SELECT a.lang, round(sum(sign(a.p - b.p) * sign(a.r - b.r)) / sqrt(count(*) FILTER (a.p <> b.p)::DOUBLE * count(*) FILTER (a.r <> b.r)), 6) AS tau FROM t a JOIN t b ON a.lang = b.lang AND a.item < b.item GROUP BY 1"


@query("kendall_tau_b", _TAU_SQL)
@query("kendall_tau_b_all", _TAU_SQL)
def _(s, d):
    """The orders by length and by id of all documents of a language."""
    return ev.kendall_tau_b(table(s, d, "documents").select("lang", F.col("doc_id").alias("item"), F.col("n_chars").alias("p"), F.col("doc_id").alias("r")), ["lang"])


@query("nugget_clamp", "SELECT event_type, round(avg(CASE WHEN value / 100 >= 0.75 THEN 1.0::DOUBLE WHEN value / 100 >= 0.25 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS score FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.avg(ev.nugget_clamp(F.col("value") / 100)), 6).alias("score"))


@query("question_score", "WITH q AS (SELECT user_id, avg(CASE WHEN value / 100 >= 0.75 THEN 1.0::DOUBLE WHEN value / 100 >= 0.25 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM events GROUP BY 1) SELECT user_id, round(s, 6) AS score, round(s, 6) >= 0.5 AS passed FROM q")
def _(s, d):
    q = table(s, d, "events").groupBy("user_id").agg(F.round(F.avg(ev.nugget_clamp(F.col("value") / 100)), 6).alias("score"))
    return q.select("user_id", "score", (F.col("score") >= 0.5).alias("passed"))


@query("probing_flatten", "SELECT source AS type, doc_id AS question FROM documents")
def _(s, d):
    """A map of lists to rows."""
    m = table(s, d, "documents").groupBy("source").agg(F.collect_list("doc_id").alias("q")).select(F.create_map("source", "q").alias("m"))
    return m.select(F.explode(F.map_entries("m")).alias("e")).select(F.col("e.key").alias("type"), F.explode("e.value").alias("question"))


@query("chronological_context", "SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, concat('[', strftime(make_timestamp((1704067200 + doc_id * 3600) * 1000000), '%Y-%m-%d'), '] ', text) AS line FROM documents")
def _(s, d):
    """The dated lines of each source with their places, whole texts."""
    line = F.concat(F.lit("["), F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd"), F.lit("] "), F.coalesce("content", F.lit("")))
    return running_count(memories(s, d).select(F.col("room").alias("source"), "id", line.alias("line")), ["source"], "id", "place").select("source", "place", "line")


@query("chronological_context_whole", "SELECT source, md5(string_agg(md5(concat('[', strftime(make_timestamp((1704067200 + doc_id * 3600) * 1000000), '%Y-%m-%d'), '] ', text)), chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY 1")
def _(s, d):
    """One hash for each source, over its lines' hashes in order."""
    line = F.concat(F.lit("["), F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd"), F.lit("] "), F.coalesce("content", F.lit("")))
    hashed = memories(s, d).select(F.col("room").alias("source"), F.struct("id", F.md5(line.cast("binary")).alias("l")).alias("x"))
    return hashed.groupBy("source").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["l"]), "\n").cast("binary")).alias("h"))


@query("resume_checkpoint", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    return memories(s, d).select("id").join(table(s, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")
