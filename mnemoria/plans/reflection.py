"""Reflection, personas, audit, schedules, and administration of beliefs and of the graph."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.text import STABILITY_PATTERNS, stability_signal
from ..operators import beliefs, graph, ingest, jobs, reflect
from ..sources.tables import EVENTS_NOW, NOW, events, memories, order_pairs, place_relations, table
from .annotation import ANN_SQL
from .knowledge import BELIEF, JACCARD, PAIR_SQL, PARITY, PLACE, SEL, TOPIC, believed, evidence, summary_sql
from .registry import query

#: Phrases with and without signs of stability, by the id's remainder; the driver's texts have none.
PHRASES = ["我总是喜欢擅长研究。", "他长期在外。", "避免推荐。", "plain."]
_PHRASE = "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PHRASES)) + " END"


def _stable_sql(c: str) -> str:
    counts = [f"len(regexp_extract_all({c}, '{p}'))" for p in STABILITY_PATTERNS]
    return f"least(1.0::DOUBLE, ({' + '.join(counts)}) / 3.0::DOUBLE)"


def _phrased(s, d):
    """memories with a phrase before the content."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("id") % 4 + 1).cast("int"))
    return memories(s, d).withColumn("plain", F.col("content")).withColumn("content", F.concat(phrase, F.col("content")))


@query("stability_signal", f"SELECT doc_id AS id, round({_stable_sql(f'concat({_PHRASE}, text)')}, 6) AS s FROM documents")
def _(s, d):
    return _phrased(s, d).select("id", F.round(stability_signal(F.col("content")), 6).alias("s"))


_PERSONA_ROWS = f"SELECT {TOPIC} AS topic, doc_id AS id, concat({_PHRASE}, text) AS text FROM documents"


@query("persona_distill", f"WITH {summary_sql(_PERSONA_ROWS, 'topic', 8, (0.4, 0.2, 0.4), _stable_sql('s'), 5, 200)} SELECT topic, summary, n_sent, c.n, CASE WHEN c.n >= 5 AND sig > 0.5 THEN 'high' WHEN c.n >= 3 AND sig > 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM sm JOIN (SELECT {TOPIC} AS topic, count(*) AS n FROM documents GROUP BY 1) c USING (topic)")
def _(s, d):
    return jobs.persona_distill(_phrased(s, d).select(jobs.persona_topic(F.col("plain")).alias("topic"), "id", "content"))


@query("persona_get", "WITH t AS (SELECT source AS topic, count(*) AS evidence, CASE WHEN count(*) % 2 = 0 THEN 'medium' ELSE 'high' END AS confidence FROM documents GROUP BY 1) SELECT topic, confidence, evidence, row_number() OVER (ORDER BY confidence DESC, evidence DESC, topic) - 1 AS rank FROM t WHERE confidence IN ('medium', 'low')")
def _(s, d):
    """Personas of some levels: by the text of the level, then by the evidence."""
    t = memories(s, d).groupBy(F.col("room").alias("topic")).agg(F.count("*").alias("evidence"))
    return jobs.persona_get(t.withColumn("confidence", F.when(F.col("evidence") % 2 == 0, "medium").otherwise("high")), ["medium", "low"])


_REFLECT_NOW = 1704067200 + 8 * 86400
_REFLECT = f"""{PLACE}, hot AS (SELECT concat('NATION_', (user_id % 25)::VARCHAR) AS name, 'location' AS type, count(*) AS n FROM events WHERE floor(epoch(ts))::BIGINT >= {EVENTS_NOW} - 86400 GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, name LIMIT 5),
tr AS (SELECT name, subject, predicate, object, row_number() OVER (PARTITION BY name ORDER BY subject, predicate, object) AS r FROM hot JOIN rel ON name = subject OR name = object),
ts AS (SELECT name, string_agg(concat_ws(' ', subject, predicate, object), '; ' ORDER BY r) AS rels FROM tr WHERE r <= 3 GROUP BY name),
pa AS (SELECT 0 AS part, -n AS x, name AS y, concat('实体: ', name, ' (', type, ') [', rels, ']') AS line FROM hot JOIN ts USING (name)),
sc AS (SELECT concat(lang, '/', source) AS name, arg_min(substr(text, 1, 80), doc_id) AS summary, 1704067200 + min(doc_id) * 3600 AS created_at, 1704067200 + max(doc_id) * 3600 AS updated_at FROM documents GROUP BY 1),
pb AS (SELECT 1 AS part, -updated_at AS x, name AS y, concat('场景: ', name, ' (', created_at::VARCHAR, ') [', summary, ']') AS line FROM sc WHERE name IS NOT NULL AND created_at > {_REFLECT_NOW} - 7 * 86400 ORDER BY updated_at DESC, name LIMIT 10),
pc AS (SELECT 2 AS part, 0 AS x, md5(concat(doc_id::VARCHAR, ':7')) AS y, concat('记忆: ', substr(text, 1, 200)) AS line FROM documents ORDER BY y LIMIT 5),
ps AS (SELECT * FROM pa UNION ALL SELECT * FROM pb UNION ALL SELECT * FROM pc)"""


def _reflection(s, d):
    """relations, hot entities, scenes and samples of the tables."""
    m = memories(s, d)
    hot = events(s, d).filter(F.col("at") >= EVENTS_NOW - 86400).groupBy(F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("name")).agg(F.count("*").alias("n")).filter("n >= 2").withColumn("type", F.lit("location"))
    scenes = m.groupBy(F.concat("wing", F.lit("/"), "room").alias("name")).agg(F.min_by(F.substring("content", 1, 80), "id").alias("summary"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at")).filter("name is not null")
    samples = m.select(F.md5(F.concat(F.col("id").cast("string"), F.lit(":7")).cast("binary")).alias("k"), "content")
    return place_relations(s, d).drop("weight"), hot, scenes.filter(F.col("created_at") > _REFLECT_NOW - 7 * 86400), samples


@query("reflect_context", f"WITH {_REFLECT} SELECT substr(string_agg(line, chr(10) ORDER BY part, x, y), 1, 4000) AS context FROM ps")
def _(s, d):
    return reflect.reflect_context(*_reflection(s, d))


#: What a model answers in the queries below.
ANSWER = {
    "insights": ["x"],
    "kg_updates": [{"action": "add_entity", "subject": "NEW", "type": "org"}, {"action": "add_relation", "subject": "NATION_1", "predicate": "cause", "object": "NATION_2", "weight": 2.5}, {"action": "add_relation", "subject": "NEW", "predicate": "part_of"}],
    "mental_model_updates": [{"category": "goal", "key": "a", "value": "run", "confidence_delta": 0.2}, {"key": "b"}],
}


def _applied(s, d):
    answers = reflect.reflect(reflect.reflect_context(*_reflection(s, d)), lambda prompt, form: json.dumps(ANSWER))
    proof = s.createDataFrame([("goal", "a", 1, "run", 0.1)], "category string, key string, seq long, value string, delta double")
    return reflect.reflect_apply(answers, table(s, d, "nation").select(F.col("n_name").alias("name"), F.lit("location").alias("type")), place_relations(s, d), proof)


@query("reflect_apply", f"WITH {PLACE} SELECT subject, predicate, object, sum(w)::DOUBLE AS weight FROM (SELECT *, 1.0 AS w FROM rel UNION ALL SELECT 'NATION_1', 'cause', 'NATION_2', 2.5) GROUP BY 1, 2, 3")
def _(s, d):
    """Relations after a model's answer: weights add up, an update without an object is left out."""
    return _applied(s, d)["relations"]


@query("reflect_entities", "SELECT n_name AS name, 'location' AS type FROM nation UNION ALL SELECT 'NEW', 'org'")
def _(s, d):
    return _applied(s, d)["entities"]


_P = "(0.51::DOUBLE / (0.51::DOUBLE + 0.06::DOUBLE + 1e-10::DOUBLE))"  # 0.6 after agreeing evidence


@query("reflect_beliefs", f"SELECT 'goal' AS category, 'a' AS key, 'run' AS value, round(0.98::DOUBLE * round({_P} + 0.2::DOUBLE * (1 - {_P}), 6), 6) AS confidence, 2::BIGINT AS evidence UNION ALL SELECT 'belief', 'b', '', round(0.98::DOUBLE * 0.6::DOUBLE, 6), 1")
def _(s, d):
    """Beliefs after the answer, faded once."""
    return _applied(s, d)["beliefs"].select("category", "key", "value", "confidence", "evidence")


@query("compress_llm", f"WITH {SEL} SELECT wing, room, CASE WHEN count(*) % 2 = 0 THEN concat('of ', count(*)::VARCHAR) ELSE 'plain' END AS summary, CASE WHEN count(*) % 2 = 0 THEN 'llm' ELSE 'heuristic' END AS method FROM sel GROUP BY 1, 2")
def _(s, d):
    """A model that answers for groups of an even number; the others keep the fallback."""
    groups = jobs.compress_select(memories(s, d), NOW).groupBy("wing", "room").agg(F.count("*").alias("n"))
    texts = groups.select("wing", "room", F.col("n").cast("string").alias("text"))
    out = reflect.compress_llm(texts, lambda prompt, form: json.dumps({"summary": f"of {prompt}"}) if int(prompt) % 2 == 0 else "no JSON", groups.select("wing", "room", F.lit("plain").alias("summary")))
    return out.select("wing", "room", "summary", "method")


_AUDIT = """SELECT 'table' AS layer, (CASE WHEN count(*) > 0 THEN 20 ELSE 0 END)::BIGINT AS score FROM documents
UNION ALL SELECT 'vectors', (12 + CASE WHEN r >= 0.99 THEN 8 WHEN r >= 0.8 THEN 5 ELSE 0 END)::BIGINT FROM (SELECT (SELECT count(*) FROM embeddings)::DOUBLE / count(*) AS r FROM documents)
UNION ALL SELECT 'kg', ((CASE WHEN (SELECT count(*) FROM ent) > 0 THEN 10 ELSE 0 END) + greatest(0, 5 - 5 * (SELECT count(*) FROM (SELECT lower(name) FROM ent GROUP BY 1 HAVING count(DISTINCT type) > 1))))::BIGINT
UNION ALL SELECT 'scenes', (10 + CASE WHEN count(DISTINCT lang) > 1 THEN 10 ELSE 0 END)::BIGINT FROM documents
UNION ALL SELECT 'l1', floor(20 * avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))::BIGINT FROM ann"""


@query("memory_audit", f"WITH {ANN_SQL}, au AS ({_AUDIT}) SELECT layer, score, 20::BIGINT AS most, CASE WHEN score < 20 THEN concat(layer, ': ', score::VARCHAR, ' of 20') ELSE '' END AS finding FROM au UNION ALL SELECT 'total', sum(score)::BIGINT, 100, CASE WHEN sum(score) >= 90 THEN 'pass' ELSE 'fail' END FROM au")
def _(s, d):
    """Layer scores of the store with findings, and the total with its verdict."""
    m = memories(s, d)
    return jobs.audit(table(s, d, "embeddings"), ingest.annotate(m), ingest.extract_entities(m, "id", "content"))


@query("next_run", "WITH e AS (SELECT event_id, floor(epoch(ts))::BIGINT AS t FROM events) SELECT event_id, job, CASE job WHEN 'reflect' THEN floor((t + 28800 - 7200) / 86400)::BIGINT * 86400 + 86400 + 7200 - 28800 WHEN 'consolidate' THEN t + 14400 WHEN 'expire' THEN t + 21600 ELSE t + 86400 END AS next_run FROM e, (VALUES ('reflect'), ('consolidate'), ('compress'), ('persona'), ('expire')) j(job)")
def _(s, d):
    """For each time the next run of each job."""
    return jobs.next_runs(events(s, d).select("event_id", F.col("at").alias("now"))).select("event_id", "job", "next_run")


@query("belief_get", f"WITH RECURSIVE {BELIEF} SELECT category, key, value, confidence, evidence, conflicts FROM bl WHERE category = 'view' AND key = 7")
def _(s, d):
    return beliefs.belief_get(believed(s, d), "view", 7)


@query("belief_by_category", f"WITH RECURSIVE {BELIEF} SELECT category, key, value, confidence FROM bl WHERE category = 'purchase'")
def _(s, d):
    return beliefs.by_category(believed(s, d), "purchase").select("category", "key", "value", "confidence")


@query("conflict_history", f"WITH RECURSIVE {BELIEF}, h AS (SELECT f.category, f.key, f.n::BIGINT AS step, f.value AS old_value, e.value AS new_value, {JACCARD} AS sim FROM f JOIN e ON e.category = f.category AND e.key = f.key AND e.seq = f.seq + 1) SELECT category, key, step, old_value, new_value, round(sim, 3) AS similarity FROM h WHERE sim < 0.4 QUALIFY row_number() OVER (PARTITION BY category, key ORDER BY step DESC) <= 20")
def _(s, d):
    return beliefs.conflict_history(evidence(s, d))


@query("type_merge", f"WITH c AS (SELECT user_id AS name, {PARITY} AS type, count(*) AS n FROM events GROUP BY 1, 2) SELECT name, arg_max(type, (n, type)) AS type, count(*) AS n_types FROM c GROUP BY 1")
def _(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return graph.merge_types(events(s, d).select(F.col("user_id").alias("name"), F.when(k % 2 == 0, "even").otherwise("odd").alias("type")))


def _nations(s, d):
    return table(s, d, "nation").select(F.col("n_name").alias("name"), F.lit("location").alias("type"))


@query("entity_get", "SELECT n_name AS name, 'location' AS type FROM nation WHERE n_name IN ('NATION_3', 'NATION_9')")
def _(s, d):
    return graph.entity_get(_nations(s, d), s.createDataFrame([("NATION_3",), ("NATION_9",), ("nowhere",)], "name string"))


@query("entity_list", "SELECT n_name AS name FROM nation UNION SELECT s_name FROM supplier")
def _(s, d):
    return _nations(s, d).select("name").union(table(s, d, "supplier").select("s_name")).distinct()


@query("entity_delete", f"WITH {PLACE} SELECT 'entity' AS kind, n_name AS a, '' AS b FROM nation WHERE n_name NOT IN ('NATION_3', 'NATION_4') UNION ALL SELECT 'relation', subject, object FROM rel WHERE subject NOT IN ('NATION_3', 'NATION_4') AND object NOT IN ('NATION_3', 'NATION_4')")
def _(s, d):
    """Entities go with all relations that touch them."""
    names = s.createDataFrame([("NATION_3",), ("NATION_4",)], "name string")
    left, rel = graph.entity_delete(_nations(s, d), place_relations(s, d), names)
    return left.select(F.lit("entity").alias("kind"), F.col("name").alias("a"), F.lit("").alias("b")).union(rel.select(F.lit("relation"), "subject", "object"))


@query("relation_delete_pair", f"WITH {PLACE} SELECT subject, predicate, object FROM rel WHERE NOT (subject = 'NATION_1' AND object = 'NATION_2')")
def _(s, d):
    pairs = s.createDataFrame([("NATION_1", "NATION_2"), ("NATION_2", "NATION_1")], "s string, o string")
    return graph.relation_delete_pair(place_relations(s, d), pairs).select("subject", "predicate", "object")


@query("code_symbols", f"WITH c AS ({PAIR_SQL.format(c='p_type')}), s AS (SELECT DISTINCT p_brand AS file, p_type AS name FROM part) SELECT file, name, 'function' AS type, (SELECT count(*) FROM c WHERE object = name) AS n_callers, (SELECT count(*) FROM c WHERE subject = name) AS n_callees FROM s")
def _(s, d):
    """Types of parts as symbols that brands contain and that call those they share an order with."""
    part = table(s, d, "part")
    inside = part.select(F.col("p_brand").alias("subject"), F.lit("contains").alias("predicate"), F.col("p_type").alias("object")).distinct()
    calls = order_pairs(s, d, "p_type").select("subject", F.lit("calls").alias("predicate"), "object").distinct()
    return graph.symbols(part.select(F.col("p_type").alias("name"), F.lit("function").alias("type")).distinct(), inside.union(calls))
