"""Graph, beliefs and batch jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import entity_density, sentences, stability_signal, summary_tokens
from ..operators import beliefs, graph, ingest, jobs
from ..sources.tables import EVENTS_NOW, NOW, brand_edges, events, memories, order_pairs, place_relations, table
from .annotation import ANN_SQL
from .registry import MEM, query

PAIR_SQL = "SELECT a.n AS subject, b.n AS object, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, {c} AS n FROM lineitem JOIN part ON l_partkey = p_partkey) a JOIN (SELECT DISTINCT l_orderkey, {c} AS n FROM lineitem JOIN part ON l_partkey = p_partkey) b ON a.l_orderkey = b.l_orderkey AND a.n < b.n GROUP BY 1, 2"
BRAND = f"pr AS ({PAIR_SQL.format(c='p_brand')}), rel AS (SELECT subject, 'co_occurs_with' AS predicate, object, weight::DOUBLE AS weight FROM pr), und AS (SELECT subject AS entity, object AS other, predicate FROM rel UNION ALL SELECT object, subject, predicate FROM rel)"
PLACE = "rel AS (SELECT s_name AS subject, 'located_in' AS predicate, n_name AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, 'part_of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT a.n_name, 'cause', b.n_name FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1), und AS (SELECT subject AS entity, object AS other, predicate FROM rel UNION ALL SELECT object, subject, predicate FROM rel)"
SIM = "nb AS (SELECT DISTINCT entity, other AS mid FROM und), dg AS (SELECT entity, count(*) AS degree FROM nb GROUP BY 1), sh AS (SELECT a.entity, b.entity AS other, count(*) AS shared FROM nb a JOIN nb b ON a.mid = b.mid AND a.entity <> b.entity GROUP BY 1, 2), sm AS (SELECT sh.entity, sh.other, round(shared / (x.degree + y.degree - shared)::DOUBLE, 6) AS jaccard FROM sh JOIN dg x ON x.entity = sh.entity JOIN dg y ON y.entity = sh.other), sk AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY jaccard DESC, other) - 1 AS rank FROM sm QUALIFY rank < 5)"


@query("entity_upsert", "SELECT name, min(type) AS type FROM (SELECT n_name AS name, 'location' AS type FROM nation UNION ALL SELECT r_name, 'location' FROM region UNION ALL SELECT s_name, 'org' FROM supplier) GROUP BY 1")
def _(s, d):
    n, r, p = table(s, d, "nation").select(F.col("n_name").alias("name"), F.lit("location").alias("type"), F.lit(0).alias("seq")), table(s, d, "region").select("r_name", F.lit("location"), F.lit(1)), table(s, d, "supplier").select("s_name", F.lit("org"), F.lit(2))
    return n.union(r).union(p).groupBy("name").agg(F.min_by("type", "seq").alias("type"))


@query("relation_add", f"WITH {PLACE} SELECT x.name, 'unknown' AS type FROM (SELECT subject AS name FROM rel UNION SELECT object FROM rel) x WHERE x.name NOT IN (SELECT n_name FROM nation)")
def _(s, d):
    """Endpoints that are not yet entities, created with type unknown."""
    rel = place_relations(s, d)
    ends = rel.select(F.col("subject").alias("name")).union(rel.select("object")).distinct()
    return ends.join(table(s, d, "nation").select(F.col("n_name").alias("name")), "name", "left_anti").select("name", F.lit("unknown").alias("type"))


@query("cooccurrence_edges", PAIR_SQL.format(c="p_type"))
def _(s, d):
    return order_pairs(s, d, "p_type").groupBy("subject", "object").agg(F.count("*").alias("weight"))


@query("relation_accumulate", f"SELECT subject, 'co_occurs_with' AS predicate, object, weight::DOUBLE AS weight FROM ({PAIR_SQL.format(c='p_brand')})")
def _(s, d):
    return graph.relation_accumulate(order_pairs(s, d, "p_brand").select("subject", F.lit("co_occurs_with").alias("predicate"), "object", F.lit(1.0).alias("weight")))


@query("relation_delete", f"WITH {PLACE} SELECT subject, predicate, object FROM rel WHERE subject <> 'NATION_3' AND object <> 'NATION_3'")
def _(s, d):
    gone = s.createDataFrame([("NATION_3",)], "name string")
    rel = place_relations(s, d).drop("weight")
    return rel.join(F.broadcast(gone.select(F.col("name").alias("subject"))), "subject", "left_anti").join(F.broadcast(gone.select(F.col("name").alias("object"))), "object", "left_anti").select("subject", "predicate", "object")


@query("relations_query", f"WITH {PLACE} SELECT entity, other, predicate FROM und WHERE entity = 'NATION_1' AND predicate = 'cause'")
def _(s, d):
    return graph.undirected(place_relations(s, d)).filter("entity = 'NATION_1' and predicate = 'cause'")


@query("neighbors", f"WITH {BRAND} SELECT DISTINCT entity, other, predicate FROM und WHERE entity <> other")
def _(s, d):
    return graph.neighbors(brand_edges(s, d))


@query("entity_context", f"WITH {PLACE} SELECT entity, count(*) AS n_relations, string_agg(DISTINCT other, ',' ORDER BY other) AS neighbors FROM und GROUP BY 1")
def _(s, d):
    return graph.undirected(place_relations(s, d)).groupBy("entity").agg(F.count("*").alias("n_relations"), F.array_join(F.sort_array(F.collect_set("other")), ",").alias("neighbors"))


@query("kg_query", f"WITH {PLACE} SELECT entity, count(*) FILTER (predicate NOT IN ('co_occurs_with', 'related_to')) AS n_semantic, count(*) FILTER (predicate IN ('co_occurs_with', 'related_to')) AS n_weak FROM und GROUP BY 1")
def _(s, d):
    weak = F.col("predicate").isin(graph.WEAK)
    return graph.undirected(place_relations(s, d)).groupBy("entity").agg(F.count_if(~weak).alias("n_semantic"), F.count_if(weak).alias("n_weak"))


@query("similar_entities", f"WITH {BRAND}, {SIM} SELECT entity, other, jaccard, rank FROM sk")
def _(s, d):
    return graph.similar_entities(brand_edges(s, d))


#: Steps from the table `seeds`: needs PLACE and SIM.
EXPAND = """near AS (SELECT seed, other AS node, 0.8::DOUBLE AS score, 'cooccurrence' AS type, 0 AS p FROM seeds JOIN und ON seed = entity),
c1 AS (SELECT DISTINCT seed, other AS mid FROM seeds JOIN und ON seed = entity WHERE predicate IN ('cause', 'effect', 'prevent', 'enable')), two AS (SELECT seed, other AS node, 0.21::DOUBLE AS score, 'causal' AS type, 1 AS p FROM c1 JOIN und ON mid = entity),
lk AS (SELECT seed, other AS node, jaccard * 0.6 AS score, 'semantic_knn' AS type, 2 AS p FROM seeds JOIN sk ON seed = entity), ev AS (SELECT * FROM near UNION ALL SELECT * FROM two UNION ALL SELECT * FROM lk),
ex AS (SELECT seed, node, round(score, 6) AS score, type FROM ev WHERE node <> seed QUALIFY row_number() OVER (PARTITION BY seed, node ORDER BY p, score DESC) = 1)"""


@query("graph_expand", f"WITH {PLACE}, {SIM}, seeds AS (SELECT n_name AS seed FROM nation), {EXPAND} SELECT seed, node, score, type FROM ex")
def _(s, d):
    return graph.graph_expand(place_relations(s, d), table(s, d, "nation").select(F.col("n_name").alias("seed")))


@query("hot_entities", f"SELECT user_id AS entity, count(*) AS n FROM events WHERE floor(epoch(ts))::BIGINT >= {EVENTS_NOW} - 72 * 3600 GROUP BY 1 HAVING count(*) >= 2")
def _(s, d):
    return events(s, d).filter(F.col("at") >= EVENTS_NOW - 72 * 3600).groupBy(F.col("user_id").alias("entity")).agg(F.count("*").alias("n")).filter("n >= 2")


PARITY = "CASE WHEN (props::JSON->>'k')::INT % 2 = 0 THEN 'even' ELSE 'odd' END"


@query("type_conflicts", f"WITH c AS (SELECT user_id AS entity, {PARITY} AS type, count(*) AS n FROM events GROUP BY 1, 2) SELECT entity, string_agg(type, ',' ORDER BY type) AS types, arg_max(type, (n, type)) AS best FROM c GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    c = events(s, d).groupBy(F.col("user_id").alias("entity"), F.when(k % 2 == 0, "even").otherwise("odd").alias("type")).agg(F.count("*").alias("n"))
    return c.groupBy("entity").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"), F.max_by("type", F.struct("n", "type")).alias("best"), F.count("*").alias("m")).filter("m > 1").drop("m")


@query("code_call_graph", f"WITH {PLACE} SELECT n_name AS symbol, (SELECT count(*) FROM rel WHERE predicate = 'cause' AND subject = n_name) AS n_callees, (SELECT count(*) FROM rel WHERE predicate = 'cause' AND object = n_name) AS n_callers FROM nation")
def _(s, d):
    """Directed in- and out-neighbours of one predicate, as for calls."""
    calls = place_relations(s, d).filter("predicate = 'cause'")
    ends = calls.select(F.col("subject").alias("symbol"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(calls.select("object", F.lit(0), F.lit(1))).union(table(s, d, "nation").select("n_name", F.lit(0), F.lit(0)))
    return ends.groupBy("symbol").agg(F.sum("o").alias("n_callees"), F.sum("i").alias("n_callers"))


@query("kg_stats", f"WITH {PLACE} SELECT predicate, count(*) AS n_relations, count(DISTINCT subject) AS n_subjects, count(DISTINCT object) AS n_objects FROM rel GROUP BY 1")
def _(s, d):
    return place_relations(s, d).groupBy("predicate").agg(F.count("*").alias("n_relations"), F.count_distinct("subject").alias("n_subjects"), F.count_distinct("object").alias("n_objects"))


@query("kg_load", f"WITH {PLACE} SELECT subject AS name FROM rel UNION SELECT object FROM rel")
def _(s, d):
    rel = place_relations(s, d)
    return rel.select(F.col("subject").alias("name")).union(rel.select("object")).distinct()


_VAL = "concat('bucket_', floor((props::JSON->>'k')::INT / 25)::INT::VARCHAR)"
_SET = "CASE WHEN length({0}) = 1 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) END"
JACCARD = f"len(list_intersect({_SET.format('f.value')}, {_SET.format('e.value')}))::DOUBLE / len(list_distinct(list_concat({_SET.format('f.value')}, {_SET.format('e.value')})))"
BELIEF = f"""e AS (SELECT event_type AS category, user_id AS key, {_VAL} AS value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS seq FROM events),
f AS (SELECT category, key, value, 0.6::DOUBLE AS c, 1 AS n, 0 AS x, 1::BIGINT AS seq FROM e WHERE seq = 1
UNION ALL SELECT category, key, CASE WHEN sim < 0.4 THEN (CASE WHEN x + 1 >= n / 2.0 THEN ev ELSE value END) WHEN sim < 0.9 THEN ev ELSE value END,
CASE WHEN sim < 0.4 THEN c * 0.15::DOUBLE / (c * 0.15::DOUBLE + (1 - c) * 0.85::DOUBLE + 1e-10::DOUBLE) ELSE least(1.0::DOUBLE, c * 0.85::DOUBLE / (c * 0.85::DOUBLE + (1 - c) * 0.15::DOUBLE + 1e-10::DOUBLE) + 0.1::DOUBLE * (1 - c * 0.85::DOUBLE / (c * 0.85::DOUBLE + (1 - c) * 0.15::DOUBLE + 1e-10::DOUBLE))) END,
n + 1, CASE WHEN sim < 0.4 THEN x + 1 ELSE x END, seq FROM (SELECT f.category, f.key, f.value, f.c, f.n, f.x, e.seq, e.value AS ev, {JACCARD} AS sim FROM f JOIN e ON e.category = f.category AND e.key = f.key AND e.seq = f.seq + 1)),
bl AS (SELECT category, key, value, round(c, 6) AS confidence, n::BIGINT AS evidence, x::BIGINT AS conflicts FROM f QUALIFY row_number() OVER (PARTITION BY category, key ORDER BY seq DESC) = 1)"""


def evidence(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return events(s, d).select(F.col("event_type").alias("category"), F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), F.concat(F.lit("bucket_"), F.floor(k / 25).cast("string")).alias("value"), F.lit(0.1).alias("delta"))


def believed(s, d):
    return beliefs.belief_fold(evidence(s, d))


@query("belief_upsert", f"WITH RECURSIVE {BELIEF} SELECT * FROM bl")
def _(s, d):
    return believed(s, d)


@query("belief_decay", f"WITH RECURSIVE {BELIEF} SELECT category, key, round(confidence * pow(0.95::DOUBLE, 40), 6) AS confidence FROM bl WHERE round(confidence * pow(0.95::DOUBLE, 40), 6) >= 0.1")
def _(s, d):
    return beliefs.belief_decay(believed(s, d), 0.95, 40).select("category", "key", "confidence")


@query("belief_strong", f"WITH RECURSIVE {BELIEF} SELECT category, key, confidence FROM bl WHERE confidence >= 0.7 ORDER BY confidence DESC, category, key LIMIT 20")
def _(s, d):
    return believed(s, d).filter("confidence >= 0.7").select("category", "key", "confidence").orderBy(F.desc("confidence"), "category", "key").limit(20)


@query("belief_query", f"WITH RECURSIVE {BELIEF} SELECT category, key, value FROM bl WHERE contains(lower(category), 'view') OR contains(lower(value), '_3')")
def _(s, d):
    return believed(s, d).filter(F.lower("category").contains("view") | F.lower("value").contains("_3")).select("category", "key", "value")


@query("belief_context", f"WITH RECURSIVE {BELIEF} SELECT category, key, concat(category, ':', key::VARCHAR, ' = ', value, ' (置信度: ', floor(confidence * 100 + 0.5)::INT::VARCHAR, '%)', CASE WHEN conflicts > 0 THEN ' [冲突]' ELSE '' END) AS line FROM bl WHERE confidence >= 0.6")
def _(s, d):
    line = F.concat("category", F.lit(":"), F.col("key").cast("string"), F.lit(" = "), "value", F.lit(" (置信度: "), F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("%)"), F.when(F.col("conflicts") > 0, " [冲突]").otherwise(""))
    return believed(s, d).filter("confidence >= 0.6").select("category", "key", line.alias("line"))


@query("belief_stats", f"WITH RECURSIVE {BELIEF} SELECT category, count(*) AS n, round(avg(confidence), 3) AS mean, count(*) FILTER (conflicts > 0) AS conflicted FROM bl GROUP BY 1")
def _(s, d):
    return believed(s, d).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("mean"), F.count_if(F.col("conflicts") > 0).alias("conflicted"))


@query("belief_evict", f"WITH RECURSIVE {BELIEF} SELECT category, key, confidence FROM bl ORDER BY confidence DESC, category, key LIMIT 100")
def _(s, d):
    return believed(s, d).select("category", "key", "confidence").orderBy(F.desc("confidence"), "category", "key").limit(100)


@query("bigram_jaccard", f"SELECT DISTINCT f.value AS a, e.value AS b, round({JACCARD}, 6) AS sim FROM (SELECT DISTINCT {_VAL} AS value FROM events) f, (SELECT DISTINCT event_type AS value FROM events) e")
def _(s, d):
    from ..functions.text import bigram_set, set_jaccard

    a, b = evidence(s, d).select(F.col("value").alias("a")).distinct(), events(s, d).select(F.col("event_type").alias("b")).distinct()
    return a.join(F.broadcast(b)).select("a", "b", F.round(set_jaccard(bigram_set(F.col("a")), bigram_set(F.col("b"))), 6).alias("sim"))  # five types


SEL = f"{MEM}, old AS (SELECT *, count(*) OVER (PARTITION BY wing, room) AS n FROM memories WHERE created_at < {NOW} - 7 * 86400), sel AS (SELECT * FROM old WHERE n >= 3)"


@query("compress_select", f"WITH {SEL} SELECT id, wing, room, n FROM sel")
def _(s, d):
    return jobs.compress_select(memories(s, d), NOW).select("id", "wing", "room", "n")


@query("compress_select_limit", f"WITH {MEM}, old AS (SELECT * FROM memories WHERE created_at < {NOW} - 7 * 86400 ORDER BY wing, room, created_at, id LIMIT 50), g AS (SELECT *, count(*) OVER (PARTITION BY wing, room) AS n FROM old) SELECT id, n FROM g WHERE n >= 3")
def _(s, d):
    return jobs.compress_select(memories(s, d), NOW, limit=50).select("id", "n")


@query("compress_retention", f"WITH {SEL}, r AS (SELECT *, row_number() OVER (PARTITION BY wing, room ORDER BY created_at DESC, id DESC) AS k FROM sel) SELECT id, k <= greatest(1, floor(n * 0.2)) AS keep FROM r")
def _(s, d):
    sel = jobs.compress_select(memories(s, d), NOW)
    k = F.row_number().over(Window.partitionBy("wing", "room").orderBy(F.desc("created_at"), F.desc("id")))
    return sel.select("id", (k <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.2))).alias("keep"))


@query("compress_record", f"WITH {SEL} SELECT wing, room, count(*) AS source_count, min(created_at) AS t0, max(created_at) AS t1, md5(string_agg(id::VARCHAR, ',' ORDER BY id)) AS ids FROM sel GROUP BY 1, 2")
def _(s, d):
    sel = jobs.compress_select(memories(s, d), NOW)
    return sel.groupBy("wing", "room").agg(F.count("*").alias("source_count"), F.min("created_at").alias("t0"), F.max("created_at").alias("t1"), F.md5(F.array_join(F.sort_array(F.collect_list("id")), ",").cast("binary")).alias("ids"))


_SENT = r"list_filter(list_transform(regexp_split_to_array(text, '[。！？；.!?;]\s*'), lambda x: regexp_replace(x, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')), lambda x: x <> '')"


@query("sentence_split", f"SELECT doc_id AS id, len({_SENT}) AS n, list_sum(list_transform({_SENT}, lambda x: length(x)))::BIGINT AS chars FROM documents")
def _(s, d):
    x = sentences(F.col("content"))
    return memories(s, d).select("id", F.size(x).cast("long").alias("n"), F.nullif(F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + F.length(v)), F.lit(0)).alias("chars"))


@query("summary_tokens", r"SELECT doc_id AS id, len(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: x <> '')) AS n FROM documents")
def _(s, d):
    return memories(s, d).select("id", F.size(summary_tokens(F.col("content"))).cast("long").alias("n"))


@query("entity_density", r"SELECT doc_id AS id, round(least(1.0::DOUBLE, (len(regexp_extract_all(text, '[0-9]+')) + len(regexp_extract_all(text, '元|块|万|亿|￥|¥|\$'))) / 5.0::DOUBLE), 6) AS density FROM documents")
def _(s, d):
    return memories(s, d).select("id", F.round(entity_density(F.col("content")), 6).alias("density"))


def summary_sql(rows: str, by: str, shortest: int, w: tuple, signal: str, top: int, most: int) -> str:
    return f"""src AS ({rows}), sx AS (SELECT {by}, id, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS k FROM src), s1 AS (SELECT {by}, s, row_number() OVER (PARTITION BY {by} ORDER BY id, k) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM sx WHERE length(s) >= {shortest}),
tk AS (SELECT {by}, i, n, unnest(list_filter(regexp_split_to_array(lower(s), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS term FROM s1), tf AS (SELECT {by}, i, n, term, count(*) AS tf FROM tk GROUP BY ALL), df AS (SELECT {by}, term, count(*) AS df FROM tf GROUP BY ALL),
ti AS (SELECT {by}, i, sum(tf * (ln((n + 1) / (df + 1)::DOUBLE) + 1)) / sum(tf) AS tfidf FROM tf JOIN df USING ({by}, term) GROUP BY {by}, i),
sc AS (SELECT s1.*, {signal} AS sig, round({w[0]}::DOUBLE * coalesce(tfidf, 0) + {w[1]}::DOUBLE * (1 - 0.3::DOUBLE * i / n) + {w[2]}::DOUBLE * {signal}, 9) AS score FROM s1 LEFT JOIN ti USING ({by}, i)),
rk AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, i) AS r FROM sc QUALIFY r <= {top}), jn AS (SELECT {by}, string_agg(s, '；' ORDER BY i) AS j, max(n) AS n_sent, avg(sig) FILTER (r <= 5) AS sig FROM rk GROUP BY {by}),
sm AS (SELECT {by}, CASE WHEN length(j) > {most} THEN concat(substr(j, 1, {most - 3}), '...') ELSE j END AS summary, n_sent, sig FROM jn)"""


_DENS = r"least(1.0::DOUBLE, (len(regexp_extract_all(s, '[0-9]+')) + len(regexp_extract_all(s, '元|块|万|亿|￥|¥|\$'))) / 5.0::DOUBLE)"


@query("extractive_summary", f"WITH {summary_sql('SELECT lang AS wing, source AS room, doc_id AS id, text FROM documents', 'wing, room', 5, (0.5, 0.2, 0.3), _DENS, 10, 300)} SELECT wing, room, summary, n_sent FROM sm")
def _(s, d):
    return jobs.extractive_summary(memories(s, d), ["wing", "room"])


TOPIC = "CASE WHEN regexp_matches(text, '编程|代码|Python|开发|架构|算法') THEN '编程' WHEN regexp_matches(text, 'GEF') THEN '林草' WHEN regexp_matches(text, 'AI|Agent|LLM') THEN 'AI' ELSE 'general' END"


@query("persona_topic", f"SELECT doc_id AS id, {TOPIC} AS topic FROM documents")
def _(s, d):
    return memories(s, d).select("id", jobs.persona_topic(F.col("content")).alias("topic"))


@query("persona_upsert", f"WITH t AS (SELECT {TOPIC} AS topic, doc_id AS id FROM documents) SELECT topic, max(id) AS last_id, count(*) AS evidence, max(1704067200 + id * 3600) + 90 * 86400 AS expires_at FROM t GROUP BY 1")
def _(s, d):
    m = memories(s, d).withColumn("topic", jobs.persona_topic(F.col("content")))
    return m.groupBy("topic").agg(F.max("id").alias("last_id"), F.count("*").alias("evidence"), (F.max("created_at") + 90 * 86400).alias("expires_at"))


_NB = "names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT concat(n_name, ' x') FROM nation), g AS (SELECT name, list_distinct(list_transform(range(1, length(name)), lambda i: substr(lower(trim(name)), i, 2))) AS g FROM names), pr AS (SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS sim FROM g a JOIN g b ON a.name < b.name)"


def _names(s, d):
    return table(s, d, "part").select(F.col("p_name").alias("name")).union(table(s, d, "nation").select(F.concat("n_name", F.lit(" x")))).distinct()


@query("consolidate_dedup", f"WITH {_NB} SELECT a, b, sim FROM pr WHERE sim >= 0.85")
def _(s, d):
    return graph.name_pairs(_names(s, d), 0.85)


@query("consolidate_merge", f"WITH {_NB} SELECT a, b, sim FROM pr WHERE sim >= 0.7 AND sim < 0.85")
def _(s, d):
    return graph.name_pairs(_names(s, d), 0.7, 0.85)


@query("relation_redirect", f"WITH {BRAND}, m AS (SELECT p_brand AS old, min(p_brand) OVER (PARTITION BY substr(p_brand, 1, 7)) AS new FROM (SELECT DISTINCT p_brand FROM part)) SELECT x.new AS subject, predicate, y.new AS object, sum(weight) AS weight FROM rel JOIN m x ON x.old = subject JOIN m y ON y.old = object WHERE x.new <> y.new GROUP BY 1, 2, 3")
def _(s, d):
    b = table(s, d, "part").select(F.col("p_brand").alias("old")).distinct()
    return graph.redirect(brand_edges(s, d), b.withColumn("new", F.min("old").over(Window.partitionBy(F.substring("old", 1, 7)))))


_LINK = "nb AS (SELECT DISTINCT entity, other AS mid FROM und), lk AS (SELECT a.entity AS a, b.entity AS b, count(*) AS n_common FROM nb a JOIN nb b ON a.mid = b.mid AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 2), link AS (SELECT lk.* FROM lk ANTI JOIN (SELECT entity AS a, other AS b FROM und) x USING (a, b))"


@query("consolidate_link", f"WITH {BRAND}, {_LINK} SELECT a, b, n_common FROM link")
def _(s, d):
    return graph.consolidate_link(brand_edges(s, d))


@query("consolidate_upgrade", f"WITH {PLACE} SELECT entity, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'knowledge' ELSE 'unknown' END AS type FROM und GROUP BY 1")
def _(s, d):
    return graph.undirected(place_relations(s, d)).groupBy("entity").agg(F.count("*").alias("n")).select("entity", "n", F.when(F.col("n") >= 3, "knowledge").otherwise("unknown").alias("type"))


@query("evidence_chain", f"WITH {BRAND}, {_LINK}, {_NB.replace('pr AS', 'np AS')} SELECT 'link' AS strategy, a AS entity_a, b AS entity_b, n_common::DOUBLE AS similarity FROM link UNION ALL SELECT 'dedup', a, b, sim FROM np WHERE sim >= 0.85")
def _(s, d):
    link = graph.consolidate_link(brand_edges(s, d)).select(F.lit("link").alias("strategy"), F.col("a").alias("entity_a"), F.col("b").alias("entity_b"), F.col("n_common").cast("double").alias("similarity"))
    return link.union(graph.name_pairs(_names(s, d), 0.85).select(F.lit("dedup"), "a", "b", "sim"))
