"""Ingest, annotation, scenes, registry and conversation shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import entities, ingest
from ..sources.tables import memories, table
from .registry import MEM, query

_PERSON, _ORG = r"[A-Z][a-z]+(?:[ \t\n]+[A-Z][a-z]+)*", "[A-Z]{2,}(?:-[A-Z]+)*"
_G = ", ".join(f"'{g}'" for g in names.GENERIC)
_B = ", ".join(f"'{g}'" for g in names.GARBAGE)
ENT_SQL = f"""r AS (SELECT doc_id AS id, 0 AS part, unnest(regexp_extract_all(text, '{_PERSON}')) AS name, generate_subscripts(regexp_extract_all(text, '{_PERSON}'), 1) AS k, len(regexp_extract_all(text, '{_PERSON}')) AS np, 'person' AS type FROM documents
UNION ALL SELECT doc_id, 1, unnest(regexp_extract_all(text, '{_ORG}')), generate_subscripts(regexp_extract_all(text, '{_ORG}'), 1), len(regexp_extract_all(text, '{_PERSON}')), 'org' FROM documents),
f AS (SELECT id, name, type, (CASE part WHEN 0 THEN k - 1 ELSE np + k - 1 END)::BIGINT AS ap FROM r WHERE length(name) >= 2 AND name NOT IN ({_B}) AND lower(name) NOT IN ({_G}) AND (contains(name, ' ') OR (upper(name) = name AND length(name) >= 3) OR length(name) > 4)),
ent AS (SELECT id, arg_min(name, ap) AS name, arg_min(type, ap) AS type, count(*) AS freq, min(ap) AS pos FROM f GROUP BY id, lower(name))"""


@query("entity_extract_en", f"WITH {ENT_SQL} SELECT id, name, type, freq, pos FROM ent")
def _(s, d):
    return ingest.extract_entities(memories(s, d), "id", "content")


@query("entity_score_en", f"""WITH {ENT_SQL} SELECT id, name, round(greatest(0.3::DOUBLE, least(0.99::DOUBLE, (CASE WHEN freq >= 3 THEN 0.15 WHEN freq >= 2 THEN 0.08 ELSE 0.0 END)::DOUBLE + (CASE WHEN type = 'person' AND contains(text, concat(name, ':')) THEN 0.2 ELSE 0.0 END)::DOUBLE
+ (CASE type WHEN 'person' THEN 0.2 ELSE 0.15 END)::DOUBLE + (CASE WHEN type = 'person' AND contains(name, ' ') THEN 0.1 ELSE 0.0 END)::DOUBLE + (CASE WHEN type = 'org' AND upper(name) = name THEN 0.1 ELSE 0.0 END)::DOUBLE)), 2) AS confidence FROM ent JOIN documents ON doc_id = id""")
def _(s, d):
    return entities.score_entities(memories(s, d), "id", "content").select("id", "name", "confidence")


#: Literal texts, and the entities that the patterns, filters and cleaning leave of them: (name, type, freq, confidence).
HAN_TEXTS = {
    1: "张三说他喜欢北京市的天气，李四老师也在清华大学工作",
    2: "我们在上海市讨论了智能管理系统，王五表示同意",
    3: "赵局长和陈医生去了人民医院",
    4: "今天用户参加了数据平台的开发，刘洋也去了杭州市西湖区",
    5: "腾讯公司发布了微信APP，腾讯公司宣布合作",
    6: "方案已经完成",
    7: "周杰说：周杰觉得周杰喜欢音乐，他很满意",
}
HAN_ENTITIES = [
    (1, "张三", "person", 1, 0.6), (1, "李四老师", "person", 1, 0.55), (1, "清华大学", "org", 1, 0.3), (1, "张三说他", "location", 1, 0.3),
    (2, "王五", "person", 1, 0.5), (2, "上海市", "location", 1, 0.3), (3, "赵局长", "person", 1, 0.45),
    (4, "刘洋", "person", 1, 0.3), (4, "了杭州市", "location", 1, 0.3), (5, "腾讯公司", "org", 2, 0.3), (7, "周杰", "person", 4, 0.75),
]


def _han(s):
    return s.createDataFrame(list(HAN_TEXTS.items()), "id long, content string")


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


@query("entity_extract", f"WITH {ENT_SQL} SELECT id, name, type, freq FROM ent UNION ALL SELECT -id, name, type, freq FROM {_values(r[:4] for r in HAN_ENTITIES)} v(id, name, type, freq)")
def _(s, d):
    """All patterns, Han and Latin: over the documents, and over literal texts under negative ids."""
    texts = memories(s, d).select("id", "content").union(_han(s).select(-F.col("id"), "content"))
    return entities.extract_entities(texts, "id", "content").select("id", "name", "type", "freq")


@query("garbage_entity_filter", f"WITH {ENT_SQL} SELECT count(*) AS n FROM ent WHERE name NOT IN ({_B})")
def _(s, d):
    bad = s.createDataFrame([(g,) for g in names.GARBAGE], "name string")
    return ingest.extract_entities(memories(s, d), "id", "content").join(F.broadcast(bad), "name", "left_anti").agg(F.count("*").alias("n"))


REG_SQL = f"{ENT_SQL}, reg AS (SELECT name, arg_max(type, (id, pos)) AS type, sum(freq)::BIGINT AS count, CASE WHEN sum(freq) >= 3 THEN 'confirmed' ELSE 'candidate' END AS state FROM ent GROUP BY name)"


def _registry(s, d):
    return ingest.registry_count(ingest.extract_entities(memories(s, d), "id", "content"))


@query("registry_count", f"WITH {REG_SQL} SELECT * FROM reg")
def _(s, d):
    return _registry(s, d)


@query("registry_stats", f"WITH {REG_SQL} SELECT state, count(*) AS n FROM reg GROUP BY 1")
def _(s, d):
    return _registry(s, d).groupBy("state").agg(F.count("*").alias("n"))


@query("registry_decisions", f"WITH {REG_SQL} SELECT name, CASE WHEN length(name) > 20 THEN 'rejected' WHEN length(name) = 8 THEN 'confirmed' ELSE state END AS state FROM reg")
def _(s, d):
    """Manual confirmations and rejections laid over the counted states."""
    r = _registry(s, d)
    decided = r.select("name", F.when(F.length("name") > 20, "rejected").when(F.length("name") == 8, "confirmed").alias("decision")).filter("decision is not null")
    return r.join(decided, "name", "left").select("name", F.coalesce("decision", "state").alias("state"))


@query("registry_filter", f"WITH {REG_SQL} SELECT ent.id, ent.name FROM ent JOIN reg USING (name) WHERE reg.state = 'confirmed'")
def _(s, d):
    e = ingest.extract_entities(memories(s, d), "id", "content")
    return e.join(ingest.registry_count(e).filter("state = 'confirmed'").select("name"), "name", "left_semi").select("id", "name")


_CJK = [(1, "因为下雨所以路滑"), (2, "我去过北京"), (3, "我喜欢Python"), (4, "今天天气很好"), (5, "plain words"), (6, "系统的结构和功能")]


def _fact_sql(c: str) -> str:
    n = {k: " + ".join(f"(CASE WHEN contains({c}, '{w}') THEN 1 ELSE 0 END)" for w in ws) for k, ws in ingest.FACT_TYPES.items()}
    most = f"greatest({', '.join(n.values())})"
    return "CASE " + " ".join(f"WHEN ({n[k]}) = {most} THEN '{k}'" for k in ingest.FACT_TYPES) + " END"


_V = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _CJK) + ") v(id, text)"
_OWN = " OR ".join(f"contains(text, '{p}')" for p in ingest.FIRST_PERSON)
ANN_SQL = f"""{ENT_SQL}, en AS (SELECT id, least(20, count(*)) AS n, arg_min(name, pos) AS first FROM ent GROUP BY id),
ft AS (SELECT doc_id AS id, text, coalesce(n, 0) AS n, coalesce(first, 'general') AS scene, {_fact_sql('text')} AS fact_type FROM documents LEFT JOIN en ON id = doc_id),
ann AS (SELECT *, CASE WHEN {_OWN} THEN 'critical' WHEN (fact_type = 'world' AND n >= 1) OR n >= 3 OR fact_type = 'experience' THEN 'high' WHEN n < 1 AND fact_type = 'opinion' THEN 'low' ELSE 'medium' END AS authority,
round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, (CASE fact_type WHEN 'world' THEN 0.9 WHEN 'observation' THEN 0.7 WHEN 'experience' THEN 0.8 WHEN 'opinion' THEN 0.5 ELSE 0.6 END)::DOUBLE + least(0.15::DOUBLE, n * 0.03::DOUBLE) + (CASE WHEN length(text) BETWEEN 50 AND 500 THEN 0.1 WHEN length(text) < 20 THEN -0.15 WHEN length(text) > 2000 THEN -0.05 ELSE 0.0 END)::DOUBLE)), 2) AS trust_score FROM ft)"""


def _annotated(s, d):
    return ingest.annotate(memories(s, d))


@query("fact_type", f"SELECT id, {_fact_sql('text')} AS fact_type FROM {_V} UNION ALL SELECT doc_id + 100, {_fact_sql('text')} FROM documents")
def _(s, d):
    rows = s.createDataFrame(_CJK, "id long, content string").union(memories(s, d).select(F.col("id") + 100, "content"))
    return rows.select("id", ingest.fact_type(F.col("content")).alias("fact_type"))


@query("authority", f"WITH {ANN_SQL} SELECT id, authority FROM ann")
def _(s, d):
    return _annotated(s, d).select("id", "authority")


@query("trust_score", f"WITH {ANN_SQL} SELECT id, trust_score FROM ann")
def _(s, d):
    return _annotated(s, d).select("id", "trust_score")


@query("l1_annotations", f"WITH {ANN_SQL} SELECT id, n AS n_entities, scene, fact_type, authority, trust_score FROM ann")
def _(s, d):
    return _annotated(s, d).select("id", F.col("n_entities").cast("long").alias("n_entities"), "scene", "fact_type", "authority", "trust_score")


_HEAD = "CASE WHEN length(text) <= 200 THEN text WHEN 200 - instr(reverse(substr(text, 1, 200)), chr(10)) > 100 AND instr(reverse(substr(text, 1, 200)), chr(10)) > 0 THEN substr(text, 1, 201 - instr(reverse(substr(text, 1, 200)), chr(10))) ELSE substr(text, 1, 200) END"


@query("summary_head", f"SELECT doc_id AS id, {_HEAD} AS summary FROM documents")
def _(s, d):
    return memories(s, d).select("id", ingest.summary_head(F.col("content")).alias("summary"))


@query("scene_assign", f"WITH {ANN_SQL} SELECT scene AS name, count(*) AS n_memories, min(1704067200 + id * 3600) AS time_start, max(1704067200 + id * 3600) AS time_end FROM ann GROUP BY 1")
def _(s, d):
    return _annotated(s, d).groupBy(F.col("scene").alias("name")).agg(F.count("*").alias("n_memories"), F.min("created_at").alias("time_start"), F.max("created_at").alias("time_end"))


@query("scene_timeline", "SELECT source AS scene, min(CASE WHEN lang = 'en' THEN 1704067200 + doc_id * 3600 END) AS time_start, max(1704067200 + doc_id * 3600) AS time_end FROM documents GROUP BY 1")
def _(s, d):
    return memories(s, d).groupBy(F.col("room").alias("scene")).agg(F.min(F.when(F.col("wing") == "en", F.col("created_at"))).alias("time_start"), F.max("created_at").alias("time_end"))


_SHORT = _HEAD.replace("200", "80").replace("201", "81").replace("> 100", "> 40")


@query("scene_summary_append", f"WITH h AS (SELECT source AS scene, doc_id AS id, {_SHORT} AS summary FROM documents) SELECT scene, list_reduce(list_prepend('', list(summary ORDER BY id)), lambda acc, x: CASE WHEN contains(acc, x) THEN acc WHEN acc = '' THEN substr(x, 1, 5000) ELSE substr(concat(acc, chr(10), x), 1, 5000) END) AS summary FROM h GROUP BY scene")
def _(s, d):
    m = memories(s, d).select(F.col("room").alias("scene"), "id", ingest.summary_head(F.col("content"), 80).alias("summary"))
    return ingest.scene_summary(m)


@query("scene_tree", f"WITH {MEM}, sc AS (SELECT wing, room, max(created_at) AS updated_at FROM memories GROUP BY 1, 2) SELECT sc.wing, sc.room, count(m.id) AS n, string_agg(m.id::VARCHAR, ',' ORDER BY m.id) FILTER (r <= 10) AS first FROM sc LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY wing, room ORDER BY id) AS r FROM memories) m ON m.wing = sc.wing AND m.room = sc.room GROUP BY 1, 2")
def _(s, d):
    from pyspark.sql import Window

    m = memories(s, d)
    scenes = m.select("wing", "room").distinct()
    count = m.groupBy("wing", "room").agg(F.count("*").alias("n"))
    part = Window.partitionBy("wing", "room", F.pmod(F.xxhash64("id"), F.lit(8))).orderBy("id")
    few = m.select("wing", "room", "id", F.row_number().over(part).alias("r")).filter("r <= 10")
    ten = few.groupBy("wing", "room").agg(F.array_join(F.slice(F.sort_array(F.collect_list("id")), 1, 10), ",").alias("first"))
    return scenes.join(count, ["wing", "room"], "left").join(ten, ["wing", "room"], "left")


@query("scene_merge", "SELECT CASE WHEN source = 'src2' THEN 'src1' ELSE source END AS scene, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    merged = F.when(F.col("room") == "src2", "src1").otherwise(F.col("room"))
    return memories(s, d).groupBy(merged.alias("scene")).agg(F.count("*").alias("n"))


@query("extract_merge", f"WITH {ENT_SQL} SELECT source AS batch, count(*) AS n_entities, min(1704067200 + id * 3600) AS start_at, max(1704067200 + id * 3600) AS end_at FROM ent JOIN documents ON doc_id = id GROUP BY 1")
def _(s, d):
    m = memories(s, d)
    e = ingest.extract_entities(m, "id", "content").join(m.select("id", "room", "created_at"), "id")
    return e.groupBy(F.col("room").alias("batch")).agg(F.count("*").alias("n_entities"), F.min("created_at").alias("start_at"), F.max("created_at").alias("end_at"))


CLEAN = [(1, "keep\n<tool_call>\nhidden\n```\nalso"), (2, "plain"), (3, "```tool\nx\n```\n"), (4, " a \nb")]


@query("clean_llm_response", "SELECT * FROM (VALUES (1, 'keep' || chr(10) || 'also'), (2, 'plain'), (3, ''), (4, 'a ' || chr(10) || 'b')) v(id, text) UNION ALL SELECT conv_id * 100 + turn + 1000, regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') FROM conversations")
def _(s, d):
    rows = s.createDataFrame(CLEAN, "id long, text string").union(table(s, d, "conversations").select(F.col("conv_id") * 100 + F.col("turn") + 1000, "text"))
    return rows.select("id", ingest.clean_llm_response(F.col("text")).alias("text"))


_CH = "c AS (SELECT *, floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 2)::BIGINT AS chunk FROM conversations WHERE trim(coalesce(text, '')) <> '')"


@query("chunk_turns", f"WITH {_CH} SELECT conv_id, chunk, string_agg(concat('[', role, ']: ', text, chr(10)), '' ORDER BY turn) AS text, count(*) AS n_turns FROM c GROUP BY 1, 2")
def _(s, d):
    return ingest.chunk_turns(table(s, d, "conversations"))


@query("turn_format", "SELECT conv_id, turn, concat('[', role, ']: ', text, chr(10)) AS line FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("["), "role", F.lit("]: "), "text", F.lit("\n")).alias("line"))


@query("retain_every_n", "WITH c AS (SELECT conv_id, count(*) OVER w AS emitted, (sum(length(text)) OVER w)::BIGINT AS n_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) SELECT * FROM c WHERE emitted % 2 = 0")
def _(s, d):
    return ingest.retain_every_n(table(s, d, "conversations"), 2)


@query("time_anchor", "SELECT user_id, min(floor(epoch(ts))::BIGINT) AS anchor FROM events WHERE event_type = 'signup' GROUP BY 1")
def _(s, d):
    """The first anchor that parses as a time."""
    e = table(s, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("ts").cast("string")).otherwise("no date").alias("anchor"))
    t = F.unix_timestamp(F.try_to_timestamp("anchor"))
    return e.select("user_id", t.alias("at")).filter("at is not null").groupBy("user_id").agg(F.min("at").alias("anchor"))
