"""Rules over names, queries, answers and rubrics: cleaning, scores, classes, noise, extraction by a model.

The driver's texts have no Han letters, so Han phrases are put before or into them by the row's id.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import sentences
from ..operators import entities, fusion, graph, plugins
from ..operators.evaluation import flatten_rubric
from ..operators.matching import match_names
from ..operators.setjoin import common_pairs, top_jaccard
from ..sources.tables import memories, place_relations, table
from .annotation import ANN_SQL, ENT_SQL
from .registry import query


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


def _pick(values, number):
    """The element whose place is a number's remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _pick_sql(values, number: str) -> str:
    return f"({_list(values)})[({number} % {len(values)} + 1)::INT]"


KINDS = list(names.TYPE_SUFFIXES)
CORES = ["张三", "李四老师", "王五", "北京市的天气", "清华大学", "智能管理系统", "数据平台", "市人民医院旁", "刘洋也", "方案", "杭州市西湖区", "腾讯公司的有限公司"]
ENDS = ["", "说", "表示同意", "觉得很好", "  ", "也"]


def _clean_sql() -> str:
    """names (id, name, type) -> cl (id, cleaned), step by step."""

    def prefixes(kind: str) -> str:
        out = "name"
        for _ in range(entities.NOISE_ROUNDS):
            safe = names.PRODUCT_PREFIXES if kind == "product" else []
            out = f"regexp_replace({out}, '(?s)^(?:{'|'.join(p for p in names.NOISE_PREFIXES if p not in safe)})(.{{2}})', '\\1')"
        return out

    verbs = " ".join(f"WHEN strpos(n, '{v}') > 0 AND length(n) > {len(v)} THEN CASE WHEN strpos(n, '{v}') > 1 THEN substr(n, 1, strpos(n, '{v}') - 1) ELSE n END" for v in sorted(names.PERSON_VERBS, key=len, reverse=True))

    def ends(kind: str) -> str:
        whens = ""
        for x in sorted(names.TYPE_SUFFIXES[kind], key=len, reverse=True):
            at = f"(length(n) - strpos(reverse(n), '{x[::-1]}') - {len(x)} + 2)"
            whens += f" WHEN regexp_matches(n, '(?s)^.+{x}') THEN concat(regexp_replace(substr(n, greatest(1, {at} - 8), least(8, {at} - 1)), '(?s)^.*[的在跟到去来]', ''), '{x}')"
        return f"WHEN '{kind}' THEN CASE{whens} ELSE n END"

    return f"""c1 AS (SELECT id, name, type, CASE type {' '.join(f"WHEN '{k}' THEN {prefixes(k)}" for k in KINDS)} END AS n FROM names),
c2 AS (SELECT id, name, type, CASE {verbs} ELSE n END AS n FROM c1), c3 AS (SELECT id, name, type, CASE WHEN type = 'person' THEN regexp_replace(n, '也$', '') ELSE n END AS n FROM c2),
cl AS (SELECT id, CASE WHEN type = 'person' AND name IN ({_list(names.NO_PERSONS)[1:-1]}) THEN '' WHEN NOT regexp_matches(name, '{names.HAN}') THEN name ELSE trim(CASE type {' '.join(map(ends, KINDS))} END) END AS cleaned FROM c3)"""


@query("entity_clean", f"""WITH {ENT_SQL}, names AS (SELECT doc_id AS id, concat({_pick_sql(names.NOISE_PREFIXES, 'doc_id')}, {_pick_sql(CORES, '(doc_id // 4)')}, {_pick_sql(ENDS, '(doc_id // 5)')}) AS name, {_pick_sql(KINDS, 'doc_id')} AS type FROM documents
UNION ALL SELECT -id - 1, name, type FROM ent), {_clean_sql()} SELECT id, cleaned FROM cl""")
def _(s, d):
    """Names with noise around them, one for each document, and the Latin names of the texts."""
    m, i = memories(s, d), F.col("id")
    han = m.select("id", F.concat(_pick(names.NOISE_PREFIXES, i), _pick(CORES, F.floor(i / 4)), _pick(ENDS, F.floor(i / 5))).alias("name"), _pick(KINDS, i).alias("type"))
    latin = entities.extract_entities(m, "id", "content").select((-i - 1).alias("id"), "name", "type")
    return han.union(latin).select("id", entities.clean_name(F.col("name"), F.col("type")).alias("cleaned"))


NAMES = ["张三", "李四老师", "北京市", "数据平台", "John Smith", "IBM", "赵局长"]
FRAMES = ["{n}说：{n}觉得很好。", "他和\n{n}去过上海\n", "{n}负责管理", "其中没有\n\n一个{n}：", "plain {n}: ", "我们\n他们在远处的很长很长很长很长很长很长很长很长很长很长很长很长很长很长很长很长很长很长很长很长很长很长很长的一行里看见{n}"]


def _score_sql() -> str:
    """named (id, name, type, freq, text) -> sc (id, confidence)."""

    def any_of(words) -> str:
        return "(" + " OR ".join(f"contains(text, concat(name, '{w}'))" for w in words) + ")"

    return f"""s1 AS (SELECT *, instr(text, name) AS p0, regexp_matches(text, '{names.HAN}') AS han FROM named), s2 AS (SELECT *, substr(text, 1, p0 - 1) AS pre, strpos(substr(text, p0), chr(10)) AS le FROM s1),
s3 AS (SELECT *, CASE WHEN strpos(pre, chr(10)) > 0 THEN greatest(0, length(pre) - strpos(reverse(pre), chr(10)) - 50) ELSE 0 END AS a, CASE WHEN le > 0 THEN least(length(text), p0 + le - 2 + 50) ELSE 49 END AS e FROM s2),
s4 AS (SELECT *, substr(text, a + 1, greatest(0, e - a)) AS win, type = 'person' AS p FROM s3),
sc AS (SELECT id, round(greatest(0.3::DOUBLE, least(0.99::DOUBLE, (CASE WHEN freq >= 3 THEN 0.15 WHEN freq = 2 THEN 0.08 ELSE 0 END)::DOUBLE + (CASE WHEN p AND (CASE WHEN han THEN {any_of(names.DIALOGUE)} ELSE {any_of(names.DIALOGUE[:2])} END) THEN 0.2 ELSE 0 END)::DOUBLE
+ (CASE WHEN p AND han AND {any_of(names.ACTIONS)} THEN 0.15 ELSE 0 END)::DOUBLE + (CASE WHEN p AND han AND p0 > 0 AND regexp_matches(win, '[{''.join(names.PRONOUNS)}]') THEN 0.1 ELSE 0 END)::DOUBLE
+ (CASE WHEN p AND regexp_matches(name, '^[{names.SURNAMES}]') THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN p AND contains(name, ' ') AND regexp_matches(name, '^[A-Z]') THEN 0.1 ELSE 0 END)::DOUBLE
+ (CASE WHEN type = 'org' AND regexp_matches(name, '[A-Z]') AND upper(name) = name THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN regexp_matches(name, '(?:{'|'.join(names.TITLES)})$') THEN 0.15 ELSE 0 END)::DOUBLE
+ (CASE WHEN p THEN 0.2 WHEN type IN ('org', 'location') THEN 0.15 ELSE 0.1 END)::DOUBLE)), 2) AS confidence FROM s4)"""


@query("entity_score", f"""WITH n0 AS (SELECT doc_id AS id, {_pick_sql(NAMES, 'doc_id')} AS name, {_pick_sql(KINDS, '(doc_id // 7)')} AS type, doc_id % 4 + 1 AS freq, text AS body FROM documents),
named AS (SELECT id, name, type, freq, concat(replace({_pick_sql(FRAMES, '(id // 3)')}, '{{n}}', name), body) AS text FROM n0), {_score_sql()} SELECT id, confidence FROM sc""")
def _(s, d):
    """All signals, over texts that name an entity; entity_score_en has the names that the texts hold themselves."""
    i = F.col("id")
    rows = memories(s, d).select("id", _pick(NAMES, i).alias("name"), _pick(KINDS, F.floor(i / 7)).alias("type"), (i % 4 + 1).alias("freq"), "content")
    text = F.concat(F.replace(_pick(FRAMES, F.floor(i / 3)), F.lit("{n}"), F.col("name")), F.col("content"))
    return rows.withColumn("text", text).select("id", entities.entity_score(F.col("name"), F.col("type"), F.col("freq"), F.col("text")).alias("confidence"))


#: Put before each sentence of a turn, by its place.
ASKED = ["", "", "上周 ", "为什么 ", "张三先生 ", "John Smith ", "how ", "一二三四五六七八九", "yesterday "]
_ASKED = f"""q0 AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[。！？；.!?\\n]'), lambda x: regexp_replace(x, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')), lambda x: x <> '') AS l FROM conversations),
q1 AS (SELECT conv_id, turn, unnest(l) AS body, generate_subscripts(l, 1) - 1 AS place FROM q0), q AS (SELECT conv_id, turn, place, concat({_pick_sql(ASKED, 'place')}, body) AS text FROM q1),
qu AS (SELECT *, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) + len(regexp_extract_all(text, '[一-鿿]')) AS u, regexp_matches(text, '{fusion.QUESTION}') AS ask, regexp_matches(text, '{fusion.ENTITY}') AS en FROM q),
cl AS (SELECT conv_id, turn, place, CASE WHEN regexp_matches(text, '{fusion.TEMPORAL}') THEN 'temporal' WHEN u BETWEEN 9 AND 15 AND NOT ask AND en THEN 'entity' WHEN u <= 15 AND NOT ask THEN 'keyword' WHEN u <= 8 AND en THEN 'entity' ELSE 'semantic' END AS class FROM qu)"""


def _asked(s, d):
    """The class of each sentence of the conversations, as a query."""
    t = table(s, d, "conversations").select("conv_id", "turn", F.posexplode(sentences(F.col("text"))).alias("place", "body"))
    query = F.concat(_pick(ASKED, F.col("place")), F.col("body"))
    return t.select("conv_id", "turn", F.col("place").cast("long").alias("place"), fusion.query_classify(query).alias("class"))


@query("query_classify", f"WITH {_ASKED} SELECT conv_id, turn, place, class FROM cl")
def _(s, d):
    return _asked(s, d)


@query("adaptive_weights", f"""WITH {_ASKED} SELECT conv_id, turn, place, CASE class WHEN 'semantic' THEN 1.3 WHEN 'keyword' THEN 0.7 ELSE 1.0 END::DOUBLE AS w_semantic, CASE class WHEN 'keyword' THEN 1.5 WHEN 'semantic' THEN 0.8 ELSE 1.0 END::DOUBLE AS w_bm25,
CASE class WHEN 'temporal' THEN 0.56 WHEN 'entity' THEN 1.2 ELSE 0.8 END::DOUBLE AS w_graph, CASE class WHEN 'temporal' THEN 0.96 WHEN 'entity' THEN 0.42 ELSE 0.6 END::DOUBLE AS w_temporal FROM cl""")
def _(s, d):
    return _asked(s, d).select("conv_id", "turn", "place", *[F.round(fusion.adaptive_weight(F.col("class"), c), 6).alias(f"w_{c}") for c in fusion.WEIGHTS])


_B = _list(names.GARBAGE)[1:-1]
_NOISE = f"(name IN ({_B}) OR length(name) < 2 OR (regexp_matches(name, '^\\p{{Nd}}') AND NOT regexp_matches(regexp_replace(name, '[.:]', '', 'g'), '^\\p{{Nd}}+$')) OR regexp_matches(name, '[=:条个种位]') OR (regexp_matches(name, '^[\\p{{L}}\\p{{N}}_\\s\\-.+()\\[\\]/]+$') AND len(list_filter(regexp_split_to_array(name, '[ \\t\\n\\r]+'), lambda w: w <> '')) <= 3))"
_FORMS = ["p_name", "concat(p_name, '=1')", "concat('三条', p_name)", "concat('10.0.0.', p_partkey::VARCHAR)", "concat(p_name, ' and its four words')", "concat('“', p_name, '”')", "concat(p_partkey::VARCHAR, 'th ”')", "'OK'", "'x'"]


def _forms(s, d):
    name, key = F.col("p_name"), F.col("p_partkey").cast("string")
    forms = [name, F.concat(name, F.lit("=1")), F.concat(F.lit("三条"), name), F.concat(F.lit("10.0.0."), key), F.concat(name, F.lit(" and its four words")), F.concat(F.lit("“"), name, F.lit("”")), F.concat(key, F.lit("th ”")), F.lit("OK"), F.lit("x")]
    return table(s, d, "part").select(F.explode(F.array(*forms)).alias("name")).distinct()


@query("kg_noise_predicate", f"WITH f AS (SELECT unnest([{', '.join(_FORMS)}]) AS name FROM part) SELECT DISTINCT name, {_NOISE} AS noise FROM f")
def _(s, d):
    """Part names in nine forms, that meet every rule."""
    return _forms(s, d).select("name", graph.is_noise(F.col("name")).alias("noise"))


_REL = "SELECT s_name AS subject, 'located_in' AS predicate, n_name AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, 'part_of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT a.n_name, 'cause', b.n_name FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1"
_KEEP = "SELECT n_name AS name FROM nation UNION ALL SELECT s_name FROM supplier WHERE s_acctbal >= 0"


@query("kg_noise_cleanup", f"WITH rel AS ({_REL}), bad AS (SELECT name FROM (SELECT subject AS name FROM rel UNION SELECT object FROM rel) WHERE {_NOISE} AND name NOT IN ({_KEEP})) SELECT subject, predicate, object FROM rel WHERE subject NOT IN (SELECT name FROM bad) AND object NOT IN (SELECT name FROM bad)")
def _(s, d):
    """Noise goes with its relations; nations and suppliers with a balance are kept by name."""
    rel = place_relations(s, d)
    ends = rel.select(F.col("subject").alias("name")).union(rel.select("object")).distinct()
    keep = table(s, d, "nation").select(F.col("n_name").alias("name")).union(table(s, d, "supplier").filter("s_acctbal >= 0").select("s_name"))
    _, left = graph.entity_delete(ends, rel, graph.noisy_entities(ends, keep))
    return left.select("subject", "predicate", "object")


def _rule_model(prompt: str, _format: dict) -> str:
    """A stand-in for a model: what it answers depends on the text's length alone."""
    (text,) = json.loads(prompt[prompt.index("\n[") + 1 :])
    n = len(text)
    if n % 5 == 0:
        raise TimeoutError
    return {1: f'```json\n{{"summary": "s{n}", "fact_type": "world"}}\n```', 2: '{"summary": "cut off', 3: "{}", 4: '{"summary": "", "entities": [{"name": "A", "type": "org"}, {"name": "B", "type": "person"}, {"name": "C"}], "confidence": 0.9, "fact_type": "opinion"}'}[n % 5]


_HEAD = "CASE WHEN length(text) <= 200 THEN text WHEN 200 - instr(reverse(substr(text, 1, 200)), chr(10)) > 100 AND instr(reverse(substr(text, 1, 200)), chr(10)) > 0 THEN substr(text, 1, 201 - instr(reverse(substr(text, 1, 200)), chr(10))) ELSE substr(text, 1, 200) END"


@query("llm_extract", f"""WITH {ANN_SQL}, x AS (SELECT *, length(text) % 5 AS m FROM ann) SELECT id, CASE WHEN m IN (0, 2) THEN least(20, n) WHEN m = 4 THEN 3 ELSE 0 END::BIGINT AS n_entities, CASE WHEN m = 1 THEN concat('s', length(text)) ELSE {_HEAD} END AS summary,
CASE m WHEN 1 THEN 'world' WHEN 3 THEN 'observation' WHEN 4 THEN 'opinion' ELSE fact_type END AS fact_type, CASE WHEN m IN (0, 2) THEN NULL WHEN m = 4 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence,
CASE WHEN m IN (0, 2) OR authority = 'critical' THEN authority WHEN m = 4 THEN 'high' ELSE 'medium' END AS authority,
CASE WHEN m IN (0, 2) THEN trust_score ELSE round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, (CASE m WHEN 1 THEN 0.9 WHEN 3 THEN 0.7 ELSE 0.5 END)::DOUBLE + (CASE m WHEN 4 THEN 3 * 0.03::DOUBLE ELSE 0.0 END)::DOUBLE + (CASE WHEN length(text) BETWEEN 50 AND 500 THEN 0.1 WHEN length(text) < 20 THEN -0.15 WHEN length(text) > 2000 THEN -0.05 ELSE 0.0 END)::DOUBLE)), 2) END AS trust_score,
CASE WHEN m IN (0, 2) THEN 'rules' ELSE 'model' END AS made_by FROM x""")
def _(s, d):
    """Extraction through the seam for models, with defaults and with rules where the model fails."""
    out = plugins.llm_extract(memories(s, d), _rule_model)
    return out.select("id", "n_entities", "summary", "fact_type", "confidence", "authority", "trust_score", "made_by")


@query("rubric_flatten", "SELECT doc_id AS id, unnest(CASE doc_id % 3 WHEN 0 THEN [text, lang] WHEN 1 THEN [text] ELSE [source, text] END) AS rubric FROM documents")
def _(s, d):
    """Three layouts of a rubric by the id: a list, a text, an object with a list."""
    i, quoted = F.col("doc_id"), F.to_json(F.array("text"))
    layout = F.when(i % 3 == 0, F.to_json(F.array("text", "lang"))).when(i % 3 == 1, F.expr("substring(q, 2, length(q) - 2)")).otherwise(F.to_json(F.struct(F.array("source", "text").alias("items"))))
    return table(s, d, "documents").withColumn("q", quoted).select(i.alias("id"), F.explode(flatten_rubric(layout)).alias("rubric"))


_SUP = "so AS (SELECT DISTINCT l_suppkey AS entity, l_orderkey AS mid FROM lineitem)"


def _supplied(s, d):
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("mid"))


@query("consolidate_link_orders", f"WITH {_SUP} SELECT a.entity AS a, b.entity AS b, count(*) AS n_common FROM so a JOIN so b ON a.mid = b.mid AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 2")
def _(s, d):
    """Suppliers that share at least two orders."""
    return common_pairs(_supplied(s, d), 2)


@query("similar_suppliers", f"WITH {_SUP}, dg AS (SELECT entity, count(*) AS n FROM so GROUP BY 1), sh AS (SELECT a.entity, b.entity AS other, count(*) AS c FROM so a JOIN so b ON a.mid = b.mid AND a.entity <> b.entity GROUP BY 1, 2), j AS (SELECT sh.entity, other, round(c / (x.n + y.n - c)::DOUBLE, 6) AS jaccard FROM sh JOIN dg x ON x.entity = sh.entity JOIN dg y ON y.entity = other) SELECT entity, other, jaccard, row_number() OVER (PARTITION BY entity ORDER BY jaccard DESC, other) - 1 AS rank FROM j QUALIFY rank < 5")
def _(s, d):
    """The five suppliers most alike by their orders."""
    return top_jaccard(_supplied(s, d), 5)


_WORD = "[a-zà-ÿ]{7,}"
_DICT = f"dict AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_WORD}')) AS name FROM benchmark UNION SELECT s_name FROM supplier UNION SELECT n_name FROM nation)"


@query("entity_match_texts", f"WITH {_DICT}, p AS (SELECT string_agg(lower(name), '|' ORDER BY length(name) DESC, name) AS p FROM dict), m AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(concat({_pick_sql(['Nation_1', 'SUPPLIER#000000001', 'nation_12'], 'doc_id')}, ' ', text)), p)) AS name FROM documents, p) SELECT id, name, count(*) AS n FROM m GROUP BY 1, 2")
def _(s, d):
    """Long words of the benchmark, suppliers and nations in all documents, by one automaton."""
    words = table(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({_WORD})"))).alias("name"))
    dictionary = words.union(table(s, d, "supplier").select("s_name")).union(table(s, d, "nation").select("n_name"))
    texts = memories(s, d).select("id", F.concat(_pick(["Nation_1", "SUPPLIER#000000001", "nation_12"], F.col("id")), F.lit(" "), F.col("content")).alias("text"))
    return match_names(texts, dictionary).groupBy("id", F.lower("name").alias("name")).agg(F.count("*").alias("n"))
