"""Retrieval channels, fusion, reranking and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.embed import hash_embedding, l2_normalize
from ..functions.text import trigram_similarity
from ..operators import fusion, graph, plugins, search
from ..sources.log import Folder
from ..sources.store import shared_folder
from ..sources.tables import NOW, memories, place_relations, table
from ..sources.text_index import TextIndex
from ..sources.vector_index import VectorIndex
from .knowledge import EXPAND, PLACE, SIM
from .registry import MEM, query

TERMS = ["license", "ouelle", "there"]
START, END = 1_704_412_800, 1_707_523_200  # 2024-01-05 to 2024-02-10
TEXTS = ["", "notes from last week", "Chicago", "John Smith", "memory management", "one two three four five six seven John Smith", "how John Smith", "why does the service restart", "license there", "plain words without any question that go on and on for a long while so the rule is the default one"]


def _values(texts, names):
    return "(VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in t) + ")" for t in texts) + f") {names}"


def _bm25_sql(terms: list[str], tail: str, where: str = "true") -> str:
    f = ", ".join("(" + " + ".join(f"(length(lower({c})) - length(replace(lower({c}), '{t}', ''))) / {len(t)}" for c in ("content", "wing", "room")) + f")::DOUBLE AS f{i}" for i, t in enumerate(terms))
    n = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))
    idf = [f"(CASE WHEN ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) END)" for i in range(len(terms))]
    part = " + ".join(f"{idf[i]} * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(terms)))
    hit = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""{MEM}, tf AS (SELECT *, (greatest(length(content) - 2, 0) + greatest(length(wing) - 2, 0) + greatest(length(room) - 2, 0))::DOUBLE AS dl, {f} FROM memories),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {n} FROM tf),
bm AS (SELECT id, content, round({part}, 6) AS bm25 FROM tf, st WHERE ({hit}) AND {where}),
bmk AS (SELECT id, content, bm25, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS rank FROM bm {tail})"""


SEM_SQL = """sem AS (SELECT e.vec_id AS id, round(greatest(0.0::DOUBLE, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
semk AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM sem ORDER BY score DESC, id LIMIT 20)"""
TMP_SQL = f"""tmp AS (SELECT id, round(exp(-0.1::DOUBLE * greatest(0.0::DOUBLE, ({NOW} - created_at) / 86400.0::DOUBLE)), 6) AS score FROM memories WHERE created_at BETWEEN {START} AND {END} AND contains(lower(content), 'there')),
tmpk AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM tmp ORDER BY score DESC, id LIMIT 20)"""
BM20 = _bm25_sql(TERMS, "ORDER BY bm25 DESC, id LIMIT 20")
CH_SQL = f"{BM20}, {SEM_SQL}, {TMP_SQL}, ch AS (SELECT 'bm25' AS channel, id, rank FROM bmk UNION ALL SELECT 'semantic', id, rank FROM semk UNION ALL SELECT 'temporal', id, rank FROM tmpk)"
W_SQL = "CASE channel WHEN 'semantic' THEN 1.0::DOUBLE WHEN 'bm25' THEN 1.0 WHEN 'graph' THEN 0.8 WHEN 'temporal' THEN 0.6 ELSE 1.0 END"
FUSE_SQL = f"""{CH_SQL}, fu AS (SELECT id, round(sum(({W_SQL}) / (30 + rank + 1)), 12) AS raw, string_agg(DISTINCT channel, ',' ORDER BY channel) AS sources, count(DISTINCT channel) AS n_sources FROM ch GROUP BY id),
fuk AS (SELECT *, row_number() OVER (ORDER BY raw DESC, id) - 1 AS rank FROM fu ORDER BY raw DESC, id LIMIT 20),
hy AS (SELECT id, round(raw / max(raw) OVER (), 6) AS score, sources, n_sources, rank FROM fuk)"""


def _query_vector(s, d):
    return table(s, d, "embeddings").filter("vec_id = 0")


_INDEXES: dict[tuple, TextIndex | VectorIndex] = {}


def _index(s, d, name, kind, write):
    """A stored index over a table of d: written at the first query over these files, read by all that follow."""
    key = (s.sparkContext.applicationId, d, name, Folder(s, f"{d}/{name}.parquet").state())
    if key not in _INDEXES:
        index = kind(s, shared_folder(s, f"index-{name}"))
        write(index)
        _INDEXES[key] = index
    return _INDEXES[key]


def text_index(s, d):
    return _index(s, d, "documents", TextIndex, lambda i: i.append(memories(s, d)))


def vector_index(s, d):
    return _index(s, d, "embeddings", VectorIndex, lambda i: i.build(table(s, d, "embeddings")))


def channels(s, d):
    m = memories(s, d)
    bm = text_index(s, d).search(TERMS).select(F.lit("bm25").alias("channel"), "id", "rank")
    sem = search.search_semantic(table(s, d, "embeddings"), _query_vector(s, d), 20).select(F.lit("semantic").alias("channel"), F.col("vec_id").alias("id"), "rank")
    tmp = search.search_temporal(m, NOW, START, END, ["there"]).select(F.lit("temporal").alias("channel"), "id", "rank")
    return bm.unionByName(sem).unionByName(tmp)


def hybrid(s, d):
    return fusion.rrf_fuse(channels(s, d))


def hybrid_with_text(s, d):
    return hybrid(s, d).join(memories(s, d).select("id", F.col("content").alias("text")), "id")


@query("search_bm25", f"WITH {BM20} SELECT id, rank, bm25, round(1 / (1 + bm25), 6) AS score_compat FROM bmk")
def _(s, d):
    return text_index(s, d).search(TERMS).select("id", "rank", "bm25", "score_compat")


@query("search_bm25_clamp", f"WITH {_bm25_sql(['tion'], '')} SELECT id, bm25 FROM bmk")
def _(s, d):
    return text_index(s, d).search(["tion"], None).select("id", "bm25")


_F = "wing = 'en' AND room = 'src1'"


@query("search_bm25_filtered", f"WITH {_bm25_sql(['thtion'], 'ORDER BY bm25 DESC, id LIMIT 20', _F)} SELECT id, rank, bm25 FROM bmk")
def _(s, d):
    return text_index(s, d).search(["thtion"], 20, (F.col("wing") == "en") & (F.col("room") == "src1")).select("id", "rank", "bm25")


@query("search_fts_plain", f"WITH {_bm25_sql(['license', 'there'], 'ORDER BY bm25 DESC, id LIMIT 20')} SELECT id, rank, bm25 FROM bmk")
def _(s, d):
    return text_index(s, d).search("license there".split()).select("id", "rank", "bm25")


@query("search_temporal", f"WITH {MEM}, {TMP_SQL} SELECT id, rank, score FROM tmpk")
def _(s, d):
    return search.search_temporal(memories(s, d), NOW, START, END, ["there"]).select("id", "rank", "score")


@query("search_semantic", f"WITH {SEM_SQL} SELECT id AS vec_id, rank, score FROM semk")
def _(s, d):
    return search.search_semantic(table(s, d, "embeddings"), _query_vector(s, d), 20).select("vec_id", "rank", "score")


@query("search_semantic_filtered", "WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT e.vec_id, round(greatest(0.0::DOUBLE, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score FROM embeddings e, q WHERE e.label = 2) SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM s ORDER BY score DESC, vec_id LIMIT 10")
def _(s, d):
    return search.search_semantic(table(s, d, "embeddings"), _query_vector(s, d), 10, F.col("label") == 2).select("vec_id", "rank", "score")


@query("search_by_embedding", "WITH q AS (SELECT list_transform(range(64), lambda i: (i % 5)::DOUBLE) AS v), s AS (SELECT e.vec_id, round(greatest(0.0::DOUBLE, list_cosine_similarity(e.embedding::DOUBLE[], q.v)), 6) AS score FROM embeddings e, q) SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM s ORDER BY score DESC, vec_id LIMIT 10")
def _(s, d):
    q = s.range(1).select(F.array(*[F.lit(float(i % 5)) for i in range(64)]).alias("embedding"))
    return search.search_semantic(table(s, d, "embeddings"), q, 10).select("vec_id", "rank", "score")


KNN_SQL = "s AS (SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0.0::DOUBLE, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0), knn AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM s QUALIFY rank < 10)"


def knn_run(s, d):
    """The stated query set: vectors whose id is divisible by 50, against all."""
    v = table(s, d, "embeddings")
    return search.knn(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


@query("knn_all", f"WITH {KNN_SQL} SELECT query_id, vec_id, score, rank FROM knn")
def _(s, d):
    return knn_run(s, d).select("query_id", "vec_id", "score", "rank")


@query("ann_lsh", None)
def _(s, d):
    """Approximate neighbours by bucketed random projection, in place of a graph index."""
    v = table(s, d, "embeddings")
    return search.ann_knn(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


@query("ann_index", None)
def _(s, d):
    """The ten nearest of the stated query set through the stored index, which looks into as many lists as it has measured."""
    v = table(s, d, "embeddings")
    return vector_index(s, d).search(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


@query("embed_text", "SELECT doc_id AS id, 64::BIGINT AS n, CASE WHEN regexp_matches(text, '[^ \t\n\r]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents")
def _(s, d):
    """The length of each embedding and its norm: 1, or 0 for a text without words."""
    v = memories(s, d).select("id", hash_embedding(F.col("content")).alias("v"))
    return v.select("id", F.size("v").cast("long").alias("n"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


@query("embed_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (3 * x::DOUBLE) * (3 * x::DOUBLE)))) / sqrt(list_sum(list_transform(embedding, lambda x: (3 * x::DOUBLE) * (3 * x::DOUBLE)))), 6) AS norm FROM embeddings")
def _(s, d):
    v = l2_normalize(F.transform("embedding", lambda x: x * 3))
    return table(s, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


QT = [(0, "NATION_1 and NATION_2"), (1, "goods of Supplier#000000003 to NATION_10"), (2, "nothing here")]


@query("graph_entity_match", f"""WITH q AS (SELECT * FROM {_values(QT, 'q(query_id, text)')}), n AS (SELECT n_name AS name FROM nation UNION SELECT s_name FROM supplier),
h AS (SELECT query_id, name, length(name) AS n, instr(lower(text), lower(name)) AS pos FROM q, n WHERE contains(lower(text), lower(name))),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY n DESC, name) AS r FROM h), c AS (SELECT *, max(pos + n) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM b WHERE r = 1)
SELECT query_id, name, pos FROM c WHERE e IS NULL OR pos >= e""")
def _(s, d):
    names = table(s, d, "nation").select(F.col("n_name").alias("name")).union(table(s, d, "supplier").select("s_name")).distinct()
    return search.graph_entity_match(s.createDataFrame(QT, "query_id int, text string"), names)


GRAPH_SQL = f"""{PLACE}, {SIM}, seeds AS (SELECT n_name AS seed FROM nation WHERE n_name IN ('NATION_1', 'NATION_2')), {EXPAND},
gs AS (SELECT node, type, round(score * CASE type WHEN 'causal' THEN 0.9::DOUBLE WHEN 'semantic_knn' THEN 0.7 ELSE 0.5 END, 6) AS s FROM ex QUALIFY row_number() OVER (PARTITION BY node ORDER BY s DESC, type DESC) = 1),
gr AS (SELECT concat('graph_', node) AS id, node, s AS score, type AS exp_type, row_number() OVER (ORDER BY s DESC, concat('graph_', node)) - 1 AS rank FROM gs ORDER BY s DESC, id LIMIT 20)"""


def graph_channel(s, d):
    """Entities of the query, expanded, scored by the weight of the kind of step; ids are graph_<name>."""
    rel = place_relations(s, d)
    q = s.createDataFrame(QT[:1], "query_id int, text string")
    seeds = search.graph_entity_match(q, table(s, d, "nation").select(F.col("n_name").alias("name"))).select(F.col("name").alias("seed"))
    out = graph.graph_expand(rel, seeds)
    w = F.lit(0.5)
    for k, v in graph.TYPE_WEIGHT.items():
        w = F.when(F.col("type") == k, v).otherwise(w)
    best = out.withColumn("s", F.round(F.col("score") * w, 6)).groupBy("node").agg(F.max(F.struct("s", "type")).alias("b"))
    return search.ranked(best.select(F.concat(F.lit("graph_"), "node").alias("id"), "node", F.col("b.s").alias("score"), F.col("b.type").alias("exp_type")), 20, F.desc("score"), F.asc("id"))


@query("search_graph", f"WITH {GRAPH_SQL} SELECT id, score, exp_type, rank FROM gr")
def _(s, d):
    return graph_channel(s, d).select("id", "score", "exp_type", "rank")


def four_channels(s, d):
    """Semantic, BM25, graph and temporal rows with their texts and metadata; ids as text."""
    m = memories(s, d)
    kept = F.create_map(F.lit("wing"), "wing", F.lit("room"), "room")
    each = channels(s, d)
    # few rows look up their texts; an outer join with all texts would shuffle these
    text = m.select("id", F.col("content").alias("text"), kept.alias("metadata")).join(F.broadcast(each.select("id").distinct()), "id")
    rows = each.join(text, "id", "left").select("channel", F.col("id").cast("string").alias("id"), "rank", F.coalesce("text", F.lit("")).alias("text"), "metadata")
    g = graph_channel(s, d).select(F.lit("graph").alias("channel"), "id", "rank", F.col("node").alias("text"), F.create_map(F.lit("exp_type"), "exp_type").alias("metadata"))
    return rows.unionByName(g)


TEMPR_SQL = f"""{CH_SQL}, {GRAPH_SQL}, c4 AS (SELECT channel, id::VARCHAR AS id, rank FROM ch UNION ALL SELECT 'graph', id, rank FROM gr),
f4 AS (SELECT id, round(sum(({W_SQL}) / (30 + rank + 1)), 12) AS raw, string_agg(DISTINCT channel, ',' ORDER BY channel) AS sources FROM c4 GROUP BY id),
k4 AS (SELECT *, row_number() OVER (ORDER BY raw DESC, id) - 1 AS rank FROM f4 ORDER BY raw DESC, id LIMIT 20)"""


@query("hybrid_search_graph", f"WITH {TEMPR_SQL} SELECT k4.id, round(raw / max(raw) OVER (), 6) AS score, sources, k4.rank, coalesce(m.content, gr.node, '') AS text, coalesce(m.wing, '') AS wing, coalesce(gr.exp_type, '') AS exp_type FROM k4 LEFT JOIN memories m ON m.id::VARCHAR = k4.id LEFT JOIN gr ON gr.id = k4.id")
def _(s, d):
    """All four channels fused, with text and metadata."""
    out = fusion.rrf_fuse_text(four_channels(s, d))
    named = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit("")).alias(k)
    return out.select("id", "score", "sources", "rank", "text", named("wing"), named("exp_type"))


@query("graph_context_text", """WITH e AS (SELECT n_name AS entity, 'part_of' AS predicate, r_name AS other FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'located_in', s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY predicate, other) AS k FROM e)
SELECT entity AS name, concat('实体: ', entity, ' (类型: location)', chr(10), string_agg(concat(predicate, ' ', other), chr(10) ORDER BY predicate, other) FILTER (k <= 3), chr(10), string_agg(other, ', ' ORDER BY other) FILTER (k <= 5)) AS text FROM r GROUP BY entity""")
def _(s, d):
    rel = place_relations(s, d).filter("predicate <> 'cause'")
    n = table(s, d, "nation").select(F.col("n_name").alias("entity"))
    e = graph.undirected(rel).join(F.broadcast(n), "entity")
    from pyspark.sql import Window

    r = e.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy("predicate", "other"))).filter("k <= 5")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= 3, F.struct("predicate", "other")))), lambda x: F.concat(x["predicate"], F.lit(" "), x["other"])), "\n")
    near = F.array_join(F.sort_array(F.collect_list("other")), ", ")
    return r.groupBy(F.col("entity").alias("name")).agg(lines.alias("l"), near.alias("m")).select("name", F.concat(F.lit("实体: "), "name", F.lit(" (类型: location)\n"), "l", F.lit("\n"), "m").alias("text"))


FUZZY = ["smal widgt", "rde ring", "boltt", "gear"]
_TRI = "list_distinct(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)))"
FUZZY_SQL = f"""WITH q AS (SELECT col0 AS query FROM (VALUES {', '.join(f"('{f}')" for f in FUZZY)})), t AS (SELECT DISTINCT p_name AS tag FROM part),
a AS (SELECT query, {_TRI.replace('x', "concat('  ', lower(trim(query)), ' ')")} AS ga FROM q), b AS (SELECT tag, {_TRI.replace('x', "concat('  ', lower(trim(tag)), ' ')")} AS gb FROM t),
p AS (SELECT query, tag, round(CASE WHEN lower(trim(query)) = lower(trim(tag)) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) END, 6) AS sim FROM a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, tag) - 1 AS rank FROM p WHERE sim >= 0.3)"""


def _fuzzy(s, d):
    return s.createDataFrame([(f,) for f in FUZZY], "query string"), table(s, d, "part").select(F.col("p_name").alias("tag")).distinct()


@query("fuzzy_search_tags", FUZZY_SQL.replace("lower(trim(tag))", "lower(trim(tag))") + " SELECT query, tag, sim, rank FROM r WHERE rank < 5")
def _(s, d):
    return search.fuzzy_search_tags(*_fuzzy(s, d)).select("query", "tag", "sim", "rank")


@query("fuzzy_match_tag", FUZZY_SQL + " SELECT query, tag, sim FROM r WHERE rank = 0 AND (sim > 0.3 OR lower(trim(query)) = lower(trim(tag)))")
def _(s, d):
    return search.fuzzy_match_tag(*_fuzzy(s, d))


@query("fuzzy_similarity", FUZZY_SQL + " SELECT query, tag, sim FROM p")
def _(s, d):
    q, t = _fuzzy(s, d)
    return t.join(F.broadcast(q)).select("query", "tag", F.round(trigram_similarity(F.col("query"), F.col("tag")), 6).alias("sim"))


@query("rrf_fuse", f"WITH {FUSE_SQL} SELECT id, score, sources, n_sources, rank FROM hy")
def _(s, d):
    return hybrid(s, d)


@query("hybrid_search", f"WITH {FUSE_SQL} SELECT id, score, sources, n_sources, rank, length(content) AS n_chars FROM hy JOIN memories USING (id)")
def _(s, d):
    return hybrid_with_text(s, d).select("id", "score", "sources", "n_sources", "rank", F.length("text").cast("long").alias("n_chars"))


@query("rrf_weights_override", f"WITH {CH_SQL}, fu AS (SELECT id, round(sum((CASE channel WHEN 'bm25' THEN 2.0::DOUBLE WHEN 'semantic' THEN 0.5 ELSE 1.0 END) / (30 + rank + 1)), 12) AS raw FROM ch GROUP BY id), k AS (SELECT *, row_number() OVER (ORDER BY raw DESC, id) - 1 AS rank FROM fu ORDER BY raw DESC, id LIMIT 20) SELECT id, round(raw / max(raw) OVER (), 6) AS score, rank FROM k")
def _(s, d):
    w = s.createDataFrame([("bm25", 2.0), ("semantic", 0.5)], "channel string, w double")
    return fusion.rrf_fuse(channels(s, d), 20, w).select("id", "score", "rank")


@query("interleave_fuse", f"WITH {CH_SQL}, z AS (SELECT channel, count(*) AS size FROM ch GROUP BY 1), f AS (SELECT id, channel, rank, row_number() OVER (PARTITION BY id ORDER BY rank, channel) AS k FROM ch) SELECT id, round(1 - rank::DOUBLE / size, 6) AS score, channel AS source, row_number() OVER (ORDER BY rank, channel, id) - 1 AS rank FROM f JOIN z USING (channel) WHERE k = 1 ORDER BY f.rank, channel, id LIMIT 20")
def _(s, d):
    return fusion.interleave_fuse(channels(s, d)).select("id", "score", "source", "rank")


@query("recency_decay", f"WITH {FUSE_SQL} SELECT id, round(score * pow(0.5::DOUBLE, greatest(0.0::DOUBLE, ({NOW} - created_at) / 86400.0::DOUBLE) / 90), 6) AS score FROM hy JOIN memories USING (id)")
def _(s, d):
    h = hybrid(s, d).join(memories(s, d).select("id", "created_at"), "id")
    return h.select("id", F.round(fusion.recency_decay(F.col("score"), (F.lit(NOW) - F.col("created_at")) / 86400.0), 6).alias("score"))


_QV = _values(list(enumerate(TEXTS)), "q(query_id, text)")
_TP = r"(?i)last[ \t\n]+week|yesterday|tomorrow|today|ago|recent"
_QP = "(?i)why|how|what|when|where|who|can you|is it|are there"
CLASS_SQL = f"""q AS (SELECT query_id, text, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS u, regexp_matches(text, '{_QP}') AS qu, regexp_matches(text, '[A-Z][a-z]+[ \\t\\n]+[A-Z][a-z]+') AS en FROM {_QV}),
cl AS (SELECT query_id, text, CASE WHEN trim(text) = '' THEN 'semantic' WHEN regexp_matches(text, '{_TP}') THEN 'temporal' WHEN u BETWEEN 9 AND 15 AND NOT qu AND en THEN 'entity' WHEN u <= 15 AND NOT qu THEN 'keyword' WHEN u <= 8 AND en THEN 'entity' ELSE 'semantic' END AS class FROM q)"""
AW_SQL = f"""{CLASS_SQL}, aw AS (SELECT query_id, class, round(CASE class WHEN 'semantic' THEN 1.3 WHEN 'keyword' THEN 0.7 ELSE 1.0 END::DOUBLE, 6) AS w_semantic, round(CASE class WHEN 'keyword' THEN 1.5 WHEN 'semantic' THEN 0.8 ELSE 1.0 END::DOUBLE, 6) AS w_bm25,
round(CASE class WHEN 'temporal' THEN 0.56 WHEN 'entity' THEN 1.2 ELSE 0.8 END::DOUBLE, 6) AS w_graph, round(CASE class WHEN 'temporal' THEN 0.96 WHEN 'entity' THEN 0.42 ELSE 0.6 END::DOUBLE, 6) AS w_temporal FROM cl)"""


def _classified(s):
    return s.createDataFrame(list(enumerate(TEXTS)), "query_id int, text string").select("query_id", fusion.query_classify(F.col("text")).alias("class"))


@query("hybrid_adaptive", f"WITH {CH_SQL}, {AW_SQL}, f AS (SELECT query_id, id, round(sum((CASE channel WHEN 'semantic' THEN w_semantic WHEN 'bm25' THEN w_bm25 ELSE w_temporal END) / (30 + rank + 1)), 12) AS raw FROM ch, aw GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) - 1 AS rank FROM f QUALIFY rank < 10) SELECT query_id, id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM k")
def _(s, d):
    cl = _classified(s)
    w = cl.select("query_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.round(fusion.adaptive_weight(F.col("class"), c), 6).alias("w")) for c in ("semantic", "bm25", "temporal")])).alias("x")).select("query_id", "x.channel", "x.w")
    every = channels(s, d).join(F.broadcast(w.select("query_id").distinct()))  # ten stated queries
    return fusion.rrf_fuse(every, 10, w, by=["query_id"]).select("query_id", "id", "score")


@query("search_details", f"WITH {FUSE_SQL}, x AS (SELECT unnest(string_split(sources, ',')) AS source FROM hy) SELECT source, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM hy), 1) AS percent FROM x GROUP BY 1")
def _(s, d):
    return fusion.search_details(hybrid(s, d))


RERANK_SQL = f"""{FUSE_SQL}, c AS (SELECT id, content AS text, score AS rrf_score, n_sources, list_filter(regexp_split_to_array(lower(content), '[ \\t\\n\\r]+'), lambda w: w <> '') AS tok FROM hy JOIN memories USING (id)),
t AS (SELECT unnest(['license', 'there']) AS term), n AS (SELECT count(*)::DOUBLE AS n, avg(len(tok)::DOUBLE) AS a FROM c), rtf AS (SELECT id, len(tok)::DOUBLE AS nt, term, len(list_filter(tok, lambda w: w = term)) AS tf FROM c, t),
idf AS (SELECT term, ln((n + 1) / (count(*) FILTER (tf > 0) + 1)) + 1 AS idf FROM rtf, n GROUP BY term, n), tot AS (SELECT sum(idf) AS total FROM idf),
sat AS (SELECT id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * nt / a))) AS sat FROM rtf JOIN idf USING (term), n WHERE tf > 0 GROUP BY id),
rr AS (SELECT id, text, round(0.45::DOUBLE * coalesce(sat, 0) / total + 0.15::DOUBLE * least(1.0::DOUBLE, n_sources / 4.0::DOUBLE) + 0.25::DOUBLE * rrf_score + 0.15::DOUBLE * (CASE WHEN length(text) < 20 THEN 0.3::DOUBLE WHEN length(text) > 2000 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score, rrf_score FROM c LEFT JOIN sat USING (id), tot),
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM rr ORDER BY score DESC, id LIMIT 10)"""


def _reranked(s, d):
    c = hybrid_with_text(s, d).select("id", "text", F.col("score").alias("rrf_score"), "n_sources")
    return fusion.rerank_heuristic(c, "license there")


@query("rerank_heuristic", f"WITH {RERANK_SQL} SELECT id, score, rrf_score, rank FROM rk")
def _(s, d):
    return _reranked(s, d).select("id", "score", "rrf_score", "rank")


@query("rerank_topk_fill", f"WITH {RERANK_SQL}, top AS (SELECT id, 0 AS tail, rank FROM rk WHERE rank < 5), rest AS (SELECT id, 1 AS tail, rank FROM hy WHERE id NOT IN (SELECT id FROM top)), u AS (SELECT * FROM top UNION ALL SELECT * FROM rest) SELECT id, tail, row_number() OVER (ORDER BY tail, rank, id) - 1 AS pos FROM u ORDER BY tail, rank, id LIMIT 12")
def _(s, d):
    top = _reranked(s, d).filter("rank < 5").select("id", F.lit(0).alias("tail"), F.col("rank").alias("r"))
    rest = hybrid(s, d).join(top.select("id"), "id", "left_anti").select("id", F.lit(1).alias("tail"), F.col("rank").alias("r"))
    return search.ranked(top.union(rest), 12, F.asc("tail"), F.asc("r"), F.asc("id")).select("id", "tail", F.col("rank").alias("pos"))


@query("rerank_llm", f"WITH {FUSE_SQL}, r AS (SELECT id, content AS text, score AS rrf, CASE WHEN length(substr(content, 1, 1000)) % 4 = 0 THEN score ELSE round((length(substr(content, 1, 1000)) % 100) / 100.0::DOUBLE, 6) END AS score FROM hy JOIN memories USING (id)) SELECT id, score, rrf AS rrf_score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM r ORDER BY score DESC, id LIMIT 10")
def _(s, d):
    """A model's scores, and the fused score where it gives none; this one knows the length of a text."""

    def model(prompt: str, form: dict) -> str | None:
        n = len(prompt) - len("query: license there\ntext: ")
        return None if n % 4 == 0 else f'{{"score": {round(n % 100 / 100, 6)}}}'

    c = hybrid_with_text(s, d).select("id", "text", F.col("score").alias("rrf_score"), "n_sources")
    return plugins.rerank_by(plugins.llm_reranker(model), c, "license there").select("id", "score", "rrf_score", "rank")


@query("rerank_cross_encoder", f"WITH {FUSE_SQL}, r AS (SELECT id, score AS rrf_score, round(1 / (1 + exp(-((CASE WHEN contains(substr(content, 1, 512), 'license') THEN 1 ELSE 0 END) + (CASE WHEN contains(substr(content, 1, 512), 'there') THEN 1 ELSE 0 END) - 1.0::DOUBLE))), 6) AS score FROM hy JOIN memories USING (id)) SELECT id, score, rrf_score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM r ORDER BY score DESC, id LIMIT 10")
def _(s, d):
    """A pair model plugged in: its logit is the number of query words in the text, less one."""
    logits = lambda query, texts: [sum(w in t for w in query.split()) - 1.0 for t in texts]
    c = hybrid_with_text(s, d).select("id", "text", F.col("score").alias("rrf_score"), "n_sources")
    return plugins.rerank_by(plugins.cross_encoder(logits), c, "license there").select("id", "score", "rrf_score", "rank")


def _budget_sql(budget: int) -> str:
    return f"""WITH {FUSE_SQL}, r AS (SELECT id, rank, content AS text, sum(length(content)) OVER (ORDER BY rank) AS used, row_number() OVER (ORDER BY rank) AS k FROM hy JOIN memories USING (id))
SELECT id, rank, length(text)::BIGINT AS n_chars, (CASE WHEN used <= {budget} THEN length(text) ELSE {budget} + 3 END)::BIGINT AS kept FROM r WHERE used <= {budget} OR k = 1"""


def _budget(s, d, n):
    h = hybrid_with_text(s, d).select("id", "text", "rank")
    cut = fusion.budget_trim(h, n).select("id", "rank", F.length("text").cast("long").alias("kept"))
    return cut.join(h.select("id", F.length("text").cast("long").alias("n_chars")), "id").select("id", "rank", "n_chars", "kept")


@query("budget_trim", _budget_sql(4000))
def _(s, d):
    return _budget(s, d, 4000)


@query("budget_trim_overflow", _budget_sql(10))
def _(s, d):
    return _budget(s, d, 10)


_LINE = "concat('[', (rank + 1)::VARCHAR, '] (', sources, ') ', CASE WHEN length(content) > 400 THEN concat(substr(content, 1, 400), '...') ELSE content END)"


@query("context_items", f"WITH {FUSE_SQL}, l AS (SELECT id, rank, {_LINE} AS line FROM hy JOIN memories USING (id) WHERE rank < 5), u AS (SELECT *, coalesce(sum(length(line)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM l) SELECT id, rank, line FROM u WHERE used < 2000")
def _(s, d):
    return fusion.context_items(hybrid_with_text(s, d))


@query("provider_format_items", f"WITH {FUSE_SQL}, l AS (SELECT id, rank, concat('[', printf('%.2f', score), '] ', content) AS line FROM hy JOIN memories USING (id)), u AS (SELECT *, 2000 - coalesce(sum(length(line)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM l) SELECT id, rank, substr(line, 1, l::BIGINT) AS line FROM u WHERE l > 0")
def _(s, d):
    return fusion.provider_format_items(hybrid_with_text(s, d))


@query("pql_find", f"WITH {_bm25_sql(['license'], 'ORDER BY bm25 DESC, id LIMIT 5')} SELECT id, rank, bm25 FROM bmk")
def _(s, d):
    from .pql import run

    return run(memories(s, d), "FIND license top_k=5")
